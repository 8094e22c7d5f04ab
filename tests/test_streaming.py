import json

import pytest

from codeloom.operators.cache import ParquetCache
from codeloom.streaming import jobs


@pytest.fixture
def stream(spark, tmp_path):
    """(put, run, ids): write request files, run the job on one output folder, list the ids of all answers."""
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")

    def put(name, ids):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": i, "seed_code": f"c{i}"}) for i in ids))

    def run(checkpoint, answer=lambda b: b.select("id"), **options):
        jobs.run_stream(jobs.request_stream(spark, str(tmp_path / "in")), answer, out, str(tmp_path / checkpoint), **options).awaitTermination()

    def ids():
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    return put, run, ids


def test_a_lost_checkpoint_keeps_all_answers(stream):
    put, run, ids = stream
    put("a.json", ["1", "2"])
    run("cp1")
    assert ids() == ["1", "2"]
    put("b.json", ["2", "3"])
    run("cp2")  # batch 0 again, with both files
    assert ids() == ["1", "2", "3"]
    run("cp3")  # nothing is new
    assert ids() == ["1", "2", "3"]


def test_a_retried_batch_keeps_its_answers(stream, tmp_path):
    put, run, ids = stream
    put("a.json", ["1", "2"])
    run("cp")
    # The answers stand, but the batch was never recorded as done.
    for f in (tmp_path / "cp" / "commits").iterdir():
        f.unlink()
    run("cp")
    assert ids() == ["1", "2"]
    put("b.json", ["3"])
    run("cp")
    assert ids() == ["1", "2", "3"]


def test_a_crash_inside_a_batch(stream, tmp_path):
    put, run, ids = stream
    put("a.json", ["1", "2"])
    run("cp")
    put("b.json", ["3", "4"])

    def fails(rows):
        if rows.where("id = '4'").count():
            raise ValueError("gone")
        return rows.select("id")

    with pytest.raises(Exception, match="gone"):
        run("cp", fails, in_flight=1)
    assert ids() == ["1", "2"]  # no half of a batch is seen
    run("cp")
    assert ids() == ["1", "2", "3", "4"]


def test_requests_in_flight(stream):
    put, run, ids = stream
    seen = []
    put("a.json", [*map(str, range(10)), "3"])
    run("cp", lambda b: seen.append(b.count()) or b.select("id"), in_flight=4)
    assert seen == [4, 4, 2] and ids() == [str(i) for i in range(10)]
    seen.clear()
    put("b.json", ["10", "11"])
    run("cp", lambda b: seen.append(b.count()) or b.select("id"), in_flight=1)
    assert seen == [1, 1] and len(ids()) == 12


def test_compaction(spark, tmp_path):
    cache = ParquetCache(spark, str(tmp_path / "c"), "v string")
    rows = lambda *kv: spark.createDataFrame(list(kv), "key string, v string")
    held = lambda: sorted(map(tuple, cache.read().collect()))
    assert held() == []
    cache.upsert(rows(("a", "1"), ("b", "1")), 1)
    cache.upsert(rows(("a", "2")), 2)
    for _ in range(2):
        cache.compact()
        assert held() == [("a", "2"), ("b", "1")] and cache.rows().count() == 2
    cache.upsert(rows(("c", "1")), 3)
    assert [tuple(r) for r in cache.read(rows(("c", ""), ("x", ""))).collect()] == [("c", "1")]
    # A crash before the pointer moves leaves what was there.
    spark.createDataFrame([], "key string, version long, v string").write.parquet(str(tmp_path / "c" / "rows-half"))
    assert len(held()) == 3
    assert len([p for p in (tmp_path / "c").iterdir() if p.name.startswith("rows")]) <= 3


def test_event_windows_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = "(timestamp'2024-01-01 00:00:01', 'view', 1.0D, 7), (timestamp'2024-01-01 00:00:40', 'view', 2.0D, 7), (timestamp'2024-01-02 00:00:00', 'click', 3.0D, 8)"
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(ts, event_type, value, user_id)")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = jobs.event_windows(stream, "30 seconds").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == 3
    assert jobs.event_sessions(df, "1 minute").count() == 2
