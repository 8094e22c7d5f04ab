"""What the operators share: joins beyond the broadcast bound, written tables, and the shared folder."""

import pytest
from pyspark.sql import functions as F

from codeloom.llm import common, decontaminate, secret_scan, simhash
from codeloom.runtime import SharedFolder

KIND = "doc_id long, text string"


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_joins_are_joins(spark, monkeypatch, how):
    left = spark.createDataFrame([(k, k % 3 if k % 7 else None) for k in range(60)], "id long, key long")
    right = spark.createDataFrame([(0, "a"), (2, "b"), (9, "c")], "key long, v string")
    want = sorted(map(str, left.join(right, ["key"], how).collect()))
    monkeypatch.setattr(common, "SENT_ROWS", 0)
    got = common.meet(left, right, ["key"], 3, "id", how)
    assert sorted(map(str, got.collect())) == want and got.columns == left.join(right, ["key"], how).columns


def test_operators_beyond_the_bound(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*words[:i], f"e{i}", *words[i:], "token=abcdefghijklmnop"])) for i in range(20)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (200, "quite another text of its own"), (None, "x"), (3, None)]
    docs = spark.createDataFrame(rows, KIND)
    read = lambda df: sorted(map(str, df.collect()))

    def results():
        return [read(simhash.drop_near_duplicates(docs)), read(simhash.simhash_components(docs)), read(secret_scan.scan_documents(docs)), read(secret_scan.mask_secrets(docs))]

    want = results()
    for module in (common, simhash, secret_scan):
        monkeypatch.setattr(module, "SENT_ROWS", 0)
    assert results() == want


def test_written_tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda s: str(tmp_path))
    df = spark.range(10).withColumn("n", F.monotonically_increasing_id())
    kept = common.checkpointed(df, 10)
    assert kept.dtypes == df.dtypes and kept.count() == 10 and len(list((tmp_path / "tables").iterdir())) == 1
    assert common.checkpointed(df.limit(0)).count() == 0
    common.discard_tables(spark)
    assert not (tmp_path / "tables").exists()


def test_shared_folder(spark, tmp_path):
    folder = SharedFolder(spark, str(tmp_path / "f"))
    assert folder.read("x") is None and folder.glob("*") == []
    folder.write("x", "é1")
    folder.write("x", "é2")
    folder.write("d/y", "z")
    assert folder.read("x") == "é2" and folder.glob("d/*") == ["d/y"]
    folder.move("d", "e")
    assert folder.exists("e/y") and not folder.exists("d")


def test_blocks_of_a_benchmark_cover_it(spark):
    items = spark.createDataFrame([(k, f"item {k} has words of its own {k}") for k in range(30)], "item_id long, text string")
    blocks = list(decontaminate._blocks(items, "item_id", "text", 1))
    assert [len(b) for b in blocks] == [1] * 30


def test_a_scope_collects_the_drivers_garbage(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    with common.tidy(spark) as keep:
        kept = keep(common.checkpointed(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()).groupBy("count").agg(F.sum("k").alias("k")))
    assert whole() > before
    assert sorted(map(tuple, kept.collect())) == [(14, 20), (15, 1)]
