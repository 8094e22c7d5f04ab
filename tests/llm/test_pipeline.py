import importlib
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import registry, simhash

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    ids = {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= ids
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            ids = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == ids
    run = corpus_pipeline.run(spark, SMALL)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_stages_take_odd_tables(spark):
    rows = [(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (7, "w " * 30000, "en", "s", 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(("score", "blob", "node", "key", "gap", "n_words", "sequence_id", "spans"))})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        assert out.count() > 0 and stage(spark, docs.limit(0), SMALL).count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert out.where("doc_id is null").count() == 1, name


def test_secrets_of_the_pipeline_are_masked(spark):
    rows = [(1, "token=abcdefghijklmnop here", "en", "s", 27), (2, "nothing", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.secrets(spark, docs, SMALL).collect()}
    assert got == {1: ("[secret] here", 13), 2: ("nothing", 7)}


def test_queries_are_registered():
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {n for n in names if n.startswith("op")} == set(registry.QUERIES) and len(registry.QUERIES) == 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_verdicts_are_not_capped():
    assert simhash.likeness(simhash.np.array([1, 2]), simhash.np.array([1, 2])) == 1.0
