"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import SharedFolder

#: Rows and bytes of one Arrow batch that goes to a Python worker; bounds the worker's memory.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20

#: Characters A-Z and a-z, for lower-casing that leaves every other character alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


#: Rows of one file of a small table.
FILE_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names, which all executors share.

    A temporary one is set only where a local session names none (tests).
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codeloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written once to a table in the shared folder and read from there; its lineage ends there.

    A table has the size that it has: the sizes that the planner guesses for a
    chain of joins over checkpoints are products, numbers whose length doubles
    with every round and which fill the driver's memory. ``rows`` bounds how
    many rows ``df`` can have: a table that is cheap to finish and small for
    its partitions is written in fewer files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables written in each open scope, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A scope at whose end the tables written in it are deleted; it gives ``keep``, which writes a table that stays.

    The driver's garbage is collected then, so that its heap does not grow by
    what the plans and events of scope after scope leave.
    """
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame, rows: int | None = None) -> DataFrame:
        out = checkpointed(df, rows)
        kept.append(made.pop())
        return out

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        if _SCOPES:
            _SCOPES[-1].extend(kept)
        for path in made:
            SharedFolder(spark, path).delete("")
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def discard_tables(spark: SparkSession) -> None:
    """Delete the tables that this session has written on the way; results that still read them are lost."""
    SharedFolder(spark, shared_folder(spark)).delete("tables")


_SHIPPED: set[str] = set()


def _ship(df: DataFrame) -> None:
    """Send the package to the Python workers, once for each application, so that they need no copy installed."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp(prefix="codeloom-")) / f"{top.name}.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(str(file))
    _SHIPPED.add(sc.applicationId)


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded size."""
    _ship(df)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


#: Rows of a table that is sent to every executor at most; larger ones meet their partner by a shuffle.
SENT_ROWS = 200_000
#: Copies of the other side over which the rows of one key are spread in such a shuffle.
SALTS = 16


def meet(left: DataFrame, right: DataFrame, on: list[str], rows: int, spread: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has each key once and ``rows`` rows.

    A small ``right`` is broadcast. A larger one is copied ``SALTS`` times and
    the rows of ``left`` are dealt to the copies by ``spread``, so that no key
    meets in one task however many rows have it.
    """
    if rows <= SENT_ROWS:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"], how).drop("__salt")


def connected_components(edges: DataFrame, rows: int, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long; at most ``rows`` of them); component: its smallest node.

    Alternating large-star and small-star rounds; each round's edges are
    written, none reach the driver. A node that stands alone in a self
    loop is its own component.

    A hub with many neighbours meets in one aggregation group only as a
    running minimum. The minima are written before they are joined to the
    edges, so that both sides of the join are dealt anew and a hub's edges can
    be split over tasks.
    """
    with tidy(edges.sparkSession) as keep:
        def star(pairs: DataFrame, small: bool, size: int) -> DataFrame:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            if small:
                both = both.where("b < a")
            least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), 2 * size)
            linked = both.join(least, "a")
            if small:
                out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
            else:
                out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            return out.where("a <> b").distinct()

        current = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), rows)
        sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        before = sums(current)
        for _ in range(max_rounds):
            if not before[0]:
                break
            current = checkpointed(star(checkpointed(star(current, False, before[0]), 2 * before[0]), True, 2 * before[0]), 2 * before[0])
            now = sums(current)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("connected components did not settle")
        nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        return keep(nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component")), 2 * rows)
