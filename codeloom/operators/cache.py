"""Key-value caches as Parquet tables.

A table has a key, a version and values; the highest version of a key holds.
Upserts append; ``compact`` rewrites the latest rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import SharedFolder

INFERENCE_VALUES = ("response", "inference_ok", "wall_ms")
EXECUTION_VALUES = ("output", "exit_ok", "wall_ms")
#: Value columns of the three caches.
INFERENCE_CACHE = "response string, inference_ok boolean, wall_ms long"
EXECUTION_CACHE = "output string, exit_ok boolean, wall_ms long"
RESPONSE_CACHE = "response string"


def latest(rows: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The last written row of each key; of rows of one version the one of the largest values.

    One aggregation with map-side partial results, so a hot key costs a row for
    each task.
    """
    rest = [c for c in rows.columns if c not in (key, version)]
    best = rows.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("__best"))
    return best.select(key, "__best.*").select(*rows.columns)


def split_hits(work: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, misses)."""
    return work.join(cache, key), work.join(cache.select(key), key, "left_anti")


@dataclass
class ParquetCache:
    """A cache in a folder that all executors share.

    The file CURRENT names the folder of rows that holds; one job writes to a
    cache at a time.
    """

    spark: SparkSession
    path: str
    schema: str

    def _folder(self) -> str:
        return SharedFolder(self.spark, self.path).read("CURRENT") or "rows"

    def rows(self) -> DataFrame:
        full = f"key string, version long, {self.schema}"
        folder = self._folder()
        if not SharedFolder(self.spark, self.path).exists(folder):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.path.rstrip('/')}/{folder}")

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """The rows that hold; with ``wanted`` (key), those of its keys alone, which are picked before anything is aggregated."""
        rows = self.rows()
        if wanted is not None:
            rows = rows.join(wanted.select("key").distinct(), "key", "left_semi")
        return latest(rows).drop("version")

    def upsert(self, rows: DataFrame, version: int) -> None:
        """Append ``rows`` (key and values) under ``version``; later versions win."""
        names = [f.strip().split(" ")[0] for f in _split(self.schema)]
        rows.select("key", F.lit(version).cast("long").alias("version"), *names).write.mode("append").parquet(f"{self.path.rstrip('/')}/{self._folder()}")

    def compact(self) -> None:
        """Write the latest rows to a new folder and point to it in one step.

        A crash leaves the old or the new folder in force, never neither. The
        folder before stays until the next call, for jobs that still read it.
        """
        shared = SharedFolder(self.spark, self.path)
        old, fresh = self._folder(), f"rows-{uuid.uuid4().hex}"
        latest(self.rows()).write.parquet(f"{shared.path}/{fresh}")
        shared.write("CURRENT", fresh)
        for name in shared.glob("rows*"):
            if name not in (old, fresh):
                shared.delete(name)


def _split(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(schema[start:k])
            start = k + 1
    return [*out, schema[start:]]


def through_cache(work: DataFrame, cached: DataFrame | Callable[[DataFrame], DataFrame] | None, do, values: tuple[str, ...], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(work with ``values`` and cache_hit, fresh rows): each distinct key that the cache lacks is done once.

    ``do`` maps rows, one for each key, to rows with ``values``. ``cached`` may
    be a reader that is told which keys are wanted.
    """
    once = work.dropDuplicates([key])
    if callable(cached):
        cached = cached(once)
    if cached is None:
        fresh = do(once).select(key, *values)
        return work.join(fresh.withColumn("cache_hit", F.lit(False)), key), fresh
    hits = split_hits(once.select(key), cached)[0]
    misses = split_hits(once, cached)[1]
    fresh = do(misses).select(key, *values)
    known = fresh.withColumn("cache_hit", F.lit(False)).unionByName(hits.select(key, *values, F.lit(True).alias("cache_hit")))
    return work.join(known, key), fresh


@dataclass
class Stores:
    """The caches of a run, any of them absent, and the version under which it writes."""

    inference: ParquetCache | None = None
    execution: ParquetCache | None = None
    response: ParquetCache | None = None
    version: int = 1

    @classmethod
    def under(cls, spark: SparkSession, path: str, version: int) -> "Stores":
        """All three caches in one shared folder."""
        return cls(*(ParquetCache(spark, f"{path}/{n}", s) for n, s in (("inference", INFERENCE_CACHE), ("execution", EXECUTION_CACHE), ("response", RESPONSE_CACHE))), version)

    def known(self, store: ParquetCache | None, use: bool) -> Callable[[DataFrame], DataFrame] | None:
        """The reader of a cache's rows by key, if there is a cache and it is to be read."""
        return store.read if store is not None and use else None

    def keep(self, store: ParquetCache | None, rows: DataFrame) -> None:
        """Write rows, one for each key; caches are written whether or not they are read."""
        if store is not None:
            store.upsert(rows.dropDuplicates(["key"]), self.version)
