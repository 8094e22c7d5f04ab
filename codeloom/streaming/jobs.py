"""Structured Streaming front ends of the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import response_key
from codeloom.runtime import SharedFolder
from codeloom.schemas import REQUEST, conform

#: Requests in flight at most.
IN_FLIGHT = 250
_KEYS = "_keys"


def request_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Requests from JSON files as they arrive."""
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return conform(stream, REQUEST)


def answered(spark: SparkSession, output: str, but: str | None = None) -> DataFrame:
    """(key) of the requests whose answers stand in ``output``, those of the batch folder ``but`` left out."""
    folder = SharedFolder(spark, output)
    kept = [f for f in folder.glob(f"run=*/batch=*/{_KEYS}") if f != f"{but}/{_KEYS}"]
    if not kept:
        return spark.createDataFrame([], "key string")
    return spark.read.schema("key string").parquet(*[f"{folder.path}/{f}" for f in kept])


def in_parts(keyed: DataFrame, most: int) -> Iterator[DataFrame]:
    """``keyed`` (with distinct keys) in parts of at most ``most`` rows; only the first key of each part reaches the driver."""
    ranked = keyed.select("key", F.row_number().over(Window.orderBy("key")).alias("n"))
    first = [r["key"] for r in ranked.where(F.col("n") % most == (1 if most > 1 else 0)).orderBy("n").collect()]
    for low, high in zip_longest(first, first[1:]):
        yield keyed.where(F.col("key") >= low if high is None else (F.col("key") >= low) & (F.col("key") < high))


def run_stream(requests: DataFrame, run_batch: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, depth: int = 3, early_stop: str = "direct", in_flight: int = IN_FLIGHT):
    """A query that answers each request once and keeps all answers in ``output``.

    Answers of a micro-batch go to ``output``/run=R/batch=N, R drawn once for
    each checkpoint. A batch is written aside together with the keys of its
    requests and then moved into place in one step, so that a folder holds both
    or neither. Requests whose keys stand in another folder are left out: a job
    that lost its checkpoint goes on without repeating work or overwriting
    answers, and a batch that is retried replaces its own folder alone. Equal
    requests of one batch are answered once. ``run_batch`` takes at most
    ``in_flight`` requests at a time. One job writes to a folder at a time.
    """
    spark = requests.sparkSession
    own = SharedFolder(spark, checkpoint)
    run = own.read("codeloom-run")
    if run is None:
        run = uuid.uuid4().hex
        own.write("codeloom-run", run)
    folder = SharedFolder(spark, output)

    def batch(rows: DataFrame, number: int) -> None:
        place, aside = f"run={run}/batch={number}", f"_aside/{run}-{number}"
        keyed = rows.withColumn("key", response_key({c: F.col(c) for c in rows.columns}, depth, early_stop)).dropDuplicates(["key"])
        keyed = keyed.join(answered(rows.sparkSession, output, but=place), "key", "left_anti").persist()
        try:
            folder.delete(aside)
            parts = 0
            for part in in_parts(keyed, in_flight):
                run_batch(part.drop("key")).write.mode("append").parquet(f"{output}/{aside}")
                parts += 1
            if parts:
                keyed.select("key").write.parquet(f"{output}/{aside}/{_KEYS}")
                folder.move(aside, place)
            else:
                folder.delete(place)
        finally:
            keyed.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums of events in tumbling or sliding windows; events later than ``late`` are left out of a stream."""
    at = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = events.withWatermark(ts, late).groupBy(at.alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n", "total")


def event_sessions(events: DataFrame, gap: str, late: str = "10 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Sessions of each user: events closer than ``gap`` belong together."""
    counts = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), user, "n")
