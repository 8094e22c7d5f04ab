"""Quality metrics over the flat table of edge occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.schemas import FOUND, TIMEOUT_MARK

MOST_ATTEMPTS = 10


def first_rows(flat: DataFrame, k: int) -> DataFrame:
    """The first k rows of each request, by path and place in the path."""
    order = Window.partitionBy("request_id").orderBy("path_rank", "edge_pos")
    return flat.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def _percent(part: Column, whole: Column) -> Column:
    """null for no requests at all."""
    return F.when(whole > 0, part / whole * 100)


def by_request(flat: DataFrame) -> DataFrame:
    """Per request whether it has a status, a found translation, and a found direct one; two-phase, so a hot request is a row for each task."""
    found = F.col("status") == FOUND
    return flat.groupBy("request_id").agg(
        F.bool_or(F.col("status") != "").alias("counted"),
        F.bool_or(found).alias("found"),
        F.bool_or(found & (F.col("parent_edge_id") == -1)).alias("found_direct"),
    )


def ca_at_k(flat: DataFrame, k: int) -> DataFrame:
    """(k, requests, found, ca_at_k): the share of requests with a translation among their first k rows, in percent."""
    if not 1 <= k <= MOST_ATTEMPTS:
        raise ValueError(f"k from 1 to {MOST_ATTEMPTS}")
    per = by_request(first_rows(flat, k))
    counts = per.agg(F.count_if("counted").alias("requests"), F.count_if("found").alias("found"))
    return counts.select(F.lit(k).cast("long").alias("k"), "requests", "found", _percent(F.col("found"), F.col("requests")).alias("ca_at_k"))


def ca_stats(flat: DataFrame) -> DataFrame:
    """(requests, ca_direct, ca_intermediates, difference), in percent."""
    counts = by_request(flat).agg(F.count_if("counted").alias("requests"), F.count_if("found_direct").alias("d"), F.count_if("found").alias("i"))
    direct, both = _percent(F.col("d"), F.col("requests")), _percent(F.col("i"), F.col("requests"))
    return counts.select("requests", direct.alias("ca_direct"), both.alias("ca_intermediates"), (both - direct).alias("difference"))


def stats_text(flat: DataFrame) -> DataFrame:
    """The stats as lines of text (position, line)."""
    s = ca_stats(flat)
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.format_number(c, 2), F.lit("%"))
    lines = F.array(line("Computational Accuracy - Only direct (baseline)", "ca_direct"), line("Computational Accuracy - Including intermediate langs", "ca_intermediates"), line("Difference from baseline", "difference"))
    return s.select(F.posexplode(lines).alias("position", "line"))


def ca_cube(flat: DataFrame) -> DataFrame:
    """Accuracy by source and target language, and over all of either."""
    per = flat.groupBy("request_id", "seed_language", "request_target_language").agg(F.bool_or(F.col("status") != "").alias("counted"), F.bool_or(F.col("status") == FOUND).alias("found"))
    counts = per.cube("seed_language", "request_target_language").agg(F.count_if("counted").alias("requests"), F.count_if("found").alias("found"))
    return counts.withColumn("ca", _percent(F.col("found"), F.col("requests")))


def timeout_percent(tests: DataFrame) -> DataFrame:
    """(tests, timeouts, timeout_pct) over tests that have an output."""
    marked = F.count_if(F.col("actual_output").contains(TIMEOUT_MARK)).alias("timeouts")
    counts = tests.agg(F.count("actual_output").alias("tests"), marked)
    return counts.withColumn("timeout_pct", _percent(F.col("timeouts"), F.col("tests")))


def first_translation(flat: DataFrame) -> DataFrame:
    """(request_id, code) of the first found edge; null for requests that have none."""
    order = F.struct("path_rank", "edge_pos")
    return flat.groupBy("request_id").agg(F.min_by("extracted_code", F.when(F.col("status") == FOUND, order)).alias("code"))


def found_requests(requests: DataFrame, flat: DataFrame) -> DataFrame:
    return requests.join(flat.where(F.col("status") == FOUND).select(F.col("request_id").alias("id")).distinct(), "id", "left_semi")


def throughput(events: DataFrame, ts: str = "ts", kind: str = "kind", size: str = "30 seconds", slow: str = "execution", fast: str = "inference") -> DataFrame:
    """Counts of two kinds of work in tumbling windows, and how far one lags behind, in percent of the larger."""
    at = F.window(ts, size)
    counts = events.groupBy(at.alias("w")).agg(F.count_if(F.col(kind) == fast).alias("n_fast"), F.count_if(F.col(kind) == slow).alias("n_slow"))
    more = F.greatest("n_fast", "n_slow")
    lag = F.when(more > 0, (more - F.least("n_fast", "n_slow")) * 100 / more)
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_fast", "n_slow", lag.alias("lag_pct"))
