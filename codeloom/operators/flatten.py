"""Nested responses, and the flat table of edge occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import status_colour
from codeloom.schemas import EDGE, PATH, REQUEST, TIMEOUT_MARK
from codeloom.schemas import conform

FLAT = ("seed_language", "request_target_language", "request_id", "input_languages", "target_languages", "level", "edge_id", "parent_edge_id", "status", "memoized", "failed_timeout", "extracted_code", "inference_output")


def edge_response(edges: DataFrame) -> Column:
    """An evaluated edge in the nested form; a root's parent is -1, times are milliseconds."""
    given = {
        "translation_id": F.concat_ws("-", "request_id", F.col("edge_id").cast("string")),
        "success": F.col("status").isin("SUCCESS", "TRANSLATION_FOUND"),
        "execution_output": F.lit(""),
        "inference_output": F.col("inference_output"),
        "parent_edge_id": F.coalesce("parent_edge_id", F.lit(-1)),
        "wallTimeInference": F.col("wall_inference_ms"),
        "wallTimeTestExecution": F.col("wall_test_ms"),
        "usedMemoization": F.col("memoized"),
        "usedInferenceCache": F.col("used_inference_cache"),
    }
    names = [x.split(":")[0] for x in _fields(EDGE)]
    return F.struct(*[given.get(n, F.col(n)).alias(n) for n in names]).cast(EDGE)


def _fields(struct: str) -> list[str]:
    """Top-level fields of a struct's type text."""
    body, out, depth, start = struct[len("struct<") : -1], [], 0, 0
    for k, c in enumerate(body):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(body[start:k])
            start = k + 1
    return [*out, body[start:]]


def nest(requests: DataFrame, edges: DataFrame, path_edges: DataFrame) -> DataFrame:
    """(translation_request, paths) of every request; a request without paths keeps an empty list. Sort by id where responses are handed out.

    A request's edges and steps are collected, both bounded by its planned
    tree; paths are put together within the row, so wide edges are dealt once,
    however many paths they stand on.
    """
    plain = edges.withColumn("memoized", F.lit(False))
    made = plain.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("edge_id", edge_response(plain).alias("edge")))).alias("made"))
    steps = path_edges.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("path_rank", "edge_pos", "edge_id", "memoized"))).alias("steps"))
    whole = conform(requests, REQUEST)
    own = whole.withColumn("request_id", F.col("id"))
    joined = own.join(steps.join(made, "request_id"), "request_id", "left")
    held = F.filter("steps", lambda s: F.array_contains(F.map_keys("made"), s["edge_id"]))
    ranks = F.array_distinct(F.transform(held, lambda s: s["path_rank"]))

    def path(rank: Column) -> Column:
        own_steps = F.filter(held, lambda s: s["path_rank"] == rank)
        edge = lambda s: F.try_element_at("made", s["edge_id"]).withField("usedMemoization", s["memoized"])
        return F.struct(F.transform(own_steps, edge).alias("translation_edges"), F.transform(own_steps, lambda s: s["memoized"]).alias("edge_index_memoized"))

    nested = F.coalesce(F.transform(ranks, path), F.array()).cast(f"array<{PATH}>")
    return joined.select(F.struct(*whole.columns).alias("translation_request"), nested.alias("paths"))


def flatten(responses: DataFrame) -> DataFrame:
    """One row for each request, path and edge occurrence, with path_rank, edge_pos and the tests' array.

    memoized is the flag of the edge's own position; memoized_compat looks the
    position up among the flags as numbers, as some old tables have it. Tests
    are fuzzy ones, else unit ones.
    """
    request = F.col("translation_request")
    # One array of all edge occurrences, so that one explode does for paths and edges.
    steps = F.flatten(F.transform("paths", lambda p, i: F.transform(p["translation_edges"], lambda e, j: F.struct(i.alias("path_pos"), j.alias("edge_pos"), p["edge_index_memoized"].alias("flags"), e.alias("e")))))
    about = [request["seed_language"].alias("seed_language"), request["target_language"].alias("request_target_language"), request["id"].alias("request_id")]
    rows = responses.select(F.struct(*about).alias("about"), steps.alias("steps")).select("about", F.explode("steps").alias("s"))
    rows = rows.select("about.*", "s.*")
    fuzzy = F.transform("e.fuzzy_tests", lambda t: F.struct(t["stdin_input"].alias("input"), t["actual_output"].alias("actual_output")))
    unit = F.transform("e.unit_tests", lambda t: F.struct(t["source_code"].alias("input"), t["actual_output"].alias("actual_output")))
    tests = F.when(F.size("e.fuzzy_tests") > 0, fuzzy).otherwise(F.coalesce(unit, F.expr("cast(array() as array<struct<input:string,actual_output:string>>)")))
    rows = rows.withColumn("tests", tests)
    timeout = F.exists("tests", lambda t: F.coalesce(t["actual_output"].contains(TIMEOUT_MARK), F.lit(False)))
    compat = F.when(F.col("edge_pos") == 0, F.array_contains("flags", False)).when(F.col("edge_pos") == 1, F.array_contains("flags", True)).otherwise(False)
    return rows.select(
        "seed_language",
        "request_target_language",
        "request_id",
        F.col("e.input_language").alias("input_languages"),
        F.col("e.target_language").alias("target_languages"),
        F.col("e.level").alias("level"),
        F.col("e.edge_id").alias("edge_id"),
        F.coalesce("e.parent_edge_id", F.lit(-1)).alias("parent_edge_id"),
        F.col("e.status").alias("status"),
        F.coalesce(F.get("flags", "edge_pos"), F.lit(False)).alias("memoized"),
        timeout.alias("failed_timeout"),
        F.col("e.extracted_source_code").alias("extracted_code"),
        F.col("e.inference_output").alias("inference_output"),
        (F.col("path_pos") + 1).alias("path_rank"),
        "edge_pos",
        compat.alias("memoized_compat"),
        "tests",
    )


def tests_long(flat: DataFrame) -> DataFrame:
    """One row for each edge occurrence and test."""
    rows = flat.select("request_id", "path_rank", "edge_pos", "edge_id", F.posexplode("tests").alias("test_idx", "t"))
    return rows.select("request_id", "path_rank", "edge_pos", "edge_id", "test_idx", F.col("t.input").alias("input"), F.col("t.actual_output").alias("actual_output"))


def tests_wide(flat: DataFrame, width: int | None = None) -> DataFrame:
    """``flat`` with columns test_{i}_input and test_{i}_actual_output in place of tests; null beyond an edge's own tests.

    Without ``width`` the widest edge decides, which costs a pass.
    """
    if width is None:
        width = flat.agg(F.max(F.size("tests"))).first()[0] or 0
    cells = [F.get("tests", F.lit(i))[part].alias(f"test_{i}_{part}") for i in range(width) for part in ("input", "actual_output")]
    return flat.select(*[c for c in flat.columns if c != "tests"], *cells)


def flat_edges(requests: DataFrame, edges: DataFrame, path_edges: DataFrame) -> DataFrame:
    """The flat table straight from evaluated edges, without nesting in between."""
    about = requests.select(F.col("id").alias("request_id"), "seed_language", F.col("target_language").alias("request_target_language"))
    rows = path_edges.join(edges, ["request_id", "edge_id"]).join(about, "request_id")
    marked = F.exists("fuzzy_tests", lambda t: t["actual_output"].contains(TIMEOUT_MARK)) | F.exists("unit_tests", lambda t: t["actual_output"].contains(TIMEOUT_MARK))
    return rows.select(
        "seed_language", "request_target_language", "request_id", F.col("input_language").alias("input_languages"), F.col("target_language").alias("target_languages"), "level", "edge_id", "parent_edge_id", "status", "memoized", marked.alias("failed_timeout"), F.col("extracted_source_code").alias("extracted_code"), "inference_output", "path_rank", "edge_pos"
    )


def tree_edges(flat: DataFrame) -> DataFrame:
    """(request_id, parent_edge_id, edge_id, status, colour) of each distinct edge, for plots; -1 is the root."""
    return flat.select("request_id", "parent_edge_id", "edge_id", "status").distinct().withColumn("colour", status_colour(F.col("status")))


def tree_nodes(flat: DataFrame) -> DataFrame:
    """(request_id, edge_id, label, status, colour): a node for each edge, labelled with its language, and one for the root."""
    nodes = flat.select("request_id", "edge_id", F.col("target_languages").alias("label"), "status").distinct()
    roots = flat.select("request_id", F.lit(-1).alias("edge_id"), F.col("seed_language").alias("label"), F.lit("ROOT").alias("status")).distinct()
    return nodes.unionByName(roots).withColumn("colour", status_colour(F.col("status")))
