"""Planning of translation paths.

A request's tree has its seed language at the root; each edge translates into
one of the request's languages other than the edge's own source, down to a
depth, and a branch ends where it reaches the target language. The tree grows
inside each row by exploding the request's languages, so planning needs one
shuffle by request, for numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grow_edges(requests: DataFrame, depth: int) -> DataFrame:
    """Every edge of every request's tree, unnumbered.

    (request_id, level, input_language, target_language, final_target, ord_path,
    languages, reaches): ord_path has the positions in used_languages from the root to
    the edge, languages the language names from the seed on, reaches says
    whether a complete path goes through the edge. A language that
    stands twice in used_languages gives two branches; a request whose target
    is not among its languages gets edges that reach nothing.
    """
    base = requests.select(F.col("id").alias("request_id"), F.col("target_language").alias("final_target"), "used_languages", F.array("seed_language").alias("languages"), F.expr("cast(array() as array<int>)").alias("ord_path"))
    levels, frontier = [], base
    for level in range(1, depth + 1):
        here = F.element_at("languages", -1)
        open_rows = frontier if level == 1 else frontier.where(here != F.col("final_target"))
        grown = open_rows.select("*", F.posexplode("used_languages").alias("pos", "next")).where(F.col("next") != here)
        grown = grown.select("request_id", "final_target", "used_languages", F.concat("languages", F.array("next")).alias("languages"), F.concat("ord_path", F.array("pos")).alias("ord_path"))
        # Below the last level every open branch can still step to the target, if the request lists it.
        reaches = (F.col("final_target") == F.element_at("languages", -1)) | F.array_contains("used_languages", F.col("final_target")) if level < depth else F.col("final_target") == F.element_at("languages", -1)
        levels.append(grown.withColumn("level", F.lit(level)).withColumn("reaches", reaches))
        frontier = grown
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("request_id", "level", F.element_at("languages", -2).alias("input_language"), F.element_at("languages", -1).alias("target_language"), "final_target", "ord_path", "languages", "reaches")


#: Depth that planning takes.
MOST_LEVELS = 8


def number_edges(edges: DataFrame, depth: int = MOST_LEVELS) -> DataFrame:
    """Edges with edge_id, 1, 2, ... in depth-first order over all that were created, and parent_edge_id, -1 at a root.

    Arrays order a prefix first, so ordering by ord_path is depth-first order,
    and the nearest earlier edge of the level above is the parent.
    """
    own = Window.partitionBy("request_id").orderBy("ord_path")
    numbered = edges.withColumn("edge_id", F.row_number().over(own))
    above = {level: F.last(F.when(F.col("level") == level, F.col("edge_id")), ignorenulls=True).over(own) for level in range(1, depth)}
    parent = F.lit(-1)
    for level, last in above.items():
        parent = F.when(F.col("level") == level + 1, last).otherwise(parent)
    return numbered.withColumn("parent_edge_id", parent)


def plan_edges(requests: DataFrame, depth: int) -> DataFrame:
    """All numbered edges; depth is bounded by ``MOST_LEVELS``."""
    if not 1 <= depth <= MOST_LEVELS:
        raise ValueError(f"depth from 1 to {MOST_LEVELS}")
    return number_edges(grow_edges(requests, depth), depth)


def plan_paths(edges: DataFrame) -> DataFrame:
    """(request_id, path_rank, path_len, edge_id, ord_path, languages) of each complete path, named by its last edge.

    Short paths come first; of equally long ones that with the larger ord_path.
    """
    rank = Window.partitionBy("request_id").orderBy("path_len", F.col("ord_path").desc())
    complete = edges.where("target_language = final_target").withColumn("path_len", F.size("ord_path"))
    return complete.withColumn("path_rank", F.row_number().over(rank)).select("request_id", "path_rank", "path_len", "edge_id", "ord_path", "languages")


def plan_path_edges(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(request_id, path_rank, edge_pos, edge_id, memoized): the edges of each path in order.

    memoized: an earlier path of the request holds the edge as well.
    """
    paths = plan_paths(edges) if paths is None else paths
    steps = paths.select("request_id", "path_rank", F.explode(F.sequence(F.lit(1), "path_len")).alias("n"), "ord_path")
    steps = steps.select("request_id", "path_rank", (F.col("n") - 1).alias("edge_pos"), F.slice("ord_path", F.lit(1), F.col("n")).alias("ord_path"))
    joined = steps.join(edges.select("request_id", "ord_path", "edge_id"), ["request_id", "ord_path"])
    seen = Window.partitionBy("request_id", "edge_id").orderBy("path_rank")
    return joined.withColumn("memoized", F.row_number().over(seen) > 1).select("request_id", "path_rank", "edge_pos", "edge_id", "memoized")


def path_display(paths: DataFrame) -> DataFrame:
    """(request_id, path_rank, path): each path as one line."""
    n = F.size("languages")
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.element_at("languages", i), F.lit(" -> "), F.element_at("languages", i + 1)))
    return paths.select("request_id", "path_rank", F.concat(F.array_join(steps, " >> "), F.lit(" -| ")).alias("path"))


def plan_totals(paths: DataFrame) -> DataFrame:
    """(request_id, n_paths) of requests that have any."""
    return paths.groupBy("request_id").agg(F.count("*").alias("n_paths"))


def level_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("level").agg(F.count("*").alias("n_edges"))


SQL_TREE = """
WITH RECURSIVE tree AS (
  SELECT id AS request_id, target_language AS final_target, used_languages, 0 AS level, '' AS input_language,
         seed_language AS language, cast(array() AS array<int>) AS ord_path FROM {requests}
  UNION ALL
  SELECT request_id, final_target, used_languages, level + 1, language, u.col, concat(ord_path, array(u.pos))
  FROM tree, LATERAL posexplode(used_languages) AS u(pos, col)
  WHERE u.col <> language AND level < {depth} AND (level = 0 OR language <> final_target)
)
SELECT request_id, level, input_language, language AS target_language, final_target, ord_path FROM tree WHERE level > 0
LIMIT ALL
"""


def grow_edges_sql(requests: DataFrame, depth: int, view: str = "codeloom_requests") -> DataFrame:
    """``grow_edges`` as one recursive query, without the languages along the path.

    LIMIT ALL lifts the bound of ``spark.sql.cteRecursionRowLimit`` on all rows
    together; the depth bounds the recursion.
    """
    requests.createOrReplaceTempView(view)
    return requests.sparkSession.sql(SQL_TREE.format(requests=view, depth=int(depth)))
