"""Evaluation of edges: prompts, inference, extraction, tests, statuses.

Trees are evaluated level by level. A level's rows are independent of each
other, so each runs fully in parallel; the direct translations come before
everything else, because a found one makes all other edges needless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.config import ConfigError, EngineConfig
from codeloom.functions.chat import request_body
from codeloom.functions.text import extract_code, inference_key, lookup, render_prompt
from codeloom.operators.cache import EXECUTION_VALUES, INFERENCE_VALUES, Stores, through_cache
from codeloom.operators.testing import EDGE_KEY, checked_suites, execute, fold_tests, fuzzy_runs, tested_in_row, tested_status, unit_runs, with_programs, with_verdicts
from codeloom.plans.planner import plan_edges, plan_path_edges
from codeloom.runtime import checkpointed, settled
from codeloom.schemas import DEAD, FOUND, FUZZY_RESULT, NO_EXTRACTED, NO_INFERENCE, PARENT_FAILED, SKIPPED_FOUND, TRANSLATED, UNIT_RESULT

REQUEST_PARTS = ("seed_code", "test_suite", "prompt_template_name", "regex_template_name", "model_name", "target_signatures", "extra_prompt_data")
TREE = ("request_id", "edge_id", "parent_edge_id", "level", "input_language", "target_language", "final_target")
RESULT = (*TREE, "prompt_template", "prompt", "source_code", "inference_output", "extracted_source_code", "status", "fuzzy_tests", "unit_tests", "wall_inference_ms", "wall_test_ms", "used_inference_cache")


def signature_of(signatures: Column, language: Column) -> Column:
    """The first signature for a language, in the order in which they are listed; empty without one."""
    return F.coalesce(F.get(F.filter(signatures, lambda s: s["language"] == language), F.lit(0))["signature"], F.lit(""))


def with_prompts(edges: DataFrame, config: EngineConfig, extra: bool = False) -> DataFrame:
    """Edges with prompt_template and prompt. Extra prompt data is used by independent attempts alone."""
    template = lookup(config.prompt_templates, F.col("prompt_template_name"), "prompt template")
    more = F.col("extra_prompt_data") if extra else F.lit("")
    edges = edges.withColumn("prompt_template", template)
    prompt = render_prompt(F.col("prompt_template"), F.col("source_code"), F.col("input_language"), F.col("target_language"), more, signature_of(F.col("target_signatures"), F.col("target_language")), config.transcoder_format)
    return edges.withColumn("prompt", prompt)


def infer(edges: DataFrame, provider, config: EngineConfig, cached=None) -> DataFrame:
    """Edges with response, inference_ok, wall_ms, cache_hit and call_key (null for providers that do not answer by key)."""
    calls = edges.withColumn("model", F.col("model_name"))
    if not provider.keyed:
        return provider.infer(calls).withColumns({"cache_hit": F.lit(False), "call_key": F.lit(None).cast("string")})
    keyed = calls.withColumn("body", request_body(F.col("model"), F.col("prompt"), config))
    keyed = keyed.withColumn("key", inference_key(F.col("model"), F.col("prompt"), config.max_tokens, config.temperature, config.top_p, config.top_k, config.seed))
    if "attempt" in edges.columns:  # attempts are independent calls
        keyed = keyed.withColumn("key", F.concat_ws(":", "key", "request_id", F.col("attempt").cast("string")))
    slim = keyed.select("key", "model", "prompt", "body")
    answers, _ = through_cache(slim, cached, provider.infer, INFERENCE_VALUES)
    answers = answers.select("key", *INFERENCE_VALUES, "cache_hit").dropDuplicates(["key"])
    return keyed.drop("body").join(answers, "key").withColumnRenamed("key", "call_key")


def extract(edges: DataFrame, config: EngineConfig) -> DataFrame:
    """Edges with extracted (whether there was code) and code."""
    text = F.col("response") if config.regex_inference_only else F.concat("prompt", "response")
    name = F.col("regex_template_name")
    missing = F.raise_error(F.concat(F.lit("no regex template "), name))
    if not config.regex_templates:
        raise ConfigError("no regex templates")
    ok = code = None
    for k, pattern in config.regex_templates.items():
        this_ok, this_code = extract_code(text, pattern)
        ok = F.when(name == k, this_ok) if ok is None else ok.when(name == k, this_ok)
        code = F.when(name == k, this_code) if code is None else code.when(name == k, this_code)
    return edges.withColumn("extracted", ok.otherwise(missing.cast("boolean"))).withColumn("code", code.otherwise(missing.cast("string")))


def in_row(inference, execution, config: EngineConfig) -> bool:
    """Whether edges can be evaluated row by row: both providers are expressions, and no program is rewritten by Python."""
    return not inference.keyed and not execution.keyed and getattr(execution, "in_row", False) and not config.transcoder_format


def _early(config: EngineConfig) -> Column:
    """The status of an edge that is not tested."""
    return (
        F.when(~F.col("inference_ok"), NO_INFERENCE)
        .when(~F.col("extracted"), NO_EXTRACTED)
        .when(F.lit(not config.verify_intermediates) & (F.col("target_language") != F.col("final_target")), TRANSLATED)
    )


def attempt(edges: DataFrame, inference, execution, config: EngineConfig, stores: Stores | None = None, extra: bool = False, unit_by_language: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Live edges carried through all steps to a status, with the columns ``carry`` beside.

    ``edges`` has the tree's columns, source_code and the request's parts.
    Tests run only where the final target is reached, unless intermediate
    translations are verified as well. ``stores`` answer what they know and
    keep what is new. Expressions are evaluated within the row.
    """
    stores = stores or Stores()
    expressions = in_row(inference, execution, config)
    prompted = with_prompts(edges, config, extra)
    answered = infer(prompted, inference, config, stores.known(stores.inference, config.use_inference_cache))
    if expressions:
        answered = settled(answered, response=F.col("response"), inference_ok=F.col("inference_ok"))
    got = extract(answered, config).withColumnRenamed("wall_ms", "wall_inference_ms")
    found = {"extracted": F.col("extracted"), "code": F.when(F.col("inference_ok"), F.col("code")).otherwise("")}
    got = (settled(got, **found) if expressions else got.withColumns(found)).withColumn("early", _early(config))
    at_target = F.col("target_language") == F.col("final_target")
    live = F.col("early").isNull()
    if expressions:
        out = tested_in_row(got, execution, live, unit_by_language)
    else:
        # Providers without a key answer once, as those with one do: what they said is tested and joined back.
        got = checkpointed(got)
        if inference.keyed:
            fresh = got.where(~F.col("cache_hit")).select(F.col("call_key").alias("key"), "response", "inference_ok", F.col("wall_inference_ms").alias("wall_ms"))
            stores.keep(stores.inference, fresh if config.cache_failures else fresh.where("inference_ok"))
        tested = test_edges(got.where(live), execution, config, stores, unit_by_language)
        out = got.join(tested, list(EDGE_KEY), "left")
    status = F.coalesce("early", tested_status(F.col("all_passed"), F.col("first_event"), at_target))
    none = lambda name, kind: F.coalesce(name, F.expr(f"cast(array() as array<{kind}>)")).alias(name)
    return out.select(
        *carry,
        *TREE,
        "prompt_template",
        "prompt",
        "source_code",
        F.col("response").alias("inference_output"),
        F.col("code").alias("extracted_source_code"),
        status.alias("status"),
        none("fuzzy_tests", FUZZY_RESULT),
        none("unit_tests", UNIT_RESULT),
        "wall_inference_ms",
        F.coalesce("wall_test_ms", F.lit(0)).cast("long").alias("wall_test_ms"),
        F.col("cache_hit").alias("used_inference_cache"),
    )


def test_edges(edges: DataFrame, execution, config: EngineConfig, stores: Stores | None = None, unit_by_language: bool = True) -> DataFrame:
    """Edges (with code and test_suite) folded over their tests."""
    runs = fuzzy_runs(edges).unionByName(unit_runs(edges, unit_by_language))
    stores = stores or Stores()
    done = execute(with_programs(runs, config, go=execution.keyed), execution, stores.known(stores.execution, config.use_execution_cache))
    if execution.keyed:
        done = checkpointed(done)
        stores.keep(stores.execution, done.where(~F.col("cache_hit")).select("key", *EXECUTION_VALUES))
    return fold_tests(with_verdicts(done, config.transcoder_format))


def _blank() -> dict[str, Column]:
    """Results of an edge that was never tried."""
    text = {n: F.lit("") for n in ("prompt_template", "prompt", "source_code", "inference_output", "extracted_source_code")}
    empty = {"fuzzy_tests": F.expr(f"cast(array() as array<{FUZZY_RESULT}>)"), "unit_tests": F.expr(f"cast(array() as array<{UNIT_RESULT}>)")}
    return {**text, **empty, "wall_inference_ms": F.lit(0).cast("long"), "wall_test_ms": F.lit(0).cast("long"), "used_inference_cache": F.lit(False)}


def _skipped(edges: DataFrame, status: Column | str) -> DataFrame:
    """Edges that were never tried, with a status and empty results."""
    s = F.lit(status) if isinstance(status, str) else status
    return edges.withColumns({"status": s, **_blank()}).select(*RESULT)


def _tree_in_row(requests: DataFrame, edges: DataFrame, inference, execution, config: EngineConfig) -> DataFrame:
    """``evaluate_tree`` for expressions: a request's planned edges travel in its row, and each level explodes the children of the last.

    Texts are dealt and written once, with the request; a level is a chain of
    projections, so columns that nobody asks for are never made.
    """
    slim = F.struct("edge_id", "parent_edge_id", "level", "input_language", "target_language", "final_target")
    listed = edges.groupBy("request_id").agg(F.collect_list(slim).alias("edges"))
    parts = requests.select(F.col("id").alias("request_id"), *REQUEST_PARTS)
    base = checkpointed(parts.join(listed, "request_id"))
    kept = ("request_id", *REQUEST_PARTS, "edges")
    carry = tuple(c for c in kept if c != "request_id")

    def grown(rows: DataFrame, which, *more: Column) -> DataFrame:
        """A row for each edge of ``which``, with its source."""
        return rows.select(*kept, *more, F.explode(F.filter("edges", which)).alias("e")).select(*kept, "source_code", "blocked", "e.*")

    def tried(rows: DataFrame) -> DataFrame:
        done = attempt(rows, inference, execution, config, carry=(*carry, "blocked"))
        done = settled(done, status=F.coalesce("blocked", "status"))
        blank = _blank()
        return done.select(*carry, *[F.when(F.col("blocked").isNotNull(), blank[c]).otherwise(F.col(c)).alias(c) if c in blank else F.col(c) for c in RESULT])

    no_block = F.lit(None).cast("string").alias("blocked")
    seed = F.col("seed_code").alias("source_code")
    is_direct = lambda e: (e["level"] == 1) & (e["target_language"] == e["final_target"])
    results: list[DataFrame] = []
    if config.early_stop == "direct":
        direct = mask_after_found(tried(grown(base, is_direct, seed, no_block)), "edge_id", descending=True)
        results.append(direct.select(*RESULT))
        found = checkpointed(direct.where(F.col("status") == FOUND).select("request_id").distinct())
        others = edges.where("not (level = 1 and target_language = final_target)")
        results.append(_skipped(others.join(found, "request_id", "left_semi"), SKIPPED_FOUND))
        base = base.join(found, "request_id", "left_anti")
        level = tried(grown(base, lambda e: (e["level"] == 1) & ~is_direct(e), seed, no_block))
    else:
        level = tried(grown(base, lambda e: e["level"] == 1, seed, no_block))
    results.append(level.select(*RESULT))
    for _ in range(2, config.depth + 1):
        blocked = F.when(F.col("status").isin(*DEAD), PARENT_FAILED).when(F.col("status") == SKIPPED_FOUND, SKIPPED_FOUND)
        if config.early_stop == "any":
            won = F.max(F.col("status").isin(FOUND, SKIPPED_FOUND).cast("int")).over(Window.partitionBy("request_id")) == 1
            level = level.withColumn("__won", won)
            blocked = F.when(F.col("__won"), SKIPPED_FOUND).otherwise(blocked)
        level = tried(grown(level.withColumn("__edge", F.col("edge_id")), lambda e: e["parent_edge_id"] == F.col("__edge"), F.col("extracted_source_code").alias("source_code"), blocked.alias("blocked")))
        results.append(level.select(*RESULT))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def evaluate_tree(requests: DataFrame, edges: DataFrame, inference, execution, config: EngineConfig, stores: Stores | None = None) -> DataFrame:
    """The result of every edge that can reach its request's target.

    Each level is written once before the next reads it: providers run once,
    and plans do not grow with the depth.
    """
    edges = edges.where("reaches")
    if in_row(inference, execution, config):
        return _tree_in_row(requests, edges, inference, execution, config)
    parts = requests.select(F.col("id").alias("request_id"), *REQUEST_PARTS)

    def tried(live: DataFrame) -> DataFrame:
        return checkpointed(attempt(live, inference, execution, config, stores))

    seeded = edges.where("level = 1").join(parts, "request_id").withColumn("source_code", F.col("seed_code"))
    results: list[DataFrame] = []
    if config.early_stop == "direct":
        direct = mask_after_found(tried(seeded.where("target_language = final_target")), "edge_id", descending=True)
        found = direct.where(F.col("status") == FOUND).select("request_id").distinct()
        results.append(direct)
        others = edges.where("not (level = 1 and target_language = final_target)")
        results.append(_skipped(others.join(found, "request_id", "left_semi"), SKIPPED_FOUND))
        edges = others.join(found, "request_id", "left_anti")
        seeded = seeded.where("target_language <> final_target").join(found, "request_id", "left_anti")
    level = tried(seeded)
    results.append(level)
    for depth in range(2, config.depth + 1):
        children = edges.where(F.col("level") == depth)
        if config.early_stop == "any":
            found = level.where(F.col("status").isin(FOUND, SKIPPED_FOUND)).select("request_id").distinct()
            results.append(_skipped(children.join(found, "request_id", "left_semi"), SKIPPED_FOUND))
            stopped = children.join(found, "request_id", "left_semi")
            children = children.join(found, "request_id", "left_anti")
        parents = level.select("request_id", F.col("edge_id").alias("parent_edge_id"), F.col("status").alias("parent_status"), F.col("extracted_source_code").alias("source_code"))
        gated = children.join(parents, ["request_id", "parent_edge_id"])
        dead = F.col("parent_status").isin(*DEAD)
        halted = F.col("parent_status") == SKIPPED_FOUND
        skipped = _skipped(gated.where(dead | halted).drop("source_code"), F.when(dead, PARENT_FAILED).otherwise(SKIPPED_FOUND))
        live = tried(gated.where(~dead & ~halted).drop("parent_status").join(parts, "request_id"))
        results += [skipped, live]
        level = skipped.unionByName(live)
        if config.early_stop == "any":
            level = level.unionByName(_skipped(stopped, SKIPPED_FOUND))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def mask_after_found(edges: DataFrame, order: str, descending: bool = False) -> DataFrame:
    """Root edges of a request in order: those after a found one were never tried."""
    by = F.col(order).desc() if descending else F.col(order)
    before = Window.partitionBy("request_id").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.max(F.when(F.col("status") == FOUND, 1).otherwise(0)).over(before), F.lit(0)) == 1
    marked = edges.withColumn("__late", late)
    blank = {"prompt": F.lit(""), "inference_output": F.lit(""), "extracted_source_code": F.lit(""), "status": F.lit(SKIPPED_FOUND)}
    kept = [F.when(F.col("__late"), blank[c]).otherwise(F.col(c)).alias(c) if c in blank else F.col(c) for c in edges.columns]
    emptied = {"fuzzy_tests": FUZZY_RESULT, "unit_tests": UNIT_RESULT}
    out = marked.select(*kept, "__late")
    for c, kind in emptied.items():
        out = out.withColumn(c, F.when(F.col("__late"), F.expr(f"cast(array() as array<{kind}>)")).otherwise(F.col(c)))
    return out.drop("__late")


def translate(requests: DataFrame, inference, execution, config: EngineConfig, stores: Stores | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, path_edges): every evaluated edge, and the edges of every path in order.

    The tree-of-translations entry point. An edge is memoized on a path if an
    earlier path holds it or it was cancelled before it was tried.
    """
    requests = checked_suites(requests, config.verify_intermediates)
    planned = checkpointed(plan_edges(requests, config.depth))
    edges = evaluate_tree(requests, planned, inference, execution, config, stores)
    steps = plan_path_edges(planned)
    halted = edges.where(F.col("status") == SKIPPED_FOUND).select("request_id", "edge_id", F.lit(True).alias("halted"))
    steps = steps.join(halted, list(EDGE_KEY), "left").withColumn("memoized", F.col("memoized") | F.coalesce("halted", F.lit(False))).drop("halted")
    return edges, steps


def attempts(requests: DataFrame, inference, execution, config: EngineConfig, stores: Stores | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, path_edges) of independent direct attempts, one path each; the attempt with the largest edge_id comes first."""
    config.check_attempts()
    requests = checked_suites(requests)
    parts = requests.select(F.col("id").alias("request_id"), "seed_language", "target_language", *REQUEST_PARTS)
    rows = parts.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(config.attempts))))
    rows = rows.withColumns({"edge_id": F.col("attempt"), "parent_edge_id": F.lit(-1), "level": F.lit(1), "input_language": F.col("seed_language"), "final_target": F.col("target_language"), "source_code": F.col("seed_code")})
    done = attempt(rows, inference, execution, config, stores, extra=True)
    if inference.keyed or execution.keyed:
        done = checkpointed(done)
    if config.early_stop != "never":
        done = mask_after_found(done, "edge_id", descending=True)
    steps = done.select("request_id", (F.lit(config.attempts + 1) - F.col("edge_id")).alias("path_rank"), F.lit(0).alias("edge_pos"), "edge_id", (F.col("status") == SKIPPED_FOUND).alias("memoized"))
    return done, steps


def verify(requests: DataFrame, execution, config: EngineConfig, stores: Stores | None = None) -> DataFrame:
    """(id, status, fuzzy_tests, unit_tests, extracted_source_code) of given inference outputs.

    Unit tests of all languages run, as they are the caller's own; success is
    always a found translation. Sort by id for a stable listing.
    """
    config.check_verification()
    rows = checked_suites(requests.withColumn("used_languages", F.array("targetLanguage")))
    ok, code = extract_code(F.col("inferenceOutput"), config.regex(config.verification_template))
    edges = rows.select(F.col("id").alias("request_id"), F.lit(1).alias("edge_id"), F.col("targetLanguage").alias("target_language"), "test_suite", ok.alias("extracted"), code.alias("code"))
    tested = test_edges(edges.where("extracted"), execution, config, stores, unit_by_language=False)
    out = edges.join(tested, list(EDGE_KEY), "left")
    status = F.when(~F.col("extracted"), NO_EXTRACTED).otherwise(tested_status(F.col("all_passed"), F.col("first_event"), F.lit(True)))
    empty = lambda name, kind: F.coalesce(name, F.expr(f"cast(array() as array<{kind}>)")).alias(name)
    return out.select(F.col("request_id").alias("id"), status.alias("status"), empty("fuzzy_tests", FUZZY_RESULT), empty("unit_tests", UNIT_RESULT), F.col("code").alias("extracted_source_code"))
