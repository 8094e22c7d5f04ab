"""Tests of extracted programs: attaching them, running them, and the status that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.config import EngineConfig
from codeloom.functions.code import RUN, TEST, normalise, test_program
from codeloom.functions.text import count_verdict, execution_key, trim_ws
from codeloom.operators.cache import EXECUTION_VALUES, through_cache
from codeloom.runtime import settled
from codeloom.schemas import FAILED, FAILED_EXECUTION, FAILED_TIMEOUT, FAILED_VERIFICATION, FOUND, INVALID_UTF8, SUCCESS, TIMEOUT_MARK, UNIT_TEST

#: Columns that name an edge.
EDGE_KEY = ("request_id", "edge_id")


def suite_problem(suite: Column) -> Column:
    """What is wrong with a test suite: it has to hold fuzzy or unit tests, and not both; null if nothing is."""
    fuzzy, unit = F.coalesce(F.size(suite["fuzzy_suite"]), F.lit(0)), F.coalesce(F.size(suite["unit_test_suite"]), F.lit(0))
    return F.when((fuzzy <= 0) & (unit <= 0), "no tests").when((fuzzy > 0) & (unit > 0), "fuzzy and unit tests")


def checked_suites(requests: DataFrame, verify_intermediates: bool = False) -> DataFrame:
    """``requests``; reading a row whose suite is wrong is an error. With intermediate checks, unit tests have to exist for every language."""
    problem = suite_problem(F.col("test_suite"))
    if verify_intermediates:
        tested = F.array_distinct(F.transform("test_suite.unit_test_suite", lambda t: t["language"]))
        missing = F.size(F.array_except("used_languages", tested)) > 0
        problem = F.coalesce(problem, F.when((F.size("test_suite.unit_test_suite") > 0) & missing, "a language has no unit tests"))
    error = F.raise_error(F.concat(F.lit("request "), F.col("id"), F.lit(": "), problem)).cast("string")
    return requests.withColumn("id", F.when(problem.isNull(), F.col("id")).otherwise(error))


def fuzzy_runs(edges: DataFrame) -> DataFrame:
    """One row for each edge and fuzzy test of its request."""
    rows = edges.select(*EDGE_KEY, "target_language", "code", F.posexplode("test_suite.fuzzy_suite").alias("test_idx", "t"))
    return rows.select(*EDGE_KEY, F.lit(0).alias("suite"), "test_idx", F.col("target_language").alias("language"), F.col("t.stdin_input").alias("stdin"), F.col("t.expected_output").alias("expected"), F.lit("").alias("test_code"), F.lit("").alias("imports"), F.lit(RUN).alias("kind"), "code")


def unit_runs(edges: DataFrame, by_language: bool = True) -> DataFrame:
    """One row for each edge and unit test of its request, in the edge's own language unless ``by_language`` is off.

    Tests keep their order; their index counts those that are kept.
    """
    tests = F.col("test_suite.unit_test_suite")
    kept = F.filter(tests, lambda t: t["language"] == F.col("target_language")) if by_language else tests
    rows = edges.select(*EDGE_KEY, "target_language", "code", F.posexplode(kept).alias("test_idx", "t"))
    return rows.select(*EDGE_KEY, F.lit(1).alias("suite"), "test_idx", F.col("target_language").alias("language"), F.lit("").alias("stdin"), F.lit("").alias("expected"), F.col("t.test_case").alias("test_code"), F.coalesce("t.imports", F.lit("")).alias("imports"), F.lit(TEST).alias("kind"), "code")


def with_programs(runs: DataFrame, config: EngineConfig, go: bool = True) -> DataFrame:
    """Runs with source_code (what was submitted) and executed_code (what the runner gets)."""
    unit = test_program(F.col("code"), F.col("test_code"), F.col("imports"), F.col("language"), config.transcoder_format)
    runs = runs.withColumn("source_code", F.when(F.col("suite") == 1, unit).otherwise(F.col("code")))
    return runs.withColumn("executed_code", normalise(F.col("source_code"), F.col("language"), F.col("kind"), go)).drop("code")


def execute(runs: DataFrame, provider, cached=None) -> DataFrame:
    """Runs with output, exit_ok, wall_ms, cache_hit and key (null for providers that do not answer by key).

    Providers that answer by key run each distinct program and input once.
    """
    if not provider.keyed:
        return provider.execute(runs).withColumns({"cache_hit": F.lit(False), "key": F.lit(None).cast("string")})
    keyed = runs.withColumn("key", execution_key(F.col("source_code"), F.col("language"), F.col("stdin"), F.col("executed_code"), F.col("kind")))
    return through_cache(keyed, cached, provider.execute, EXECUTION_VALUES)[0]


def judged(suite: Column, ok: Column, output: Column, expected: Column, transcoder: bool = False) -> tuple[Column, Column, Column]:
    """(passed, event, actual_output) of a run; event is the status that a failing test asks for, null if none."""
    unit = (ok & count_verdict(output)) if transcoder else ok
    passed = F.when(suite == 0, trim_ws(output) == trim_ws(expected)).otherwise(unit)
    event = (
        F.when(~ok, FAILED_EXECUTION)
        .when(output == TIMEOUT_MARK, FAILED_TIMEOUT)
        .when(output == INVALID_UTF8, FAILED_EXECUTION)
        .when(~passed, FAILED_VERIFICATION)
    )
    return passed, event, F.when(suite == 0, trim_ws(output)).otherwise(output)


def with_verdicts(done: DataFrame, transcoder: bool = False) -> DataFrame:
    """Runs with passed, event and actual_output."""
    passed, event, shown = judged(F.col("suite"), F.col("exit_ok"), F.col("output"), F.col("expected"), transcoder)
    return done.withColumns({"passed": passed, "event": event, "actual_output": shown})


def tested_in_row(edges: DataFrame, execution, live: Column, by_language: bool = True) -> DataFrame:
    """Edges (with code and test_suite) with all_passed, first_event, wall_test_ms and the tests of both kinds, which only ``live`` ones have.

    For providers that are functions of a run: an edge's tests stay an array of
    its row, so nothing is dealt anew and nothing is joined back. Suites are of
    one kind, so that the order of runs is that of the array.
    """
    language, code = F.col("target_language"), F.col("code")
    run_code = normalise(code, language, F.lit(RUN), False)
    units = F.coalesce(F.col("test_suite.unit_test_suite"), F.array().cast(f"array<{UNIT_TEST}>"))
    units = F.filter(units, lambda t: t["language"] == language) if by_language else units
    none = F.lit("")

    def programs(t: Column) -> tuple[Column, Column]:
        source = test_program(code, t["test_case"], F.coalesce(t["imports"], none), language)
        return source, normalise(source, language, F.lit(TEST), False)

    def outcome(suite: int, i: Column, stdin: Column, expected: Column, test: Column, imports: Column, kind: str, source: Column, executed: Column) -> Column:
        run = {"suite": F.lit(suite), "test_idx": i, "language": language, "stdin": stdin, "expected": expected, "test_code": test, "imports": imports, "kind": F.lit(kind), "source_code": source, "executed_code": executed}
        output, ok, wall = execution.outcome(lambda name: run[name] if name in run else F.col(name))
        passed, event, shown = judged(run["suite"], ok, output, expected)
        return F.struct(shown.alias("actual_output"), passed.alias("passed"), event.alias("event"), wall.alias("wall"))

    kind = "array<struct<actual_output:string,passed:boolean,event:string,wall:bigint>>"
    fuzzy = F.transform(F.col("test_suite.fuzzy_suite"), lambda t, i: outcome(0, i, t["stdin_input"], t["expected_output"], none, none, RUN, code, run_code))
    unit = F.transform(units, lambda t, i: outcome(1, i, none, none, t["test_case"], F.coalesce(t["imports"], none), TEST, *programs(t)))
    listed = lambda c: F.coalesce(F.when(live, c), F.array().cast(kind)).cast(kind)
    own = settled(edges, __fuzzy=listed(fuzzy), __unit=listed(unit))
    every = F.concat("__fuzzy", "__unit")

    def shown_fuzzy(o: Column, i: Column) -> Column:
        t = F.get(F.col("test_suite.fuzzy_suite"), i)
        return F.struct(t["stdin_input"].alias("stdin_input"), t["expected_output"].alias("expected_output"), o["actual_output"].alias("actual_output"), o["passed"].alias("passed"), run_code.alias("executed_code"))

    def shown_unit(o: Column, i: Column) -> Column:
        source, executed = programs(F.get(units, i))
        return F.struct(source.alias("source_code"), o["actual_output"].alias("actual_output"), o["passed"].alias("passed"), executed.alias("executed_code"))

    return own.withColumns(
        {
            "all_passed": F.when(F.size(every) > 0, F.forall(every, lambda t: t["passed"])),
            "first_event": F.get(F.filter(F.transform(every, lambda t: t["event"]), lambda e: e.isNotNull()), F.lit(0)),
            "wall_test_ms": F.aggregate(every, F.lit(0).cast("long"), lambda s, t: s + t["wall"]),
            "fuzzy_tests": F.transform("__fuzzy", shown_fuzzy),
            "unit_tests": F.transform("__unit", shown_unit),
        }
    ).drop("__fuzzy", "__unit")


def fold_tests(runs: DataFrame) -> DataFrame:
    """Per edge: all_passed, first_event (the first failing test's), wall_test_ms and the tests of both kinds, in order."""
    order = F.struct("suite", "test_idx")
    fuzzy = F.when(F.col("suite") == 0, F.struct("test_idx", F.struct(F.col("stdin").alias("stdin_input"), F.col("expected").alias("expected_output"), "actual_output", "passed", "executed_code").alias("t")))
    unit = F.when(F.col("suite") == 1, F.struct("test_idx", F.struct(F.col("source_code"), "actual_output", "passed", "executed_code").alias("t")))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"])
    return runs.groupBy(*EDGE_KEY).agg(
        F.bool_and("passed").alias("all_passed"),
        F.min_by(F.col("event"), F.when(F.col("event").isNotNull(), order)).alias("first_event"),
        F.sum("wall_ms").alias("wall_test_ms"),
        listed(fuzzy).alias("fuzzy_tests"),
        listed(unit).alias("unit_tests"),
    )


def tested_status(all_passed: Column, first_event: Column, at_target: Column) -> Column:
    """The status of an edge after its tests: the first event holds; no test at all passes."""
    passed = F.when(at_target, FOUND).otherwise(SUCCESS)
    return F.coalesce(first_event, F.when(F.coalesce(all_passed, F.lit(True)), passed).otherwise(FAILED))


def failure_reasons(runs: DataFrame) -> DataFrame:
    """(request_id, edge_id, reason) of edges with a failing test: "execution" or "test", by the first failing one."""
    kind = F.when(~F.col("exit_ok"), "execution").when(~F.col("passed"), "test")
    out = runs.withColumn("reason", kind).where(F.col("reason").isNotNull())
    return out.groupBy(*EDGE_KEY).agg(F.min_by("reason", F.struct("suite", "test_idx")).alias("reason"))
