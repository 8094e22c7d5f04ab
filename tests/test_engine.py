import dataclasses
import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from codeloom import catalogue
from codeloom.config import ConfigError, EngineConfig
from codeloom.operators import cache, evaluate, flatten, metrics, service, testing
from codeloom.plans import planner
from codeloom.schemas import DEAD
from codeloom.sources import io, providers

LANGUAGES = ["Go", "Java", "Python", "C++", "JavaScript", "Rust"]
QUICK = [("1199", "ABC"), ("1200", "ARC"), ("4208", "AGC")]


def request(id="1", seed="C++", target="Python", languages=LANGUAGES, fuzzy=QUICK, unit=(), **more):
    return {
        "id": id,
        "seed_language": seed,
        "target_language": target,
        "seed_code": "seed",
        "test_suite": {"fuzzy_suite": [{"stdin_input": a, "expected_output": b} for a, b in fuzzy], "unit_test_suite": [{"language": x, "test_case": t, "imports": i} for x, t, i in unit]},
        "used_languages": list(languages),
        "prompt_template_name": "p",
        "regex_template_name": "temperature",
        "model_name": "m",
        "target_signatures": [],
        "extra_prompt_data": "",
        **more,
    }


CONFIG = EngineConfig(prompt_templates={"p": "{input_code} {extra_prompt_data}"})


@pytest.mark.parametrize(("depth", "paths", "edges"), [(1, 1, 5), (2, 5, 25), (3, 21, 105)])
def test_plan_sizes(spark, depth, paths, edges):
    rows = io.requests_from_rows(spark, [request()])
    plan = planner.plan_edges(rows, depth).cache()
    assert plan.count() == edges and planner.plan_paths(plan).count() == paths
    assert planner.grow_edges_sql(rows, depth).count() == edges


def test_recursive_plan_beyond_the_row_limit(spark):
    rows = io.requests_from_rows(spark, [request(str(k)) for k in range(3)])
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    try:
        grown = planner.grow_edges_sql(rows, 3)
        got = sorted(map(tuple, grown.groupBy("request_id", "level").count().collect()))
    finally:
        spark.conf.set(name, before)
    assert got == [(str(k), level, n) for k in range(3) for level, n in ((1, 5), (2, 20), (3, 80))]


def test_plan_corner_cases(spark):
    rows = io.requests_from_rows(spark, [request("none", target="Cobol"), request("twice", languages=["Python", "Python"]), request("same", seed="Python"), request("empty", languages=[])])
    plan = planner.plan_edges(rows, 2)
    n = {r["request_id"]: r["n_paths"] for r in planner.plan_totals(planner.plan_paths(plan)).collect()}
    assert n == {"twice": 2, "same": 5}
    with pytest.raises(ValueError):
        planner.plan_edges(rows, 99)


def preorder(depth, languages, seed, target):
    """Edges and paths by plain recursion: {edge_id: (parent, level, source, target)}, [[edge ids]] in depth-first order."""
    edges, paths, count = {}, [], [0]

    def go(lang, level, parent, trail):
        for nxt in languages:
            if nxt == lang:
                continue
            count[0] += 1
            me = count[0]
            edges[me] = (parent, level, lang, nxt)
            if nxt == target:
                paths.append([*trail, me])
            elif level < depth:
                go(nxt, level + 1, me, [*trail, me])

    go(seed, 1, -1, [])
    return edges, paths


def test_numbering_is_depth_first(spark):
    edges, paths = preorder(3, LANGUAGES, "C++", "Python")
    plan = planner.plan_edges(io.requests_from_rows(spark, [request()]), 3).cache()
    got = {r["edge_id"]: (r["parent_edge_id"], r["level"], r["input_language"], r["target_language"]) for r in plan.collect()}
    assert got == edges
    ranked = [p for _, p in sorted(enumerate(paths), key=lambda x: (len(x[1]), -x[0]))]
    steps = planner.plan_path_edges(plan).orderBy("path_rank", "edge_pos").collect()
    mine = {}
    for r in steps:
        mine.setdefault(r["path_rank"], []).append(r["edge_id"])
    assert [mine[k] for k in sorted(mine)] == ranked


def walk(edges, paths, outcome, early):
    """Statuses and memo flags by walking the paths one after another."""
    ranked = [p for _, p in sorted(enumerate(paths), key=lambda x: (len(x[1]), -x[0]))]
    status, flags, stop = {}, [], False
    for path in ranked:
        row = []
        for e in path:
            row.append(e in status)
            if e in status:
                continue
            parent = edges[e][0]
            if stop:
                status[e] = "SKIPPED_TRANSLATION_FOUND"
                row[-1] = True
            elif parent != -1 and status[parent] in DEAD:
                status[e] = "SKIPPED_PARENT_FAILED"
            elif parent != -1 and status[parent] == "SKIPPED_TRANSLATION_FOUND":
                status[e] = "SKIPPED_TRANSLATION_FOUND"
            else:
                status[e] = outcome(e)
                if early and parent == -1 and status[e] == "TRANSLATION_FOUND":
                    stop = True
        flags.append(row)
    return status, flags


@pytest.mark.parametrize("early", [True, False])
def test_levels_equal_a_walk(spark, early):
    rng = random.Random(7)
    seeds = [rng.choice(LANGUAGES[:4]) for _ in range(12)]
    reqs = [request(str(i), seed=s, target="Python", languages=LANGUAGES[:4], fuzzy=[("0", "ok")]) for i, s in enumerate(seeds)]
    draw = {(str(i), e): rng.choice(["found", "found", "bad", "none", "plain"]) for i in range(12) for e in range(1, 60)}
    table = spark.createDataFrame([(i, e, o) for (i, e), o in draw.items()], "request_id string, edge_id int, o string")

    class Drawn:
        keyed = False

        def infer(self, calls):
            j = calls.join(F.broadcast(table), ["request_id", "edge_id"])
            body = F.when(F.col("o") == "plain", "x").otherwise(F.concat(F.lit("```"), F.col("o"), F.lit("```")))
            return j.withColumns({"response": body, "inference_ok": F.col("o") != "none", "wall_ms": F.lit(1).cast("long")}).drop("o")

    runner = providers.ExpressionExecution(F.when(F.col("source_code") == "found", "ok").otherwise("no"))
    config = CONFIG.with_(depth=3, early_stop="direct" if early else "never")
    edges, steps = evaluate.translate(io.requests_from_rows(spark, reqs), Drawn(), runner, config)
    got = {(r["request_id"], r["edge_id"]): r["status"] for r in edges.collect()}
    flags = {(r["request_id"], r["path_rank"], r["edge_pos"]): r["memoized"] for r in steps.collect()}
    for i, seed in enumerate(seeds):
        tree, paths = preorder(3, LANGUAGES[:4], seed, "Python")

        def outcome(e, i=i, tree=tree):
            o = draw[str(i), e]
            if o in ("none", "plain"):
                return {"none": "FAILED_NO_INFERENCE", "plain": "FAILED_NO_EXTRACTED"}[o]
            return "TRANSLATED" if tree[e][3] != "Python" else {"found": "TRANSLATION_FOUND", "bad": "FAILED_VERIFICATION"}[o]

        status, memo = walk(tree, paths, outcome, early)
        assert {e: s for (r, e), s in got.items() if r == str(i)} == status
        assert [[flags[str(i), k + 1, p] for p in range(len(row))] for k, row in enumerate(memo)] == memo


def test_quickstart_with_real_programs(spark):
    program = "n=int(input())\nprint('ABC' if n < 1200 else 'ARC' if n < 2800 else 'AGC')"
    infer = providers.ExpressionInference(F.lit(f"```python\n{program}\n```"))
    edges, steps = evaluate.translate(io.requests_from_rows(spark, [request()]), infer, providers.SubprocessExecution(), CONFIG.with_(depth=1))
    row = edges.first()
    assert row["status"] == "TRANSLATION_FOUND" and [t["actual_output"] for t in row["fuzzy_tests"]] == ["ABC", "ARC", "AGC"]


def run_programs(spark, run, *programs):
    rows = [(k, x, "Python", "", "RUN") for k, x in enumerate(programs)]
    got = run.execute(spark.createDataFrame(rows, "k int, executed_code string, language string, stdin string, kind string"))
    return [(r["output"], r["exit_ok"]) for r in got.orderBy("k").collect()]


def test_runner_failures(spark):
    run = providers.SubprocessExecution(timeout=2)
    got = run_programs(spark, run, "import time; time.sleep(9)", "import sys; sys.exit(3)", "import sys; sys.stdout.buffer.write(b'\\xff')", "print('x' * (1 << 21))", "while True: print('y' * 1000)", "print('ok')")
    assert got[0] == ("CMD_TIMEOUT_KILLED", False) and got[2] == ("FAIL_INVALID_UTF8_STRING", False) and got[5] == ("ok\n", True)
    assert got[1][0].startswith("(Exit code: 3)") and not got[3][1] and not got[4][1]
    assert run._run("x", "Cobol", "")[2] == 127
    assert providers.SubprocessExecution(memory_mb=200)._run("x = 'a' * (1 << 30)", "Python", "")[2] != 0
    late = providers.SubprocessExecution(settle=0.5)._run("print('name?', flush=True)\nprint(input())", "Python", "Ann")
    assert late[0] == b"Ann\n"


@pytest.fixture
def server():
    """(url, calls): a chat server that answers by the prompt: a number is a status, a word comes back."""
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][0]["content"]
            calls.append((self.path, said, self.headers["Authorization"]))
            self.send_response(int(said) if said.isdigit() else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": f"you said {said}"}}]}).encode())

        def log_message(self, *_):
            pass

    with ThreadingHTTPServer(("127.0.0.1", 0), Handler) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{s.server_port}", calls
        s.shutdown()


def test_http_inference(spark, server):
    url, calls = server
    config = CONFIG.with_(endpoints=(f"{url}/a", f"{url}/b/"), token="t0", inference_workers=3)
    infer, run = providers.from_config(config)
    assert infer.workers == 3 and run.workers == config.execution_workers
    infer = dataclasses.replace(infer, retries=2, pause=0.0)
    rows = spark.createDataFrame([(x,) for x in ("one", "two", "three", "four", "400", "429", "500")], "prompt string").withColumn("body", evaluate.request_body(F.lit("m"), F.col("prompt"), config))
    got = {r["prompt"]: (r["response"], r["inference_ok"]) for r in infer.infer(rows).collect()}
    assert got == {**{x: (f"you said {x}", True) for x in ("one", "two", "three", "four")}, **{x: (providers.FAILED_CALL, False) for x in ("400", "429", "500")}}
    times = {x: sum(c[1] == x for c in calls) for x in ("400", "429", "500")}
    assert times == {"400": 1, "429": 3, "500": 3}  # a refused call is not repeated
    assert {c[0] for c in calls} == {"/a/chat/completions", "/b/chat/completions"} and {c[2] for c in calls} == {"Bearer t0"}
    down = providers.HttpInference(("http://127.0.0.1:9",), retries=0)
    assert down._ask("{}", "http://127.0.0.1:9")[0] is None


def test_containers_from_config():
    with pytest.raises(ConfigError, match="endpoints"):
        providers.from_config(CONFIG)
    _, run = providers.from_config(CONFIG.with_(endpoints=("x",), containers={"Go": "go.sif"}, execution_workers=9))
    command = run.commands["Go"]
    assert command[:2] == ["singularity", "exec"] and "go.sif" in command and command[-1] == "/code/{name}"
    assert (run.workers, run.for_tests, run.memory_mb) == (9, ("test",), 0)


def test_stores_from_config(spark, tmp_path):
    config = CONFIG.with_(endpoints=("x",), cache_path=str(tmp_path / "c"))
    infer, run, stores = service.from_config(spark, config, 3)
    assert infer.endpoints == ("x",) and stores.version == 3 and stores.inference.path.startswith(config.cache_path)
    assert service.from_config(spark, config.with_(cache_path=""))[2].inference is None


def test_answers_from_a_table(spark):
    calls = spark.createDataFrame([("m", "p1"), ("m", "p2"), ("n", "p1")], "model string, prompt string")
    answers = spark.createDataFrame([("m", "p1", "r1"), ("m", "p1", "r1")], "model string, prompt string, response string")
    got = {(r["model"], r["prompt"]): (r["response"], r["inference_ok"]) for r in providers.TableInference(answers).infer(calls).collect()}
    assert got == {("m", "p1"): ("r1", True), ("m", "p2"): ("", False), ("n", "p1"): ("", False)}


def test_workers_bound_the_calls(spark):
    rows = spark.range(100)
    for workers in (1, 3, 4, 9):
        dealt, threads = providers.spread(rows, workers)
        assert dealt.rdd.getNumPartitions() * threads <= workers


def test_verification(spark):
    suite = {"fuzzy_suite": [{"stdin_input": "", "expected_output": "1"}], "unit_test_suite": []}
    rows = [{"id": str(k), "test_suite": suite, "inferenceOutput": o, "targetLanguage": "Python", "sourceLanguage": "Go"} for k, o in enumerate(["```print(1)```", "```print(2)```", "print(1)", "```raise SystemExit(2)```"])]
    got = evaluate.verify(io.verifications_from_rows(spark, rows), providers.SubprocessExecution(), CONFIG)
    assert [r["status"] for r in got.orderBy("id").collect()] == ["TRANSLATION_FOUND", "FAILED_VERIFICATION", "FAILED_NO_EXTRACTED", "FAILED_EXECUTION"]


def test_suites_are_checked(spark):
    both = request(unit=[("Python", "t", "")])
    for bad, what in ((request(fuzzy=()), "no tests"), (both, "fuzzy and unit")):
        with pytest.raises(Exception, match=what):
            testing.checked_suites(io.requests_from_rows(spark, [bad])).collect()
    lacking = request(fuzzy=(), unit=[("Python", "t", "")])
    with pytest.raises(Exception, match="no unit tests"):
        testing.checked_suites(io.requests_from_rows(spark, [lacking]), True).collect()


def test_first_event_wins(spark):
    rows = spark.createDataFrame([("r", 1, 0, 0, "", "a", "b", False, 1, "", ""), ("r", 1, 0, 1, "", "a", "z", True, 2, "", ""), ("s", 1, 0, 0, "", "a", " a ", True, 2, "", "")], "request_id string, edge_id int, suite int, test_idx int, stdin string, expected string, output string, exit_ok boolean, wall_ms long, source_code string, executed_code string")
    got = {r["request_id"]: r for r in testing.fold_tests(testing.with_verdicts(rows)).collect()}
    assert got["r"]["first_event"] == "FAILED_EXECUTION" and got["r"]["wall_test_ms"] == 3
    assert got["s"]["first_event"] is None and got["s"]["all_passed"]


def test_attempts(spark):
    ok = providers.ExpressionInference(F.concat(F.lit("```"), F.col("edge_id").cast("string"), F.lit("```")))
    runner = providers.ExpressionExecution(F.when(F.col("source_code") == "9", "ABC").otherwise("no"))
    config = CONFIG.with_(depth=1)
    rows = io.requests_from_rows(spark, [request(fuzzy=[("", "ABC")])])
    edges, steps = evaluate.attempts(rows, ok, runner, config)
    status = {r["edge_id"]: r["status"] for r in edges.collect()}
    assert status[10] == "FAILED_VERIFICATION" and status[9] == "TRANSLATION_FOUND" and status[8] == "SKIPPED_TRANSLATION_FOUND"
    flat = flatten.flat_edges(rows, edges, steps)
    assert metrics.ca_at_k(flat, 1).first()["ca_at_k"] == 0 and metrics.ca_at_k(flat, 2).first()["ca_at_k"] == 100
    for k in (0, 11):
        with pytest.raises(ValueError):
            metrics.ca_at_k(flat, k)
    with pytest.raises(ConfigError):
        evaluate.attempts(rows, ok, runner, config.with_(seed=1))


def test_round_trip_through_files(spark, tmp_path):
    rows = io.requests_from_rows(spark, [request("b"), request("a", target="Cobol")])
    infer = providers.ExpressionInference(F.lit("```x```"))
    edges, steps = evaluate.translate(rows, infer, providers.ExpressionExecution(F.lit("ABC")), CONFIG.with_(depth=2))
    nested = flatten.nest(rows, edges, steps).orderBy("translation_request.id")
    assert [r["translation_request"]["id"] for r in nested.collect()] == ["a", "b"]
    io.save(nested, str(tmp_path), "out", 3)
    again = io.read_responses(spark, str(tmp_path / "out.json"))
    key = lambda df: sorted(map(str, flatten.flatten(df).drop("tests").collect()))
    assert key(again) == key(nested)
    csv = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "out.csv"))
    assert csv.count() == flatten.flatten(nested).count() and "test_2_actual_output" in csv.columns
    stats = [r["line"] for r in metrics.stats_text(flatten.flatten(nested)).orderBy("position").collect()]
    assert stats[0].endswith("0.00%") and len(stats) == 3
    assert flatten.tree_nodes(flatten.flatten(nested)).where("status = 'ROOT'").count() == 1


def test_written_responses_do_not_repeat_their_code(spark, tmp_path):
    rng = random.Random(5)
    rows = io.requests_from_rows(spark, [request("a", seed_code="".join(rng.choice("abcdefgh \n") for _ in range(4000)))])
    infer = providers.ExpressionInference(F.concat(F.lit("```"), F.col("source_code"), F.lit("```")))
    nested = flatten.nest(rows, *evaluate.translate(rows, infer, providers.ExpressionExecution(F.lit("no")), CONFIG.with_(depth=2)))
    whole = nested.select(F.to_json(F.struct("translation_request", "paths"))).first()[0]
    io.write_responses(nested, str(tmp_path), "out")
    for kind in ("json", "parquet"):
        assert sum(f.stat().st_size for f in (tmp_path / f"out.{kind}").iterdir() if not f.name.startswith(".")) < len(whole) / 4
    assert io.read_responses(spark, str(tmp_path / "out.json")).collect() == io.read_responses(spark, str(tmp_path / "out.parquet"), "parquet").collect()


def test_engine_output_document(spark, tmp_path):
    doc = '{"translation_responses": [{"translation_request": {"id": "1", "seed_language": "Go"}, "paths": [{"translation_edges": [{"edge_id": 1, "parent_edge_id": -1, "status": "TRANSLATION_FOUND", "unit_tests": [{"source_code": "s", "actual_output": "CMD_TIMEOUT_KILLED"}]}], "edge_index_memoized": [false]}]}]}'
    (tmp_path / "o.json").write_text(doc)
    row = io.load_flat(spark, str(tmp_path / "o.json")).first()
    assert row["failed_timeout"] and row["status"] == "TRANSLATION_FOUND" and row["memoized_compat"]


def test_dataset(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"source_lang": "Java", "target_lang": "Python", "input_code": "c", "test_code": "t", "target_signature": "s"}\n{"source_lang": "Go", "target_lang": "Python"}\n')
    data = io.language_pair(io.read_dataset(spark, str(tmp_path / "d.jsonl")), "Java", "Python")
    row = io.dataset_requests(data, LANGUAGES, "p", "temperature", "m").first()
    assert row["test_suite"]["unit_test_suite"][0]["test_case"] == "t" and row["target_signatures"][0]["signature"] == "s"


def test_cache(spark, tmp_path):
    store = cache.ParquetCache(spark, str(tmp_path / "c"), "response string, ok boolean")
    assert store.read().count() == 0
    put = lambda rows, v: store.upsert(spark.createDataFrame(rows, "key string, response string, ok boolean"), v)
    put([("a", "1", True), ("b", "1", False)], 1)
    put([("a", "2", True)], 2)
    want = {("a", "2", True), ("b", "1", False)}
    assert {tuple(r) for r in store.read().collect()} == want
    store.compact()
    assert {tuple(r) for r in store.read().collect()} == want and store.rows().count() == 2
    work = spark.createDataFrame([("a", 1), ("c", 2), ("c", 3)], "key string, n int")
    done, fresh = cache.through_cache(work, store.read(), lambda x: x.withColumn("response", F.lit("new")).withColumn("ok", F.lit(True)), ("response", "ok"))
    assert sorted((r["n"], r["response"], r["cache_hit"]) for r in done.collect()) == [(1, "2", True), (2, "new", False), (3, "new", False)]
    assert fresh.count() == 1


def test_keyed_inference_runs_once(spark):
    class Counted:
        keyed = True

        def infer(self, calls):
            return calls.withColumns({"response": F.lit("```x```"), "inference_ok": F.lit(True), "wall_ms": F.lit(5).cast("long")})

    rows = io.requests_from_rows(spark, [request("1"), request("2")])
    edges, _ = evaluate.translate(rows, Counted(), providers.ExpressionExecution(F.lit("no")), CONFIG.with_(depth=1))
    assert edges.count() == 2 and {r["wall_inference_ms"] for r in edges.collect()} == {5}


def test_flagship(spark):
    assert catalogue.entry(spark, "/root/testdata/sf0.001").count() > 0


def test_caches_answer_and_keep(spark, tmp_path):
    calls = str(tmp_path / "calls")

    class Logged:
        keyed = True

        def infer(self, calls_):
            calls_.select("key").write.mode("append").parquet(calls)
            return calls_.withColumns({"response": F.lit("```print(input())```"), "inference_ok": F.lit(True), "wall_ms": F.lit(5).cast("long")})

    asked = lambda: spark.read.parquet(calls).count()
    rows = io.requests_from_rows(spark, [request("1", fuzzy=[("a", "a")]), request("2", fuzzy=[("b", "b")])])
    config = CONFIG.with_(depth=1, use_inference_cache=True)
    stores = cache.Stores.under(spark, str(tmp_path / "s"), 1)
    first = service.respond(rows, Logged(), providers.SubprocessExecution(), config, stores).collect()
    assert [r["paths"][0]["translation_edges"][0]["status"] for r in first] == ["TRANSLATION_FOUND"] * 2
    assert asked() == 1 and stores.inference.read().count() == 1 and stores.execution.read().count() == 2
    assert stores.response.read().count() == 0
    again = service.respond(rows, Logged(), providers.SubprocessExecution(), config.with_(use_response_cache=True), stores).collect()
    assert asked() == 1 and again[0]["paths"][0]["translation_edges"][0]["usedInferenceCache"]
    more = io.requests_from_rows(spark, [request("1", fuzzy=[("a", "a")]), request("3", fuzzy=[("c", "x")])])
    third = service.respond(more, Logged(), providers.SubprocessExecution(), config.with_(use_response_cache=True), stores).collect()
    assert [(r["translation_request"]["id"], r["paths"][0]["translation_edges"][0]["status"]) for r in third] == [("1", "TRANSLATION_FOUND"), ("3", "FAILED_VERIFICATION")]
    assert stores.response.read().count() == 3


def test_batch_replies(spark, tmp_path):
    infer = providers.ExpressionInference(F.lit("```x```"))
    rows = io.requests_from_rows(spark, [request("2"), request("1")])
    args = (rows, infer, providers.ExpressionExecution(F.lit("no")), CONFIG.with_(depth=1))
    here = service.answer_batch(*args)
    assert len(here.request_id) == 6 and not here.returned_to_disk and here.responses.count() == 2
    row = here.as_rows().first()
    assert [r["translation_request"]["id"] for r in row["translation_responses"]] == ["1", "2"] and row["request_id"] == here.request_id
    there = service.answer_batch(*args, base_name="b", save_path=str(tmp_path))
    assert there.returned_to_disk and there.responses.count() == 0 and there.request_id != here.request_id
    assert there.as_rows().first()["translation_responses"] == []
    assert io.read_responses(spark, str(tmp_path / "b.json")).count() == io.read_responses(spark, str(tmp_path / "b.parquet"), "parquet").count() == 2
    assert not service.answer_batch(*args, base_name="b").returned_to_disk


def test_independent_responses(spark):
    infer = providers.ExpressionInference(F.lit("```x```"))
    got = service.respond(io.requests_from_rows(spark, [request()]), infer, providers.ExpressionExecution(F.lit("no")), CONFIG.with_(depth=1), independent=True).first()
    assert len(got["paths"]) == 10
