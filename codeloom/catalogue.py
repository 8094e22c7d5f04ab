"""Queries over the test tables, one for each operator, and their SQL twins.

Documents stand for requests: a document's language gives the seed language,
its text the seed code. Providers are arithmetic on ids, so that SQL can
replay them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.config import FENCE, EngineConfig
from codeloom.functions import chat, code, text
from codeloom.operators import cache, evaluate, flatten, metrics, service, testing
from codeloom.plans import planner
from codeloom.runtime import SharedFolder, shared_folder
from codeloom.schemas import REQUEST, TIMEOUT_MARK, conform
from codeloom.sources import io
from codeloom.sources.io import language_pair
from codeloom.sources.providers import ExpressionExecution, ExpressionInference
from codeloom.streaming import jobs

LANGUAGES = ("Go", "Java", "Python", "C++")
TARGET = "Java"
DEPTH = 3
SEEDS = {"en": "Python", "fr": "Java", "de": "Go", "es": "C++"}
TEMPLATE = "Translate {input_lang} to {target_lang}:\n{input_code}\n{signature}{extra_prompt_data}"
CONFIG = EngineConfig(depth=DEPTH, prompt_templates={"plain": TEMPLATE}, regex_templates={"temperature": FENCE})


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _seed() -> Column:
    out = F.when(F.col("lang") == "en", SEEDS["en"])
    for k in ("fr", "de", "es"):
        out = out.when(F.col("lang") == k, SEEDS[k])
    return out.otherwise("Python")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests with two fuzzy tests each."""
    tests = F.array(*[F.struct(F.lit(str(i)).alias("stdin_input"), F.lit("ok").alias("expected_output")) for i in range(2)])
    rows = _docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        _seed().alias("seed_language"),
        F.lit(TARGET).alias("target_language"),
        F.col("text").alias("seed_code"),
        F.struct(tests.alias("fuzzy_suite"), F.expr("cast(array() as array<struct<language:string,test_case:string,imports:string>>)").alias("unit_test_suite")).alias("test_suite"),
        F.array(*[F.lit(x) for x in LANGUAGES]).alias("used_languages"),
        F.lit("plain").alias("prompt_template_name"),
        F.lit("temperature").alias("regex_template_name"),
        F.lit("m").alias("model_name"),
    )
    return conform(rows, REQUEST)


def _rid() -> Column:
    return F.col("request_id").cast("long")


def inference() -> ExpressionInference:
    r = F.pmod(_rid() * 31 + F.col("edge_id") * 17, F.lit(10))
    body = F.concat(F.lit("E"), F.col("edge_id").cast("string"), F.lit(":"), F.col("seed_code"))
    fenced = F.concat(F.lit("```python\n"), body, F.lit("\n```"))
    return ExpressionInference(F.when(r == 1, body).otherwise(fenced), r != 0)


def execution() -> ExpressionExecution:
    def place(ask, times: int = 1) -> Column:
        return ask("request_id").cast("long") + ask("edge_id") * times + ask("test_idx")

    def output(ask) -> Column:
        return F.when(place(ask) % 13 == 0, TIMEOUT_MARK).when(place(ask, 3) % 4 != 0, "ok").otherwise("bad")

    return ExpressionExecution(output, lambda ask: (place(ask) % 11 != 0) & (place(ask) % 13 != 0))


def _toct(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = requests(spark, sf_dir)
    edges, steps = evaluate.translate(rows, inference(), execution(), CONFIG)
    return rows, edges, steps


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.flat_edges(*_toct(spark, sf_dir))


def _cak(spark: SparkSession, sf_dir: str, early_stop: str = "direct") -> DataFrame:
    rows = requests(spark, sf_dir)
    edges, steps = evaluate.attempts(rows, inference(), execution(), CONFIG.with_(depth=1, early_stop=early_stop))
    return flatten.flat_edges(rows, edges, steps)


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.plan_edges(requests(spark, sf_dir), DEPTH)


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- SQL building blocks -------------------------------------------------------------------------------------------

_SEED_SQL = "CASE lang WHEN 'en' THEN 'Python' WHEN 'fr' THEN 'Java' WHEN 'de' THEN 'Go' WHEN 'es' THEN 'C++' ELSE 'Python' END"
_REQ = f"req AS (SELECT doc_id AS rid, CAST(doc_id AS VARCHAR) AS request_id, {_SEED_SQL} AS seed, 'Java' AS target, text FROM documents), lang(pos, l) AS (VALUES (0, 'Go'), (1, 'Java'), (2, 'Python'), (3, 'C++'))"
_TREE = (
    _REQ
    + """,
l1 AS (SELECT rid, request_id, seed, target, text, 1 AS level, seed AS src, l AS dst, [pos] AS ord FROM req, lang WHERE l <> seed),
l2 AS (SELECT rid, request_id, seed, target, text, 2 AS level, dst AS src, l AS dst, list_append(ord, pos) AS ord FROM l1, lang WHERE l <> dst AND dst <> target),
l3 AS (SELECT rid, request_id, seed, target, text, 3 AS level, dst AS src, l AS dst, list_append(ord, pos) AS ord FROM l2, lang WHERE l <> dst AND dst <> target),
made AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3),
edge AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS edge_id FROM made),
tree AS (SELECT e.*, coalesce(p.edge_id, -1) AS parent_id FROM edge e LEFT JOIN edge p ON e.request_id = p.request_id AND len(e.ord) > 1 AND p.ord = e.ord[1:len(e.ord) - 1]),
path AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY len(ord), ord DESC) AS path_rank FROM tree WHERE dst = target),
step AS (SELECT p.request_id, p.path_rank, t.edge_id, t.level - 1 AS edge_pos FROM path p JOIN tree t ON p.request_id = t.request_id AND t.ord = p.ord[1:len(t.ord)]),
seen AS (SELECT *, row_number() OVER (PARTITION BY request_id, edge_id ORDER BY path_rank) > 1 AS again FROM step)
"""
)
_BODY_SQL = "'E' || edge_id || ':' || text"
_TRIMMED = r"regexp_replace({}, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g')"
_TRY = (
    """SELECT *, (rid * 31 + edge_id * 17) % 10 AS r,
  CASE WHEN (rid * 31 + edge_id * 17) % 10 = 0 THEN '' WHEN (rid * 31 + edge_id * 17) % 10 = 1 THEN """
    + _BODY_SQL
    + """ ELSE '```python' || chr(10) || """
    + _BODY_SQL
    + """ || chr(10) || '```' END AS response,
  CASE WHEN (rid * 31 + edge_id * 17) % 10 < 2 THEN '' ELSE """
    + _TRIMMED.format(_BODY_SQL)
    + """ END AS code,
  CASE WHEN (rid + edge_id + 0) % 11 = 0 OR (rid + edge_id + 0) % 13 = 0 THEN 'FAILED_EXECUTION' WHEN (rid + edge_id * 3 + 0) % 4 = 0 THEN 'FAILED_VERIFICATION' END AS e0,
  CASE WHEN (rid + edge_id + 1) % 11 = 0 OR (rid + edge_id + 1) % 13 = 0 THEN 'FAILED_EXECUTION' WHEN (rid + edge_id * 3 + 1) % 4 = 0 THEN 'FAILED_VERIFICATION' END AS e1,
  (rid + edge_id) % 13 = 0 OR (rid + edge_id + 1) % 13 = 0 AS slow
"""
)
_OWN = "CASE WHEN r = 0 THEN 'FAILED_NO_INFERENCE' WHEN r = 1 THEN 'FAILED_NO_EXTRACTED' WHEN dst <> target THEN 'TRANSLATED' ELSE coalesce(e0, e1, 'TRANSLATION_FOUND') END"
_EVAL = (
    _TREE
    + f""",
used AS (SELECT t.* FROM tree t WHERE t.dst = t.target OR t.level < 3),
tried AS ({_TRY} FROM used),
own AS (SELECT *, {_OWN} AS own FROM tried),
won AS (SELECT request_id FROM own WHERE level = 1 AND dst = target AND own = 'TRANSLATION_FOUND'),
s1 AS (SELECT o.*, o.text AS source, CASE WHEN dst <> target AND request_id IN (SELECT request_id FROM won) THEN 'SKIPPED_TRANSLATION_FOUND' ELSE own END AS status FROM own o WHERE level = 1),
s2 AS (SELECT o.*, p.code AS source, CASE WHEN p.status = 'SKIPPED_TRANSLATION_FOUND' THEN p.status WHEN p.status = 'SKIPPED_PARENT_FAILED' OR p.status LIKE 'FAILED%' THEN 'SKIPPED_PARENT_FAILED' ELSE o.own END AS status FROM own o JOIN s1 p ON o.request_id = p.request_id AND o.parent_id = p.edge_id WHERE o.level = 2),
s3 AS (SELECT o.*, p.code AS source, CASE WHEN p.status = 'SKIPPED_TRANSLATION_FOUND' THEN p.status WHEN p.status = 'SKIPPED_PARENT_FAILED' OR p.status LIKE 'FAILED%' THEN 'SKIPPED_PARENT_FAILED' ELSE o.own END AS status FROM own o JOIN s2 p ON o.request_id = p.request_id AND o.parent_id = p.edge_id WHERE o.level = 3),
done AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3),
flat AS (SELECT d.*, s.path_rank, s.edge_pos, s.again OR d.status = 'SKIPPED_TRANSLATION_FOUND' AS memoized FROM seen s JOIN done d ON s.request_id = d.request_id AND s.edge_id = d.edge_id)
"""
)
_CAK_ALL = (
    _REQ
    + f""",
cand AS (SELECT rid, request_id, seed, target, text, 1 AS level, seed AS src, target AS dst, k AS edge_id FROM req, range(1, 11) t(k)),
tried AS ({_TRY} FROM cand),
own AS (SELECT *, {_OWN} AS own, 11 - edge_id AS path_rank FROM tried)
"""
)
_CAK = (
    _CAK_ALL
    + """,
masked AS (SELECT *, coalesce(max(CASE WHEN own = 'TRANSLATION_FOUND' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY path_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS late FROM own),
flat AS (SELECT *, CASE WHEN late THEN 'SKIPPED_TRANSLATION_FOUND' ELSE own END AS status FROM masked)
"""
)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL twin."""
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# --- Scalar functions ----------------------------------------------------------------------------------------------


@query(
    f"""SELECT doc_id, replace(replace(replace(replace('Translate {{input_lang}} to {{target_lang}}:' || chr(10) || '{{input_code}}' || chr(10) || '{{signature}}{{extra_prompt_data}}', '{{input_code}}', text), '{{input_lang}}', {_SEED_SQL}), '{{target_lang}}', 'Java'), '{{signature}}', 'sig' || doc_id) AS prompt FROM documents"""
)
def prompt_render(spark, sf_dir):
    p = text.render_prompt(F.lit(TEMPLATE), F.col("text"), _seed(), F.lit(TARGET), F.lit(""), F.concat(F.lit("sig"), F.col("doc_id").cast("string")))
    return _docs(spark, sf_dir).select("doc_id", p.alias("prompt"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN '#' ELSE '//' END AS separator FROM documents")
def comment_separator(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.comment_separator(_seed()).alias("separator"))


@query(f"SELECT doc_id, doc_id % 3 <> 0 AS ok, CASE WHEN doc_id % 3 <> 0 THEN {_TRIMMED.format('text')} ELSE '' END AS code FROM documents")
def extract_source(spark, sf_dir):
    fenced = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    ok, found = text.extract_code(fenced, FENCE)
    return _docs(spark, sf_dir).select("doc_id", ok.alias("ok"), found.alias("code"))


@query(f"SELECT item_id, {_TRIMMED.format('chr(9) || text || chr(10)')} AS trimmed FROM benchmark")
def trim_space(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select("item_id", text.trim_ws(F.concat(F.lit("\t "), F.col("text"), F.lit("\n"))).alias("trimmed"))


@query("SELECT doc_id, quality = toxic AS passed FROM labels")
def transcoder_verdict(spark, sf_dir):
    output = F.concat(F.lit("#Results: "), F.col("quality").cast("string"), F.lit(", "), F.col("toxic").cast("string"))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", text.count_verdict(output).alias("passed"))


@query(r"SELECT doc_id, 'class A { }' || chr(10) || regexp_replace(text, 'public\s+class\s+\w+', 'class A', 'g') AS code FROM documents")
def java_class_normalise(spark, sf_dir):
    source = F.concat(F.lit("public  class Foo"), F.col("doc_id").cast("string"), F.lit(" { }\n"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", code.java_class(source).alias("code"))


@query("SELECT doc_id, 'int f_filled(int a)' || chr(10) || '{ // }' || chr(10) || 'if (a) { return ' || doc_id || '; }' || chr(10) || 'return \"}\"; }' AS code FROM documents")
def cpp_fill_in(spark, sf_dir):
    source = F.concat(F.lit("// int f(int a) {\nint add(int a)\n{ // }\nif (a) { return "), F.col("doc_id").cast("string"), F.lit('; }\nreturn "}"; }\nint main() {}\n/* '), F.col("text"), F.lit(" */"))
    return _docs(spark, sf_dir).select("doc_id", code.filled_function(source, F.lit("C++")).alias("code"))


@query("SELECT doc_id, 'public static int f_filled(int a, int[] b) { return a + ' || doc_id || '; } }' AS code FROM documents")
def java_fill_in(spark, sf_dir):
    source = F.concat(F.lit("class X { public int add(int a, int[] b) { return a + "), F.col("doc_id").cast("string"), F.lit("; } }"))
    return _docs(spark, sf_dir).select("doc_id", code.filled_function(source, F.lit("Java")).alias("code"))


@query("SELECT doc_id, 'def f_filled(a, b):  ' || chr(10) || '    ' || chr(10) || '    return a + ' || doc_id || chr(10) AS code FROM documents")
def python_fill_in(spark, sf_dir):
    source = F.concat(F.lit('def add(a, b):  # sum\n    """adds"""\n    return a + '), F.col("doc_id").cast("string"), F.lit("\n"))
    return _docs(spark, sf_dir).select("doc_id", code.filled_function(source, F.lit("Python")).alias("code"))


_GO = 'package main\nimport (\n\t"fmt"\n\t"os"\n)\nfunc main() { fmt.Println("}") }\nfunc g() { fmt.Println('


@query("SELECT doc_id, 'package main' || chr(10) || 'import (' || chr(10) || '\"fmt\"' || chr(10) || chr(9) || chr(10) || ')' || chr(10) || 'func main() { fmt.Println(\"}\") }' || chr(10) || 'func g() { fmt.Println(' || doc_id || ') }' AS code FROM documents")
def go_import_prune(spark, sf_dir):
    source = F.concat(F.lit(_GO), F.col("doc_id").cast("string"), F.lit(") }"))
    return _docs(spark, sf_dir).select("doc_id", code.normalise(source, F.lit("Go"), F.lit(code.RUN)).alias("code"))


@query("SELECT doc_id, 'package common' || chr(10) || 'import (' || chr(10) || '\"fmt\"' || chr(10) || chr(9) || '\"testing\"' || chr(10) || ')' || chr(10) || chr(10) || 'func g() { fmt.Println(' || doc_id || ') } // testing.T' AS code FROM documents")
def go_test_file(spark, sf_dir):
    source = F.concat(F.lit(_GO), F.col("doc_id").cast("string"), F.lit(") } // testing.T"))
    return _docs(spark, sf_dir).select("doc_id", code.normalise(source, F.lit("Go"), F.lit(code.TEST)).alias("code"))


@query(f"SELECT doc_id, CASE {_SEED_SQL} WHEN 'Java' THEN 'class A' ELSE 'public class Foo' END || ' {{ }}' || chr(10) || text AS code FROM documents")
def normalise_programs(spark, sf_dir):
    source = F.concat(F.lit("public class Foo { }\n"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", code.normalise(source, _seed(), F.lit(code.RUN)).alias("code"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'imports' || chr(10) ELSE '' END || text || chr(10) || 'test ' || doc_id AS code FROM documents")
def test_programs(spark, sf_dir):
    imports = F.when(F.col("doc_id") % 2 == 0, "imports").otherwise("")
    test = F.concat(F.lit("test "), F.col("doc_id").cast("string"))
    return _docs(spark, sf_dir).select("doc_id", code.test_program(F.col("text"), test, imports, _seed()).alias("code"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'no tests' WHEN 3 THEN 'fuzzy and unit tests' END AS problem FROM documents")
def suite_problems(spark, sf_dir):
    fuzzy = F.when(F.col("doc_id") % 4 >= 2, F.array(F.struct(F.lit("1").alias("stdin_input"), F.col("text").alias("expected_output"))))
    unit = F.when(F.col("doc_id") % 2 == 1, F.array(F.struct(F.lit("Go").alias("language"), F.col("text").alias("test_case"), F.lit("").alias("imports"))))
    return _docs(spark, sf_dir).select("doc_id", testing.suite_problem(F.struct(fuzzy.alias("fuzzy_suite"), unit.alias("unit_test_suite"))).alias("problem"))


@query("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'zero: ' ELSE 'one: ' END || '{input_code}' AS template FROM documents")
def template_lookup(spark, sf_dir):
    templates = {"t0": "zero: {input_code}", "t1": "one: {input_code}"}
    name = F.concat(F.lit("t"), (F.col("doc_id") % 2).cast("string"))
    return _docs(spark, sf_dir).select("doc_id", text.lookup(templates, name, "prompt template").alias("template"))


@query("SELECT sha256(concat_ws(chr(31), lang, 'Java', text, 'test ' || doc_id)) AS id, lang AS seed_language, 'Java' AS target_language, text AS seed_code, 'test ' || doc_id AS test_case, 'sig' AS signature FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def dataset_requests(spark, sf_dir):
    rows = _docs(spark, sf_dir).where("lang is not null and text is not null")
    rows = rows.select(F.col("lang").alias("source_lang"), F.lit("Java").alias("target_lang"), F.col("text").alias("input_code"), F.concat(F.lit("test "), F.col("doc_id").cast("string")).alias("test_code"), F.lit("sig").alias("target_signature"))
    made = io.dataset_requests(rows, list(LANGUAGES), "plain", "temperature", "m")
    return made.select("id", "seed_language", "target_language", "seed_code", F.col("test_suite.unit_test_suite")[0]["test_case"].alias("test_case"), F.col("target_signatures")[0]["signature"].alias("signature"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'const readline = require(''readline'');' || chr(10) || 'readline(' || doc_id || ')' WHEN 1 THEN 'import fs from ''fs'';' || chr(10) || 'import x; fs.y(' || doc_id || ')' ELSE 'prompt = require(' || doc_id || ')' END AS code FROM documents")
def js_import_inject(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 3
    source = F.when(k == 0, F.concat(F.lit("readline("), n, F.lit(")"))).when(k == 1, F.concat(F.lit("import x; fs.y("), n, F.lit(")"))).otherwise(F.concat(F.lit("prompt = require("), n, F.lit(")")))
    return _docs(spark, sf_dir).select("doc_id", code.with_js_imports(source).alias("code"))


@query("SELECT page_id, CASE WHEN url IS NULL THEN NULL ELSE list_last(string_split(url, '/')) END AS part FROM pages")
def last_segment(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.last_part(F.col("url"), "/").alias("part"))


@query("SELECT doc_id, CASE lang WHEN 'fr' THEN '.java' WHEN 'de' THEN '.go' WHEN 'es' THEN '.cpp' ELSE '.py' END AS extension FROM documents")
def language_extension(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.file_extension(_seed()).alias("extension"))


@query(f"SELECT doc_id, sha256(concat_ws(chr(31), {_SEED_SQL}, 'Java', text, 'm', 'plain', 'temperature', CAST(doc_id AS VARCHAR), '', '3', 'direct')) AS key FROM documents")
def response_key(spark, sf_dir):
    row = {c: F.col(c) for c in ("seed_language", "target_language", "seed_code", "model_name", "prompt_template_name", "regex_template_name", "id")}
    return requests(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), text.response_key(row, DEPTH, "direct").alias("key"))


@query("SELECT doc_id, sha256(concat_ws(chr(31), 'm', text, '4096', '0.7', '0.95', '10', '-1')) AS key FROM documents")
def inference_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.inference_key(F.lit("m"), F.col("text"), 4096, 0.7, 0.95, 10, -1).alias("key"))


@query(f"SELECT doc_id, sha256(concat_ws(chr(31), text, {_SEED_SQL}, '', text, 'RUN')) AS key FROM documents")
def execution_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.execution_key(F.col("text"), _seed(), F.lit(""), F.col("text"), F.lit("RUN")).alias("key"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'CMD_TIMEOUT_KILLED' WHEN doc_id % 5 <> 0 THEN '(Exit code: ' || doc_id % 5 || ') err' ELSE 'out' END AS output FROM documents")
def outcome_text(spark, sf_dir):
    n = F.col("doc_id")
    return _docs(spark, sf_dir).select("doc_id", text.outcome_text(F.lit("out"), F.lit("err"), n % 5, n % 7 == 0).alias("output"))


@query("SELECT conv_id, turn, json_extract_string(to_json({'m': text}), '$.m') AS content, 'm' AS model, 10 AS top_k, true AS skip FROM conversations")
def chat_json_build(spark, sf_dir):
    body = chat.request_body(F.lit("m"), F.col("text"), CONFIG)
    kind = "model string, messages array<struct<role:string,content:string>>, top_k int, skip_special_tokens boolean"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("b", F.from_json(body, kind))
    return rows.select("conv_id", "turn", F.col("b.messages")[0]["content"].alias("content"), F.col("b.model").alias("model"), F.col("b.top_k").alias("top_k"), F.col("b.skip_special_tokens").alias("skip"))


@query("SELECT conv_id, turn, text AS content FROM conversations")
def chat_json_parse(spark, sf_dir):
    choice = F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"))
    body = F.to_json(F.struct(F.lit("x").alias("id"), F.array(choice).alias("choices")))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", chat.answer_text(body).alias("content"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS endpoint FROM documents")
def round_robin(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", chat.endpoint_of(F.col("doc_id"), ("a", "b", "c")).alias("endpoint"))


# --- Planning ------------------------------------------------------------------------------------------------------


@query(f"WITH {_TREE} SELECT request_id, path_rank, len(ord) AS path_len, edge_id FROM path")
def plan_paths(spark, sf_dir):
    paths = planner.plan_paths(_planned(spark, sf_dir))
    return paths.select("request_id", *_long("path_rank", "path_len", "edge_id"))


@query(f"WITH {_TREE} SELECT request_id, edge_id, parent_id AS parent_edge_id, level, src AS input_language, dst AS target_language FROM tree")
def plan_edges(spark, sf_dir):
    return _planned(spark, sf_dir).select("request_id", *_long("edge_id", "parent_edge_id"), "level", "input_language", "target_language")


@query(f"WITH {_TREE} SELECT level, count(*) AS n_edges FROM tree GROUP BY level")
def plan_level_histogram(spark, sf_dir):
    return planner.level_histogram(planner.grow_edges(requests(spark, sf_dir), DEPTH))


@query(f"WITH {_TREE} SELECT level, src AS input_language, dst AS target_language, count(*) AS n_edges FROM tree GROUP BY ALL")
def plan_recursive(spark, sf_dir):
    grown = planner.grow_edges_sql(requests(spark, sf_dir), DEPTH)
    return grown.groupBy("level", "input_language", "target_language").agg(F.count("*").alias("n_edges"))


@query(f"WITH {_TREE} SELECT request_id, count(*) AS n_paths FROM path GROUP BY request_id")
def plan_totals(spark, sf_dir):
    edges = planner.grow_edges(requests(spark, sf_dir), DEPTH)
    return planner.plan_totals(edges.where("target_language = final_target"))


@query(f"WITH {_TREE} SELECT p.request_id, p.path_rank, string_agg(t.src || ' -> ' || t.dst, ' >> ' ORDER BY t.level) || ' -| ' AS path FROM path p JOIN tree t ON p.request_id = t.request_id AND t.ord = p.ord[1:len(t.ord)] GROUP BY ALL")
def path_display(spark, sf_dir):
    shown = planner.path_display(planner.plan_paths(_planned(spark, sf_dir)))
    return shown.select("request_id", *_long("path_rank"), "path")


@query(f"WITH {_TREE} SELECT request_id, path_rank, edge_pos, edge_id, again AS memoized FROM seen")
def prefix_memo_flags(spark, sf_dir):
    steps = planner.plan_path_edges(_planned(spark, sf_dir))
    return steps.select("request_id", *_long("path_rank"), "edge_pos", *_long("edge_id"), "memoized")


# --- Attaching -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'first' WHEN 'fr' THEN 'j' ELSE '' END AS signature FROM documents")
def signature_lookup(spark, sf_dir):
    listed = F.array(*[F.struct(F.lit(x).alias("language"), F.lit(s).alias("signature")) for x, s in (("Python", "first"), ("Java", "j"), ("Python", "second"))])
    return _docs(spark, sf_dir).select("doc_id", evaluate.signature_of(listed, _seed()).alias("signature"))


_ITEMS = "(SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark)"


def _tested(spark: SparkSession, sf_dir: str, unit: bool) -> DataFrame:
    """Documents joined to the benchmark items that their id picks by place, as edges with tests of all languages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("text").alias("item"), (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("place"))
    rows = _docs(spark, sf_dir).withColumn("place", F.col("doc_id") % items.count()).join(items, "place")
    tests = F.array(*[F.struct(F.lit(x).alias("language"), F.concat(F.lit(f"{x}:"), F.col("item")).alias("test_case"), F.lit("").alias("imports")) for x in ("Python", "Java", "Python")])
    fuzzy = F.array(*[F.struct(F.lit(str(i)).alias("stdin_input"), F.concat(F.lit(f"{i}:"), F.col("item")).alias("expected_output")) for i in range(3)])
    suite = F.struct((fuzzy if not unit else F.expr("cast(array() as array<struct<stdin_input:string,expected_output:string>>)")).alias("fuzzy_suite"), tests.alias("unit_test_suite"))
    return rows.select(F.col("doc_id").cast("string").alias("request_id"), F.lit(1).alias("edge_id"), _seed().alias("target_language"), F.col("text").alias("code"), suite.alias("test_suite"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS request_id, i AS test_idx, CAST(i AS VARCHAR) AS stdin, i || ':' || b.text AS expected FROM documents d JOIN {_ITEMS} b ON b.place = d.doc_id % b.n, range(3) t(i)")
def attach_fuzzy_tests(spark, sf_dir):
    return testing.fuzzy_runs(_tested(spark, sf_dir, False)).select("request_id", *_long("test_idx"), "stdin", "expected")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS request_id, i AS test_idx, CASE lang WHEN 'fr' THEN 'Java:' ELSE 'Python:' END || b.text AS test_code FROM documents d JOIN {_ITEMS} b ON b.place = d.doc_id % b.n, range(2) t(i) WHERE lang = 'en' OR (lang = 'fr' AND i = 0)")
def attach_unit_tests(spark, sf_dir):
    return testing.unit_runs(_tested(spark, sf_dir, True)).select("request_id", *_long("test_idx"), "test_code")


# --- Verification --------------------------------------------------------------------------------------------------


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    fuzzy = F.array(*[F.struct(F.lit(str(i)).alias("stdin_input"), F.lit("ok").alias("expected_output")) for i in range(3)])
    rows = _docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        F.struct(fuzzy.alias("fuzzy_suite"), F.expr("cast(array() as array<struct<language:string,test_case:string,imports:string>>)").alias("unit_test_suite")).alias("test_suite"),
        F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```"))).alias("inferenceOutput"),
        F.lit("Python").alias("targetLanguage"),
        _seed().alias("sourceLanguage"),
    )
    n = _rid() + F.col("test_idx")
    runner = ExpressionExecution(F.when(n % 4 != 0, "ok").otherwise("bad"), n % 7 != 0)
    return evaluate.verify(rows, runner, CONFIG)


_VERIFY_SQL = (
    """
v AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'FAILED_NO_EXTRACTED' ELSE coalesce(
  CASE WHEN doc_id % 7 = 0 THEN 'FAILED_EXECUTION' WHEN doc_id % 4 = 0 THEN 'FAILED_VERIFICATION' END,
  CASE WHEN (doc_id + 1) % 7 = 0 THEN 'FAILED_EXECUTION' WHEN (doc_id + 1) % 4 = 0 THEN 'FAILED_VERIFICATION' END,
  CASE WHEN (doc_id + 2) % 7 = 0 THEN 'FAILED_EXECUTION' WHEN (doc_id + 2) % 4 = 0 THEN 'FAILED_VERIFICATION' END, 'TRANSLATION_FOUND') END AS status,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string([CASE WHEN (doc_id + i) % 4 <> 0 THEN 'ok:true' ELSE 'bad:false' END FOR i IN [0, 1, 2]], ',') END AS tests,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE """
    + _TRIMMED.format("text")
    + """ END AS code FROM documents)
"""
)


@query(f"WITH {_VERIFY_SQL} SELECT CAST(doc_id AS VARCHAR) AS id, status, tests, code FROM v")
def verify_batch(spark, sf_dir):
    tests = F.array_join(F.transform("fuzzy_tests", lambda t: F.concat_ws(":", t["actual_output"], t["passed"].cast("string"))), ",")
    return _verified(spark, sf_dir).select("id", "status", tests.alias("tests"), F.col("extracted_source_code").alias("code"))


@query(f"WITH {_VERIFY_SQL} SELECT status, count(*) AS n FROM v GROUP BY status")
def verify_status_counts(spark, sf_dir):
    return _verified(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'execution' ELSE 'test' END AS reason FROM labels WHERE quality = 0 OR toxic = 1")
def failure_reason(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("request_id"), F.lit(1).alias("edge_id"), F.lit(0).alias("suite"), F.lit(0).alias("test_idx"), (F.col("quality") == 1).alias("exit_ok"), (F.col("toxic") == 0).alias("passed"))
    return testing.failure_reasons(runs).select(F.col("request_id").alias("doc_id"), "reason")


# --- Trees of translations -----------------------------------------------------------------------------------------


@query(f"WITH {_EVAL} SELECT request_id, edge_id, level, status, CASE WHEN status LIKE 'SKIPPED%' THEN '' ELSE code END AS code, CASE WHEN status LIKE 'SKIPPED%' THEN '' ELSE response END AS response, CASE WHEN status LIKE 'SKIPPED%' THEN '' ELSE 'Translate ' || src || ' to ' || dst || ':' || chr(10) || source || chr(10) || '{{signature}}{{extra_prompt_data}}' END AS prompt FROM done")
def toct_edges(spark, sf_dir):
    _, edges, _ = _toct(spark, sf_dir)
    return edges.select("request_id", *_long("edge_id"), "level", "status", F.col("extracted_source_code").alias("code"), F.col("inference_output").alias("response"), "prompt")


@query(f"WITH {_EVAL} SELECT status, count(*) AS n FROM done GROUP BY status")
def toct_status_counts(spark, sf_dir):
    _, edges, _ = _toct(spark, sf_dir)
    return edges.groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_EVAL} SELECT DISTINCT request_id FROM flat WHERE status = 'TRANSLATION_FOUND'")
def toct_found(spark, sf_dir):
    rows, edges, steps = _toct(spark, sf_dir)
    return metrics.found_requests(rows, flatten.flat_edges(rows, edges, steps)).select(F.col("id").alias("request_id"))


_FLAT_COLUMNS = "seed AS seed_language, target AS request_target_language, request_id, src AS input_languages, dst AS target_languages, level, edge_id, parent_id AS parent_edge_id, status, memoized, status NOT LIKE 'SKIPPED%' AND r > 1 AND dst = target AND slow AS failed_timeout, CASE WHEN status LIKE 'SKIPPED%' THEN '' ELSE code END AS extracted_code, CASE WHEN status LIKE 'SKIPPED%' THEN '' ELSE response END AS inference_output, path_rank, edge_pos"


@query(f"WITH {_EVAL} SELECT {_FLAT_COLUMNS} FROM flat")
def flatten_response(spark, sf_dir):
    rows, edges, steps = _toct(spark, sf_dir)
    flat = flatten.flatten(flatten.nest(rows, edges, steps))
    return flat.select(*[F.col(c).cast("long").alias(c) if c in ("edge_id", "parent_edge_id", "path_rank") else F.col(c) for c in (*flatten.FLAT, "path_rank", "edge_pos")])


@query(f"WITH {_EVAL} SELECT request_id, path_rank, edge_pos, CASE WHEN tested THEN '0' END AS test_0_input, CASE WHEN tested THEN CASE WHEN (rid + edge_id) % 13 = 0 THEN 'CMD_TIMEOUT_KILLED' WHEN (rid + edge_id * 3) % 4 <> 0 THEN 'ok' ELSE 'bad' END END AS test_0_actual_output, CASE WHEN tested THEN '1' END AS test_1_input, CASE WHEN tested THEN CASE WHEN (rid + edge_id + 1) % 13 = 0 THEN 'CMD_TIMEOUT_KILLED' WHEN (rid + edge_id * 3 + 1) % 4 <> 0 THEN 'ok' ELSE 'bad' END END AS test_1_actual_output FROM (SELECT *, status NOT LIKE 'SKIPPED%' AND r > 1 AND dst = target AS tested FROM flat)")
def tests_wide(spark, sf_dir):
    flat = flatten.flatten(flatten.nest(*_toct(spark, sf_dir)))
    wide = flatten.tests_wide(flat, 2)
    return wide.select("request_id", *_long("path_rank"), "edge_pos", "test_0_input", "test_0_actual_output", "test_1_input", "test_1_actual_output")


@query(f"WITH {_EVAL}, n AS (SELECT request_id, count(DISTINCT path_rank) AS p, count(*) AS e FROM flat GROUP BY request_id) SELECT q.request_id, coalesce(p, 0) AS n_paths, coalesce(e, 0) AS n_edges FROM req q LEFT JOIN n ON q.request_id = n.request_id")
def renest_counts(spark, sf_dir):
    nested = flatten.nest(*_toct(spark, sf_dir))
    edges = F.aggregate("paths", F.lit(0).cast("long"), lambda s, p: s + F.size(p["translation_edges"]))
    return nested.select(F.col("translation_request.id").alias("request_id"), F.size("paths").cast("long").alias("n_paths"), edges.alias("n_edges"))


@query(f"WITH {_EVAL} SELECT request_id, min_by(CASE WHEN status = 'TRANSLATION_FOUND' THEN code END, CASE WHEN status = 'TRANSLATION_FOUND' THEN path_rank * 10 + edge_pos END) AS code FROM flat GROUP BY request_id")
def first_translation(spark, sf_dir):
    return metrics.first_translation(_flat(spark, sf_dir))


@query(f"WITH {_EVAL}, f AS (SELECT request_id, bool_or(status = 'TRANSLATION_FOUND' AND parent_id = -1) AS d, bool_or(status = 'TRANSLATION_FOUND') AS i FROM flat GROUP BY request_id) SELECT count(*) AS requests, round(100.0 * count(*) FILTER (d) / count(*), 6) AS ca_direct, round(100.0 * count(*) FILTER (i) / count(*), 6) AS ca_intermediates, round(100.0 * count(*) FILTER (i) / count(*) - 100.0 * count(*) FILTER (d) / count(*), 6) AS difference FROM f")
def ca_stats(spark, sf_dir):
    s = metrics.ca_stats(_flat(spark, sf_dir))
    return s.select("requests", F.round("ca_direct", 6).alias("ca_direct"), F.round("ca_intermediates", 6).alias("ca_intermediates"), F.round("difference", 6).alias("difference"))


@query(f"WITH {_EVAL}, f AS (SELECT seed, target, request_id, bool_or(status = 'TRANSLATION_FOUND') AS i FROM flat GROUP BY ALL) SELECT seed AS seed_language, target AS request_target_language, count(*) AS requests, count(*) FILTER (i) AS found, round(100.0 * count(*) FILTER (i) / count(*), 6) AS ca FROM f GROUP BY CUBE (seed, target)")
def ca_cube(spark, sf_dir):
    return metrics.ca_cube(_flat(spark, sf_dir)).withColumn("ca", F.round("ca", 6))


@query(f"WITH {_EVAL}, t AS (SELECT (rid + edge_id + i) % 13 = 0 AS slow FROM flat, range(2) k(i) WHERE status NOT LIKE 'SKIPPED%' AND r > 1 AND dst = target) SELECT count(*) AS tests, count(*) FILTER (slow) AS timeouts, round(100.0 * count(*) FILTER (slow) / count(*), 6) AS timeout_pct FROM t")
def timeout_pct(spark, sf_dir):
    flat = flatten.flatten(flatten.nest(*_toct(spark, sf_dir)))
    return metrics.timeout_percent(flatten.tests_long(flat)).select("tests", "timeouts", F.round("timeout_pct", 6).alias("timeout_pct"))


@query(f"WITH {_EVAL} SELECT request_id, bool_or(status NOT LIKE 'SKIPPED%' AND r > 1 AND dst = target AND slow) AS failed_timeout FROM flat GROUP BY request_id")
def failed_timeout_flag(spark, sf_dir):
    return _flat(spark, sf_dir).groupBy("request_id").agg(F.bool_or("failed_timeout").alias("failed_timeout"))


@query(f"WITH {_EVAL} SELECT DISTINCT request_id, parent_id AS parent_edge_id, edge_id, status, CASE status WHEN 'TRANSLATION_FOUND' THEN 'green' WHEN 'TRANSLATED' THEN 'blue' WHEN 'SKIPPED_TRANSLATION_FOUND' THEN 'grey' WHEN 'SKIPPED_PARENT_FAILED' THEN 'grey' ELSE 'red' END AS colour FROM flat")
def tree_edges_coloured(spark, sf_dir):
    tree = flatten.tree_edges(_flat(spark, sf_dir))
    return tree.select("request_id", *_long("parent_edge_id", "edge_id"), "status", "colour")


@query(f"WITH {_EVAL} SELECT DISTINCT request_id, edge_id, dst AS label, status, CASE status WHEN 'TRANSLATION_FOUND' THEN 'green' WHEN 'TRANSLATED' THEN 'blue' WHEN 'SKIPPED_TRANSLATION_FOUND' THEN 'grey' WHEN 'SKIPPED_PARENT_FAILED' THEN 'grey' ELSE 'red' END AS colour FROM flat UNION ALL SELECT DISTINCT request_id, -1, seed, 'ROOT', 'skyblue' FROM flat")
def tree_nodes_coloured(spark, sf_dir):
    return flatten.tree_nodes(_flat(spark, sf_dir)).select("request_id", *_long("edge_id"), "label", "status", "colour")


# --- Independent attempts ------------------------------------------------------------------------------------------


@query(f"WITH {_CAK_ALL} SELECT request_id, edge_id, path_rank, own AS status FROM own")
def cak_attempts(spark, sf_dir):
    return _cak(spark, sf_dir, "never").select("request_id", *_long("edge_id", "path_rank"), "status")


@query(f"WITH {_CAK} SELECT request_id, edge_id, path_rank, status FROM flat")
def cak_early_stop(spark, sf_dir):
    return _cak(spark, sf_dir).select("request_id", *_long("edge_id", "path_rank"), "status")


def _ca_sql(k: int) -> str:
    return f"WITH {_CAK}, f AS (SELECT request_id, bool_or(status = 'TRANSLATION_FOUND') AS i FROM flat WHERE path_rank <= {k} GROUP BY request_id) SELECT CAST({k} AS BIGINT) AS k, count(*) AS requests, count(*) FILTER (i) AS found, round(100.0 * count(*) FILTER (i) / count(*), 6) AS ca_at_k FROM f"


def _ca(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return metrics.ca_at_k(_cak(spark, sf_dir), k).withColumn("ca_at_k", F.round("ca_at_k", 6))


@query(_ca_sql(1))
def ca_at_1(spark, sf_dir):
    return _ca(spark, sf_dir, 1)


@query(_ca_sql(5))
def ca_at_5(spark, sf_dir):
    return _ca(spark, sf_dir, 5)


@query(_ca_sql(10))
def ca_at_10(spark, sf_dir):
    return _ca(spark, sf_dir, 10)


# --- Caches and datasets -------------------------------------------------------------------------------------------


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("key"))


@query("WITH k AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT key, max(doc_id) AS cached FROM k WHERE doc_id % 2 = 0 GROUP BY key) SELECT doc_id, cached FROM k JOIN c USING (key)")
def cache_hits(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    stored = cache.latest(rows.where("doc_id % 2 = 0").select("key", F.col("doc_id").alias("version"), F.col("doc_id").alias("cached"))).drop("version")
    return cache.split_hits(rows, stored)[0].select("doc_id", "cached")


@query("WITH k AS (SELECT doc_id, sha256(text) AS key FROM documents) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 2 = 0)")
def cache_misses(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    return cache.split_hits(rows, rows.where("doc_id % 2 = 0").select("key").distinct())[1].select("doc_id", "key")


@query("SELECT sha256(text) AS key, max(doc_id) AS version, max_by(lang, doc_id) AS lang FROM documents GROUP BY text")
def cache_latest(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("key"), F.col("doc_id").alias("version"), "lang")
    return cache.latest(rows)


@query("SELECT doc_id, length(text) AS answer, sha256(text) AS key FROM documents")
def dedupe_calls(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    done, _ = cache.through_cache(rows, None, lambda once: once.withColumn("answer", F.length("text").cast("long")), ("answer",))
    return done.select("doc_id", "answer", "key")


@query("WITH k AS (SELECT doc_id, length(text) AS answer, sha256(text) AS key FROM documents) SELECT doc_id, answer, key, key IN (SELECT key FROM k WHERE doc_id % 2 = 0) AS cache_hit FROM k")
def cached_calls(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    answer = F.length("text").cast("long").alias("answer")
    stored = rows.where("doc_id % 2 = 0").select("key", answer).distinct()
    done, _ = cache.through_cache(rows, lambda wanted: stored.join(wanted.select("key"), "key", "left_semi"), lambda once: once.withColumn("answer", F.length("text").cast("long")), ("answer",))
    return done.select("doc_id", "answer", "key", "cache_hit")


@query(f"WITH {_EVAL}, n AS (SELECT request_id, string_agg(status, ',' ORDER BY path_rank, edge_pos) AS statuses FROM flat GROUP BY request_id) SELECT q.request_id, coalesce(statuses, '') AS statuses FROM req q LEFT JOIN n ON q.request_id = n.request_id")
def responses(spark, sf_dir):
    out = service.respond(requests(spark, sf_dir), inference(), execution(), CONFIG)
    statuses = F.flatten(F.transform("paths", lambda p: F.transform(p["translation_edges"], lambda e: e["status"])))
    return out.select(F.col("translation_request.id").alias("request_id"), F.array_join(statuses, ",").alias("statuses"))


@query(f"WITH {_EVAL} SELECT request_id, path_rank, edge_pos, status, CASE WHEN status LIKE 'SKIPPED%' THEN '' ELSE code END AS extracted_code FROM flat")
def saved_responses(spark, sf_dir):
    out = service.respond(requests(spark, sf_dir), inference(), execution(), CONFIG)
    folder = SharedFolder(spark, f"{shared_folder(spark)}/responses-{uuid.uuid4().hex}")
    io.write_responses(out, folder.path, "out")
    flat = flatten.flatten(io.read_responses(spark, f"{folder.path}/out.json"))
    return flat.select("request_id", *_long("path_rank"), "edge_pos", "status", "extracted_code")


@query("SELECT doc_id, lang AS source_lang, CASE doc_id % 2 WHEN 0 THEN 'Python' ELSE 'Java' END AS target_lang FROM documents WHERE lang = 'fr' AND doc_id % 2 = 0")
def dataset_pair_filter(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("source_lang"), F.when(F.col("doc_id") % 2 == 0, "Python").otherwise("Java").alias("target_lang"))
    return language_pair(rows, "fr", "Python")


# --- Events --------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("WITH c AS (SELECT time_bucket(INTERVAL 30 SECONDS, ts) AS window_start, count(*) FILTER (event_type = 'view') AS n_fast, count(*) FILTER (event_type = 'click') AS n_slow FROM events GROUP BY 1) SELECT window_start, window_start + INTERVAL 30 SECONDS AS window_end, n_fast, n_slow, CASE WHEN greatest(n_fast, n_slow) > 0 THEN round((greatest(n_fast, n_slow) - least(n_fast, n_slow)) * 100.0 / greatest(n_fast, n_slow), 6) END AS lag_pct FROM c")
def throughput_30s(spark, sf_dir):
    return metrics.throughput(_events(spark, sf_dir), kind="event_type", fast="view", slow="click").withColumn("lag_pct", F.round("lag_pct", 6))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2, 3")
def event_windows_tumbling(spark, sf_dir):
    return jobs.event_windows(_events(spark, sf_dir), "1 hour").withColumn("total", F.round("total", 3))


@query("SELECT time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS window_start, time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events, range(2) t(k) GROUP BY 1, 2, 3")
def event_windows_sliding(spark, sf_dir):
    return jobs.event_windows(_events(spark, sf_dir), "1 hour", "30 minutes").withColumn("total", F.round("total", 3))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    return jobs.event_sessions(_events(spark, sf_dir), "2 hours")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: trees of translations over all documents, as the flat table."""
    return flatten_response(spark, sf_dir)


