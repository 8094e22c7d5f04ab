import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from codeloom import config, schemas
from codeloom.functions import chat, code, text


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_extraction(spark):
    cases = {
        "a ```python\nprint(1)\n``` b": (True, "print(1)"),
        "none": (False, ""),
        "``````": (False, ""),
        "```typescript\nx\n```": (True, "typescript\nx"),
        "```go\na\n``` t ```go\nb\n```": (True, "a\n``` t ```go\nb"),
        "```\n \n```": (True, ""),
    }
    for given, want in cases.items():
        assert tuple(one(spark, *text.extract_code(F.lit(given), config.FENCE))) == want


def test_template_without_group():
    with pytest.raises(config.ConfigError):
        text.extract_code(None, "abc")


def test_trim_takes_any_white_space(spark):
    assert one(spark, text.trim_ws(F.lit(" \t a b \n")))[0] == "a b"


def test_prompt_fills_code_first(spark):
    p = text.render_prompt(F.lit("{input_code}|{input_lang}|{target_lang}|{extra_prompt_data}|{signature}"), F.lit("x {target_lang}"), F.lit("Go"), F.lit("Java"), F.lit(""), F.lit("s"))
    assert one(spark, p)[0] == "x Java|Go|Java|{extra_prompt_data}|s"


def test_verdicts(spark):
    got = one(spark, *[text.count_verdict(F.lit(x)) for x in ("#Results: 10, 10", "9, 10", "x", "1, 2 and 3, 3")])
    assert tuple(got) == (True, False, False, False)


def test_comment_separator_unknown(spark):
    with pytest.raises(Exception, match="no comment separator"):
        one(spark, text.comment_separator(F.lit("Cobol")))


def test_lookup_missing(spark):
    assert one(spark, text.lookup({"a": "x"}, F.lit("a"), "template"))[0] == "x"
    with pytest.raises(Exception, match="no template b"):
        one(spark, text.lookup({"a": "x"}, F.lit("b"), "template"))


def test_keys_do_not_run_parts_together(spark):
    a, b = one(spark, text.key(F.lit("ab"), F.lit("c")), text.key(F.lit("a"), F.lit("bc")))
    assert a != b and len(a) == 64


def test_small_texts(spark):
    got = one(spark, text.last_part(F.lit("a/b/c"), "/"), text.last_part(F.lit("abc"), "/"), text.file_extension(F.lit("JavaScript"), F.lit("import x")), text.file_extension(F.lit("Klingon")), text.path_text(F.array(F.lit("A -> B"), F.lit("B -> C"))))
    assert tuple(got) == ("c", "abc", ".mjs", None, "A -> B >> B -> C -| ")
    assert len(schemas.EXTENSIONS) == 40


def test_outcomes(spark):
    cases = [("o", "e", 0, False), ("o", "e", 3, False), ("o", "e", 3, True)]
    got = [one(spark, text.outcome_text(F.lit(a), F.lit(b), F.lit(c), F.lit(d)))[0] for a, b, c, d in cases]
    assert got == ["o", "(Exit code: 3) e", schemas.TIMEOUT_MARK]


def test_path_helpers(spark):
    p = F.array(F.lit("Go"), F.lit("Java"))
    got = one(spark, text.already_visited(p, F.lit("Go")), text.is_direct(p, F.lit("Go"), F.lit("Java")), text.without_last(p), text.is_status(F.lit("FAILED")), text.status_colour(F.lit("FAILED_EXECUTION")), text.status_colour(F.lit("ROOT")))
    assert tuple(got) == (True, True, ["Go"], True, "red", "skyblue")


def test_java_and_js(spark):
    js = code.with_js_imports
    got = one(spark, code.java_class(F.lit("public  class Foo { } public class B")), js(F.lit("readline()")), js(F.lit("readline = require(1)")), js(F.lit("import a; fs")))
    assert tuple(got) == ("class A { } class A", "const readline = require('readline');\nreadline()", "readline = require(1)", "import fs from 'fs';\nimport a; fs")


def test_cpp_function():
    src = "// int fake(int a)\nint add(int a, int b) { if (a) { return b; } return a; }\nint main() {}"
    name, body = code.cpp_function(src)
    assert name == "add"
    assert code.cpp_function("x") == ("", "")
    assert code.fill_in("int add(int a) { return a; }\n", "C++") == "int f_filled(int a) { return a; }"


def test_java_function():
    src = "class X { public int add(int a, int[] b) { return a; } }"
    assert code.java_function(src) == ("add", "int", ["a", "b"])
    assert code.fill_in(src, "Java") == "public static int f_filled(int a, int[] b) { return a; } }"
    assert code.fill_in("nothing", "Java") == ""


def test_python_function():
    src = 'def add(a, b):  # sum\n    """adds"""\n    return a + b\n'
    assert code.python_function(src)[0] == "add"
    assert "f_filled(a, b)" in code.fill_in(src, "Python") and "adds" not in code.fill_in(src, "Python")
    with pytest.raises(ValueError):
        code.fill_in("x", "Go")


def test_go_imports():
    src = 'package main\nimport (\n\t"fmt"\n\t"math/rand"\n\t"os"\n)\nfunc f() { fmt.Println(rand.Int()) }'
    out = code.prune_go_imports(src)
    assert '"fmt"' in out and '"math/rand"' in out and '"os"' not in out
    assert code.prune_go_imports('import "fmt"\nfmt.X').startswith("import (\n")
    assert code.prune_go_imports("package x") == "package x"
    assert '"testing"' in code.prune_go_imports('import (\n"fmt"\n)\nfmt.X(testing.T)')


def test_go_main():
    src = 'package main\nfunc main() { x := "}" // {\n if y { } }\nfunc g() {}\n'
    assert code.drop_go_main(src) == "package main\n\nfunc g() {}\n"
    assert code.drop_go_main("func main() { {") == "func main() { {"
    assert code.go_test_file("func g() {}").startswith("package common")
    assert "package common" in code.go_test_file(src)


def test_normalise_dispatch(spark):
    rows = spark.createDataFrame([("Java", "RUN", "public class Q"), ("JavaScript", "TEST", "fs"), ("JavaScript", "RUN", "fs"), ("Go", "TEST", "func g() {}"), ("Go", "RUN", "x"), ("Rust", "RUN", "y")], "language string, kind string, code string")
    got = [r[0] for r in rows.select(code.normalise(F.col("code"), F.col("language"), F.col("kind"))).collect()]
    assert got == ["class A", "fs", "const fs = require('fs');\nfs", "package common\n\nfunc g() {}", "x", "y"]


def test_test_program(spark):
    lit = F.lit
    got = one(spark, code.test_program(lit("c"), lit("t"), lit("i"), lit("Go")), code.test_program(lit("c"), lit("t"), lit(""), lit("Go")), code.test_program(lit("def g(x):\n return x"), lit("#TOFILL\nf_filled(1)"), lit(""), lit("Python"), True))
    assert got[0] == "i\nc\nt" and got[1] == "c\nt" and got[2].startswith("def f_filled(x):")


def test_chat(spark):
    c = config.EngineConfig(seed=5)
    body = one(spark, chat.request_body(F.lit("m"), F.lit("p"), c))[0]
    assert '"seed":5' in body and '"skip_special_tokens":true' in body
    plain = one(spark, chat.request_body(F.lit("m"), F.lit("p"), c.with_(backend="openai", top_p=0.0)))[0]
    assert "top_k" not in plain and "top_p" not in plain
    assert one(spark, chat.answer_text(F.lit('{"choices":[{"message":{"content":"x"}}]}')), chat.answer_text(F.lit("{}")))[:] == ("x", None)


def test_config(tmp_path):
    c = config.from_mapping({"expansionIntermediaryNodes": 2, "earlyStop": False, "stopOnDirectTranslation": True, "inferenceApiBaseUrls": ["a"]})
    assert (c.depth, c.early_stop, c.endpoints) == (2, "never", ("a",))
    for bad in ({"depth": 0}, {"early_stop": "x"}, {"regex_templates": {"a": "b"}}, {"regex_templates": {"a": "("}}):
        with pytest.raises(config.ConfigError):
            config.from_mapping(bad)
    with pytest.raises(config.ConfigError):
        c.check_attempts()
    with pytest.raises(config.ConfigError):
        c.with_(regex_inference_only=False).check_verification()
    (tmp_path / "c.json").write_text('{"top-k": 3}')
    assert config.load(str(tmp_path / "c.json")).top_k == 3


def test_yaml_config(tmp_path, monkeypatch):
    # JSON is YAML, so a JSON reader stands in where no YAML reader is installed.
    monkeypatch.setitem(sys.modules, "yaml", types.SimpleNamespace(safe_load=json.loads))
    (tmp_path / "c.yaml").write_text('{"inferenceApiToken": "t", "executionContainers": {"Go": "go.sif"}, "numExecutionWorkers": 7, "cacheDatabasePath": "/c"}')
    c = config.load(str(tmp_path / "c.yaml"))
    assert (c.token, dict(c.containers), c.execution_workers, c.cache_path) == ("t", {"Go": "go.sif"}, 7, "/c")
    monkeypatch.setitem(sys.modules, "yaml", None)
    with pytest.raises(config.ConfigError, match="YAML"):
        config.load(str(tmp_path / "c.yaml"))


def test_scanner():
    src = 'f("}") // {\n{ a { b } /* } */ } c'
    assert src[: code.block_end(src, "Java", 0)].endswith("*/ }")
    assert code.block_end("{ {", "Go", 0) is None and code.block_end("} x", "C++", 0) is None
    assert code.blanked("a // b\nc", "C++", "comment") == "a     \nc"
    assert code.python_function("x = '#'\ndef f(a): # no\n    return '#' + a\n") == ("f", "def f(a): \n    return '#' + a\n")
    assert code.cpp_function('/* int f(int a) {} */\nint g(int a)\n{ return "}"; }\n') == ("g", 'int g(int a)\n{ return "}"; }')
    assert code.prune_go_imports('import (\n"a/b"\n"c"\n)\nassert.X(b.Y)') == 'import (\n"a/b"\n\t"github.com/stretchr/testify/assert"\n)\nassert.X(b.Y)'
