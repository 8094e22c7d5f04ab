"""Row types of requests, responses and caches, and the statuses of an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUZZY_TEST = "struct<stdin_input:string,expected_output:string>"
UNIT_TEST = "struct<language:string,test_case:string,imports:string>"
TEST_SUITE = f"struct<fuzzy_suite:array<{FUZZY_TEST}>,unit_test_suite:array<{UNIT_TEST}>>"
SIGNATURE = "struct<language:string,signature:string>"

REQUEST = (
    "id string, seed_language string, target_language string, seed_code string, "
    f"test_suite {TEST_SUITE}, used_languages array<string>, prompt_template_name string, regex_template_name string, "
    f"model_name string, target_signatures array<{SIGNATURE}>, extra_prompt_data string"
)
VERIFICATION = f"id string, test_suite {TEST_SUITE}, inferenceOutput string, targetLanguage string, sourceLanguage string"

FUZZY_RESULT = "struct<stdin_input:string,expected_output:string,actual_output:string,passed:boolean,executed_code:string>"
UNIT_RESULT = "struct<source_code:string,actual_output:string,passed:boolean,executed_code:string>"
EDGE = (
    "struct<prompt_template:string,prompt:string,translation_id:string,input_language:string,target_language:string,level:int,"
    "success:boolean,inference_output:string,execution_output:string,source_code:string,extracted_source_code:string,parent_edge_id:int,"
    f"status:string,fuzzy_tests:array<{FUZZY_RESULT}>,unit_tests:array<{UNIT_RESULT}>,edge_id:int,wallTimeInference:bigint,"
    "wallTimeTestExecution:bigint,usedMemoization:boolean,usedInferenceCache:boolean>"
)
REQUEST_STRUCT = "struct<" + REQUEST.replace(" string", ":string").replace("test_suite ", "test_suite:").replace("used_languages ", "used_languages:").replace("target_signatures ", "target_signatures:").replace(", ", ",") + ">"
PATH = f"struct<translation_edges:array<{EDGE}>,edge_index_memoized:array<boolean>>"
RESPONSE = f"translation_request {REQUEST_STRUCT}, paths array<{PATH}>"
ENGINE_OUTPUT = f"translation_responses array<struct<translation_request:{REQUEST_STRUCT},paths:array<{PATH}>>>, request_id string, returnedToDisk boolean"

DATASET = "source_lang string, target_lang string, input_code string, test_code string, target_signature string"

PENDING = "PENDING"
PROCESSING = "PROCESSING"
TRANSLATED = "TRANSLATED"
SUCCESS = "SUCCESS"
FOUND = "TRANSLATION_FOUND"
FAILED = "FAILED"
NO_INFERENCE = "FAILED_NO_INFERENCE"
NO_EXTRACTED = "FAILED_NO_EXTRACTED"
FAILED_EXECUTION = "FAILED_EXECUTION"
FAILED_TIMEOUT = "FAILED_EXECUTION_TIMEOUT"
FAILED_VERIFICATION = "FAILED_VERIFICATION"
PARENT_FAILED = "SKIPPED_PARENT_FAILED"
SKIPPED_FOUND = "SKIPPED_TRANSLATION_FOUND"

STATUSES = (
    PENDING,
    PROCESSING,
    TRANSLATED,
    SUCCESS,
    FOUND,
    FAILED,
    NO_INFERENCE,
    NO_EXTRACTED,
    FAILED_EXECUTION,
    FAILED_TIMEOUT,
    FAILED_VERIFICATION,
    PARENT_FAILED,
    SKIPPED_FOUND,
)
#: Statuses of a parent that leave its children nothing to translate.
DEAD = (FAILED, NO_INFERENCE, NO_EXTRACTED, FAILED_EXECUTION, FAILED_TIMEOUT, FAILED_VERIFICATION, PARENT_FAILED)

TIMEOUT_MARK = "CMD_TIMEOUT_KILLED"
INVALID_UTF8 = "FAIL_INVALID_UTF8_STRING"

#: File extensions by language.
EXTENSIONS = {
    "Python": ".py",
    "JavaScript": ".js",
    "Java": ".java",
    "C": ".c",
    "C++": ".cpp",
    "C#": ".cs",
    "Go": ".go",
    "Ruby": ".rb",
    "PHP": ".php",
    "Swift": ".swift",
    "Kotlin": ".kt",
    "TypeScript": ".ts",
    "HTML": ".html",
    "CSS": ".css",
    "R": ".R",
    "MATLAB": ".m",
    "Shell Script": ".sh",
    "Perl": ".pl",
    "Scala": ".scala",
    "Objective-C": ".m",
    "Rust": ".rs",
    "Haskell": ".hs",
    "Lua": ".lua",
    "Dart": ".dart",
    "Elixir": ".ex",
    "Erlang": ".erl",
    "F#": ".fs",
    "Fortran": ".f90",
    "Groovy": ".groovy",
    "Pascal": ".pas",
    "VHDL": ".vhd",
    "Verilog": ".v",
    "COBOL": ".cob",
    "Assembly": ".asm",
    "Tcl": ".tcl",
    "Ada": ".adb",
    "Prolog": ".pl",
    "Julia": ".jl",
    "Visual Basic": ".vb",
    "SQL": ".sql",
}

#: Colours of a status in a tree plot; statuses that are not listed are red.
COLOURS = {
    FOUND: "green",
    SKIPPED_FOUND: "grey",
    SUCCESS: "blue",
    TRANSLATED: "blue",
    FAILED: "red",
    PARENT_FAILED: "grey",
    "SKIPPED_NO_EXTRACT": "grey",
    NO_EXTRACTED: "red",
    "ROOT": "skyblue",
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema``: missing ones added, absent strings and lists empty rather than null."""
    out = []
    for f in T._parse_datatype_string(schema):
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)
