"""Prompts, extraction, verdicts, keys and other text expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.config import ConfigError, group_count
from codeloom.schemas import COLOURS, EXTENSIONS, INVALID_UTF8, STATUSES, TIMEOUT_MARK

#: Languages whose line comments begin with two slashes.
SLASHES = ("Java", "C++", "Go", "JavaScript", "Rust")
#: Joins the parts of a key, so that no two lists of parts give one text.
SEPARATOR = "\x1f"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: White space of any script.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_ws(c: Column) -> Column:
    """Without white space of any script at both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE))


def render_prompt(template: Column, code: Column, source: Column, target: Column, extra: Column, signature: Column, comment: bool = False) -> Column:
    """A template with its placeholders filled in.

    Code comes first, so placeholders inside the code are filled in too. Empty
    extra data and signatures leave their placeholders.
    """
    p = F.replace(template, F.lit("{input_code}"), code)
    p = F.replace(p, F.lit("{input_lang}"), source)
    p = F.replace(p, F.lit("{target_lang}"), target)
    p = F.when(extra != "", F.replace(p, F.lit("{extra_prompt_data}"), extra)).otherwise(p)
    p = F.when(signature != "", F.replace(p, F.lit("{signature}"), signature)).otherwise(p)
    return F.replace(p, F.lit("{comment_separator}"), comment_separator(target)) if comment else p


def comment_separator(language: Column) -> Column:
    known = F.when(language == "Python", "#").when(language.isin(*SLASHES), "//")
    return known.otherwise(F.raise_error(F.concat(F.lit("no comment separator for "), language)))


def extract_code(text: Column, pattern: str) -> tuple[Column, Column]:
    """(ok, code): whether ``pattern`` matches, and its first group, trimmed."""
    if group_count(pattern) < 1:
        raise ConfigError("an extraction pattern needs a group")
    ok = text.rlike(pattern)
    return ok, F.when(ok, trim_ws(F.regexp_extract(text, pattern, 1))).otherwise("")


def count_verdict(output: Column) -> Column:
    """Whether the first ``passed, total`` pair of an output has equal numbers; false without one."""
    pair = r"(\d+), (\d+)"
    return output.rlike(pair) & (F.regexp_extract(output, pair, 1) == F.regexp_extract(output, pair, 2))


def lookup(values: Mapping[str, str], key: Column, what: str) -> Column:
    """The entry of a small mapping; a missing one is an error."""
    if not values:
        return F.raise_error(F.concat(F.lit(f"no {what} "), key)).cast("string")
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.raise_error(F.concat(F.lit(f"no {what} "), key)).cast("string"))


def file_extension(language: Column, code: Column | None = None) -> Column:
    """The extension of a language's files, null for unknown ones; JavaScript with an import is a module."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    known = F.try_element_at(table, language)
    return known if code is None else F.when((language == "JavaScript") & code.contains("import"), ".mjs").otherwise(known)


def last_part(c: Column, separator: str) -> Column:
    """What follows the last separator."""
    return F.substring_index(c, separator, -1)


def key(*parts: Column) -> Column:
    """The SHA-256 of parts, in lower-case hexadecimal digits."""
    return F.sha2(F.concat_ws(SEPARATOR, *[or_empty(p.cast("string")) for p in parts]), 256)


def response_key(row: dict[str, Column], depth: int, early_stop: str) -> Column:
    """The key of a request: everything that its response depends on."""
    names = ("seed_language", "target_language", "seed_code", "model_name", "prompt_template_name", "regex_template_name", "id")
    nested = ("used_languages", "test_suite", "target_signatures")
    parts = [row[n] for n in names] + [F.to_json(row[n]) for n in nested if n in row]
    return key(*parts, row.get("extra_prompt_data", F.lit("")), F.lit(depth), F.lit(early_stop))


def execution_key(source: Column, language: Column, stdin: Column, executed: Column, kind: Column) -> Column:
    return key(source, language, stdin, executed, kind)


def inference_key(model: Column, prompt: Column, max_tokens: int, temperature: float, top_p: float, top_k: int, seed: int) -> Column:
    return key(model, prompt, F.lit(max_tokens), F.lit(f"{temperature:g}"), F.lit(f"{top_p:g}"), F.lit(top_k), F.lit(seed))


def outcome_text(stdout: Column, stderr: Column, exit_code: Column, timed_out: Column) -> Column:
    """What an execution says: its output, or why there is none."""
    text = F.when(timed_out, TIMEOUT_MARK).when(exit_code != 0, F.concat(F.lit("(Exit code: "), exit_code.cast("string"), F.lit(") "), stderr)).otherwise(stdout)
    return F.when(F.is_valid_utf8(text), text).otherwise(INVALID_UTF8)


def edge_text(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" -> "), target)


def path_text(edges: Column) -> Column:
    """An array of edge texts as one line."""
    return F.concat(F.array_join(edges, " >> "), F.lit(" -| "))


def is_status(c: Column) -> Column:
    return c.isin(*STATUSES)


def status_colour(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit("red"))


# Helpers on arrays of languages along a path.

def already_visited(path: Column, language: Column) -> Column:
    return F.array_contains(path, language)


def is_direct(path: Column, seed: Column, target: Column) -> Column:
    return (F.size(path) == 2) & (F.get(path, F.lit(0)) == seed) & (F.get(path, F.lit(1)) == target)


def without_last(path: Column) -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
