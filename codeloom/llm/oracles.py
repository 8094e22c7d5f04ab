"""DuckDB twins of the queries that SQL can express, written apart from the operators' logic."""

from __future__ import annotations

from codeloom.llm.decontaminate import SHARE, WINDOW
from codeloom.llm.licenses import BASE, TEMPLATES, Template
from codeloom.llm.secret_scan import RULES, Rule
from codeloom.llm.urls import OP6_SQL

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- Licences ------------------------------------------------------------------------------------------------------


def _stands(words: list[str], at: str) -> str:
    """Whether words stand at a 0-based place; a place before the text is none."""
    return " AND ".join(f"{at} + {j} >= 0 AND w[{at} + {j} + 1] = {_quoted(x)}" for j, x in enumerate(words))


def _template(k: int, t: Template) -> str:
    """Starts of a template: where its first phrase stands, less that phrase's offset, if the others stand as well."""
    (first, words), rest = t.offsets()[0], t.offsets()[1:]
    there = " AND ".join(f"({x})" for x in (_stands(words, "p"), *(_stands(v, f"p + {o - first}") for o, v in rest)))
    starts = f"list_transform(list_filter(range(0, len(w)), lambda p: coalesce({there}, false)), lambda p: p - {first})"
    return f"CASE WHEN list_has_all(w, [{', '.join(map(_quoted, words))}]) THEN {starts} ELSE [] END AS t{k}"


def _share(k: int, t: Template) -> str:
    each = " + ".join(f"CASE WHEN s + {j} >= 0 AND w[s + {j} + 1] = {_quoted(x)} THEN 1 ELSE 0 END" for j, x in enumerate(t.words))
    return f"coalesce(list_max(list_transform(t{k}, lambda s: ({each}) / CAST({len(t.words)} AS DOUBLE))), 0.0)"


def licence_sql() -> str:
    base = ", ".join(f"list_filter(range(0, len(w)), lambda s: coalesce({_stands(p.split(), 's')}, false)) AS b{k}" for k, (p, _) in enumerate(BASE))
    made = ", ".join(_template(k, t) for k, t in enumerate(TEMPLATES))
    count = " + ".join(f"len(b{k})" for k in range(len(BASE)))
    joined = " || ".join(f"b{k}" for k in range(len(BASE)))
    base_labels = " || ".join(f"CASE WHEN len(b{k}) > 0 THEN [{_quoted(label)}] ELSE CAST([] AS VARCHAR[]) END" for k, (_, label) in enumerate(BASE))
    own = " || ".join(f"CASE WHEN len(t{k}) > 0 THEN [{_quoted(t.label)}] ELSE CAST([] AS VARCHAR[]) END" for k, t in enumerate(TEMPLATES))
    shares = ", ".join(_share(k, t) for k, t in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT doc_id, w, {base}, {made} FROM d), g AS (SELECT *, {count} AS n, {joined} AS places FROM f)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(list_sort({base_labels}), ',') AS base_labels, array_to_string(list_sort(list_distinct({base_labels} || {own})), ',') AS labels,
  CASE WHEN n > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(greatest({shares}) AS DOUBLE) END AS score
FROM g
"""


# --- Contamination -------------------------------------------------------------------------------------------------

DECONTAMINATION_SQL = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, row_number() OVER () AS i, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT item, i, k, w[k + 1 : k + least(len(w), {WINDOW})] AS win FROM (SELECT *, unnest(range(0, greatest(1, len(w) - {WINDOW - 1}))) AS k FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
spots AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS p, w FROM docs, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, item, i, k, p, n FROM spots JOIN wins ON spots.w[p + 1 : p + n] = wins.win),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS at FROM found) GROUP BY doc_id),
runs AS (SELECT doc_id, item, i, p, k, n, p - row_number() OVER (PARTITION BY doc_id, i, p - k ORDER BY p) AS island FROM found),
matches AS (SELECT doc_id, item, max(p + n) - min(p) AS z, min(p) AS s, min(k) AS a FROM runs GROUP BY doc_id, item, i, p - k, island),
long AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY z DESC, s, item, a) = 1),
own AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(d.w) AS contaminated, CAST(coalesce(z, 0) AS BIGINT) AS longest_match, CAST(s AS BIGINT) AS match_start, long.item AS match_item, CAST(a AS BIGINT) AS match_at
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN long USING (doc_id)
"""


# --- Secrets -------------------------------------------------------------------------------------------------------


def _either_case(pattern: str) -> str:
    """A pattern that ignores case for A-Z alone: each letter outside a class as a pair."""
    out, inside = [], False
    for k, c in enumerate(pattern):
        inside = (inside or c == "[") and c != "]"
        escaped = k and pattern[k - 1] == "\\"
        hexes = pattern[max(0, k - 2) : k].endswith("\\x") or pattern[max(0, k - 3) : k - 1].endswith("\\x")
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not inside and not escaped and not hexes else c)
    return "".join(out)


def _rule(k: int, r: Rule) -> str:
    pattern = _quoted(_either_case(r.pattern.removeprefix("(?i)")) if r.pattern.startswith("(?i)") else r.pattern)
    return f"SELECT doc_id, {k} AS k, {_quoted(r.kind)} AS kind, {r.base} AS base, {r.least} AS least, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS g, string_split_regex(t, {pattern}) AS gaps FROM d"


def secret_sql() -> str:
    rules = " UNION ALL ".join(_rule(k, r) for k, r in enumerate(RULES))
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({rules}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
spans AS (SELECT doc_id, k, kind, base, CAST({size('gaps[1:i]')} + {size('m[1:i - 1]')} AS BIGINT) AS s, length(m[i]) AS n FROM each WHERE length(g[i]) >= least),
own AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (base) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN own USING (doc_id)
"""


ORACLE_SQL: dict[str, str] = {
    "op5_licence_scan": licence_sql(),
    "op6_url_digests": OP6_SQL,
    "op7_suffix_decontamination": DECONTAMINATION_SQL,
    "op8_secret_ledger": secret_sql(),
}
