"""Licence scans with a positional index of rare words.

The index holds, for the rarest words of each template's mandatory phrases by
how many documents have them, where in which template they stand. A file's
licence words are looked up in it; the postings of a template's words that
agree in their relative position give the places where the template can begin,
and its mandatory phrases decide. The tables of templates travel as data, so
the plan does not grow with them. Everything is DataFrame functions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import ascii_lower, table, text_or_empty

#: A word of a lower-cased text; before lower-casing A-Z belong to it as well.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that label a text wherever their words stand side by side.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    """Words of a licence notice, and the phrases in it that have to be there."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def offsets(self) -> list[tuple[int, list[str]]]:
        """(place in the notice, words) of each mandatory phrase."""
        out = []
        for p in self.phrases:
            w = p.split()
            out.append((next(k for k in range(len(self.words)) if self.words[k : k + len(w)] == w), w))
        return out


def _spdx(identifier: str) -> Template:
    """The line by which a file names its licence."""
    words = "spdx license identifier " + " ".join(identifier.replace("-", " ").replace(".", " ").split())
    return Template(identifier, words, (words,))


# Licence notices in lower-case words, and the identifiers that files name licences by.
_NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    Template("apache-1.1", "apache software license version 1 1", ("apache software license version 1 1",)),
    Template("apache-1.1", "the apache license version 1 1", ("apache license version 1 1",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge", "obtaining a copy of this software")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute", "fee is hereby granted")),
    Template("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and distribute", "fee is hereby granted")),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2 of the license")),
    Template("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3 of the license")),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("lgpl", "gnu library general public license", ("gnu library general public license",)),
    Template("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license", "either version 2 1 of the license")),
    Template("lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license", "either version 3 of the license")),
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Template("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "either version 3 of the license")),
    Template("mpl-1.1", "mozilla public license version 1 1", ("mozilla public license version 1 1",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("epl-1.0", "eclipse public license v1 0", ("eclipse public license v1 0",)),
    Template("epl-2.0", "eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-2-clause", "bsd 2 clause license", ("bsd 2 clause",)),
    Template("bsd-3-clause", "bsd 3 clause license", ("bsd 3 clause",)),
    Template("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    Template("cc-by-nc", "creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "creative commons attribution sharealike", ("creative commons attribution sharealike",)),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    Template("boost", "boost software license version 1 0", ("boost software license version 1 0",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable for any damages arising from the use of this software",)),
    Template("artistic-2.0", "artistic license 2 0", ("artistic license 2 0",)),
    Template("wtfpl", "do what the fuck you want to public license", ("want to public license",)),
)
_IDENTIFIERS = "mit isc zlib unlicense apache-2.0 apache-1.1 gpl-2.0 gpl-3.0 lgpl-2.1 lgpl-3.0 agpl-3.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 bsd-2-clause bsd-3-clause cc-by-4.0 cc-by-sa-4.0 cc-by-nc-4.0 cc0-1.0 bsl-1.0 artistic-2.0 wtfpl".split()
TEMPLATES = (*_NOTICES, *map(_spdx, _IDENTIFIERS))

#: Words too common in any text, of one language or another, to look a licence up by.
COMMON = frozenset(
    "a and any are as at be by for from in into is of on or the this to under use used with without want what will you your no not may be can"
    " 0 1 2 3 4 v v1 free all mit nc nd sa public version software source forms copy modify person charge fee held event authors name names products"
    " terms derived domain released library license purpose international attribution clause bsd".split()
)
#: A template's rarest words whose positions are intersected.
ANCHORS = 2


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    """Licence words: those of the templates' mandatory phrases and of the base phrases that are not common; all words of a phrase list that has no others."""
    words = {w for p, _ in BASE for w in p.split()} - COMMON
    for t in templates:
        own = {w for p in t.phrases for w in p.split()}
        words |= own - COMMON or own
    return sorted(words)


def _gate(text: Column, words: list[str]) -> Column:
    """Whether any licence word can occur: long ones as part of other words too, short ones between other characters; the exact look-up follows.

    Searches for fixed strings are several times as fast as one pattern of all
    words that ignores case.
    """
    held = [text.contains(w) & text.rlike(f"(?<![0-9a-z]){w}(?![0-9a-z])") if len(w) < 4 else text.contains(w) for w in words]
    while len(held) > 1:  # a balanced tree: a chain of many words would be too deep
        held = [a | b for a, b in zip(held[::2], held[1::2], strict=False)] + held[len(held) & ~1 :]
    return held[0] if held else F.lit(False)


def licence_words(docs: DataFrame, vocab: list[str], gates: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(carried columns, n_words, words, hits) of every row; hits: (i, w), place and word of each word of ``vocab``.

    ``words`` is empty where a text has no word of ``gates``.
    """
    rows = docs.select(*carry, text_or_empty().alias("text"))
    rows = rows.withColumn("lower", F.lower("text")).withColumn("gated", _gate(F.col("lower"), gates)).drop("lower")
    rows = rows.withColumn("words", F.when(F.col("gated"), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")))
    n_words = F.when(F.col("gated"), F.size("words")).otherwise(F.regexp_count("text", F.lit(ANY_CASE_WORD))).cast("long")
    at = F.transform("words", lambda w, i: F.when(w.isin(vocab), F.struct(i.alias("i"), w.alias("w"))))
    return rows.select(*carry, n_words.alias("n_words"), "words", F.filter(at, lambda x: x.isNotNull()).alias("hits"))


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Documents that hold each licence word, over all documents; at most one entry for each licence word reaches the driver."""
    vocab = vocabulary(templates)
    hits = licence_words(docs, vocab, vocab).select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w"))
    return {r["w"]: r["n"] for r in hits.groupBy("w").agg(F.count("*").alias("n")).collect()}


def anchors(template: Template, frequency: dict[str, int], count: int = ANCHORS) -> list[tuple[int, str]]:
    """(offset, word) of the template's rarest words inside its mandatory phrases; ties go to the first. Common words count only where there are no others."""
    inside = {k + j: w for k, words in template.offsets() for j, w in enumerate(words)}
    own = {k: w for k, w in inside.items() if w not in COMMON} or inside
    seen: dict[str, int] = {}
    for _, k, w in sorted((frequency.get(w, 0), k, w) for k, w in own.items()):
        seen.setdefault(w, k)
    return [(k, w) for w, k in seen.items()][:count]


@dataclass(frozen=True)
class Index:
    """Postings of the templates' rarest words, and what is needed to check a place; all as literals of the plan."""

    postings: Column  #: word to (template, offset, first, last): whether it opens and closes the intersection
    phrases: Column  #: of each template, (offset, words)
    words: Column
    labels: Column
    vocab: list[str]
    gates: list[str]


def build_index(templates: tuple[Template, ...], frequency: dict[str, int]) -> Index:
    postings: dict[str, list[dict]] = {}
    gates = {w for p, _ in BASE for w in p.split()} - COMMON
    for t, template in enumerate(templates):
        own = anchors(template, frequency)
        gates.add(own[0][1])
        for k, (offset, word) in enumerate(own):
            postings.setdefault(word, []).append({"t": t, "o": offset, "first": k == 0, "last": k == len(own) - 1})
    parsed = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    return Index(
        parsed(postings, "map<string,array<struct<t:int,o:int,first:boolean,last:boolean>>>"),
        parsed([[{"o": o, "w": w} for o, w in t.offsets()] for t in templates], "array<array<struct<o:int,w:array<string>>>>"),
        parsed([t.words for t in templates], "array<array<string>>"),
        parsed([t.label for t in templates], "array<string>"),
        sorted(set(postings) | gates),
        sorted(gates),
    )


#: A template and a place in one number; a template may begin before the text does.
_SHIFT, _BEFORE = 1 << 40, 1 << 20


def _places(index: Index) -> Column:
    """(t, s): templates whose rarest words stand in their relative places, and where they begin."""
    looked = F.filter(F.transform("hits", lambda h: F.struct(h["i"].alias("i"), F.try_element_at(index.postings, h["w"]).alias("p"))), lambda x: x["p"].isNotNull())

    def posted(which: str) -> Column:
        return F.flatten(F.transform(looked, lambda x: F.transform(F.filter(x["p"], lambda p: p[which]), lambda p: p["t"].cast("long") * _SHIFT + (x["i"] - p["o"] + _BEFORE))))

    agreed = F.array_intersect(posted("first"), posted("last"))
    return F.transform(agreed, lambda c: F.struct((c / _SHIFT).cast("int").alias("t"), (c % _SHIFT - _BEFORE).cast("int").alias("s")))


def _phrase_at(start: Column, offset: int, words: list[str]) -> Column:
    same = F.get("words", start + offset) == words[0]
    for j, w in enumerate(words[1:], 1):
        same = same & (F.get("words", start + offset + j) == w)
    return F.coalesce(same, F.lit(False))


_NONE = "cast(array() as array<int>)"


def _base_starts(phrase: str) -> Column:
    words = phrase.split()
    key = next(w for w in words if w not in COMMON)
    k = words.index(key)
    at = F.transform(F.filter("hits", lambda h: h["w"] == key), lambda h: h["i"] - k)
    return F.filter(at, lambda s: (s >= 0) & _phrase_at(s, 0, words))


def scan_licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base: all places of base phrases; first_word and last_word: their
    smallest and largest start, null without one. labels: those of base
    phrases and of templates, distinct, sorted, comma-joined. score: 1 with a
    base phrase, else the largest share of a found template's words that stand
    at their places, else 0. A null text counts as empty; texts of any length
    are searched as a whole; repeated rows and null ids stay; other columns are
    ignored; an empty table gives an empty result.
    """
    index = build_index(templates, document_frequencies(docs, templates))
    rows = licence_words(docs, index.vocab, index.gates, ("doc_id",))
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"b{k}", F.when(F.size("hits") > 0, _base_starts(phrase)).otherwise(F.expr(_NONE)))
    stands = lambda s, p: (s + p["o"] >= 0) & (F.slice("words", F.greatest(s + p["o"], F.lit(0)) + 1, F.size(p["w"])) == p["w"])
    whole = lambda x: F.forall(F.get(index.phrases, x["t"]), lambda p: stands(x["s"], p))
    rows = rows.withColumn("places", F.when(F.size("hits") > 0, _places(index))).withColumn("found", F.filter("places", whole))
    words = lambda x: F.get(index.words, x["t"])
    matched = lambda x: F.size(F.filter(F.transform(words(x), lambda w, i: F.coalesce(F.get("words", x["s"] + i) == w, F.lit(False))), lambda m: m))
    share = F.coalesce(F.array_max(F.transform("found", lambda x: matched(x).cast("double") / F.size(words(x)))), F.lit(0.0))
    base = [F.col(f"b{k}") for k in range(len(BASE))]
    n_base = sum((F.size(b) for b in base[1:]), F.size(base[0]))
    flag = lambda name, label: F.when(F.size(name) > 0, F.lit(label))
    base_labels = F.array_compact(F.array(*[flag(f"b{k}", label) for k, (_, label) in enumerate(BASE)]))
    own = F.coalesce(F.transform("found", lambda x: F.get(index.labels, x["t"])), F.expr("cast(array() as array<string>)"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.least(*[F.array_min(b) for b in base]).cast("long").alias("first_word"),
        F.greatest(*[F.array_max(b) for b in base]).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, own)).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``scan_licences`` says of every document; rules for odd rows as there."""
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
