"""URL rules in a sorted array of digests.

A rule is a host and the start of a path. Its key is the 64-bit XXH64 of both;
the keys are sorted in one file beside the rules' full strings, which Spark
brings to every executor once and all its workers map into memory. A URL is
probed for every suffix of its host and every rule length that its path
reaches, by vectorised binary search; a hit counts once the stored strings
agree, so equal digests of different rules do no harm.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import UPPER, LOWER, checkpointed, in_batches, table

SEED = 42
#: Bytes of the file of rules that goes to every executor; more rules are met by a join on their digests.
MOST_BYTES = 1 << 30

#: (verdict, rule); a rule's host goes up to its first slash.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The method's own verdict: a URL that no stored rule fits passes.
DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for what has no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def digest(host: str, path: str) -> int:
    """XXH64 of host and path, as a signed number; ``F.xxhash64`` of the same text."""
    h = xxhash.xxh64_intdigest(f"{host}\n{path}".encode(), SEED)
    return h - (1 << 64) if h >= 1 << 63 else h


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    parts = host.split(".")
    return [".".join(parts[k:]) for k in range(len(parts))]


class DigestArray:
    """Sorted digests, their rules' strings and verdicts, mapped from one file.

    The file has the number of rules and the sizes of strings and names, then
    digests, ends of strings, strings, verdicts, and the names of verdicts with
    the lengths that the paths of rules have.
    """

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, text, names = data[:24].view(np.int64).tolist()
        at = np.cumsum([24, 8 * n, 8 * n, text, n, names]).tolist()
        self.keys, self.ends = data[at[0] : at[1]].view(np.int64), data[at[1] : at[2]].view(np.int64)
        self.text, self.verdict = data[at[2] : at[3]], data[at[3] : at[4]]
        self.verdicts, self.lengths = json.loads(data[at[4] : at[5]].tobytes() or b"[[], []]")

    @staticmethod
    def write(rules: Iterable[tuple[int, str, str]], folder: str) -> str:
        """A file in ``folder`` of ``rules`` (digest, rule, verdict), which come in order and are not held in memory; its name tells its content."""
        parts = {k: os.path.join(folder, k) for k in ("keys", "ends", "text", "verdict")}
        out = {k: open(p, "wb") for k, p in parts.items()}
        names: dict[str, int] = {}
        lengths: set[int] = set()
        n = text = 0
        for key, rule, verdict in rules:
            spelt = rule.encode()
            n, text = n + 1, text + len(spelt)
            lengths.add(len(split_rule(rule)[1]))
            out["keys"].write(key.to_bytes(8, "little", signed=True))
            out["ends"].write(text.to_bytes(8, "little"))
            out["text"].write(spelt)
            out["verdict"].write(bytes([names.setdefault(verdict, len(names))]))
        for f in out.values():
            f.close()
        meta = json.dumps([list(names), sorted(lengths, reverse=True)]).encode()
        whole, seen = os.path.join(folder, "whole"), hashlib.sha256()
        with open(whole, "wb") as f:
            for block in (np.array([n, text, len(meta)], np.int64).tobytes(), *parts.values(), meta):
                if isinstance(block, bytes):
                    f.write(block)
                    seen.update(block)
                else:
                    with open(block, "rb") as part:
                        while piece := part.read(1 << 20):
                            f.write(piece)
                            seen.update(piece)
                    os.remove(block)
        path = os.path.join(folder, f"digests-{seen.hexdigest()[:24]}.bin")
        os.replace(whole, path)
        return path

    def rule(self, j: int) -> str:
        return self.text[self.ends[j - 1] if j else 0 : self.ends[j]].tobytes().decode()

    def find(self, hosts: list[str], paths: list[str]) -> list[int]:
        """For each URL the place of its longest fitting rule, or -1.

        Rules that fit one URL differ in length unless they are one rule on a
        longer host with a shorter path; then the longer host wins.
        """
        row, rule, keys = [], [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            for h in suffixes(host):
                for n in self.lengths:
                    if n <= len(path):
                        row.append(k)
                        rule.append((h, path[:n]))
                        keys.append(digest(h, path[:n]))
        best: list[tuple[int, int, int]] = [(-1, -1, -1)] * len(hosts)
        if keys and len(self.keys):
            probe = np.array(keys, np.int64)
            at = np.searchsorted(self.keys, probe)
            hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe)
            for i in hit.tolist():
                j, (h, p) = int(at[i]), rule[i]
                while j < len(self.keys) and self.keys[j] == probe[i]:  # several rules may share a digest
                    if self.rule(j) == h + p:
                        best[row[i]] = max(best[row[i]], (len(h) + len(p), len(h), j))
                    j += 1
        return [b[2] for b in best]


#: Files that an application already has.
_ADDED: set[tuple[str, str]] = set()
_MAPPED: dict[str, DigestArray] = {}


def _mapped(name: str) -> DigestArray:
    """The array of a file that Spark brought to this executor, mapped once for each worker."""
    if name not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[name] = DigestArray(SparkFiles.get(name))
    return _MAPPED[name]


def _sorted_rules(spark: SparkSession, rules: DataFrame | Iterable[tuple[str, str]]) -> DataFrame:
    """(key, rule, verdict) of distinct rules; of given pairs that repeat a rule the first holds, of rows the least verdict."""
    if not isinstance(rules, DataFrame):
        first: dict[str, str] = {}
        for verdict, rule in rules:
            first.setdefault(rule, verdict)
        rules = spark.createDataFrame([(v, r) for r, v in first.items()], "verdict string, rule string")
    own = rules.where("verdict is not null and rule is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    host = F.substring_index("rule", "/", 1)
    key = F.xxhash64(F.concat(host, F.lit("\n"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")))
    return own.select(key.alias("key"), "rule", "verdict")


def judge_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str]] = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url", most: int = MOST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's; the longest rule wins, of equally long ones that with the longer
    host. rule is null and the verdict ``default`` where none fits, as for null
    and malformed URLs, whose host and path are empty. URLs of any length are
    judged as a whole; rows stay, repeated ones and those with a null id too;
    other columns are ignored; an empty table gives an empty result.
    ``rules``: pairs or a DataFrame (verdict, rule), of at most 256 verdicts;
    up to ``most`` bytes travel as one file, more are joined by digest.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    own = checkpointed(_sorted_rules(spark, rules))
    if (own.agg(F.sum(F.octet_length("rule") + 17)).first()[0] or 0) > most:
        return _judge_by_join(rows, own, default)
    folder = tempfile.mkdtemp(prefix="codeloom-digests-")
    file = DigestArray.write(((r["key"], r["rule"], r["verdict"]) for r in own.orderBy("key", "rule").toLocalIterator()), folder)
    name = os.path.basename(file)
    if (spark.sparkContext.applicationId, name) in _ADDED:  # the same rules, of an earlier call
        shutil.rmtree(folder, ignore_errors=True)
    else:
        # The driver serves the file from its folder; executors keep copies that go with the application.
        weakref.finalize(spark.sparkContext, shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addFile(file)
        _ADDED.add((spark.sparkContext.applicationId, name))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped(name)
        for b in batches:
            found = index.find(b.column("host").to_pylist(), b.column("path").to_pylist())
            rule = pa.array([index.rule(j) if j >= 0 else None for j in found], pa.string())
            verdict = pa.array([index.verdicts[index.verdict[j]] if j >= 0 else default for j in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), rule, verdict], ["page_id", "host", "path", "rule", "verdict"])

    return in_batches(rows, work, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def _judge_by_join(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rule sets beyond the bound: URLs and ``rules`` (key, rule, verdict) meet by the digest of host and path start.

    Distinct (host, path) pairs are probed, so a hot URL costs no more than a
    rare one; the lengths of rule paths come to the driver, at most one for
    each length. What has no host takes no part.
    """
    own = rules.select("key", "rule", F.col("verdict").alias("rule_verdict"), F.substring_index("rule", "/", 1).alias("h"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("p"))
    lengths = [r[0] for r in own.select(F.length("p")).distinct().collect()]
    urls = rows.select("host", "path").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    probes = urls.select("host", "path", F.explode(tails).alias("h")).select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).where("n <= length(path)")
    probes = probes.withColumn("p", F.expr("substring(path, 1, n)"))
    hits = probes.withColumn("key", F.xxhash64(F.concat("h", F.lit("\n"), "p"))).join(own, ["key", "h", "p"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.length("h"), "rule", "rule_verdict")).alias("b"))
    # Written, so that both sides of the join are dealt anew and the rows of a hot URL can be split.
    best = checkpointed(best.select("host", "path", "b.rule", "b.rule_verdict"))
    found = rows.where("host <> ''").join(best, ["host", "path"], "left")
    out = found.unionByName(rows.where("host = ''"), allowMissingColumns=True)
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def op6_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; rules for odd rows as in ``judge_urls``."""
    return judge_urls(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), f AS (
  SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM s LEFT JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""
