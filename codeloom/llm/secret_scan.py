"""Secret scans with an incremental ledger of blobs.

Every text is addressed by its content, every rule by what it says. The ledger
knows which blob was scanned by which version of which rule and what was found;
a run scans only the pairs that are missing from it and joins the findings
back to all rows that hold the blob. Everything is DataFrame functions.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import SENT_ROWS, checkpointed, meet, shared_folder, table, text_or_empty, tidy
from codeloom.runtime import SharedFolder


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` is shorter than ``least`` are dropped after the search. ``gates``: literals, one of which any match holds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    gates: tuple[str, ...] = ()
    base: bool = False

    @property
    def version(self) -> str:
        """Changes with anything that decides what the rule finds."""
        return hashlib.sha256(json.dumps(astuple(self)).encode()).hexdigest()[:16]


#: Base kinds in the order in which they are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, ("AKIA",), base=True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----\s*(?:[A-Za-z][A-Za-z0-9-]*:[^\r\n-]*(?:--?[^\r\n-]+){0,20}[\r\n]*){0,20}[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----)?", 0, 1, ("PRIVATE KEY-----", "PRIVATE KEY BLOCK-----")),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+|github_pat_[A-Za-z0-9_]+|glpat-[A-Za-z0-9_-]+", 0, 24, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", 0, 30, ("eyJ",)),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39, ("AIza",)),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]+", 0, 24, ("k_live_",)),
)
MASK = "[secret]"


SPANS = "array<struct<start:int,rule:string,end:int>>"


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, rule, end) of a rule's matches, leftmost first.

    Matches and the gaps between them alternate, so running sums of their
    lengths are the places.
    """
    p = F.lit(rule.pattern)
    # The third argument keeps trailing gaps; a match is never empty, so there is one gap more than matches.
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, p, F.lit(0))
    checked = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("size"), F.transform(checked, lambda x: F.length(x)).alias("part"))
    kind = SPANS
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        found = F.array(F.struct(begin.alias("start"), F.lit(rule.version).alias("rule"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["spans"], found)).otherwise(acc["spans"]).alias("spans"))

    parts = F.filter(parts, lambda x: x["size"].isNotNull())
    found = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    gate = text.rlike(rule.pattern)
    if rule.gates:
        held = text.contains(rule.gates[0])
        for g in rule.gates[1:]:
            held = held | text.contains(g)
        gate = held & gate
    return F.when(gate, found).otherwise(F.expr(f"cast(array() as {kind})"))


def blob_id(text: Column) -> Column:
    """The content address of a text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of ``blobs`` (blob, text, done): what rules find whose versions are not among ``done``."""
    none = F.expr(f"cast(array() as {SPANS})")
    found = [F.when(F.array_contains("done", r.version), none).otherwise(_spans(F.col("text"), r)) for r in rules]
    return blobs.select("blob", F.concat(*found).alias("spans"))


class Ledger:
    """What was scanned and found, in a folder that all executors share.

    Rows (blob, ruleset, spans) say that all rules of a set have seen a blob,
    and what those found that had not before; a file for each set lists its
    rules' versions. Rows are only added, and each is true by itself, so a
    crash between them loses work but nothing else.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, SharedFolder(spark, path)

    @staticmethod
    def name(rules: tuple[Rule, ...]) -> str:
        return hashlib.sha256(",".join(r.version for r in rules).encode()).hexdigest()[:16]

    def rows(self) -> DataFrame:
        schema = f"blob binary, ruleset string, spans {SPANS}"
        if not self.folder.exists("rows"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder.path}/rows")

    def done(self) -> DataFrame:
        """(blob, done): the versions of all rules that have seen each blob."""
        sets = {n.rpartition("/")[2]: (self.folder.read(n) or "").split(",") for n in self.folder.glob("rulesets/*")}
        if not sets:
            return self.spark.createDataFrame([], "blob binary, done array<string>")
        table_ = F.create_map(*[x for n, versions in sorted(sets.items()) for x in (F.lit(n), F.array(*map(F.lit, versions)))])
        return self.rows().groupBy("blob").agg(F.collect_set("ruleset").alias("sets")).select("blob", F.array_distinct(F.flatten(F.transform("sets", lambda n: F.try_element_at(table_, n)))).alias("done"))

    def add(self, found: DataFrame, rules: tuple[Rule, ...]) -> None:
        name = self.name(rules)
        self.folder.write(f"rulesets/{name}", ",".join(r.version for r in rules))
        found.select("blob", F.lit(name).alias("ruleset"), "spans").write.mode("append").parquet(f"{self.folder.path}/rows")

    def delete(self) -> None:
        self.folder.delete("")


def incremental_scan(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, fresh): rows (doc_id, blob) of ``docs`` and what this run found (blob, spans) in pairs of blob and rule that ``ledger`` did not know.

    The text of a blob is taken from one of its rows, that of the smallest
    doc_id as text. ``fresh`` has a row for each blob that was scanned, clean
    ones included, and is added to the ledger.
    """
    with tidy(docs.sparkSession) as keep:
        rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("blob", blob_id(F.col("text"))).withColumn("id_text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        paths = keep(rows.select("doc_id", "id_text", "blob"))
        first = paths.groupBy("blob").agg(F.min("id_text").alias("id_text"))
        if ledger is None:
            todo = first.withColumn("done", F.expr("cast(array() as array<string>)"))
        else:
            todo = first.join(ledger.done(), "blob", "left").withColumn("done", F.coalesce("done", F.expr("cast(array() as array<string>)")))
            todo = todo.where(F.size(F.array_except(F.array(*[F.lit(r.version) for r in rules]), "done")) > 0)
        n = paths.count()
        todo = checkpointed(todo, n)
        key = ["id_text", "blob"]
        count, partly = todo.count(), todo.where(F.size("done") > 0).count()
        rest = paths.select(*key).distinct().count() - count
        if rest <= min(count, SENT_ROWS) and not partly:
            # Nearly every blob is new: the few other rows are sent around in place of the texts.
            others = paths.select(*key).distinct().join(todo.select(*key), key, "left_anti")
            at = meet(rows, others, key, rest, "blob", "left_anti").withColumn("done", F.expr("cast(array() as array<string>)"))
        else:
            at = meet(rows, todo, key, count, "blob")
        # The new rows are written before anything filters them: a filter on findings would else move below the join and scan every copy.
        fresh = keep(scan(at, rules).dropDuplicates(["blob"]), n)
        if ledger is not None:
            ledger.add(fresh, rules)
        return paths.select("doc_id", "blob"), fresh


def dirty_blobs(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs in which ``rules`` found something; spans are (start, kind, end), kind the place of the rule, in this order."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    kept = found.where(F.size("spans") > 0).select("blob", F.filter("spans", lambda s: F.array_contains(versions, s["rule"])).alias("spans"))
    placed = F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"].alias("start"), (F.array_position(versions, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end")))
    spans = kept.groupBy("blob").agg(F.array_sort(F.array_distinct(placed)).alias("spans"))
    return checkpointed(spans.where(F.size("spans") > 0))


def findings(paths: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row of ``paths``, clean ones with an empty list."""
    dirty = dirty_blobs(found, rules)
    joined = meet(paths, dirty, ["blob"], dirty.count(), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")).alias("spans"))


def _known(docs: DataFrame, ledger: Ledger | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """(paths, found): rows of ``docs`` and all that is known of their blobs after this run."""
    paths, fresh = incremental_scan(docs, ledger, rules)
    return paths, fresh if ledger is None else ledger.rows().select("blob", "spans").join(paths.select("blob").distinct(), "blob", "left_semi")


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Spans are kind:start:end in code points, end exclusive, by start, then kind
    as the rules list them. Null and empty texts have none; texts of any length
    are scanned as a whole. Repeated rows stay, each with the findings of its
    text; rows that share a doc_id are told apart by their texts; rows with a
    null doc_id are scanned as well; other columns are ignored; an empty table
    gives an empty result.
    """
    with tidy(docs.sparkSession) as keep:
        paths, known = _known(docs, ledger, rules)
        found = keep(findings(paths, known, rules))
    order = {r.kind: k for k, r in enumerate(rules) if r.base}
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == order[kind])).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*order.values()))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(base, rules), 256).alias("base_sha256"), _listed(F.col("spans"), rules).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with every stretch that spans cover replaced by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def mask_secrets(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` masked and ``n_chars``, where there is such a column, counted anew.

    Documents are kept, repeated rows and null ids included; clean ones stay as
    they are, null texts null. A row is masked by its own text's findings,
    whatever other rows share its doc_id. An empty table gives an empty result.
    """
    with tidy(docs.sparkSession) as keep:
        _, known = _known(docs, ledger, rules)
        dirty = keep(dirty_blobs(known, rules).toDF("__blob", "__spans"))
    own = docs.columns
    spread = F.xxhash64(F.col("doc_id").cast("string"))
    joined = meet(docs.withColumn("__blob", blob_id(text_or_empty())).withColumn("__spread", spread), dirty, ["__blob"], dirty.count(), "__spread", "left")
    text = F.when(F.col("__spans").isNotNull(), _masked(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    out = joined.withColumn("__text", text)
    changed = {"text": F.col("__text")}
    if "n_chars" in own:
        size = F.length("__text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("__spans").isNotNull(), size).otherwise(F.col("n_chars"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in own])


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document, in two increments over one ledger.

    The first run scans about half of the documents, the second is given all of
    them and scans what is missing. Rules for odd rows as in ``scan_documents``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    with tidy(spark):
        incremental_scan(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger)
    found = scan_documents(docs, ledger)
    ledger.delete()
    return found
