"""One-permutation MinHash fingerprints, in DataFrame functions only.

Every shingle is hashed once. The hash's first bits choose a bin, the smallest
hash of a bin stands for it, and its low bits are stored. An empty bin takes
the value of a filled one: candidates come in an order that depends on the bin
alone, so two texts that both lack it and agree on what is filled choose alike
(optimal densification). Equal low bits of different hashes are corrected for
when fingerprints are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import table, text_or_empty

WIDTH = 5
#: 2**BIN_BITS bins of LOW_BITS bits each.
BIN_BITS, LOW_BITS = 8, 8
BINS = 1 << BIN_BITS
#: Candidates tried one by one before all filled bins are ranked.
TRIES = 8
#: Ranges of ids that neighbours are looked for in, at most, and how many there are for each shuffle partition.
MOST_RANGES, RANGES_PER_PARTITION = 4096, 4

_HEX = "array(" + ",".join(f"'{x:02x}'" for x in range(256)) + ")"


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS) + (BINS >> 1)


def with_bins(df: DataFrame, text: str, out: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``out``: the low bits of each bin (array of tinyint), null for a text without words.

    Words are runs without ASCII white space, lower-cased; shingles have
    ``width`` words, or all words of a shorter text.
    """
    keep = df.columns
    words = F.split(F.btrim(F.lower(F.col(text)), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    # One select for each step, so that every array is made once.
    df = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("__words"))
    runs = F.slice("__words", F.lit(1), F.greatest(F.size("__words") - (width - 1), F.lit(1)))
    shingles = F.transform(runs, lambda x, i: F.xxhash64(x, *[F.get("__words", i + k) for k in range(1, width)]))
    df = df.select(*keep, F.sort_array(shingles).alias("__all"))
    first = F.filter("__all", lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get("__all", i - 1), 64 - BIN_BITS)))
    df = df.select(*keep, first.alias("__least"))
    none = F.lit(None).cast("tinyint")

    def placed(x: Column, i: Column) -> Column:
        after = F.coalesce(_bin(F.get("__least", i + 1)), F.lit(BINS))
        low = F.shiftright(F.shiftleft(x, 64 - LOW_BITS), 64 - LOW_BITS).cast("tinyint")
        return F.concat(F.array(low), F.array_repeat(none, (after - _bin(x) - 1).cast("int")))

    before = F.array_repeat(none, _bin(F.get("__least", F.lit(0))).cast("int"))
    df = df.select(*keep, "__least", F.concat(before, F.flatten(F.transform("__least", placed))).alias("__open"))

    def filled(j: Column) -> Column:
        tried = [F.get("__open", F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(TRIES)]
        ranked = F.array_min(F.transform("__least", lambda x: F.struct(F.xxhash64(j, F.lit(TRIES), _bin(x)).alias("rank"), _bin(x).cast("int").alias("bin"))))
        return F.coalesce(F.get("__open", j), *tried, F.get("__open", ranked["bin"]))

    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), filled)
    blank = F.length(F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r"))) == 0
    return df.select(*keep, F.when(~blank, bins).alias(out))


def fingerprint(bins: Column) -> Column:
    """Two hexadecimal digits for each bin; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(bins, lambda x: F.element_at(F.expr(_HEX), F.pmod(x.cast("int"), F.lit(256)) + 1)), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two texts' shingle sets, 0 to 1; two texts without words are alike, one of them is unlike any other."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / float(BINS)
    chance = 1.0 / (1 << LOW_BITS)
    both = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a.isNotNull() & b.isNotNull(), both).when(a.isNull() & b.isNull(), 1.0).otherwise(0.0)


def _range_starts(ids: DataFrame, count: int) -> list[int]:
    """At most ``count - 1`` ids that divide all into ranges of about the same number of rows."""
    shares = [k / count for k in range(1, count)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 20 * count)).first()[0]
    return sorted(set(found or []))


def beside_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``range``, ``extra`` and ``tie``: rows of a range are neighbours in descending doc_id.

    Each range also gets the first row of the range that follows (of the first
    one after the last) as an extra row, so that the next row of every row is
    in its own range. Only ids, one for each range, reach the driver.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = _range_starts(docs.select("doc_id"), max(2, min(MOST_RANGES, RANGES_PER_PARTITION * partitions)))
    bounds = F.array(*[F.lit(x).cast("long") for x in starts]) if starts else F.expr("cast(array() as array<long>)")
    # Ids above a start share a range with it; null ids come last and have range -1.
    of = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    ranged = docs.select("doc_id", "text", of.alias("range"), F.xxhash64("text").alias("tie"))
    top = sorted((r["range"], r["top"]) for r in docs.select("doc_id", of.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top")).collect())
    after = {r: top[k - 1] for k, (r, _) in enumerate(top)}
    rows = [(target, source, first) for target, (source, first) in after.items()]
    firsts = docs.sparkSession.createDataFrame(rows, "target int, source int, first long")
    # As many rows as there are ranges.
    extra = ranged.join(F.broadcast(firsts), (F.col("range") == F.col("source")) & F.col("doc_id").eqNullSafe(F.col("first")))
    extra = extra.select("doc_id", "text", F.col("target").alias("range"), "tie", F.lit(1).alias("extra"))
    return ranged.withColumn("extra", F.lit(0)).unionByName(extra)


def fingerprint_edits(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the row's own with its last half replaced by the start
    of the next one's, rows in descending doc_id, of equal ids those of the
    smaller text hash first, null ids last; the first follows the last. A null
    text counts as empty; a single row is its own next; texts of any length are
    read as a whole; repeated rows stay, each with a next of its own; other
    columns are ignored; an empty table gives an empty result.
    """
    from pyspark.sql import Window

    rows = beside_next(docs.select("doc_id", text_or_empty().alias("text")))
    order = Window.partitionBy("range").orderBy("extra", F.desc_nulls_last("doc_id"), "tie")
    rows = rows.withColumn("next", F.lead("text").over(order))
    rows = with_bins(rows, "text", "bins", width).withColumn("next_bins", F.lead("bins").over(order)).where("extra = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "bins", "next_bins", edited.alias("edited"))
    rows = with_bins(rows, "edited", "edited_bins", width)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("bins")).alias("fingerprint"),
        fingerprint(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``fingerprint_edits`` says of every document; rules for odd rows as there."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
