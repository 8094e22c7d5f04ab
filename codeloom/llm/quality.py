"""Document quality by Bradley-Terry pairwise ranking.

A preference pair is a document labelled 1 over one labelled 0; all such
pairs count. The chance that the first wins is the logistic function of the
difference of their scores, and a score is linear in features of the text, so
the model is logistic regression without an intercept on feature differences.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import SENT_ROWS, checkpointed, in_batches, meet, table, text_or_empty, tidy

ACCEPT = 0.7
RIDGE = 1e-3
FEATURES = 10

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?'\"()-"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SIGN = ~(_LETTER | _DIGIT | _STOP | _BLANK)


def features(data: bytes) -> list[float]:
    """Shares of kinds of characters, words and lines of a whole text; zeros for an empty one."""
    if not data:
        return [0.0] * FEATURES
    a = np.frombuffer(data, np.uint8)
    count = np.bincount(a, minlength=256)
    n = len(a)
    letters = max(1, int(count[_LETTER].sum()))
    inside = int(np.count_nonzero(_UPPER[a[1:]] & _LETTER[a[:-1]]))
    words = data.split()
    k = max(1, len(words))
    again = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    long_lines = sum(map(len, lines))
    alone = sum(map(len, set(lines)))
    size = math.log((n + 1) / k)
    return [
        math.sqrt(count[_SIGN].sum() / n),
        math.sqrt(inside / letters),
        math.sqrt(count[_DIGIT].sum() / n),
        math.sqrt(again / k),
        math.log(k) - math.log(max(1, distinct)),
        distinct / k,
        1 - alone / max(1, long_lines),
        size,
        size * size,
        math.sqrt(count[_STOP].sum() / n),
    ]


@dataclass
class Ranking:
    """Weights of standardised features and the raw score at which documents are accepted."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.asarray(self.mean)) / np.asarray(self.scale) * np.asarray(self.weights)).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance to win against a document at the threshold, moved so that the threshold itself gives ``ACCEPT``."""
        z = self.raw(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)) * (1 - ACCEPT) / ACCEPT)


#: Scores are gathered on intervals of this width, each with this many Chebyshev points; sums over all pairs are right to about 1e-12 of their size.
WIDTH, POINTS = 2.0, 16
_AT = np.cos(np.pi * (np.arange(POINTS) + 0.5) / POINTS)
#: Values at the points to coefficients of Chebyshev polynomials.
_COEFFICIENTS = np.cos(np.outer(np.arange(POINTS), np.arccos(_AT))) * np.where(np.arange(POINTS) == 0, 1, 2)[:, None] / POINTS
_I, _J = np.triu_indices(FEATURES + 1)

#: For (label, interval) the sums over its rows of each point's interpolation weight times the products of 1 and the features.
Masses = dict[tuple[int, int], np.ndarray]


def _masses(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> Masses:
    """The rows ``z`` labelled ``y`` gathered by their scores under ``w``."""
    raw = (z * w).sum(1)
    at = np.floor(raw / WIDTH).astype(np.int64)
    inside = np.clip(2 * (raw / WIDTH - at) - 1, -1, 1)
    share = np.cos(np.arccos(inside)[:, None] * np.arange(POINTS)) @ _COEFFICIENTS
    one = np.concatenate([np.ones((len(z), 1)), z], axis=1)
    products = one[:, _I] * one[:, _J]
    out = {}
    for label, k in np.unique(np.stack([y, at], axis=1), axis=0).tolist():
        own = (y == label) & (at == k)
        out[label, k] = share[own].T @ products[own]
    return out


def _add(total: Masses, more: Masses) -> None:
    for k, m in more.items():
        total[k] = total[k] + m if k in total else m


def _gathered(masses: Masses, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a label's points, and the sums at each of 1, the features and their products."""
    at = sorted(k for y, k in masses if y == label)
    scores = np.concatenate([WIDTH * (k + (_AT + 1) / 2) for k in at])
    m = np.zeros((len(scores), FEATURES + 1, FEATURES + 1))
    m[:, _I, _J] = m[:, _J, _I] = np.concatenate([masses[label, k] for k in at])
    return scores, m[:, 0, 0], m[:, 0, 1:], m[:, 1:, 1:]


def _newton(gather: Callable[[np.ndarray], Masses], ridge: float) -> np.ndarray:
    """The weights of the largest mean log-likelihood over all pairs of a row labelled 1 and one labelled 0, less the ridge.

    The chance of a pair depends on two scores alone and is smooth in both, so
    a pass over the rows, ``gather``, gives all that the sums over pairs need.
    """
    w = np.zeros(FEATURES)
    for _ in range(40):
        masses = gather(w)
        s1, n1, x1, xx1 = _gathered(masses, 1)
        s0, n0, x0, xx0 = _gathered(masses, 0)
        grad, hess = np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))
        for k in range(0, len(s1), POINTS):  # an interval at a time, so that memory grows with the intervals only
            part = slice(k, k + POINTS)
            lose = 1 / (1 + np.exp(np.clip(s1[part, None] - s0, -60, 60)))
            both = lose * (1 - lose)
            grad += (lose @ n0) @ x1[part] - (n1[part] @ lose) @ x0
            cross = x1[part].T @ both @ x0
            hess += np.tensordot(both @ n0, xx1[part], 1) + np.tensordot(n1[part] @ both, xx0, 1) - cross - cross.T
        pairs = n1.sum() * n0.sum()
        step = np.linalg.solve(hess / pairs + ridge * np.eye(FEATURES), grad / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return _rounded(w, 9)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """So many significant digits, beyond which the order of summation shows."""
    return np.array([float(f"{v:.{digits}g}") for v in x])


def _neutral() -> Ranking:
    """Without rows of both labels every document scores at the threshold."""
    return Ranking([0.0] * FEATURES, [1.0] * FEATURES, [0.0] * FEATURES, 0.0)


def fit(x: np.ndarray, y: np.ndarray, share_of_ones: float, ridge: float = RIDGE) -> Ranking:
    """The ranking learnt from all pairs of rows ``x`` labelled ``y``; ``share_of_ones``: label 1 among all labelled rows.

    The threshold is the score quantile below which the share of label 0 lies,
    each label weighing as it does among all labelled rows. Without rows of
    both labels every document scores at the threshold.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return _neutral()
    mean, scale = _rounded(x.mean(0), 12), _rounded(x.std(0), 12) + 1e-9
    w = _newton(lambda w: _masses((x - mean) / scale, y, w), ridge)
    ranking = Ranking(mean.tolist(), scale.tolist(), w.tolist(), 0.0)
    raw = ranking.raw(x)
    weight = np.where(y == 1, share_of_ones / len(good), (1 - share_of_ones) / len(bad))
    order = np.lexsort((y, raw))
    below = np.cumsum(weight[order])
    k = min(len(raw) - 1, int(np.searchsorted(below, 1 - share_of_ones + 1e-12)))
    at = raw[order]
    ranking.threshold = float((at[k] + at[max(0, k - 1)]) / 2)
    return ranking


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept apart from learning: crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _feature_rows(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but for the text, and x: its features."""
    names = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([features(x) for x in b.column("__data").to_pylist()], pa.list_(pa.float64()))], [*names, "x"])

    return in_batches(rows.select(*names, text_or_empty().cast("binary").alias("__data")), work, f"{kinds}, x array<double>")


#: Tasks at most that send their sums to the driver in one pass, and parts that a range of scores is counted in.
SENDERS, PARTS = 32, 4096


def _gather(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> Callable[[np.ndarray], Masses]:
    """A pass over the feature rows that sums them up for ``_newton``; what a task sends grows with the range of scores, not with its rows."""

    def gather(w: np.ndarray) -> Masses:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Masses = {}
            for b in batches:
                _add(total, _masses((_matrix(b) - mean) / scale, b.column("y").to_numpy(), w))
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array([m.tobytes() for m in total.values()], pa.binary())], ["y", "k", "m"])

        out: Masses = {}
        for r in in_batches(rows.coalesce(SENDERS), work, "y long, k long, m binary").collect():
            _add(out, {(r["y"], r["k"]): np.frombuffer(r["m"], float).reshape(POINTS, -1)})
        return out

    return gather


def _threshold(raw: DataFrame, weights: tuple[float, float], target: float) -> float:
    """The least score at which the rows up to it, label 0 first among equals, weigh ``target`` or more; the middle between it and the score of the row before.

    ``raw`` (y, raw); ``weights`` of a row of either label. The range in which
    it lies is counted in parts until one score is left, so the result is exact.
    """
    lo, hi = raw.agg(F.min("raw"), F.max("raw")).first()
    below = [0, 0]
    weigh = lambda n: n[0] * weights[0] + n[1] * weights[1]
    while lo < hi:
        part = F.least(F.floor((F.col("raw") - lo) / ((hi - lo) / PARTS)), F.lit(PARTS - 1))
        counts = [F.count(F.when(F.col("y") == y, 1)).alias(f"n{y}") for y in (0, 1)]
        found = raw.where(F.col("raw").between(lo, hi)).groupBy(part.alias("part")).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), *counts).collect()
        for r in sorted(found, key=lambda r: r["lo"]):
            lo, hi = r["lo"], r["hi"]
            upto = [below[0] + r["n0"], below[1] + r["n1"]]
            if weigh(upto) >= target:
                break
            below = upto
        else:
            below = [upto[0] - r["n0"], upto[1] - r["n1"]]
    first = 0 if not raw.where((F.col("raw") == lo) & (F.col("y") == 0)).isEmpty() else 1
    below[first] += 1
    before = raw.where(F.col("raw") < lo).agg(F.max("raw")).first()[0]
    return lo if before is None or weigh(below) < target else (lo + before) / 2


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """A ranking from all labelled documents that are not held out, as ``fit`` makes it.

    Null labels and ids whose label rows disagree are left out. The features
    are written once; a pass over them for each step of the fit sends sums to
    the driver.
    """
    with tidy(docs.sparkSession):
        known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("top")).where("y = top").drop("top")
        counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out())
        if total <= SENT_ROWS:
            rows = _feature_rows(texts.join(F.broadcast(known), "doc_id").select("y", "text"))
        else:  # features meet the labels, not texts
            rows = meet(_feature_rows(texts), known, ["doc_id"], total, "x").select("y", "x")
        rows = checkpointed(rows)
        by_label = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(by_label) < 2:
            return _neutral()
        x = [F.get("x", F.lit(k)) for k in range(FEATURES)]
        about = rows.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
        mean, scale = _rounded(about[:FEATURES], 12), _rounded(about[FEATURES:], 12) + 1e-9
        w = _newton(_gather(rows, mean, scale), RIDGE)
        ranking = Ranking(mean.tolist(), scale.tolist(), w.tolist(), 0.0)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(ranking.raw(_matrix(b)))], ["y", "raw"])

        raw = checkpointed(in_batches(rows, work, "y int, raw double"), sum(by_label.values()))
        ones = counts[1] / total
        ranking.threshold = _threshold(raw, ((1 - ones) / by_label[0], ones / by_label[1]), 1 - ones + 1e-12)
        return ranking


def with_scores(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``docs`` with a column score, which replaces one of that name; null and empty texts are scored as empty, texts of any length as a whole. Rows, repeated ones too, and other columns stay; an empty table gives an empty result."""
    docs = docs.drop("score")
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column("__data").to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(ranking.score(x))], [*names, "score"])

    return in_batches(docs.withColumn("__data", text_or_empty().cast("binary")), work, f"{kinds}, score double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score ``ACCEPT`` or more under a ranking learnt from ``labels``, columns as they are.

    Equal texts have equal scores, so repeated rows stay or go together; null
    texts are scored as empty ones; an id may be null. Without usable labels
    every document is kept; an empty table gives an empty result.
    """
    scored = with_scores(docs.select("text", F.struct(*docs.columns).alias("__keep")), learn(docs, labels))
    return scored.where(F.col("score") >= ACCEPT).select("__keep.*")


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; rules for odd rows as in ``with_scores``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
