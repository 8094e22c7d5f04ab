"""SimHash fingerprints, BK-tree search in shards, and near-duplicate groups.

A BK-tree over 64-bit fingerprints prunes little, so one tree over everything
would cost time that grows with the square of the corpus, and broadcasting it
would grow with the data. The trees here belong to shards that the shuffle
brings together: fingerprints within r bits of each other agree on m - r of m
blocks, so the shards of all choices of m - r blocks together hold every pair.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import SENT_ROWS, checkpointed, connected_components, in_batches, meet, table, text_or_empty, tidy

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
RADIUS = 4
#: Rows of whole shards that a task searches at once (a larger shard is taken whole; see ``DENSE_ROWS``).
BLOCK_ROWS = 60_000
#: Pairs of query and row that are followed at once.
WALK_PAIRS = 250_000
#: Fingerprints that a shard should hold on average at most; more blocks are used beyond it.
SHARD_ROWS = 2048
_H = xxhash.xxh64_intdigest


def words_of(data: bytes) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return data.translate(FOLD).split()


def shingle_hashes(words: list[bytes], width: int, block: int = 65_536) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``width`` words (of all words if there are fewer), in blocks."""
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - width + 1)].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    for at in range(0, len(starts), block):
        yield np.array([_H(joined[a:b], SEED) for a, b in zip(starts[at : at + block], stops[at : at + block], strict=True)], dtype=np.uint64)


def fingerprint(words: list[bytes], width: int) -> int:
    """The 64 majority bits of the shingles' hashes, repeats included; 0 without words."""
    total, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(words, width):
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


class Forest:
    """BK-trees of many shards in flat arrays.

    ``shard`` is sorted; a shard's first row is its root. Children are keyed by
    their distance to the parent, ``keys`` sorts them by parent and distance,
    and a parent always stands before its children.
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        n = len(fps)
        self.fps, self.n = fps, n
        first = np.concatenate([[True], shard[1:] != shard[:-1]]) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = []
        rows = np.flatnonzero(~first)
        at = self.root[rows]
        while len(rows):
            d = self.distance(rows, at)
            _, lead, back = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            child = rows[lead]
            self.parent[child], self.edge[child] = at[lead], d[lead]
            self.levels.append(child)
            below = child[back]
            stay = below != rows
            rows, at = rows[stay], below[stay]
        kids = np.flatnonzero(self.parent >= 0)
        keys = self.parent[kids] * 65 + self.edge[kids]
        order = np.argsort(keys, kind="stable")
        self.kids, self.keys = kids[order], keys[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).astype(np.int64)

    def walk(self, queries: np.ndarray, radius: int, enter: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance) of every node within ``radius``; ``enter`` says which subtrees are worth it."""
        todo = [(queries, self.root[queries])]
        while todo:
            q, node = todo.pop()
            d = self.distance(q, node)
            near = d <= radius
            if near.any():
                yield q[near], node[near], d[near]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            size = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right") - lo
            some = np.flatnonzero(size)
            q, lo, size = q[some], lo[some], size[some]
            # In pieces of bounded size, depth first: in a dense shard every query meets nearly every row.
            cuts = np.searchsorted(np.cumsum(size), np.arange(WALK_PAIRS, int(size.sum()) + WALK_PAIRS, WALK_PAIRS))
            for a, b in zip([0, *(cuts + 1).tolist()], (cuts + 1).tolist(), strict=False):
                n = size[a:b]
                slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:b], n)
                q2, node2 = np.repeat(q[a:b], n), self.kids[slot]
                ok = enter(q2, node2)
                if ok.any():
                    todo.append((q2[ok], node2[ok]))

    def components(self, radius: int) -> np.ndarray:
        """The first row of each row's component under links of ``radius`` inside its shard.

        A subtree whose rows all belong to the query's component already is not
        entered: it could add nothing. That keeps dense groups from costing the
        square of their size, and loses no component.
        """
        label = np.arange(self.n)
        tight = (self.parent >= 0) & (self.edge <= radius)
        label[tight] = self.parent[tight]
        while (label != (up := label[label])).any():
            label = up
        low, high = self._spread(label)
        at, step = 0, 512
        while at < self.n:
            queries = np.arange(at, min(self.n, at + step))
            at, step = at + step, min(2 * step, 2048)
            pairs: set[tuple[int, int]] = set()
            enter = lambda q, c: ((low[c] != label[q]) | (high[c] != label[q]))
            for q, node, _ in self.walk(queries, radius, enter):
                a, b = label[q], label[node]
                if (differ := a != b).any():
                    codes = np.unique(a[differ] * self.n + b[differ])
                    pairs.update(zip((codes // self.n).tolist(), (codes % self.n).tolist(), strict=True))
            if pairs:
                top: dict[int, int] = {}

                def find(x: int, top=top) -> int:
                    while (y := top.get(x, x)) != x:
                        top[x] = x = top.get(y, y)
                    return x

                for a, b in pairs:
                    a, b = find(a), find(b)
                    if a != b:
                        top[max(a, b)] = min(a, b)
                to = np.arange(self.n)
                for x in list(top):
                    to[x] = find(x)
                label = to[label]
                low, high = self._spread(label)
        return label

    def _spread(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest label in each row's subtree."""
        low, high = label.copy(), label.copy()
        for level in reversed(self.levels):
            np.minimum.at(low, self.parent[level], low[level])
            np.maximum.at(high, self.parent[level], high[level])
        return low, high

    def nearest_before(self, radii: tuple[int, ...]) -> np.ndarray:
        """For each row the nearest row that stands before it in its shard, within the last of ``radii``, or -1.

        The radius grows until something is found, so that rows in dense groups
        stop at a small one.
        """
        none = 65 * (self.n + 1)
        best = np.full(self.n, none)  # distance * (n + 1) + row, so that the least is the nearest, then the first
        before = lambda q, c: c < q  # noqa: E731  a subtree's rows stand after its root
        open_rows = np.flatnonzero(self.root != np.arange(self.n))
        for radius in radii:
            for at in range(0, len(open_rows), 2048):
                for q, node, d in self.walk(open_rows[at : at + 2048], radius, before):
                    ok = node < q
                    np.minimum.at(best, q[ok], d[ok] * (self.n + 1) + node[ok])
            open_rows = open_rows[best[open_rows] == none]
        return np.where(best < none, best % (self.n + 1), -1)


def _by_shard(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of whole shards, gathered up to ``BLOCK_ROWS``; rows come sorted by the first column."""
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(x).to_numpy() for x in names]
        held.append(now)
        size += b.num_rows
        if size >= BLOCK_ROWS:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield [x[:last] for x in cols]
                cols = [x[last:] for x in cols]
            held, size = [cols], len(cols[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the blocks to agree on: of m blocks all choices of m - radius, m as small as shards of bounded size allow."""
    for m in range(radius + 1, 17):
        ends = [64 * k // m for k in range(m + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
        if n / 2 ** ((m - radius) * (64 // m)) <= SHARD_ROWS:
            break
    return [sum(x) for x in combinations(blocks, m - radius)]


def sample_masks(n: int, miss: float = 0.01, differ: float = 0.11) -> list[int]:
    """Masks of sampled bits: pairs whose bits differ with chance ``differ`` agree on one mask at least, but for a share ``miss``."""
    k = min(32, max(16, math.ceil(math.log2(max(1, n) / 256))))
    count = math.ceil(math.log(miss) / math.log(1 - (1 - differ) ** k))
    draw = random.Random(SEED)
    return [sum(1 << b for b in draw.sample(range(64), k)) for _ in range(count)]


def _dealt(rows: DataFrame, masks: list[int], *order: str) -> DataFrame:
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    return rows.withColumn("key", F.explode(keys)).repartition("key").sortWithinPartitions("key", *order)


#: Rows beyond which a shard is split further, and blocks that its other bits are split into.
DENSE_ROWS, DENSE_BLOCKS = 200_000, 4


def finer_masks(mask: int, radius: int = RADIUS, more: int = DENSE_BLOCKS) -> list[int]:
    """Masks on the bits outside ``mask``: of radius + more blocks all choices of ``more``, so that rows within ``radius`` agree on one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    m = radius + more
    blocks = [sum(1 << b for b in free[len(free) * k // m : len(free) * (k + 1) // m]) for k in range(m)]
    return [sum(x) for x in combinations(blocks, more)]


def _shards(fps: DataFrame, n: int, radius: int, dense: int) -> DataFrame:
    """(key, fp): the rows of every shard; shards of more than ``dense`` rows are split by their other bits, which loses no link."""
    masks = block_masks(n, radius)
    parts = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    rows = fps.select("fp", F.posexplode(parts).alias("i", "part")).select("fp", "i", F.xxhash64("i", "part").alias("key"))
    if n <= dense:  # no shard can be larger
        return rows.select("key", "fp")
    hot = checkpointed(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > dense).select("key", F.lit(True).alias("hot")))
    count = hot.count()
    if not count:
        return rows.select("key", "fp")
    finer = F.array(*[F.array(*[F.lit(_signed(x)) for x in finer_masks(m, radius)]) for m in masks])
    split = F.transform(F.get(finer, F.col("i")), lambda x, j: F.xxhash64("key", j, F.col("fp").bitwiseAND(x)))
    flagged = meet(rows, hot, ["key"], count, "fp", "left")
    return flagged.select("fp", F.explode(F.when(F.col("hot"), split).otherwise(F.array("key"))).alias("key")).select("key", "fp")


def linked_fingerprints(fps: DataFrame, n: int, radius: int = RADIUS, dense: int = DENSE_ROWS) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints of ``fps`` (fp long), of which there are ``n``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _by_shard(batches, ("key", "fp")):
            label = Forest(fp.view(np.uint64), key).components(radius)
            other = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(fp[other]), pa.array(fp[label[other]])], ["a", "b"])

    dealt = _shards(fps, n, radius, dense).repartition("key").sortWithinPartitions("key", "fp")
    return in_batches(dealt, work, "a long, b long")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; a null text has no words and fingerprint 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(words_of(x), width) for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("data"))
    return in_batches(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Texts of any length are read as a whole; other columns are ignored. Rows with equal fingerprints form one class; classes link at ``radius`` or
    fewer differing bits, and component_id is the smallest doc_id that links
    reach. Null and empty texts share fingerprint 0. Repeated rows stay, each
    with its component; a component whose ids are all null has a null id; an
    empty table gives an empty result.
    """
    with tidy(docs.sparkSession) as keep:
        fps = checkpointed(fingerprints(docs, width))
        classes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), fps.count())
        n = classes.count()
        masks = len(block_masks(n, radius))
        edges = checkpointed(linked_fingerprints(classes, n, radius).distinct(), n * masks)
        label = checkpointed(connected_components(edges, edges.count()).select(F.col("node").alias("fp"), "component"), n)
        linked = classes.join(label, "fp")
        least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
        linked = meet(linked.select("fp", "component"), least, ["component"], label.count(), "fp").select("fp", F.struct("component_id").alias("of"))
        # Written, so that both sides of the last join are dealt anew and a class of many rows can be split.
        own = F.when(F.col("of").isNotNull(), F.col("of.component_id")).otherwise(F.col("least"))
        ids = checkpointed(classes.join(linked, "fp", "left").select("fp", own.alias("component_id")), n)
        return keep(fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


# Near-duplicate documents by likeness of their shingle sets.

SHINGLE_WORDS, LIKENESS = 5, 0.8
#: First candidates are fingerprints of word pairs within this many bits; what they leave apart is met by shared shingles.
CANDIDATE_RADII = (2, 4, 8, 13)
#: Documents at least, and the largest share, whose shingles are counted to order prefixes, and shingles ranked; no result depends on them.
#: A share that fell with the corpus would take shingles for rare that ever more documents hold.
SAMPLE_DOCS, SAMPLE_SHARE, RANKED = 2000, 16, 500_000
#: Bits of a set's parities: a power of two, this many times the set's size at least, and within bounds.
PARITY_BITS, LEAST_PARITIES, MOST_PARITIES = 4, 512, 1 << 20
#: Seeds that are tried until no two classes share a 64-bit name.
NAME_SEEDS = 8


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _shingle_set(words: list[bytes], width: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(words, width)]))


def _name(words: list[bytes], seed: int) -> int:
    """The class of a text's words, as a signed number."""
    return _signed(_H(b" ".join(words), seed))


def _parities(h: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of the set's shingles falls on them."""
    n = min(MOST_PARITIES, max(LEAST_PARITIES, 1 << (PARITY_BITS * len(h)).bit_length()))
    odd = np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, data): blob names the text, so that both together name a document."""
    text = text_or_empty()
    return docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("blob"), text.cast("binary").alias("data"))


def _marks(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc_id, blob, node, check, fp, size, bits): node and check name the word sequence, fp is the fingerprint of its word pairs, size and bits describe its shingle set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, check, fp, size, bits = [], [], [], [], []
            for x in b.column("data").to_pylist():
                words = words_of(x)
                h = _shingle_set(words, width)
                node.append(_name(words, seed))
                check.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(words))))
                fp.append(fingerprint(words, 2))
                size.append(len(h))
                bits.append(_parities(h))
            made = [*(pa.array(v, pa.int64()) for v in (node, check, fp)), pa.array(size, pa.int32()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("blob"), *made], ["doc_id", "blob", "node", "check", "fp", "size", "bits"])

    rows = _rows(docs)
    return in_batches(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, blob binary, node long, check long, fp long, size int, bits array<long>")


def _classes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(marks, classes, rows, seed): texts of the same words are one class (node, rep, n, fp, size, bits); rep is its first (doc_id, blob)."""
    for seed in range(NAME_SEEDS):
        marks = checkpointed(_marks(docs, width, seed))
        n = marks.count()
        about = [F.any_value(c).alias(c) for c in ("fp", "size", "bits")]
        classes = checkpointed(marks.groupBy("node", "check").agg(F.min(F.struct("doc_id", "blob")).alias("rep"), F.count("*").alias("n"), *about).drop("check"), n)
        if classes.count() == classes.select("node").distinct().count():
            return marks, classes, n, seed
    raise RuntimeError("different texts share a name under every seed")


def _candidates(leaders: DataFrame, n: int) -> DataFrame:
    """(a, b): for each leader (id, fp) and each shard the nearest leader with a smaller id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, fp in _by_shard(batches, ("key", "id", "fp")):
            best = Forest(fp.view(np.uint64), key).nearest_before(CANDIDATE_RADII)
            found = best >= 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(ids[best[found]])], ["a", "b"])

    return in_batches(_dealt(leaders, sample_masks(n), "id").select("key", "id", "fp"), work, "a long, b long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """(node) of every node of ``pairs`` (a, b)."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _can_be_alike(pairs: DataFrame, classes: DataFrame, n: int, least: float) -> DataFrame:
    """``pairs`` without those whose sizes and parities show that too many shingles are in one set only.

    Two sets differ in at least as many shingles as their parities differ in
    bits, so that no pair of a likeness of ``least`` or more goes.
    """
    nodes = checkpointed(_ends(pairs), n)
    count = nodes.count()
    about = checkpointed(meet(classes.select("node", "size", "bits"), nodes, ["node"], count, "node", "left_semi"), count)
    near_in_size = F.abs(F.col("m") - F.col("n")) <= (F.col("m") + F.col("n")) * ((1 - least) / (1 + least)) + 1e-6
    sized = about.select("node", "size")
    pairs = pairs.join(sized.toDF("a", "m"), "a").join(sized.toDF("b", "n"), "b").where(near_in_size)
    both = pairs.join(about.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a").join(about.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b")

    def halved(long: Column, short: Column) -> Column:
        """Parities of twice as many bits, folded; sets that can be alike differ no more than that."""
        k = F.size(short)
        folded = F.zip_with(F.slice(long, F.lit(1), k), F.slice(long, k + 1, k), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(long) > k, folded).otherwise(long)

    bits = F.zip_with(halved(F.col("x"), F.col("y")), halved(F.col("y"), F.col("x")), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int"))
    differ = F.aggregate(bits, F.lit(0), lambda acc, k: acc + k)
    return both.where(differ <= (F.col("m") + F.col("n")) * ((1 - least) / (1 + least)) + 1e-6).select("a", "b").distinct()


def _alike(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, width: int, least: float) -> DataFrame:
    """The pairs of classes whose whole shingle sets have a likeness of ``least`` or more."""
    wanted = checkpointed(_ends(pairs), n)
    count = wanted.count()
    named = classes.select("node", "rep").join(wanted, "node").select("node", "rep.doc_id", "rep.blob")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_shingle_set(words_of(x), width).tobytes() for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(got, pa.binary())], ["node", "shingles"])

    texts = meet(_rows(docs), named, ["doc_id", "blob"], count, "blob").select("node", "data")
    known = checkpointed(in_batches(texts, sets, "node long, shingles binary"), count)
    if known.count() > count:  # rows that repeat an id and a text are one document
        known = checkpointed(known.dropDuplicates(["node"]), count)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).to_pylist() for c in ("x", "y"))
            ok = pa.array([likeness(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= least for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    both = pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
    return in_batches(both.select("a", "b", "x", "y"), work, "a long, b long")


def _common_shingles(docs: DataFrame, n: int, width: int) -> np.ndarray:
    """Hashes of the shingles that most of a sample of ``docs`` hold, the most common last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(words_of(x), width).view(np.int64))], ["h"])

    share = max(1, min(n // SAMPLE_DOCS, SAMPLE_SHARE))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select(text_or_empty().cast("binary").alias("data"))
    counts = checkpointed(in_batches(some, work, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2"))
    # The least count that at most RANKED shingles reach, found without sorting them all.
    enough, ranked = 0, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():
        ranked += r["k"]
        if ranked > RANKED:
            enough = r["n"] + 1
            break
    top = counts.where(F.col("n") >= enough).toArrow()
    h, often = (top.column(c).to_numpy() for c in ("h", "n"))
    return h[np.lexsort((h, often))].view(np.uint64)


def _prefixes(docs: DataFrame, seed: int, common: np.ndarray, width: int, least: float) -> DataFrame:
    """(node, size, keys): the first shingles of each text's set, rarest first.

    Sets of a likeness of ``least`` or more share one of these: all but
    ceil(least * size) - 1 shingles, in one order for all texts. Keys are the
    upper 40 bits; texts without words have none.
    """
    by_hash = np.argsort(common).astype(np.int32)
    known = common[by_hash]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, keys = [], [], []
            for x in b.column("data").to_pylist():
                words = words_of(x)
                h = _shingle_set(words, width)
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, by_hash[at] + 1, 0), kind="stable")]
                node.append(_name(words, seed))
                size.append(len(h))
                # The subtrahend keeps a product just above a whole number from taking the next one.
                keys.append((h[: len(h) - math.ceil(least * len(h) - 1e-9) + 1] >> np.uint64(24)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["node", "size", "keys"])

    return in_batches(docs.select(text_or_empty().cast("binary").alias("data")), work, "node long, size int, keys array<long>")


def _firsts(docs: DataFrame, marks: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """``docs`` without the rows that are not the first of their class, as far as a table of bounded size can tell; others may stay."""
    several = classes.where("n > 1").select("node", "rep")
    copies = meet(marks.select("doc_id", "blob", "node"), several, ["node"], several.count(), "blob").where(F.struct("doc_id", "blob") != F.col("rep"))
    copies = checkpointed(copies.select("doc_id", "blob").distinct(), n)
    count = copies.count()
    rows = docs.withColumn("blob", F.unhex(F.md5(text_or_empty().cast("binary"))))
    return meet(rows, copies, ["doc_id", "blob"], count, "blob", "left_anti") if count <= SENT_ROWS else docs


#: Pairs of one key beyond which its rows first meet a few others alone, how many these are, and the passes over such keys at most while they link; these passes stay linear.
HOT_PAIRS, NEXT_ROWS, TURNS = 32, 4, 4
#: Links for each row of such keys, below which another of these passes is not worth it.
LEAST_LINKS = 0.01
#: 64-bit words that parities are folded to where rows of such keys meet.
SKETCH = 4


def _sketch(bits: Column) -> Column:
    """Parities folded to ``SKETCH`` words: two sets' differ in no more bits than the sets differ in shingles."""
    words = F.transform(F.sequence(F.lit(1), F.lit(SKETCH)), lambda k: F.aggregate(F.filter(bits, lambda _, i: F.pmod(i + 1 - k, F.lit(SKETCH)) == 0), F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(w)))
    return F.struct(*[words[k].alias(f"p{k}") for k in range(SKETCH)])


def _of_largest(key: np.ndarray, of: np.ndarray, turn: int) -> np.ndarray:
    """For each row one of the rows of its key whose ``of`` most rows of the key have, another one each turn; rows are sorted by key and ``of``."""
    n = len(key)
    new_key = np.append(True, key[1:] != key[:-1])
    new_run = new_key | np.append(True, of[1:] != of[:-1])
    starts = np.flatnonzero(new_run)
    length = np.diff(np.append(starts, n))[np.cumsum(new_run) - 1]
    keys = np.flatnonzero(new_key)
    group = np.cumsum(new_key) - 1
    largest = length == np.maximum.reduceat(length, keys)[group]
    rows = np.flatnonzero(largest)
    several = np.bincount(group[rows], minlength=len(keys))
    place = np.array([_H(int(k).to_bytes(8, "little", signed=True), turn) % m for k, m in zip(key[keys].tolist(), several.tolist(), strict=True)], np.int64)
    return rows[np.cumsum(several) - several + place][group]


def _sharing(rows: DataFrame, least: float, whole: bool, turn: int = 0) -> DataFrame:
    """(a, b, key, size, at) from ``rows`` (key, of, node, size, at, sketches if there are any), one for each class and key.

    Rows without a key are pairs: classes that share a key, differ in ``of``
    and can reach ``least`` by their sizes, the key's places and sketches. Rows
    are sorted by key and ``of``, and a row meets only those of its key after
    its own ``of``: a large group costs nothing within itself. Unless
    ``whole``, rows of a key with very many pairs meet only the next few, in
    later turns one of the key's largest ``of``, and come back with their key
    (a is the class), to meet the others once these are linked.
    """
    sketches = [c for c in rows.columns if c in {f"p{k}" for k in range(SKETCH)}]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["a", "b", "key", "size", "at"], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for key, of, ids, size, at, *parts in _by_shard(batches, ("key", "of", "node", "size", "at", *sketches)):
            n = len(key)

            def pairs(x: np.ndarray, y: np.ndarray, of=of, ids=ids, size=size, at=at, parts=parts) -> Iterator[pa.RecordBatch]:
                both = np.minimum(size[x] - at[x], size[y] - at[y])
                ok = (of[x] != of[y]) & (both * (1 + least) >= least * (size[x] + size[y]) - 1e-6)
                x, y = x[ok], y[ok]
                if parts and len(x):
                    differ = sum(np.bitwise_count((p[x] ^ p[y]).view(np.uint64)).astype(np.int64) for p in parts)
                    ok = differ <= (size[x] + size[y]) * ((1 - least) / (1 + least)) + 1e-6
                    x, y = x[ok], y[ok]
                if len(x):
                    pair = np.unique(np.stack([np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])]), axis=1)
                    none = [pa.nulls(pair.shape[1], k) for k in kinds[2:]]
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), *none], names)

            new_key = key[1:] != key[:-1]
            ends = lambda new, n=n: np.append(np.flatnonzero(new) + 1, n)[np.concatenate([[0], np.cumsum(new)])]
            first = ends(new_key | (of[1:] != of[:-1]))
            count = ends(new_key) - first
            if not whole:
                group = np.concatenate([[0], np.cumsum(new_key)])
                hot = np.bincount(group, count)[group] > HOT_PAIRS
                if hot.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids[hot], ids[hot], key[hot], size[hot], at[hot]), kinds, strict=True)], names)
                    if turn:
                        yield from pairs(np.flatnonzero(hot), _of_largest(key, of, turn)[hot])
                count = np.where(hot, np.minimum(count, 0 if turn else NEXT_ROWS), count)
            rows = np.flatnonzero(count)
            total = np.cumsum(count[rows])
            cuts = np.unique(np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, WALK_PAIRS)[1:])).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                r = rows[lo:hi]
                c = count[r]
                x = np.repeat(r, c)
                yield from pairs(x, np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[r], c))

    dealt = rows.repartition("key").sortWithinPartitions("key", "of", "node").select("key", "of", "node", "size", "at", *sketches)
    return in_batches(dealt, work, "a long, b long, key long, size int, at int")


def _merged(label: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """``label`` (node, component) with the components joined that ``links`` (a, b: nodes) connect; at most ``n`` rows."""
    of = label.withColumnRenamed("component", "of")
    for end in ("a", "b"):
        links = links.withColumnRenamed(end, "node").join(of, "node", "left").withColumn(end, F.coalesce("of", "node")).drop("node", "of").distinct()
    links = checkpointed(links, n)
    tops = connected_components(links, max(1, links.count())).select(F.col("node").alias("component"), F.col("component").alias("top"))
    # A component's smallest node is a node of ``label`` only if it has links of its own.
    alone = tops.select(F.col("component").alias("node")).join(label.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return checkpointed(label.unionByName(alone).join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component")), n)


def _joined(docs: DataFrame, marks: DataFrame, classes: DataFrame, n: int, seed: int, label: DataFrame, width: int, least: float) -> DataFrame:
    """``label`` (node, component) with the components linked that hold alike classes; no such pair is left out.

    Only classes of different components are compared. Keys that very many of
    them share are taken several times: first each class meets a few others,
    then one of the component that most classes of the key are in, as long as
    that links many; then what is still apart meets.
    """
    def checked(found: DataFrame, label: DataFrame) -> tuple[DataFrame, int]:
        """``label`` merged by the pairs of ``found`` that are alike, and their number."""
        with tidy(docs.sparkSession) as keep:
            pairs = checkpointed(_can_be_alike(found.where("key is null").select("a", "b").distinct(), classes, n, least), 2 * n)
            if pairs.isEmpty():
                return label, 0
            links = checkpointed(_alike(pairs, docs, classes, n, width, least))
            count = links.count()
            return (keep(_merged(label, links, n), n), count) if count else (label, 0)

    def again(found: DataFrame, label: DataFrame) -> DataFrame:
        """The rows of ``found`` that came back with their key, with their component now and their sketches."""
        hot = found.where("key is not null").select(F.col("a").alias("node"), "key", "size", "at")
        nodes = classes.select("node", _sketch(F.col("bits")).alias("p")).join(label.withColumnRenamed("component", "of"), "node", "left")
        return hot.join(nodes, "node").select("key", own, "node", "size", "at", "p.*")

    some = label.count()
    of = label.withColumnRenamed("component", "of")
    own = F.coalesce("of", "node").alias("of")
    prefixes = _prefixes(_firsts(docs, marks, classes, n), seed, _common_shingles(docs, n, width), width, least)
    if n - classes.count() > SENT_ROWS:
        prefixes = prefixes.dropDuplicates(["node"])
    prefixes = meet(prefixes, of, ["node"], some, "node", "left")
    rows = prefixes.select("node", own, "size", F.posexplode("keys").alias("at", "key"))
    found = checkpointed(_sharing(rows, least, False).distinct())
    label, _ = checked(found, label)
    for turn in range(1, TURNS + 1):
        hot = found.where("key is not null").count()
        if not hot:
            return label
        found = checkpointed(_sharing(again(found, label), least, False, turn).distinct())
        label, links = checked(found, label)
        if links < LEAST_LINKS * hot:
            break
    if found.where("key is not null").isEmpty():
        return label
    return checked(checkpointed(_sharing(again(found, label), least, True).distinct()), label)[0]


def near_duplicate_groups(docs: DataFrame, width: int = SHINGLE_WORDS, least: float = LIKENESS) -> DataFrame:
    """(doc_id, blob, group_id, n_same, kept) of each distinct document, a pair of doc_id and text.

    blob is the MD5 of the text; group_id the smallest doc_id of the group;
    kept marks the one document of the group that stays: of the smallest
    doc_id, then of the smallest blob; n_same counts the rows that are this
    document. doc_id may be of any type that can be ordered; rows whose doc_id
    is null are left out (the caller keeps such rows).

    Documents with the same words are one class. Classes link if their sets of
    ``width``-word shingles have a likeness of ``least`` or more; first
    candidates come from the BK-trees of shards of SimHash fingerprints, and
    the groups that these make are joined by an exact search for shared
    shingles. Every candidate is checked against the whole sets. Null, empty
    and blank texts are one class. An empty table gives an empty result.
    """
    with tidy(docs.sparkSession) as keep:
        docs = docs.where(F.col("doc_id").isNotNull())
        marks, classes, n, seed = _classes(docs, width)
        leaders = checkpointed(classes.groupBy("fp").agg(F.min("node").alias("id")), n)
        same = classes.select("node", "fp").join(leaders.withColumnRenamed("id", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
        pairs = checkpointed(same.unionByName(_candidates(leaders, leaders.count())).where("a <> b").distinct(), 2 * n)
        pairs = checkpointed(_can_be_alike(pairs, classes, n, least), n)
        links = checkpointed(_alike(pairs, docs, classes, n, width, least).distinct(), n)
        label = checkpointed(connected_components(links, max(1, links.count())), n)
        label = _joined(docs, marks, classes, n, seed, label, width, least)
        # What says more than that a document is alone: linked classes with their group's first document, and classes of several rows.
        linked = checkpointed(classes.select("node", "rep").join(label, "node"), n)
        first = linked.groupBy("component").agg(F.min("rep").alias("first"))
        linked = meet(linked, first, ["component"], label.count(), "node").select("node", "first")
        several = classes.where("n > 1").select("node", "rep").join(linked.select("node"), "node", "left_anti").select("node", F.col("rep").alias("first"))
        changed = checkpointed(linked.unionByName(several), n)
        rows = marks.groupBy("doc_id", "blob", "node").agg(F.count("*").alias("n_same"))
        rows = meet(rows, changed, ["node"], changed.count(), "blob", "left")
        own = F.struct("doc_id", "blob")
        return keep(rows.select("doc_id", "blob", F.coalesce(F.col("first.doc_id"), F.col("doc_id")).alias("group_id"), "n_same", (F.col("first").isNull() | (F.col("first") == own)).alias("kept")), n)


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, least: float = LIKENESS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of the smallest doc_id, then of the smallest MD5 of its text.

    All columns stay as they are. Rows with a null doc_id stay. Different texts
    that share a doc_id are different documents. Of rows that repeat a doc_id
    and a text the one whose columns come first as JSON stays. A null text
    counts as empty; an empty table gives an empty result.
    """
    groups = near_duplicate_groups(docs, width, least)
    gone = groups.where("not kept or n_same > 1").select(F.col("doc_id").alias("__id"), F.col("blob").alias("__blob"), "kept")
    count = gone.count()
    marked = docs.withColumn("__id", F.col("doc_id")).withColumn("__blob", F.unhex(F.md5(text_or_empty().cast("binary"))))
    kept = meet(marked, gone.drop("kept"), ["__id", "__blob"], count, "__blob", "left_anti").select(*docs.columns)
    again = gone.where("kept").drop("kept")
    if repeated := again.count():
        rows = meet(marked, again, ["__id", "__blob"], repeated, "__blob").select("__id", "__blob", F.struct(*docs.columns).alias("__row"))
        kept = kept.unionByName(rows.groupBy("__id", "__blob").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*"))
    return kept


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; rules for odd rows as in ``simhash_components``."""
    return simhash_components(table(spark, sf_dir, "documents"))
