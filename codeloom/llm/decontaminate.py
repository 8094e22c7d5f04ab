"""Benchmark decontamination by suffix arrays of the training text.

Each batch of documents is a shard. Its suffix array holds the word positions
at which a benchmark window can begin, sorted by the words that follow; every
benchmark suffix that begins a window is searched in it by bisection, which
gives all places of the window in the shard. A position whose first words
begin no window has no match of the length that counts, so leaving it out of
the array loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, in_batches, table, text_or_empty

WINDOW = 13
#: One twentieth of a document's words hit: contaminated.
SHARE = 20
#: Bytes that the index of one block of items takes at most, one item at least, and blocks that one pass over the documents searches.
INDEX_BYTES, PASS_BLOCKS = 32 << 20, 8
#: Windows whose keys are made at once.
KEYS_AT_ONCE = 100_000


def _fold() -> bytes:
    """Digits, a-z and all bytes of other characters stay, A-Z become a-z, the rest blanks."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


FOLD = _fold()


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


@dataclass
class Index:
    """The windows of a block of items: places in one row of word numbers, with gaps between items."""

    words: dict[bytes, int]
    flat: np.ndarray
    place: np.ndarray  #: where each window begins in ``flat``
    size: np.ndarray
    item: np.ndarray
    at: np.ndarray  #: where it begins in its item
    pair: np.ndarray  #: hash of its first two words
    ids: list[str]
    begins: np.ndarray  #: whether a word number begins a window
    pairs: np.ndarray  #: hashed pairs of words that begin a window
    single: np.ndarray  #: word numbers that are a window by themselves
    width: int

    def keys(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest key that begins with each of ``windows``."""
        numbers = self.flat[self.place[windows][:, None] + np.arange(self.width)]
        inside = np.arange(self.width) < self.size[windows][:, None]
        return _rows(np.where(inside, numbers, 0)), _rows(np.where(inside, numbers, 0xFFFFFFFF))


_PAIR_BITS = 22
#: Bytes that the index takes for each word of an item and for each distinct word, by their fields.
_WORD_BYTES, _DISTINCT_BYTES = 4 + 8 + 1 + 4 + 4 + 4, 150


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int32)


def _rows(numbers: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    big = np.ascontiguousarray(numbers.astype(">u4"))
    return big.view(f"V{4 * big.shape[1]}").ravel()


def build_index(items: list[tuple[str, bytes]], window: int = WINDOW) -> Index:
    numbers: dict[bytes, int] = {}
    flat, place, size, item, at, ids, length = [], [], [], [], [], [], 0
    for name, data in items:
        words = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(data)], np.uint32)
        if not len(words):
            continue
        count = max(1, len(words) - window + 1)
        flat += [words, np.zeros(window, np.uint32)]
        place.append(np.arange(count, dtype=np.int64) + length)
        at.append(np.arange(count, dtype=np.int32))
        size.append(np.full(count, min(window, len(words)), np.uint8 if window < 256 else np.int64))
        item.append(np.full(count, len(ids), np.int32))
        ids.append(name)
        length += len(words) + window
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    row, where, sizes = joined(flat, np.uint32), joined(place, np.int64), joined(size, np.uint8)
    first = row[where]
    pair = _pair(first, row[where + 1]) if window > 1 else np.zeros(len(where), np.int32)
    two = sizes >= 2
    marked = lambda n, at_: np.bincount(at_, minlength=n).astype(bool)
    return Index(
        numbers, row, where, sizes, joined(item, np.int32), joined(at, np.int32), pair, ids,
        marked(len(numbers) + 1, first), marked(1 << _PAIR_BITS, pair[two]), marked(len(numbers) + 1, first[~two]), window,
    )


#: The longest match of a document: words, start in the document, item, start in the item.
NO_MATCH = (0, None, None, None)


@dataclass
class Found:
    """What one shard holds: per document its words, which of them are hit, the items and the longest match."""

    n_words: np.ndarray
    starts: np.ndarray
    hit: np.ndarray
    doc_items: list[set[str]]
    longest: list[tuple]


def longer(a: tuple, b: tuple) -> tuple:
    """The longer of two matches; of equally long ones the first by start in the document, item and start in the item."""
    return min(a, b, key=lambda m: (-m[0], *(m[1:] if m[0] else ())))


def search(texts: list[bytes], index: Index) -> Found:
    get, width = index.words.get, index.width
    counts, numbers = [], []
    for t in texts:
        words = words_of(t)
        counts.append(len(words))
        numbers.append(np.array([get(w, 0) for w in words], dtype=np.uint32))
        numbers.append(np.zeros(width, np.uint32))  # no match runs into the next document
    n_words = np.asarray(counts, np.int64)
    starts = np.concatenate([[0], np.cumsum(n_words + width)])[:-1] if counts else np.zeros(0, np.int64)
    flat = np.concatenate([*numbers, np.zeros(1, np.uint32)])
    found = Found(n_words, starts, np.zeros(len(flat), bool), [set() for _ in texts], [NO_MATCH] * len(texts))
    here = np.flatnonzero(index.begins[flat])
    if len(here):
        here = here[index.pairs[_pair(flat[here], flat[here + 1])] | index.single[flat[here]]]
    if not len(here):
        return found
    rows = _rows(flat[here[:, None] + np.arange(width)])
    order = np.argsort(rows, kind="stable")
    array, rows = here[order], rows[order]
    # Windows that begin with two words, or with one, that the shard has.
    paired, alone = np.zeros(1 << _PAIR_BITS, bool), np.zeros(len(index.words) + 1, bool)
    paired[_pair(flat[here], flat[here + 1])] = True
    alone[flat[here]] = True
    likely = np.flatnonzero(np.where(index.size >= 2, paired[index.pair], alone[index.flat[index.place]]))
    places, wins = [], []
    for at in range(0, len(likely), KEYS_AT_ONCE):
        some = likely[at : at + KEYS_AT_ONCE]
        low, high = index.keys(some)
        lo, hi = np.searchsorted(rows, low), np.searchsorted(rows, high, side="right")
        k = np.flatnonzero(hi > lo)
        size = hi[k] - lo[k]
        slot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[k], size)
        places.append(array[slot])
        wins.append(np.repeat(some[k], size))
    place, win = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, wins))
    if not len(place):
        return found
    width_of = index.size[win].astype(np.int64)
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + width_of, -1)
    found.hit = np.cumsum(change)[:-1] > 0
    doc = np.searchsorted(starts, place, side="right") - 1
    for d, i in set(zip(doc.tolist(), index.item[win].tolist(), strict=True)):
        found.doc_items[d].add(index.ids[i])
    # Places of consecutive windows of an item on one diagonal are one longer match.
    item, at = index.item[win], index.at[win]
    diagonal = place - at
    order = np.lexsort((place, diagonal, item))
    item, at, diagonal, place, doc, width_of = (x[order] for x in (item, at, diagonal, place, doc, width_of))
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(new)]]) - 1
    length = place[last] - place[first] + width_of[last]
    for d, n, p, i, a in zip(doc[first].tolist(), length.tolist(), (place[first] - starts[doc[first]]).tolist(), item[first].tolist(), at[first].tolist(), strict=True):
        found.longest[d] = longer(found.longest[d], (n, p, index.ids[i], a))
    return found


def _hits(found: Found, k: int) -> np.ndarray:
    return found.hit[found.starts[k] : found.starts[k] + found.n_words[k]]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterable[list[tuple[str, bytes]]]:
    """The items in blocks whose index has a bounded size, read one partition at a time."""
    block: list[tuple[str, bytes]] = []
    size, known = 0, set()
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    for r in items.toLocalIterator():
        words = words_of(bytes(r.t))
        fresh = set(words) - known
        more = _WORD_BYTES * len(words) + sum(_DISTINCT_BYTES + len(w) for w in fresh)
        if block and size + more > limit:
            yield block
            block, size, known = [], 0, set()
            more = _WORD_BYTES * len(words) + sum(_DISTINCT_BYTES + len(w) for w in set(words))
        block.append((r.i, bytes(r.t)))
        known |= set(words)
        size += more
    yield block


_MATCH = "match_start long, match_item string, match_at long"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, item_col: str = "item_id", text_col: str = "text", index_bytes: int = INDEX_BYTES, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids, longest_match, match_start, match_item, match_at and contaminated.

    A window is ``window`` consecutive words of an item, or all of a shorter
    one; a document word inside any place of a window is hit; contaminated:
    ``share * n_hit >= n_words`` and n_hit > 0. longest_match is the length in
    words of the longest verbatim match of a window or more, 0 without one;
    match_start, match_item and match_at say where it begins in the document,
    in which item, and where in that, null without one; of equally long matches
    the first by these three holds. Null and empty texts have no words; texts
    of any length are searched as a whole; items without words have no window;
    items that share an id count once, a null id counts as an empty one. Rows,
    repeated ones included, keep their columns; columns of the result's names
    are replaced. An empty benchmark hits nothing, an empty table gives an
    empty result.

    The index of the items goes to the executors in blocks of ``index_bytes``.
    One pass over the documents searches ``pass_blocks`` of them, so that only
    a benchmark beyond both takes more passes.
    """
    added = {"n_words": "long", "n_hit": "long", "item_ids": "array<string>", "longest_match": "long", "match_start": "long", "match_item": "string", "match_at": "long", "contaminated": "boolean"}
    docs = docs.drop(*added)
    broadcast = docs.sparkSession.sparkContext.broadcast
    names = docs.columns

    def worker(indexes, last: bool, more: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [x or b"" for x in b.column("__data").to_pylist()]
                hits = items = longest = n_words = None
                if more:
                    held = [b.column(c).to_pylist() for c in ("__hit", "__items", "longest_match", "match_start", "match_item", "match_at")]
                    items, longest = [set(x) for x in held[1]], list(zip(*held[2:], strict=True))
                for index in indexes:
                    found = search(texts, index.value)
                    n_words = found.n_words
                    own = [_hits(found, k) for k in range(len(texts))]
                    if hits is None and more:
                        hits = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for h, x in zip(own, held[0], strict=True)]
                    hits = own if hits is None else [h | x for h, x in zip(hits, own, strict=True)]
                    items = found.doc_items if items is None else [i | x for i, x in zip(items, found.doc_items, strict=True)]
                    longest = found.longest if longest is None else list(map(longer, longest, found.longest))
                kept = [b.column(c) for c in names]
                lists = pa.array([sorted(i) for i in items], pa.list_(pa.string()))
                match = [pa.array([m[k] for m in longest], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]
                if last:
                    n_hit = np.array([h.sum() for h in hits], np.int64).reshape(-1)
                    bad = (n_hit > 0) & (share * n_hit >= n_words)
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words), pa.array(n_hit), lists, *match, pa.array(bad)], [*names, *added])
                else:
                    packed = pa.array([np.packbits(h).tobytes() for h in hits], pa.binary())
                    yield pa.RecordBatch.from_arrays([*kept, b.column("__data"), packed, lists, *match], [*names, "__data", "__hit", "__items", "longest_match", "match_start", "match_item", "match_at"])

        return work

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    state, more = docs.withColumn("__data", text_or_empty(text_col).cast("binary")), False
    blocks = iter(_blocks(benchmark, item_col, text_col, index_bytes))
    block = next(blocks)
    while block is not None:
        indexes = []
        while block is not None and len(indexes) < pass_blocks:
            indexes.append(broadcast(build_index(block, window)))
            block = next(blocks, None)
        result = ", ".join(f"{k} {v}" for k, v in added.items()) if block is None else f"__data binary, __hit binary, __items array<string>, longest_match long, {_MATCH}"
        state = in_batches(state, worker(indexes, block is None, more), f"{kinds}, {result}")
        if block is not None:
            state, more = checkpointed(state), True
    return state


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``; what counts, and rules for odd rows, as in ``contamination``."""
    marked = contamination(docs.withColumn("__keep", F.struct(*docs.columns)), benchmark, **options)
    return marked.where("not contaminated").select("__keep.*")


def op7_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, match_start, match_item, match_at) of every document; rules for odd rows as in ``contamination``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = contamination(docs, table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", "longest_match", "match_start", "match_item", "match_at")
