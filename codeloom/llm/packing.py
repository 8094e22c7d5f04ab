"""Best-fit packing with bounds that certify each partition's bin count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, in_batches, table, tidy
from codeloom.llm.tokens import LIMIT, token_pieces

#: Pieces that one task packs at once.
PER_PARTITION = 40_000


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 60) -> int:
    """Bins that any packing needs, by dual feasible functions.

    Threshold functions for every cut-off up to half the capacity (their value
    at cut-off 1 is the plain volume bound) and the rounding functions for 1 to
    ``steps`` parts. Works on the histogram of lengths, so its cost does not
    grow with the number of pieces.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    up_to = np.concatenate([[0], np.cumsum(count)])
    volume = np.concatenate([[0], np.cumsum(count * size)])
    for cut in range(1, capacity // 2 + 1):  # above capacity - cut: a bin each; below cut: nothing
        large = int(up_to[-1] - up_to[capacity - cut + 1])
        middle = int(volume[capacity - cut + 1] - volume[cut])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, steps + 1):  # values in parts of 1 / (k * capacity)
        whole = (size * (k + 1)) % capacity == 0
        value = np.where(whole, size * k, (size * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, room) : each piece's bin and place in it, and what each bin has left.

    Bins are kept by the room they have; a bit mask of the rooms in use finds
    the smallest that fits.
    """
    n = len(lengths)
    bin_of, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bin_of[i], offset[i] = b, capacity - room
        room -= size
        rooms[b] = room
        by_room[room].append(b)
        mask |= 1 << room
    return bin_of, offset, np.asarray(rooms, np.int64)


_PACKED = "uid long, length long, bin long, offset long, room long, gap long"


def _pack_partitions(items: DataFrame, parts: int, capacity: int, salt: int) -> DataFrame:
    """Best-fit decreasing in each of ``parts`` partitions; gap: bins above the partition's certified bound."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("uid").to_numpy(), b.column("length").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        uid, length = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(uid, kind="stable")  # a retry packs alike whatever order blocks arrive in
        uid, length = uid[order], length[order]
        bin_of, offset, rooms = best_fit_decreasing(length, capacity)
        gap = len(rooms) - lower_bound(length, capacity)
        name = np.empty(len(rooms), np.int64)
        first = offset == 0
        name[bin_of[first]] = uid[first]
        for at in range(0, len(uid), 65536):
            s = slice(at, at + 65536)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (uid[s], length[s], name[bin_of[s]], offset[s], rooms[bin_of[s]], np.full(len(uid[s]), gap, np.int64))],
                ["uid", "length", "bin", "offset", "room", "gap"],
            )

    dealt = items.select("uid", "length").repartition(parts, F.xxhash64("uid", F.lit(salt)))
    return in_batches(dealt, work, _PACKED)


def pack(pieces: DataFrame, capacity: int = LIMIT, per_partition: int = PER_PARTITION, rounds: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id, offset and gap: sequences of at most ``capacity``, as few as found.

    Whole-capacity pieces are sequences by themselves. The others are dealt to
    partitions of bounded size; each packs by best-fit decreasing and computes
    a lower bound. A partition that meets its bound is done. The open bins of
    the others exchange their pieces through a new deal and are packed again,
    until no gap is left or a deal saves no bin, which is then dropped;
    ``rounds`` limits the deals where it is given. gap says by how many bins
    the partition that packed the row's sequence is above its lower bound: 0 is
    a certificate that no packing of these pieces needs fewer. ``pieces`` needs
    a column length (1 to ``capacity``); columns of the result's names are
    replaced; every row gets its place, repeated rows included; an empty table
    gives an empty result.
    """
    with tidy(pieces.sparkSession) as keep:
        names = [c for c in pieces.columns if c not in ("sequence_id", "offset", "gap")]
        known = checkpointed(pieces.select(*names).withColumn("__uid", F.monotonically_increasing_id()))
        small = known.where(F.col("length") < capacity).select(F.col("__uid").alias("uid"), "length")
        n = small.count()
        if not n:
            none = F.lit(0).cast("long")
            return keep(known.select(*names, F.col("__uid").alias("sequence_id"), none.alias("offset"), none.alias("gap")))
        done: list[DataFrame] = []
        state = checkpointed(_pack_partitions(small, max(1, -(-n // per_partition)), capacity, 0))
        deal = 0
        while rounds is None or deal < rounds:
            deal += 1
            is_open = (F.col("gap") > 0) & (F.col("room") > 0)
            pool = state.where(is_open)
            size, bins = pool.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
            if not size:
                break
            again = checkpointed(_pack_partitions(pool, max(1, -(-size // per_partition)), capacity, deal))
            now = again.agg(F.count(F.when(F.col("offset") == 0, 1))).first()[0]
            if now >= bins:
                break
            # Full bins of a partition with a gap keep it: no bound speaks for them alone.
            done.append(state.where(~is_open))
            state = again
        placed = state
        for d in done:
            placed = placed.unionByName(d)
        placed = placed.select(F.col("uid").alias("__uid"), F.col("bin").alias("__bin"), F.col("offset").alias("__offset"), F.col("gap").alias("__gap"))
        zero = F.lit(0).cast("long")
        out = known.join(placed, "__uid", "left")
        return keep(out.select(*names, F.coalesce("__bin", "__uid").alias("sequence_id"), F.coalesce("__offset", zero).alias("offset"), F.coalesce("__gap", zero).alias("gap")))


def pack_documents(docs: DataFrame, capacity: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap) of every piece of every document.

    A null or empty text is the end id alone: one piece of length 1. Rows that
    repeat a document are packed again; ids may be null; long texts are cut at
    ``capacity`` alone; other columns are ignored; an empty table gives an
    empty result. gap is that of ``pack``.
    """
    return pack(token_pieces(docs, capacity, vocabulary), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap) of every document's pieces; rules for odd rows as in ``pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents"))
