"""Fingerprints, SimHash components and near-duplicate groups against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import minhash, simhash
from codeloom.llm.common import connected_components

SMALL = "/root/testdata/sf0.001"
ODD = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other text of the same id"), (3, None), (2, ""), (None, "x y z"), (1, "É" * 7 + " tail"), (0, "w " * 30000), (9, " \t\n ")]
KIND = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", text.lower())
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def chain(values, seed=42):
    """Spark's xxhash64 of several longs: each is hashed with the last hash as seed."""
    h = seed
    for v in values:
        h = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed=h)
    return h


def brute_bins(text):
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(r"[^\x20\x09-\x0d]+", text.lower())]
    if not words:
        return None
    hashes = {signed(chain(words[k : k + 5])) for k in range(max(1, len(words) - 4))}
    least = {}
    for h in hashes:
        b = (h >> 56) + 128
        least[b] = min(least.get(b, h), h)
    low = {b: ((h & 255) ^ 128) - 128 for b, h in least.items()}

    def int4(v, seed):
        return xxhash.xxh64_intdigest(v.to_bytes(4, "little"), seed=seed)

    def fill(j):
        if j in low:
            return low[j]
        for t in range(minhash.TRIES):
            if (b := int4(t, int4(j, 42)) % 256) in low:
                return low[b]
        rank = lambda b: (signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=int4(minhash.TRIES, int4(j, 42)))), b)
        return low[min(low, key=rank)]

    return [fill(j) for j in range(256)]


def test_bins_match_brute_force(spark, docs):
    short = spark.createDataFrame([(1000, "one"), (1001, "a b c d e f g"), (1002, "  ")], KIND)
    rows = minhash.with_bins(docs.select("doc_id", "text").unionByName(short), "text", "bins").collect()
    for r in rows:
        assert r["bins"] == brute_bins(r["text"])


def test_likeness_is_close(spark, docs):
    got = {r["doc_id"]: r for r in minhash.fingerprint_edits(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    errors = []
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        errors.append(got[i]["near_edited"] - jaccard(shingles(t), shingles(edited)))
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.05
    same = {}
    for i, t in texts.items():
        same.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, KIND).withColumn("bins", F.lit(1)).withColumn("range", F.lit("x"))
    got = minhash.fingerprint_edits(df).collect()
    assert len(got) == len(ODD) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (2, 3, 9)} == {""}
    one = minhash.fingerprint_edits(spark.createDataFrame([(1, "abcd")], KIND)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1
    assert minhash.fingerprint_edits(spark.createDataFrame([], KIND)).count() == 0


def brute_fingerprint(text, n=4):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(fold))
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), seed=42) for k in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, radius=4):
    top = list(range(len(ids)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(ids))]


def test_components_match_brute_force(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fps, rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (f"{fps[k]:016x}", rows[root[k]][0]) for k, (i, _) in enumerate(rows)}


def test_components_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, KIND).withColumn("fp", F.lit("clash")).withColumn("key", F.lit(0))
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {2}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert simhash.simhash_components(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize(("n", "flips", "roots"), [(300, 3, 4), (300, 9, 2), (1500, 5, 1)])
def test_forest_against_all_pairs(n, flips, roots):
    rng = np.random.default_rng(n + flips)
    x = rng.integers(0, 2**63, roots).astype(np.uint64)[rng.integers(0, roots, n)]
    for _ in range(flips):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    x = rng.permutation(np.unique(x))
    shard = np.sort(rng.integers(0, 3, len(x)))
    d = np.bitwise_count(x[:, None] ^ x[None, :]).astype(int)
    d[shard[:, None] != shard[None, :]] = 99
    want = np.arange(len(x))
    while True:
        new = np.array([want[d[i] <= 4].min() for i in range(len(x))])
        if (new == want).all():
            break
        want = new
    forest = simhash.Forest(x, shard)
    assert (forest.components(4) == want).all()
    best = forest.nearest_before((2, 4, 8, 13))
    for i in range(len(x)):
        near = d[i, :i]
        assert best[i] == (int(np.argmin(near)) if len(near) and near.min() <= 13 else -1)


def test_masks_cover_every_pair():
    rng = np.random.default_rng(0)
    for n in (10, 10**8, 10**11):
        masks = simhash.block_masks(n)
        for _ in range(200):
            flips = rng.choice(64, 4, replace=False)
            diff = sum(1 << int(b) for b in flips)
            assert any(diff & m == 0 for m in masks)


def test_finer_masks_cover_every_pair():
    rng = np.random.default_rng(1)
    for mask in simhash.block_masks(10**6):
        finer = simhash.finer_masks(mask)
        assert all(not mask & x for x in finer)
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(20):
            diff = sum(1 << int(b) for b in rng.choice(free, 4, replace=False))
            assert any(diff & x == 0 for x in finer)


def test_dense_shards_are_split_without_loss(spark):
    rng = np.random.default_rng(2)
    roots = rng.integers(0, 2**63, 3).astype(np.uint64)
    x = np.concatenate([roots[[0]].repeat(900), roots[[1]].repeat(80), rng.integers(0, 2**63, 200).astype(np.uint64)])
    for _ in range(5):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    x = np.unique(x).view(np.int64)
    fps = spark.createDataFrame([(int(v),) for v in x], "fp long")

    def groups(dense):
        label = simhash.linked_fingerprints(fps, len(x), dense=dense)
        got = {r["node"]: r["component"] for r in connected_components(label, label.count() + 1).collect()}
        return {v: got.get(v, v) for v in x.tolist()}

    sizes = simhash._shards(fps, len(x), 4, 100).groupBy("key").count().agg(F.max("count")).first()[0]
    assert groups(10**6) == groups(100) and sizes < simhash._shards(fps, len(x), 4, 10**6).groupBy("key").count().agg(F.max("count")).first()[0] / 2


def near(text, every):
    w = text.split()
    return " ".join("changed" if k % every == every - 1 else x for k, x in enumerate(w))


def test_near_duplicates(spark):
    base = [" ".join(f"w{s}x{k}" for k in range(400)) for s in range(4)]
    rows = [(10, base[0]), (11, base[0]), (4, near(base[0], 200)), (20, base[1]), (21, near(base[1], 120)), (30, base[2]), (31, near(base[2], 8)), (40, base[3]), (50, ""), (51, None), (None, base[0]), (60, "same id"), (60, "same id")]
    df = spark.createDataFrame(rows, KIND).withColumn("id", F.lit("extra")).withColumn("n_same", F.lit(3))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 4, 20, 30, 31, 40, 50, 60]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    words = [f"v{k}" for k in range(300)]
    rows = []
    for i in range(400):
        w = list(words)
        w[int(rng.integers(300))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{i}y{k}" for k in range(100))) for i in range(50)]
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, KIND)).collect())
    assert kept == [0, *range(1000, 1050)]


def test_copies_of_every_kind_come_together(spark):
    """1200 pairs of a likeness of 0.8 or more: scattered edits, a passage appended, the end cut off."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        n = int(rng.integers(80, 160))
        w = [f"n{x}" for x in rng.integers(0, 3000, n)]
        more = [f"n{x}" for x in rng.integers(0, 3000, int(0.23 * (n - 4)))]
        edited = list(w)
        for k in rng.choice(n, max(1, n // 60), replace=False):
            edited[k] = "edit"
        rows += [(10 * i, w), (10 * i + 1, w + more), (10 * i + 2, w[: n - int(0.19 * (n - 4))]), (10 * i + 3, edited)]
    rows = [(i, " ".join(w)) for i, w in rows]
    sets = {i: shingles(t) for i, t in rows}
    for i in range(0, 4000, 10):
        assert all(jaccard(sets[i], sets[i + k]) >= 0.8 for k in (1, 2, 3))
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_classes_unlike_the_leader_of_their_fingerprint(spark):
    line = [f"line{k}" for k in range(13)] * 400
    own = [[f"own{i}x{k}" for k in range(60)] for i in range(3)]
    texts = {1: line + own[0], 2: line + own[1], 3: line + own[1][:-1], 4: line + own[2], 5: own[2] + line}
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    fp = {simhash.fingerprint(simhash.words_of(t.encode()), 2) for _, t in rows}
    assert len(fp) == 1
    sets = {i: shingles(t) for i, t in rows}
    assert jaccard(sets[2], sets[3]) >= 0.8 and jaccard(sets[4], sets[5]) >= 0.8 and jaccard(sets[1], sets[2]) < 0.8
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}


def test_hot_keys_lose_nothing(spark, monkeypatch):
    """A large group that the first search leaves apart, and pairs that share a hot key without being alike."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(simhash, "HOT_PAIRS", 20)
    monkeypatch.setattr(simhash, "_candidates", lambda leaders, n: spark.createDataFrame([], "a long, b long"))
    line = [f"c{k}" for k in range(12)]
    rows = []
    for i in range(120):
        words = list(line * 4) + [f"t{k}" for k in range(40)]
        words[int(rng.integers(len(words)))] = f"e{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([f"u{i}x{k}" for k in range(30)] + line)) for i in range(60)]
    rows += [(2000 + i, " ".join([f"u{i}x{k}" for k in range(30)] + line + ["end"])) for i in range(0, 60, 3)]
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {i: find(i) for i in sets}


def test_documents_of_one_id_and_ids_of_any_type(spark):
    rows = [("b", "one two three four five six"), ("b", "seven eight nine ten eleven twelve"), ("a", "one two three four five six"), ("c", "seven eight nine ten eleven twelve"), ("c", "seven eight nine ten eleven twelve")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("more", F.monotonically_increasing_id())
    kept = sorted((r["doc_id"], r["text"][:3]) for r in simhash.drop_near_duplicates(df).collect())
    assert kept == [("a", "one"), ("b", "sev")]


def test_connected_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, 41).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 99, 99: 99}


def test_texts_that_share_a_passage_do_not_all_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANKED", 0)  # nothing is known to be common
    rng = random.Random(11)
    # Shingles of this passage come early in every set.
    texts = ["nine words that all of these 272 texts have " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) for _ in range(600)]
    texts[300:] = [" ".join([*texts[i - 300].split()[:-1], f"x{i}"]) for i in range(300, 600)]  # the last word differs: a likeness of 10 to 12
    met, plain = [], simhash._can_be_alike

    def counted(pairs, *rest):
        met.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(simhash, "_can_be_alike", counted)
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i % 300 for i in range(600)}
    assert sum(met) < 20 * len(texts)  # a key's pairs are about 180,000


def test_of_largest():
    key, of = np.array([1, 1, 1, 1, 2, 3, 3, 3]), np.array([4, 5, 5, 6, 9, 1, 2, 3])
    for turn in range(9):
        at = simhash._of_largest(key, of, turn)
        assert (key[at] == key).all() and set(of[at[:4]]) == {5} and len(set(at[5:])) == 1
    assert len({simhash._of_largest(key, of, t)[5] for t in range(30)}) == 3
