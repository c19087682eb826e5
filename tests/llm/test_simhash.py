"""Bit-sliced comparison, fingerprints and groups against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from vitrine.llm import common, queries, simhash

from .conftest import TEXTS


@pytest.mark.parametrize("words,radius", [(1, 2), (5, 49), (1, 0)])
def test_close_pairs(words, radius):
    rng = np.random.default_rng(words)
    bits = rng.integers(0, 2, (20, 64 * words), dtype=np.uint8)[rng.integers(0, 20, 400)]
    for row in bits:
        row[rng.integers(0, 64 * words, rng.integers(0, radius + 2))] ^= 1
    cells = np.sort(rng.integers(0, 6, 400))
    a, b = simhash.close_pairs(cells, np.packbits(bits, axis=1, bitorder="little"), radius)
    want = {(i, j) for i, j in combinations(range(400), 2) if cells[i] == cells[j] and (bits[i] != bits[j]).sum() <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_keys_lose_no_pair():
    keys = simhash.exact_keys(2)
    for i, j in combinations(range(64), 2):
        assert any(i not in k and j not in k for k in keys)


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in fps}


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    fps = {r.doc_id: plain(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, "/root/testdata/sf0.001").collect()}
    want = components(fps)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


def test_hot_buckets_are_cut(spark):
    rng = np.random.default_rng(1)
    base = 0x0123456789ABCDEF
    values = {i: base ^ 1 << int(rng.integers(0, 12)) ^ 1 << int(rng.integers(0, 12)) for i in range(60)} | {100: ~base & 2**64 - 1}
    reps = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "little"))) for i, v in values.items()], "id long, fp binary")
    got = {r.id: r.component_id for r in simhash.classes(reps, 2, simhash.exact_keys(2)).collect()}
    small = simhash.links(reps.withColumnRenamed("id", "rep").dropDuplicates(["fp"]), 2, simhash.exact_keys(2), bucket=8)
    assert got == components(values) and small.count() > 0


def test_edge_cases(docs, no_docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    zero = {r.doc_id: r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {4: 4, 5: 4, 6: 4}
    assert {r.component_id for r in rows if r.doc_id in (1, 7)} == {1}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each(spark, docs, no_docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == [0, 1, 3, 4, 8, 9, 9, 11]  # 2 shares 12 of 14 shingles with 1
    assert simhash.one_of_each(no_docs).count() == 0
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    rows = []
    for g in range(40):
        words = [word() for _ in range(300)]
        near = words[:]
        near[150] = "changed"
        far = words[:100] + [word() for _ in range(200)]
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(near)), (3 * g + 2, " ".join(far))]
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i in range(120) if i % 3 != 1}


def shared(n, similarity, rng):
    """Two texts of n shingles of five words each; the last words differ so that their sets have about that similarity."""
    both = int(np.ceil(2 * n * similarity / (1 + similarity) - 1e-9))
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(2 * n - both + 4)]
    return " ".join(words[: n + 4]), " ".join(words[n - both :])


def jaccard(a, b):
    a, b = set(simhash.shingles(a, 5)), set(simhash.shingles(b, 5))
    return len(a & b) / len(a | b)


def test_one_of_each_at_the_bound(spark):
    """Of pairs of similarity 0.80, 0.85 and 0.90 nearly all are found; none below 0.8 is."""
    rng = np.random.default_rng(8)
    rows, bound = [], {}
    for n in (100, 400):
        for s in (0.7, 0.75, 0.79, 0.8, 0.85, 0.9):
            for _ in range(60):
                k = len(rows)
                rows += [(k + i, t) for i, t in enumerate(shared(n, s, rng))]
                bound[k + 1] = s, jaccard(rows[k][1], rows[k + 1][1])
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not set(range(0, len(rows), 2)) - kept
    for s, least in ((0.8, 0.97), (0.85, 0.99), (0.9, 0.99)):
        found = [i not in kept for i, (t, _) in bound.items() if t == s]
        assert sum(found) >= least * len(found), s
    assert all(i in kept for i, (_, j) in bound.items() if j < 0.8)


def test_one_of_each_tries_all_that_matter(spark):
    """Chains and groups where many candidates fail: components are those of all pairs."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(260)]
        rows += [(len(rows) + i, " ".join(base[8 * i : 8 * i + 170])) for i in range(7)]  # neighbours are alike, others less
    for _ in range(2):
        base = [word() for _ in range(200)]
        for _ in range(30):
            words = base[:]
            for at in rng.integers(0, 200, 4):
                words[at] = word()
            rows.append((len(rows), " ".join(words)))
    texts = dict(rows)
    label = {i: i for i in texts}
    pairs = [(i, j) for i, j in combinations(texts, 2) if jaccard(texts[i], texts[j]) >= 0.8]
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i in texts if label[i] == i}
