"""Fingerprints and near-duplicate components against brute force over all pairs."""

import random

import pytest

pytest.importorskip("quernstone.llm")
from quernstone.llm import queries, simhash  # noqa: E402


def brute_fingerprint(text):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in rows]


def key(rows):
    return sorted(rows, key=str)


def test_every_near_pair_meets_in_a_table():
    rng = random.Random(3)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not m & flips for m in simhash.MASKS)
    t = 5
    left = [b for b in range(64) if not simhash.MASKS[t] >> b & 1]
    for _ in range(1000):
        flips = sum(1 << b for b in rng.sample(left, 4))
        assert any(not m & flips for m in simhash.second_masks(t))


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    want = brute_components([(int(i), brute_fingerprint(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)])
    assert key(map(tuple, queries.op5_covering_simhash(spark, sf).collect())) == key(want)


def test_edges(spark):
    rows = [(9, None), (8, ""), (7, " \n"), (3, "one"), (3, "one"), (4, "ONE"), (None, "two words"), (5, "a b c d"), (6, "x " * 40_000), (2, "ÄB é 😀 \x00")]
    made = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert key(map(tuple, simhash.near_duplicates(made).collect())) == key(want)
    assert simhash.near_duplicates(made.limit(0)).count() == 0


@pytest.mark.parametrize("most", [20_000, 40])
def test_dense_and_hot_buckets(spark, most):
    rng = random.Random(most)
    fps = set()
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(60):
            fps.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(200)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    frame = spark.createDataFrame([(simhash.signed(f),) for _, f in rows], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(frame, 4, most)).collect()}
    got, want = {}, {}
    for _, f in rows:
        got.setdefault(roots.get(simhash.signed(f), simhash.signed(f)), set()).add(f)
    for d, f, c in brute_components(rows):
        want.setdefault(c, set()).add(int(f, 16))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_large_bucket_is_covered_again_inside_a_task(monkeypatch):
    import numpy as np

    rng = random.Random(11)
    base = rng.getrandbits(64)
    free = [b for b in range(64) if not simhash.MASKS[0] >> b & 1]
    fps = sorted({base ^ sum(1 << b for b in rng.sample(free, rng.randint(0, 7))) for _ in range(400)})
    args = (np.array(fps, np.uint64), np.zeros(len(fps), int), np.zeros(len(fps), int))
    found = []
    for direct in (10_000, 20):
        monkeypatch.setattr(simhash, "DIRECT", direct)
        forest = simhash.Forest()
        for a, b in simhash.bucket_links(*args):
            assert forest.join(a, b)
        found.append([forest.root(f) for f in fps])
    assert found[0] == found[1]
    want = {}
    for i, (_, _, c) in enumerate(brute_components(list(enumerate(fps)))):
        want.setdefault(c, set()).add(found[0][i])
    assert all(len(v) == 1 for v in want.values()) and len({next(iter(v)) for v in want.values()}) == len(want)
