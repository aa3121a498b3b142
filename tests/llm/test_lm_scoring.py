"""Scores against a plain model with dictionaries, and properties of the model."""

import math
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("quernstone.llm")
from quernstone.llm import lm_scoring, queries  # noqa: E402


def cut(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [" s", *re.findall(r"[^\x20\x09-\x0D]+", low), " e"]


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, pairs, triples = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = cut(t)
            c.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
            triples.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c.values()), len(c)
    u = (sum(x == 1 for x in c.values()) + 1) / (n + 2)
    seen = lambda h: pairs[h] if len(h) == 2 else c[" e"] if h == (" s",) else c[h[0]]
    mass = lambda k: lm_scoring.STRENGTH * max(k, 1) ** lm_scoring.GROWTH
    out = []
    for i, t in rows:
        w = cut(t)
        base = score = 0.0
        state = (" s",)
        for x in w[1:]:
            base += math.log10((c[x] + 1) / (n + v + 1))
            # the automaton, arc by arc: follow failure arcs until the state has an arc for x
            at = state
            while at and not (triples[(*at, x)] if len(at) == 2 else pairs[(*at, x)]):
                score += math.log10(mass(seen(at)) / (seen(at) + mass(seen(at))))
                at = at[1:]
            p = (1 - u) * c[x] / n if c[x] else u
            if at:
                p = (pairs[at[-1], x] + mass(seen(at[-1:])) * p) / (seen(at[-1:]) + mass(seen(at[-1:])))
            if len(at) == 2:
                p = (triples[(*at, x)] + mass(seen(at)) * p) / (seen(at) + mass(seen(at)))
            score += math.log10(p)
            state = (state[-1], x) if pairs[state[-1], x] >= lm_scoring.STATE_MIN else (x,)
        out.append((i, held(i), len(w) - 1, sum(c[x] > 0 for x in w[1:]), n, base, score))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op1_backoff_automaton(spark, sf).collect()
    same(got, brute(rows))
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


EDGE = [(1, None), (2, ""), (None, "a b a"), (3, "a B\ta"), (3, "a B\ta"), (4, "É é end start </s> <s>"), (5, "x " * 40_000), (6, "😀\x00y"), (16, "a new word"), (23, "a b"), *[(i, "the same line again") for i in range(100, 140)]]


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, True, "q") for i, t in EDGE], "doc_id long, text string, held_out boolean, chunk string")
    same(lm_scoring.score(docs, chunk_bytes=500).collect(), brute(EDGE))
    assert lm_scoring.score(docs.limit(0)).count() == 0
    none = lm_scoring.score(docs, lm_scoring.F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)


def test_distributions_sum_to_one():
    import numpy as np

    counts = np.array([3, 0, 5, 2, 1, 1, 0])  # end, start, five words of which one is unseen
    totals = lm_scoring.Totals(12, 5, 2)
    a = lm_scoring.Automaton(counts, 1, 0, totals)
    outcomes = np.array([0, 2, 3, 4, 5, 6])
    assert (10 ** a.root[outcomes]).sum() == pytest.approx(1)
    seen = {2: [1, 2, 0, 1, 1, 0], 1: [0, 3, 0, 0, 0, 0], 6: [0] * 6}
    for h, n in seen.items():
        two = a.words_after(np.full(6, h), outcomes, np.array(n, float))
        assert (10**two).sum() == pytest.approx(1)
        for context, three in ((9, [2, 0, 0, 7, 0, 0]), (8, [0, 8, 0, 0, 0, 0]), (3, [0, 0, 0, 0, 0, 0])):
            assert (10 ** a.pairs_after(np.full(6, float(context)), np.array(three, float), two)).sum() == pytest.approx(1)
