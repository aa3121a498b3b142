"""Template windows against brute force, and planted leaks."""

import random

import pytest

pytest.importorskip("quernstone.llm")
import regex  # noqa: E402

from quernstone.llm import decontaminate as d  # noqa: E402
from quernstone.llm import queries  # noqa: E402


def canon(text):
    text = (text or "").replace(d.MARK, " ")
    edges = r"[^\p{L}\p{N}\x01\s]+(?=\s|$)|(?<!\S)[^\p{L}\p{N}\x01\s]+"
    raw = regex.sub(edges, "", text)
    for p, to in d.SLOTS:
        text = regex.sub(p, to, text)
    text = regex.sub(edges, "", text)
    cut = lambda s: [x for x in regex.split(r"[ \t\n\r\f\v]+", "".join(c.lower() for c in s)) if x]
    return cut(text), cut(raw)


def brute(docs, bench):
    out = set()
    cut = [canon(body) for _, body in docs]
    for item, text in bench:
        t, raw = canon(text)
        if text is None or len(t) < d.MIN_TOKENS:
            continue
        k = min(d.WINDOW, len(t))
        own = [i for i in range(len(t) - k + 1) if 2 * sum(x[0] == d.MARK for x in t[i : i + k]) < k]
        at_item = {}
        for i in own:
            at_item.setdefault(tuple(t[i : i + k]), []).append(i)
        first = {w[0] for w in at_item}
        for (doc, _), (w, wraw) in zip(docs, cut, strict=True):
            hits = {}
            for p in range(len(w) - k + 1):
                if w[p] in first:
                    for i in at_item.get(tuple(w[p : p + k]), ()):
                        hits.setdefault(p - i, set()).add(i)
            good = set()
            for shift, at in hits.items():
                slotted = {i for i in at if any(x[0] == d.MARK for x in t[i : i + k])}
                pairs = {(t[i + j], raw[i + j], wraw[shift + i + j]) for i in slotted for j in range(k) if t[i + j][0] == d.MARK}
                one = len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs})
                good |= at if one else at - slotted
            if good and (len(good) >= min(d.MIN_RUN, len(own)) or 2 * len(good) >= len(own)):
                out.add((doc, item, len(own), len(good)))
    return out


ITEM = "If Anna buys 3 apples for 4 dollars and then Anna sells 3 pears for 9 dollars at 10% profit, how many kilometers does she walk"
BENCH = [(1, ITEM), (2, "tiny item"), (3, None), (4, "just exactly five tokens here"), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10"), (7, "A long plain item without any slots at all that goes on for quite some while until it ends")]
DOCS = [
    (1, ITEM.lower()), (2, "x " * 50 + ITEM.upper()), (3, "Note: " + ITEM.replace("Anna", "Mary").replace("3", "7").replace("4 d", "6 d")),
    (4, ITEM.replace("3 pears", "8 pears").replace("Anna sells", "Bob sells")), (5, None), (6, ""), (7, "so it has just exactly five tokens here, yes"), (7, "so it has just exactly five tokens here, yes"),
    (None, "a long plain item without any slots at all that goes on for a bit"), (8, "a long plain item without any slots"), (9, "1 2 3 4 5 6 7 8 9 10 11"), (10, "w " * 50_000), (11, "\x01n \x01c %%% *** 5kg 5 kg"),
]


def frames(spark, docs, bench):
    return spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, h int"), spark.createDataFrame(bench, "item_id long, text string")


def rows(df):
    return {(r.doc_id, r.item_id, r.n_windows, r.n_matched) for r in df.collect()}


def test_cases(spark):
    docs, bench = frames(spark, DOCS, BENCH)
    got = rows(d.contaminated_pairs(docs, bench))
    assert got == brute(DOCS, BENCH)
    assert {(3, 1), (7, 4), (None, 7)} <= {g[:2] for g in got}
    assert not {(8, 7), (9, 6), (10, 1)} & {g[:2] for g in got}
    again = {(r.doc_id, r.item_id): r.reparameterised for r in d.contaminated_pairs(docs, bench).collect()}
    assert again[3, 1] and not again[7, 4]
    # found verbatim: what templates cannot search for, and a run of 13 tokens whose slots fit no one mapping
    assert {(9, 6), (4, 1)} == {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()} - {g[:2] for g in got}
    bad = {g[0] for g in got} | {4, 9}
    left = d.clean_documents(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in DOCS if i not in bad)


def test_long_runs_take_linear_time(spark):
    docs, bench = frames(spark, [(1, "* " * 40_000 + "*" * 90_000 + "1." * 60_000 + "x " + "9" * 90_000 + "A" * 90_000 + ITEM.lower())], BENCH)
    assert {g[:2] for g in rows(d.contaminated_pairs(docs, bench))} == {(1, 1)}


def test_empty_tables(spark):
    docs, bench = frames(spark, DOCS, BENCH)
    assert d.contaminated_pairs(docs.limit(0), bench).count() == 0
    assert d.contaminated_pairs(docs, bench.limit(0)).count() == 0


def test_tokens_align(spark):
    texts = [t for _, t in [*DOCS, *BENCH]]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", d.template(d.F.col("text")).alias("t"), d.tokens(d.clean(d.F.col("text"))).alias("r")).orderBy("i").collect()
    for row, text in zip(out, texts, strict=True):
        assert (row.t, row.r) == canon(text)
        assert len(row.t) == len(row.r)


def test_planted_passages(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = lambda t: regex.findall(r"[^\x20\x09-\x0D]+", t.lower())
    want = {(i, k) for i, t in docs for k, b in items if " ".join(words(b)) in " ".join(words(t))}
    assert want <= {(r.doc_id, r.item_id) for r in queries.op4_template_decontamination(spark, sf).collect()}
    rng = random.Random(5)
    some = rng.sample(docs, 60) + [x for x in docs if x[0] in {i for i, _ in want}]
    made, bench = frames(spark, some, items)
    assert rows(d.contaminated_pairs(made, bench)) == brute(some, items)
