"""Token alignment against the definition on whole texts, pair by pair."""

import hashlib
from collections import Counter

import pytest

pytest.importorskip("quernstone.llm")
import public_tokenizers  # noqa: E402

from quernstone.llm import token_align  # noqa: E402
from quernstone.llm.queries import QUERIES  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "foo ", "  a\n\n b\t c", " \n ", "a▁ b", "▁", "x  y  z　 w", "<s> </s> <|endoftext|> <unk>", "naïve 日本語 \U0001f600\U0001f600 ไทย", "é ﬁ ①",
    "it's we'll 12345 don't  stop", "q" * 3000, "\r\n a \x0b b \x00 c", "tab\tend\t", "word " * 2000, "l\n" * 500, " a" * 3, "​ a ​", "a\x85 b", "\t\t  x",
]


def encoded(v, text):
    """Token (id, start, end) of both sides, or none."""
    if not text:
        return [], []
    sides = []
    for ids, table in ((v.a.encode(" " + text, add_special_tokens=False).ids, v.bytes_a), (v.b.encode(text), v.bytes_b)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return [], []
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(table[i])))
            at += len(table[i])
        sides.append(side)
    return tuple(sides)


def brute(v, rows):
    links, out = [], []
    for _, text in rows:
        a, b = encoded(v, text)
        mine, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    mine.append((i, b[j][0]))
                j += 1
        links.append((a, b, mine))
    count = Counter(p for *_, mine in links for p in mine)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(n, best.get(y, 0))
    for (doc, _), (a, b, mine) in zip(rows, links, strict=True):
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        for low, high in zip([0, *ends], ends, strict=False):
            inside = lambda side: ",".join(str(i) for i, s, e in side if low <= s and e <= high)  # noqa: B023, E731
            groups.append(f"{inside(a)}|{inside(b)}")
        text = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(a), len(b), len(groups), len(mine), sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine), text))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_odd_texts(spark, chunk):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b c"), (7, "a b c"), (7, "a b c"), (9_007_199_254_740_993, "large id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(token_align.align(df, A, B, chunk_bytes=chunk)) == sorted(brute(token_align.vocabularies(A, B), rows), key=str)


def test_units_encode_as_in_their_text(spark, sf):
    v = token_align.vocabularies(A, B)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text] + [t for t in ODD if t]
    for t in texts:
        units = v.units(t)
        assert "".join(units) == " " + t
        a, b = v.encode(units)
        whole = v.b.encode(t)
        assert sum(a, []) == v.a.encode(" " + t, add_special_tokens=False).ids
        if b"".join(v.bytes_b[i] for i in whole) == (" " + t).encode():
            assert sum(b, []) == whole


def test_query_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 3000]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(token_align.align(few, A, B)) == sorted(brute(token_align.vocabularies(A, B), rows), key=str)
    assert QUERIES["op13_token_alignment"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_no_rows_and_clashing_columns(spark):
    assert token_align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    clash = spark.createDataFrame([("x", "some text", 5, "u")], "doc_id string, text string, chunk long, units string")
    assert token_align.align(clash, A, B).first().doc_id == "x"
