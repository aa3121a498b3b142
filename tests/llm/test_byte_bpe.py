"""Encoding against the tiktoken library, and the exact round trip."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("quernstone.llm")
import public_tokenizers  # noqa: E402

from quernstone.llm import byte_bpe, queries  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a", "a", "it's  we'll\n\n x\t y \r\n", "é漢字 😀\x00\x1c\x1d \x85 z", "w" * 20_000, "the " * 30_000, " \n" * 3000, "<|endoftext|> ##%% 1234567"]


def want(text):
    ids = byte_bpe.encoding(PATH, public_tokenizers.PATTERN).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def merged(piece, ranks):
    """Byte pair encoding by its definition: of neighbours, the pair of the lowest rank is joined, the leftmost of equals, until none has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
        if rank == float("inf"):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_ids_by_the_definition(spark, sf):
    """Without the library: pre-tokens by the pattern, merges by rank, on whole documents and odd texts."""
    import regex

    ranks, known = byte_bpe.read_ranks(PATH), {}
    texts = [t for t in TEXTS if t is None or len(t) < 4000] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        pieces = regex.findall(public_tokenizers.PATTERN, text or "")
        known.update((p, merged(p.encode("utf-8", "surrogatepass"), ranks)) for p in pieces if p not in known)
        assert got[i] == [x for p in pieces for x in known[p]]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'slt  \n\n\t\x1c\x1f\x85\xa0 é漢1٣😀%#")), max_size=30))
def test_units_encode_apart(text):
    encode = byte_bpe.encoding(PATH, public_tokenizers.PATTERN).encode_ordinary
    assert [i for u in byte_bpe.UNIT.findall(text) for i in encode(u)] == encode(text)


def test_cases(spark):
    docs = spark.createDataFrame([(i if i else None, t, i, b"") for i, t in enumerate(TEXTS)], "doc_id long, text string, chunk int, ids binary")
    out = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, chunk_bytes=100), PATH)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in out} == {i if i else None: want(t) for i, t in enumerate(TEXTS)}
    twice = byte_bpe.encode(docs.unionByName(docs), PATH, public_tokenizers.PATTERN)
    assert twice.count() == 2 * len(TEXTS)
    assert byte_bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_tables(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op8_byte_bpe(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in out} == {i: want(t) for i, t in docs.items()}
