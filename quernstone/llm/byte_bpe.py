"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token-byte table.

Texts are cut into units: a run of white space and the run of other characters after it. No pre-token of the pattern
crosses the start of a unit, and what it matches inside does not depend on other units, so units encode apart. Each chunk of
documents lists its distinct units in sorted order, dealt by hash to buckets; a bucket encodes each distinct unit once for all chunks
that ask for it; the ids go back to their chunks, where the units' positions put them together.

Defined cases: null and empty texts have no ids; repeated rows each get theirs; very long units are encoded like any other; an empty
table gives an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.chunked import CHUNK_BYTES, chunked, pack_object, unpack, unpack_object

#: Characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
MAX_BUCKETS, MAX_KNOWN = 512, 200_000

_encodings: dict = {}
_tables: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoding(path: str, pattern: str):
    """The encoding of a rank file, once per worker process."""
    if (path, pattern) not in _encodings:
        import tiktoken

        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _encodings[path, pattern]


def dealt(units, buckets: int) -> list[list[str]]:
    """Units by bucket, each in sorted order: both ends of the exchange know it, so answers come back without the units."""
    parts: list[list[str]] = [[] for _ in range(buckets)]
    for u in sorted(units):
        parts[zlib.crc32(u.encode("utf-8", "surrogatepass")) % buckets].append(u)
    return parts


def text_of(z: bytes) -> str:
    return unpack(z).decode("utf-8", "surrogatepass")


def distinct_units(blobs) -> set[str]:
    """Text by text, so that only distinct units are held."""
    seen: set[str] = set()
    for z in blobs:
        seen.update(UNIT.findall(text_of(z)))
    return seen


def units_wanted(table: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, units): the distinct units of each chunk."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        full = [(b, pack_object(p)) for b, p in enumerate(dealt(distinct_units(df["z"]), buckets)) if p]
        return pd.DataFrame({"chunk": key[0], "bucket": [b for b, _ in full], "units": [p for _, p in full]})

    return table.groupBy("chunk").applyInPandas(run, "chunk long, bucket int, units binary")


def encoded_units(wanted: DataFrame, buckets: int, path: str, pattern: str) -> DataFrame:
    """(chunk, bucket, ids): each distinct unit of a bucket is encoded once, then kept while memory allows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, known = encoding(path, pattern).encode_ordinary, {}
        for df in batches:
            out = []
            for blob in df["units"]:
                units = unpack_object(blob)
                if len(known) > MAX_KNOWN:
                    known.clear()
                known.update((u, np.array(encode(u), "<u4").tobytes()) for u in units if u not in known)
                out.append(pack_object([known[u] for u in units]))
            yield pd.DataFrame({"chunk": df["chunk"], "bucket": df["bucket"], "ids": out})

    return wanted.repartition(buckets, "bucket").mapInPandas(run, "chunk long, bucket int, ids binary")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, round_trip: bool = False) -> DataFrame:
    """(id, ids): the token ids of every whole text as little-endian unsigned 32-bit integers. With round_trip, `decoded` too: the bytes that
    the ids stand for, looked up in the worker that has them, without another exchange with Python."""
    table, k = chunked(docs, id_col, text, chunk_bytes)
    buckets = min(k, MAX_BUCKETS)
    ids = encoded_units(units_wanted(table, buckets), buckets, path, pattern)

    def assemble(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, bytes] = {}
        answer = dict(zip(answers["bucket"], answers["ids"], strict=True))
        for bucket, units in enumerate(dealt(distinct_units(texts["z"]), buckets)):
            if units:
                known.update(zip(units, unpack_object(answer.pop(bucket)), strict=True))
        of = known.__getitem__
        out = pd.DataFrame({"id": texts["id"], "ids": [b"".join(map(of, UNIT.findall(text_of(z)))) for z in texts["z"]]})
        return out.assign(decoded=[decoded(x, path) for x in out["ids"]]) if round_trip else out

    kind = dict(docs.dtypes)[id_col]
    out = table.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInPandas(assemble, f"id {kind}, ids binary" + ", decoded binary" * round_trip)
    return out.withColumnRenamed("id", id_col)


def decoded(ids: bytes, path: str) -> bytes:
    """Each id is replaced by its row of the token-byte table, a fixed vocabulary of which each worker holds one copy."""
    table = _tables.get(path)
    if table is None:
        table = _tables[path] = {i: b for b, i in read_ranks(path).items()}
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the decoded bytes of a column of ids."""

    @F.pandas_udf("binary")
    def joined(blobs: pd.Series) -> pd.Series:
        return pd.Series([decoded(x, path) for x in blobs])

    return encoded.withColumn(name, joined(F.col(ids)))


def digests(decoded: DataFrame, id_col: str = "doc_id", more: list[str] | None = None) -> DataFrame:
    return decoded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *(more or []))
