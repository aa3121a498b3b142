"""Documents dealt into chunks, so that a vocabulary is asked for once per chunk and word, not once per occurrence.

The chunk of a row follows from a hash of its id and text, so it survives retries, does not depend on the scan and is the same in each job that
deals the table. Rows that repeat with id and text share a chunk. The number of chunks follows from the measured bytes of
the texts; one text is never cut, so a chunk is CHUNK_BYTES or its longest text. Texts travel compressed. Both users of a chunked table (the one that lists what a chunk needs and the one
that puts the answers to use) read the same exchange.
"""

from __future__ import annotations

import pickle
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import text_bytes

CHUNK_BYTES = 12 << 20


@lru_cache(1)
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(data: bytes) -> bytes:
    return _codec()[0].compress(data)


def unpack(data: bytes) -> bytes:
    return _codec()[1].decompress(bytes(data))


def pack_object(x) -> bytes:
    return pack(pickle.dumps(x, 5))


def unpack_object(data: bytes):
    """For blobs that pack_object wrote in the same job."""
    return pickle.loads(unpack(data))


def n_chunks(docs: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(8, -(-text_bytes(docs, text) // chunk_bytes))


def chunked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, more: list[str] | None = None) -> tuple[DataFrame, int]:
    """(chunk, id, z: the compressed text, more columns) and the number of chunks."""
    k = n_chunks(docs.select(id_col, text), text, chunk_bytes)

    @F.pandas_udf("binary")
    def squeezed(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(t.encode("utf-8", "surrogatepass")) for t in texts])

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.pmod(F.xxhash64(id_col, text), F.lit(k)).alias("chunk"), F.col(id_col).alias("id"), squeezed(body).alias("z"), *(more or [])), k


def dealt(words, buckets: int) -> list[list[bytes]]:
    """Words by hash bucket, each list sorted: both ends of an exchange know the order, so answers come back without the words."""
    parts: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in sorted(words):
        parts[zlib.crc32(w) % buckets].append(w)
    return parts
