"""Language-model scores by a weighted backoff automaton.

Tokens are the words of a text in small ASCII letters, then one end. The model is a trigram model with hierarchical Dirichlet smoothing
(MacKay and Peto, 1995): with counts c over the training texts,

    p(w | u v) = (c(u v w) + m(u v) p(w | v)) / (c(u v) + m(u v)),   m(h) = STRENGTH c(h) ^ GROWTH (at least STRENGTH)
    p(w | v) = (c(v w) + m(v) p(w)) / (c(v) + m(v))
    p(w) = (1 - u) c(w) / N,   p(all unseen words, one class) = u = (n1 + 1) / (N + 2)

where n1 words were seen once (Good and Turing); m(h) grows as the number of distinct successors does. Each distribution sums to one.
As an automaton: the states are the word pairs seen STATE_MIN times or more, the words, and the root. A state has an arc for each word
seen after it, weighted log p(w | state), and a failure arc, weighted log m / (c + m), from a pair to its last word and from a word to the
root; the root has an arc for each word, weighted log p(w). A text is read from left to right: from the state that was
reached, failure arcs are followed until there is an arc for the next word; it leads to the longest state that ends the text so far. That state does
not depend on how many failure arcs were followed, so the states of all steps of a chunk are found first and the weights are added up together.

No model is broadcast. Each chunk of documents asks for the words and bigrams it holds, with its own training counts; hash buckets
add up the counts of all chunks and answer each, and their sums give N, n1 and the number of words. A chunk then knows which of its pairs are
states and asks for the trigrams that begin with one, and has with the answers just that part of the automaton which its texts can reach.
Words go as they are, bigrams and trigrams as 64-bit hashes. All grow with the corpus and are dealt evenly, since a chunk asks once for each.

Defined cases: null and empty texts are one end token; a null id is in training; repeated rows count each and score alike; with nothing in
training all tokens are unseen; an empty table gives an empty result; columns other than id and text are not looked at; a text is never cut, so a chunk may be as long as one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.chunked import CHUNK_BYTES, chunked, dealt, pack, pack_object, unpack, unpack_object
from quernstone.llm.common import checkpoint

STRENGTH, GROWTH = 2.0, 0.8
#: Times that two words have to be seen in a row in training to be a state.
STATE_MIN = 8
#: Hash buckets at most; each holds an even share of the distinct words and bigrams of all chunks.
MAX_BUCKETS = 65_536
#: The two marks hold a space, so no word equals them.
END, START = b" end", b" start"


class Totals(NamedTuple):
    tokens: int
    types: int
    once: int


class Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def transposed(a: np.ndarray) -> bytes:
    """Numbers with equal bytes side by side, which compress."""
    return pack(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()) if len(a) else b""


def restored(blob: bytes, kind: str) -> np.ndarray:
    if not len(blob):
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unpack(blob), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    with np.errstate(over="ignore"):
        k = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
        k = (k ^ (k >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(32))


class Chunk:
    """The tokens of a chunk's texts as numbers, with its distinct words and bigrams in a fixed order."""

    def __init__(self, df: pd.DataFrame):
        vocabulary = Vocabulary()
        number = vocabulary.__getitem__
        end, start = number(END), number(START)
        rows = []
        for z in df["z"]:
            words = unpack(z).lower().split()
            row = np.empty(len(words) + 2, np.int64)
            row[0], row[-1] = start, end
            row[1:-1] = np.fromiter(map(number, words), np.int64, len(words))
            rows.append(row)
        self.lengths = np.array([len(r) - 1 for r in rows], np.int64)
        held = df["held_out"].to_numpy(bool)
        sequence = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        at_start = np.zeros(len(sequence), bool)
        at_start[np.concatenate(([0], np.cumsum(self.lengths + 1)[:-1])).astype(int)] = True
        self.right = sequence[~at_start]
        self.left = sequence[np.flatnonzero(~at_start) - 1]
        self.trains = np.repeat(~held, self.lengths)
        self.words = list(vocabulary)
        self.counts = np.bincount(self.right[self.trains], minlength=len(self.words)).astype(np.uint32)
        import xxhash

        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.keys, self.which = np.unique(mixed(self.hashes[self.left], self.hashes[self.right]), return_inverse=True)
        self.key_counts = self.counted(self.which, len(self.keys))
        self.first = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(int)  # first step of each text

    def counted(self, which: np.ndarray, size: int) -> np.ndarray:
        """Training occurrences of each of the numbers below size; which has a number for each step, or -1."""
        return np.bincount(which[self.trains & (which >= 0)], minlength=size).astype(np.uint32)

    def contexts(self, seen: np.ndarray) -> np.ndarray:
        """Training count of the pair before each step, given that of the bigram that each step makes; 0 where a text begins."""
        out = np.concatenate((np.zeros(1), seen[:-1]))[: len(seen)]
        out[self.first] = 0
        return out

    def trigrams(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys of the trigrams whose first two words are a state, the place there of each step's, or -1)."""
        steps = np.flatnonzero(self.contexts(seen) >= STATE_MIN)
        keys, places = np.unique(mixed(self.keys[self.which[steps - 1]], self.hashes[self.right[steps]]), return_inverse=True)
        which = np.full(len(seen), -1, np.int64)
        which[steps] = places
        return keys, which

    def word_lists(self, buckets: int) -> list[list[bytes]]:
        return dealt(self.words, buckets)

def key_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the hash, so each is a slice of the sorted keys."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def key_parts(keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple[bytes, bytes]]:
    cuts = key_cuts(keys, buckets)
    return [(transposed(np.diff(keys[a:b], prepend=np.uint64(0))), transposed(counts[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def asked(table: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, words, word_counts, keys, key_counts) of what each chunk holds; parts that hold nothing are left out."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(df)
        of = dict(zip(chunk.words, chunk.counts.tolist(), strict=True)).__getitem__
        out = []
        for b, (words, part) in enumerate(zip(chunk.word_lists(buckets), key_parts(chunk.keys, chunk.key_counts, buckets), strict=True)):
            if words or part[0]:
                out.append((key[0], b, pack_object(words), transposed(np.fromiter(map(of, words), np.uint32, len(words))), *part))
        return pd.DataFrame(out, columns=["chunk", "bucket", "words", "word_counts", "keys", "key_counts"])

    return table.groupBy("chunk").applyInPandas(run, "chunk long, bucket int, words binary, word_counts binary, keys binary, key_counts binary")


def summed(df: pd.DataFrame) -> list[bytes]:
    """For each row of keys and counts, the counts of its keys over all rows."""
    keys = [np.cumsum(restored(b, "uint64"), dtype=np.uint64) for b in df["keys"]]
    unique, which = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(which, weights=np.concatenate([restored(b, "uint32") for b in df["key_counts"]]).astype(float), minlength=len(unique)).astype(np.uint64)[which]
    ends = np.cumsum([len(k) for k in keys])
    return [transposed(totals[e - len(k) : e]) for e, k in zip(ends, keys, strict=True)]


def answered(requests: DataFrame) -> DataFrame:
    """(chunk, bucket, word_counts, key_counts, n, v, once): the counts over all chunks, in the order in which each chunk asked; the first row of a bucket has the sum of its words' counts, how many were seen, and how many once."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack_object(b) for b in df["words"]]
        words: dict[bytes, int] = {}
        for ws, blob in zip(lists, df["word_counts"], strict=True):
            for w, n in zip(ws, restored(blob, "uint32").tolist(), strict=True):
                words[w] = words.get(w, 0) + n
        of = words.__getitem__
        out = pd.DataFrame({"chunk": df["chunk"], "bucket": df["bucket"], "word_counts": [transposed(np.fromiter(map(of, ws), np.uint64, len(ws))) for ws in lists], "key_counts": summed(df), "n": 0, "v": 0, "once": 0})
        out.loc[out.index[0], ["n", "v", "once"]] = sum(words.values()), sum(n > 0 for n in words.values()), sum(n == 1 for n in words.values())
        return out

    return requests.groupBy("bucket").applyInPandas(run, "chunk long, bucket int, word_counts binary, key_counts binary, n long, v long, once long")


def asked_trigrams(table: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, keys, key_counts) of the trigrams of each chunk that begin with a state."""

    def run(key: tuple, texts: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(texts)
        keys, which = chunk.trigrams(in_order(got)[chunk.which])
        parts = key_parts(keys, chunk.counted(which, len(keys)), buckets)
        return pd.DataFrame([(key[0], b, *p) for b, p in enumerate(parts) if p[0]], columns=["chunk", "bucket", "keys", "key_counts"])

    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, "chunk long, bucket int, keys binary, key_counts binary")


def answered_trigrams(requests: DataFrame) -> DataFrame:
    """(chunk, bucket, key_counts)."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": df["chunk"], "bucket": df["bucket"], "key_counts": summed(df)})

    return requests.groupBy("bucket").applyInPandas(run, "chunk long, bucket int, key_counts binary")


def in_order(got: pd.DataFrame) -> np.ndarray:
    """The counts of a chunk's sorted keys, from its answers."""
    return np.concatenate([np.zeros(0, np.uint64), *[restored(b, "uint64") for b in got.sort_values("bucket")["key_counts"]]]).astype(float)


class Automaton:
    """The part of the model that a chunk can reach: states are the chunk's words, arcs its bigrams."""

    def __init__(self, counts: np.ndarray, start: int, end: int, totals: Totals):
        c = counts.astype(float)
        unseen = (totals.once + 1) / (totals.tokens + 2)
        self.p = np.where(c > 0, (1 - unseen) * c / max(totals.tokens, 1), unseen)
        self.root = np.log10(self.p)
        self.context = c.copy()
        self.context[start] = c[end]  # each training text starts once and ends once
        self.mass = STRENGTH * np.maximum(self.context, 1) ** GROWTH
        self.failure = np.log10(self.mass / (self.context + self.mass))

    def words_after(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log p(right | left): the arc of a word's state if the bigram was seen n > 0 times, else the failure arc and the root's arc."""
        arc = np.log10((n + self.mass[left] * self.p[right]) / (self.context[left] + self.mass[left]))
        return np.where(n > 0, arc, self.failure[left] + self.root[right])

    @staticmethod
    def pairs_after(context: np.ndarray, n: np.ndarray, below: np.ndarray) -> np.ndarray:
        """log p of each step from the state that it starts in: a pair's, where the pair before it was seen STATE_MIN times, with the arc of a trigram seen n > 0 times or the failure arc to the word's state, whose weight is `below`; the word's elsewhere."""
        mass = STRENGTH * np.maximum(context, 1) ** GROWTH
        step = np.where(n > 0, np.log10((n + mass * 10.0**below) / (context + mass)), np.log10(mass / (context + mass)) + below)
        return np.where(context >= STATE_MIN, step, below)


def score(docs: DataFrame, held_out=None, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a boolean column; by default the CRC-32 of the id modulo 7 is 2."""
    if held_out is None:
        held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2
    docs = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    table, k = chunked(docs, id_col, "text", chunk_bytes, ["held_out"])
    buckets = min(k, MAX_BUCKETS)
    answers = checkpoint(answered(asked(table, buckets)))
    totals = Totals(*answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once")]).first())
    more = answered_trigrams(asked_trigrams(table, answers.select("chunk", "bucket", "key_counts"), buckets))
    both = answers.select("chunk", "bucket", "word_counts", "key_counts", F.lit(2).alias("order")).unionByName(more.select("chunk", "bucket", F.lit(None).cast("binary").alias("word_counts"), "key_counts", F.lit(3).alias("order")))

    def traverse(key: tuple, texts: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(texts)
        two = got[got["order"] == 2].sort_values("bucket")
        of: dict[bytes, int] = {}
        lists = chunk.word_lists(buckets)
        for b, blob in zip(two["bucket"], two["word_counts"], strict=True):
            of.update(zip(lists[b], restored(blob, "uint64").tolist(), strict=True))
        counts = np.fromiter(map(of.__getitem__, chunk.words), np.int64, len(chunk.words))
        seen = in_order(two)[chunk.which]
        which = chunk.trigrams(seen)[1]
        three = np.concatenate((in_order(got[got["order"] == 3]), np.zeros(1)))[which]  # -1 is the 0 at the end
        steps = Automaton.pairs_after(chunk.contexts(seen), three, Automaton(counts, 1, 0, totals).words_after(chunk.left, chunk.right, seen))
        here = counts[chunk.right]
        base = np.log10((here + 1) / (totals.tokens + totals.types + 1))
        per = lambda x: np.add.reduceat(x, chunk.first)
        return pd.DataFrame({"id": texts["id"], "held_out": texts["held_out"], "n_tokens": chunk.lengths, "n_known": per((here > 0).astype(np.int64)), "train_tokens": totals.tokens, "base_score": per(base), "score": per(steps)})

    kind = dict(docs.dtypes)[id_col]
    out = table.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(traverse, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
