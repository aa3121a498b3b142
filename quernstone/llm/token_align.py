r"""Cross-tokenizer alignment: which tokens of vocabulary A and of vocabulary B cover the same bytes.

Each text, with a space before it, is encoded by both. The tokens of B are a static interval index: their byte ends, sorted. Every token of A
stabs it by bisection and gets the run of B tokens that it overlaps; these are the links. A gap between tokens that no token of either side
spans is a group boundary. How often the corpus links an (A id, B id) pair is counted over all texts and joined back to all of them.

A text is cut before a space or line feed that follows a visible character. Neither vocabulary has a token across such a place (checked
when they are loaded; where it does not hold, a text is one unit), so tokens, links and groups of a text are those of its units in
a row. A chunk of texts aligns each distinct unit once. A row of a text keeps its unit numbers; the first row of a chunk keeps what its units
link and how often. The counts of pairs are summed over chunks, the highest of each B id is found (a table of at most as many rows
as B has ids, which bounds its broadcast), and the answers are joined back to the chunks that asked.

Defined cases: texts that are null, empty, or whose token bytes of A or B are not the text with its space have no tokens: zeros and an
empty digest, and their units count in no pair; repeated rows count each time; null ids stay null; very long texts are one chunk each; an empty table gives
an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.chunked import pack, unpack
from quernstone.llm.common import checkpoint

SPACE = "▁"
#: Characters after which no text is cut: white space, controls and invisible ones, which the pre-tokenizers may take for white space.
UNSEEN = r"\x00-\x20\x7f-\xa0\xad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
CUT = re.compile(f"(?<=[^{UNSEEN}])(?=[ \n])")
WHOLE = re.compile(r"(?!)")
#: The same cuts, faster, for texts whose only characters of UNSEEN are spaces and line feeds.
ODD, RUNS = re.compile(f"(?![ \n])[{UNSEEN}]"), re.compile("[ \n]*[^ \n]+|[ \n]+")
BATCH = 8_000
CHUNK_BYTES = 8 << 20


class Numbering(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def byte_level(piece: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in piece)


def byte_level_table() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes bytes as: printable ones of Latin-1 stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both encoders and the bytes of their tokens; one per worker process."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        table = byte_level_table()
        names = {i: p for p, i in self.a.get_vocab(with_added_tokens=True).items()}
        own = self.a.get_vocab(with_added_tokens=False)
        self.n_a = max(names) + 1
        self.bytes_a = [b""] * self.n_a
        for i, p in names.items():
            self.bytes_a[i] = byte_level(p, table) if p in own and all(c in table for c in p) else p.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b)]
        normal = [p for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        apart = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in normal)
        self.lead = len(self.b.encode("\n"))  # a line feed before a unit keeps the encoder from adding a space; its tokens come first
        self.cut = CUT if apart and self.bytes_of_b("\n a  b \n") == b" \n a  b \n" else WHOLE
        self.names = [f"{i}{end}" for i in range(self.n_a) for end in ",|"] + [f"{i}{end}" for i in range(self.n_b) for end in ",;"]

    def bytes_of_b(self, text: str) -> bytes:
        return b"".join(map(self.bytes_b.__getitem__, self.b.encode(text)))

    def units(self, text: str) -> list[str]:
        full = " " + text
        return RUNS.findall(full) if self.cut is CUT and not ODD.search(full) else self.cut.split(full)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        if self.cut is WHOLE:
            return a, self.b.encode([u[1:] for u in units], num_threads=1)
        return a, [ids[self.lead :] for ids in self.b.encode(["\n" + u for u in units], num_threads=1)]

    def align(self, units: list[str]) -> Aligned:
        """BATCH units at a time, so that only what is kept of them takes memory."""
        return Aligned.together([Aligned.of(self, units[i : i + BATCH]) for i in range(0, len(units), BATCH)])


@dataclass
class Aligned:
    """Per unit: ok, n_a, n_b, n_groups, n_links and text (its groups, each with its end); per link, in order of units: code = A id x B's size + B id."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    code: np.ndarray
    text: list[str]

    @classmethod
    def together(cls, parts: list[Aligned]) -> Aligned:
        arrays = [np.concatenate([getattr(p, f) for p in parts]) if parts else np.empty(0, np.int64) for f in ("ok", "n_a", "n_b", "n_groups", "n_links", "code")]
        return cls(*arrays, [t for p in parts for t in p.text])

    @classmethod
    def of(cls, v: Vocabularies, units: list[str]) -> Aligned:
        ids_a, ids_b = v.encode(units)
        ok = same_bytes(v, units, ids_a, ids_b)
        if not ok.all():
            ids_a, ids_b = [[x if good else [] for x, good in zip(ids, ok, strict=True)] for ids in (ids_a, ids_b)]
        n_a, n_b = sizes(ids_a), sizes(ids_b)
        a, b = flat(ids_a), flat(ids_b)
        # both sides have the same bytes, so the units in a row are aligned as one text
        len_a, len_b = v.lengths[0][a], v.lengths[1][b]
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        first, last = np.searchsorted(end_b, end_a - len_a, "right"), np.searchsorted(end_b - len_b, end_a, "left")
        overlaps = last - first
        at = np.cumsum(overlaps) - overlaps
        links_b = np.repeat(first - at, overlaps) + np.arange(int(overlaps.sum()))
        code = np.repeat(a, overlaps) * v.n_b + b[links_b]
        unit_a = np.repeat(np.arange(len(units)), n_a)
        total = lambda x: np.bincount(unit_a, weights=x, minlength=len(units)).astype(np.int64)
        close_a, close_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        # the written form: tokens of A, then of B, group by group
        group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
        before = lambda group: np.concatenate(([0], np.cumsum(np.bincount(group, minlength=int(close_a.sum())))))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before(group_b)[group_a]] = 2 * a + close_a
        order[np.arange(len(b)) + before(group_a)[group_b + 1]] = 2 * (v.n_a + b) + close_b
        written = list(map(v.names.__getitem__, order.tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        text = ["".join(written[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        return cls(ok, n_a.astype(np.int32), n_b.astype(np.int32), total(close_a).astype(np.int32), total(overlaps).astype(np.int32), code, text)


def sizes(lists: list) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int64, len(lists))


def flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def same_bytes(v: Vocabularies, units: list[str], ids_a: list, ids_b: list) -> np.ndarray:
    """Which units both sides write as they are. All together are looked at first; one by one only if some are not."""
    raw = [u.encode() for u in units]
    whole, length = b"".join(raw), sizes(raw)

    def all_same(lists: list, table: list[bytes], lengths: np.ndarray) -> bool:
        ids = flat(lists)
        ends = np.concatenate(([0], np.cumsum(lengths[ids])))[np.cumsum(sizes(lists))]
        return np.array_equal(ends, np.cumsum(length)) and b"".join(map(table.__getitem__, ids.tolist())) == whole

    if all_same(ids_a, v.bytes_a, v.lengths[0]) and all_same(ids_b, v.bytes_b, v.lengths[1]):
        return np.ones(len(units), bool)
    joined = lambda ids, table: b"".join(map(table.__getitem__, ids))
    return np.array([joined(x, v.bytes_a) == u and joined(y, v.bytes_b) == u for u, x, y in zip(raw, ids_a, ids_b, strict=True)], bool)


@lru_cache(1)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


SCHEMA = "chunk long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, codes array<long>, counts array<long>, links binary"


def aligned_chunk(v: Vocabularies, chunk: int, ids: list, texts: list) -> pd.DataFrame:
    """The rows of a chunk; the first one's codes, counts and links are the chunk's."""
    number = Numbering()
    numbers = [np.array([number[u] for u in v.units(t)], np.int32) if t else np.empty(0, np.int32) for t in texts]
    x = v.align(list(number))
    counted, rows = [], []
    for i, n in zip(ids, numbers, strict=True):
        if len(n) and x.ok[n].all():
            counted.append(n)
            digest = hashlib.sha256("".join(map(x.text.__getitem__, n.tolist()))[:-1].encode()).hexdigest()
            rows.append((chunk, i, int(x.n_a[n].sum()), int(x.n_b[n].sum()), int(x.n_groups[n].sum()), int(x.n_links[n].sum()), digest, pack(n.astype("<u4").tobytes()), None, None, None))
        else:
            rows.append((chunk, i, 0, 0, 0, 0, "", None, None, None, None))
    codes, which = np.unique(x.code, return_inverse=True)
    times = np.repeat(np.bincount(np.concatenate([*counted, np.empty(0, np.int32)]), minlength=len(number)), x.n_links)
    counts = np.zeros(len(codes), np.int64)
    np.add.at(counts, which, times)
    links = pack(np.concatenate(([len(number)], x.n_links, which)).astype("<u4").tobytes())
    rows[0] = (*rows[0][:8], codes, counts, links)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text: str, chunk_bytes: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, task, n = vocabularies(path_a, path_b), TaskContext.get().partitionId(), 0
        for df in batches:
            sizes = np.cumsum([len(t) if isinstance(t, str) else 0 for t in df["text"]])
            for part in np.split(np.arange(len(df)), np.flatnonzero(np.diff(sizes // chunk_bytes)) + 1):
                if len(part):
                    yield aligned_chunk(v, task << 32 | n, df["id"].iloc[part].tolist(), [t if isinstance(t, str) else "" for t in df["text"].iloc[part]])
                    n += 1

    # ids travel as strings, since pandas would make nullable integers floating
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)


def answered(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of the texts of a chunk."""
    head = rows[rows["codes"].notna()].iloc[0]
    codes, kept = np.asarray(head["codes"], np.int64), np.asarray(head["counts"], np.int64) > 0
    answers = answers.sort_values("code")
    counts, best = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    counts[kept], best[kept] = answers["total"].to_numpy(), answers["best"].to_numpy()
    blob = np.frombuffer(unpack(head["links"]), "<u4").astype(np.int64)
    units = int(blob[0])
    n_links, which = blob[1 : units + 1], blob[units + 1 :]
    ends = np.cumsum(n_links)
    per_unit = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[which])))[np.concatenate(([0], ends))])
    sums, bests = per_unit(counts), per_unit(best)
    picked = [np.frombuffer(unpack(z), "<u4") if z is not None else np.empty(0, "<u4") for z in rows["units"]]
    out = rows[["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
    return out.assign(n_best=[int(bests[k].sum()) for k in picked], count_sum=[int(sums[k].sum()) for k in picked])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id), count_sum (of the pairs' counts, over links), groups_sha256."""
    n_b = vocabularies(path_a, path_b).n_b
    rows = checkpoint(aligned(docs, path_a, path_b, id_col, text, chunk_bytes))
    asked = rows.where("codes IS NOT NULL").select("chunk", F.explode(F.arrays_zip("codes", "counts")).alias("x")).select("chunk", F.col("x.codes").alias("code"), F.col("x.counts").alias("n")).where("n > 0")
    totals = pair_counts(asked, n_b)
    answers = asked.select(F.col("chunk").alias("asker"), "code").join(totals, "code").select("asker", "code", "total", F.col("best").cast("int").alias("best"))
    done = rows.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInPandas(answered, "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return done.select(F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pair_counts(asked: DataFrame, n_b: int) -> DataFrame:
    """(code, total, best) of all pairs of the corpus; best: no other A id is linked more often to the B id."""
    totals = asked.groupBy("code").agg(F.sum("n").alias("total"))
    most = totals.groupBy((F.col("code") % n_b).alias("b")).agg(F.max("total").alias("most"))
    return totals.join(F.broadcast(most), F.col("code") % n_b == F.col("b")).select("code", "total", (F.col("total") == F.col("most")).alias("best"))
