"""Quality rules: gradient-boosted trees over document statistics.

Every text is read once, whole, into the statistics in FEATURES. Trees are trained here (Newton boosting
on the logistic loss over feature histograms, with monotonic constraints: a chosen feature may only lower,
or only raise, the score) and flattened into numpy node arrays, which score a batch of documents without a loop
over rows. Training uses a bounded sample of labelled documents; everything else covers all rows.

Defined cases: a null or empty text has no words and fails the base rule; a document with several labels
takes the lowest; without labels of both kinds the base rule decides alone; repeated rows score alike;
further columns pass through (they win over no result column: result columns are made last).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents used for training: those with the smallest hashed ids. The bound also holds what reaches the driver.
TRAIN_ROWS = 8192
LEAST_LABELS = 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the trees see, and the sign of their effect on quality where it is constrained.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "line_words": 0, "digit_share": 0, "upper_share": 0, "end_share": 0, "long_words": 0, "bare_symbols": -1}


def repeated_words(words: list, distinct: set) -> int:
    """Words inside 3-word windows that the text has twice or more, the first ones included."""
    n, v = len(words) - 2, len(distinct)
    if n < 2 or v == len(words):
        return 0
    number = dict(zip(distinct, range(v), strict=True)).__getitem__
    ids = np.fromiter(map(number, words), np.int64, len(words))
    pairs = ids[:-1] * v + ids[1:]
    if v > 2_000_000:  # three numbers would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    run = windows[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    inside[:n] = twice
    inside[1 : n + 1] |= twice
    inside[2:] |= twice
    return int(inside.sum())


def duplicate_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def statistics(text: str | None) -> tuple:
    """COUNTS, then FEATURES, of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    having = lambda these: len(raw) - len(raw.translate(None, these))
    words = raw.split()
    distinct = set(words)
    n, chars, symbols = len(words), len(text) - having(SPACES), having(SYMBOLS)
    dup, lines = duplicate_lines(raw)
    rep = repeated_words(words, distinct)
    w, c = max(n, 1), max(chars, 1)
    bare = symbols - sum(map(raw.count, (b"%%", b"**", b"##", b"$$", b"&&")))
    return (n, chars, symbols, dup, rep, math.log1p(n), chars / w, symbols / c, dup / max(lines, 1), rep / w, len(distinct) / w, w / max(lines, 1), having(b"0123456789") / c, having(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c, having(b".!?") / w, sum(len(x) > 20 for x in distinct) / w, bare / c)


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


@dataclass
class Boosting:
    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    ridge: float = 2.0
    least: int = 8
    signs: tuple = tuple(FEATURES.values())
    nodes: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(p / (1 - p)))
        margin, roots, self.nodes = np.full(len(y), base), [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(self.grow(binned, cuts, p - y, p * (1 - p), np.arange(len(y)), self.depth, -np.inf, np.inf, margin))
        f, c, left, right, v = (np.array(a) for a in zip(*self.nodes, strict=True))
        return Trees(f.astype(int), c.astype(float), left.astype(int), right.astype(int), v.astype(float), np.array(roots), self.depth, base)

    def grow(self, b, cuts, g, h, rows, depth, low, high, margin) -> int:
        """low, high: what monotonic splits above allow the leaves here."""
        at = len(self.nodes)
        here = float(np.clip(-g[rows].sum() / (h[rows].sum() + self.ridge), low, high))
        self.nodes.append((0, np.inf, at, at, self.rate * here))
        best = (1e-6, None)
        if depth and len(rows) >= 2 * self.least:
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, sign in enumerate(self.signs):
                k = len(cuts[f]) + 1
                col = b[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(col, weights=w, minlength=k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                wl, wr = np.clip(-gl / (hl + self.ridge), low, high), np.clip(-(gs - gl) / (hs - hl + self.ridge), low, high)
                gain = -(gl * wl + 0.5 * (hl + self.ridge) * wl**2) - ((gs - gl) * wr + 0.5 * (hs - hl + self.ridge) * wr**2) + (gs * here + 0.5 * (hs + self.ridge) * here**2)
                gain[(nl < self.least) | (len(rows) - nl < self.least) | (sign * (wr - wl) < 0)] = -np.inf
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], (f, i, sign, wl[i], wr[i]))
        if best[1] is None:
            margin[rows] += self.rate * here
            return at
        f, i, sign, wl, wr = best[1]
        mid, goes = (wl + wr) / 2, b[rows, f] <= i
        bounds = ((low, high), (low, high)) if not sign else ((low, mid), (mid, high)) if sign > 0 else ((mid, high), (low, mid))
        left = self.grow(b, cuts, g, h, rows[goes], depth - 1, *bounds[0], margin)
        right = self.grow(b, cuts, g, h, rows[~goes], depth - 1, *bounds[1], margin)
        self.nodes[at] = (f, cuts[f][i], left, right, 0.0)
        return at


def with_statistics(docs: DataFrame, text: str = "text", name: str = "__q") -> DataFrame:
    kinds = ", ".join([f"{c} long" for c in COUNTS] + [f"{f} double" for f in FEATURES])

    @F.pandas_udf(kinds)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=[*COUNTS, *FEATURES])

    return docs.withColumn(name, measured(F.coalesce(F.col(text), F.lit(""))))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text") -> Trees | None:
    """Fit on at most `rows` labelled documents; None, and so no verdict but the base rule's, with fewer than LEAST_LABELS or one class alone. The sample of ids is bounded, so it is broadcast; its statistics come to the driver.
    Of several labels of an id the lowest counts, of several texts the one whose statistics are smallest, in their order."""
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = with_statistics(docs.select("doc_id", text).join(F.broadcast(sample), "doc_id"), text).groupBy("doc_id", "quality").agg(F.min(F.struct(*[f"__q.{f}" for f in FEATURES])).alias("__q")).select("doc_id", "quality", *[f"__q.{f}" for f in FEATURES]).toPandas().sort_values("doc_id")
    y = (found["quality"].to_numpy() > 0).astype(float)
    if len(y) < LEAST_LABELS or y.min() == y.max():
        return None
    return Boosting().fit(found[list(FEATURES)].to_numpy(float), y)


def judge(docs: DataFrame, model: Trees | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """Add COUNTS, base_failed, quality_score and kept. One pass, no shuffle."""

    @F.pandas_udf("double")
    def scored(q: pd.DataFrame) -> pd.Series:
        return pd.Series(np.ones(len(q)) if model is None else model.score(q[list(FEATURES)].to_numpy(float)))

    q = with_statistics(docs, text)
    q = q.withColumn("quality_score", scored(F.col("__q"))).withColumns({c: F.col(f"__q.{c}") for c in COUNTS}).drop("__q")
    q = q.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return q.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= least))
