"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: bit i is set if it is set in more than half of the XXH64 hashes (seed 42) of a text's word shingles.

Links at Hamming distance r or less are found without a miss (Pagh, 2016). Each bit position i has a vector m(i) of r + 1 bits;
table v, for each of the 2^(r+1) - 1 vectors v other than zero, keeps the positions with <m(i), v> = 1. The r
positions in which two fingerprints differ leave some v orthogonal to all their m(i), and in table v the two agree.

Equal fingerprints are one class from the start, so copies cost nothing further. A bucket gives the links of a spanning
forest, not all its pairs; a pair is looked at in the first table in which it meets. A bucket above MAX_BUCKET is covered
again on the positions that its table left out, as often as needed. Components come from alternating large-star and small-star
rounds (Kiveris et al., 2014), with a checkpoint in shared storage after each.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows fall into one class;
the id of a component is its smallest non-null id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.common import checkpoint, row_key

BITS, RADIUS, SHINGLE = 64, 4, 4
MAX_BUCKET = 20_000
#: Up to here a bucket's pairs are compared directly; above, it is covered again inside the task first.
DIRECT = 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions. The vectors m(i) run through all but zero in turn, so masks are balanced."""
    vectors = (1 << (radius + 1)) - 1
    m = {p: i % vectors + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (m[p] & v).bit_count() % 2) for v in range(1, vectors + 1)]


MASKS = covering(list(range(BITS)))


def second_masks(table: int) -> list[int]:
    return covering([i for i in range(BITS) if not MASKS[table] >> i & 1])


class Forest:
    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def near_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius among rows of one group; rows are ordered by group."""
    size = np.bincount(group)
    last = np.cumsum(size)[group]  # end of each row's group
    at = np.arange(len(fps))
    step = 1
    while True:
        at = at[at + step < last[at]]
        if not len(at):
            return
        close = np.bitwise_count(fps[at] ^ fps[at + step]) <= radius
        if close.any():
            yield at[close], at[close] + step
        step += 1


def bucket_links(fps: np.ndarray, table: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links of buckets; a pair counts in the first table in which its fingerprints agree."""
    forest, out = Forest(), []

    def offer(a: np.ndarray, b: np.ndarray) -> None:
        diff, t = fps[a] ^ fps[b], table[a]
        first = np.ones(len(a), bool)
        for k in range(int(t.max())):
            first &= (t <= k) | ((diff & np.uint64(MASKS[k])) != 0)
        for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True):
            if forest.join(i, j):
                out.append((int(fps[i]), int(fps[j])))

    sizes = np.bincount(group)
    small = sizes[group] <= DIRECT
    rows = np.flatnonzero(small & (sizes[group] > 1))
    if len(rows):
        dense = np.unique(group[rows], return_inverse=True)[1]
        for a, b in near_pairs(fps[rows], dense, radius):
            offer(rows[a], rows[b])
    for g in np.unique(group[~small]):
        rows = np.flatnonzero(group == g)
        for mask in second_masks(int(table[rows[0]])):
            keys = fps[rows] & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            dense = np.unique(keys[order], return_inverse=True)[1]
            for a, b in near_pairs(fps[rows][order], dense, radius):
                offer(rows[order][a], rows[order][b])
    return out


def links_in_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """rows: table, bucket columns, fp, sorted so that buckets are runs. Gives (a, b) with a > b as signed longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def solve(df: pd.DataFrame) -> pd.DataFrame:
            new = np.ones(len(df), bool)
            keys = df[["t", "k", "t2", "k2"]].to_numpy()
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            found = bucket_links(df["fp"].to_numpy(np.int64).view(np.uint64), df["t"].to_numpy(), np.cumsum(new) - 1, radius)
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": pairs.max(axis=1), "b": pairs.min(axis=1)})

        for df in batches:
            df = df if held is None else pd.concat([held, df], ignore_index=True)
            keys = df[["t", "k", "t2", "k2"]].to_numpy()
            whole = len(df) - int((keys[::-1] == keys[-1]).all(axis=1).argmin()) if (keys != keys[-1]).any() else 0
            held = df.iloc[whole:]
            if whole:
                yield solve(df.iloc[:whole])
        if held is not None and len(held):
            yield solve(held)

    return rows.select("t", "k", "t2", "k2", "fp").mapInPandas(run, "a long, b long")


def near_links(fps: DataFrame, radius: int = RADIUS, most: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius; fps has distinct `fp`."""
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("m")) for i, m in enumerate(MASKS)])
    tables = fps.select("fp", F.explode(masks).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("k"), F.lit(0).alias("t2"), F.lit(0).cast("long").alias("k2"))
    sized = tables.withColumn("n", F.count("*").over(Window.partitionBy("t", "k", "t2", "k2"))).where("n > 1")
    out = links_in_buckets(sized.where(F.col("n") <= most), radius)
    # A bucket over the bound: cover it again on the positions that its table left out. What is still over the bound shares all but a few positions.
    second = F.array(*[F.array(*[F.lit(signed(m)) for m in second_masks(t)]) for t in range(len(MASKS))])
    big = sized.where(F.col("n") > most).select("fp", "t", "k", F.posexplode(F.element_at(second, F.col("t") + 1)).alias("t2", "m"))
    again = big.select("fp", "t", "k", F.col("t2"), F.col("fp").bitwiseAND(F.col("m")).alias("k2")).repartition("t", "k", "t2", "k2").sortWithinPartitions("t", "k", "t2", "k2")
    return out.unionByName(links_in_buckets(again, radius)).distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's smallest node. Rounds grow with the logarithm of a component's size; not to settle is an error."""
    e = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for done in range(rounds + 1):
        mark = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
        if mark == before or not mark.n:
            break
        if done == rounds:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
        before = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        e = checkpoint(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(t)) for t in texts], dtype="int64")

    return docs.withColumn(name, simhash(F.coalesce(F.col(text), F.lit(""))))


def classes(marked: DataFrame, radius: int = RADIUS, most: int = MAX_BUCKET) -> DataFrame:
    """(fp, first, root) of each distinct fingerprint: its smallest (no id, id, row) and its component."""
    own = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    roots = components(near_links(own.select("fp"), radius, most))
    return own.join(roots, own["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def marked_rows(docs: DataFrame) -> DataFrame:
    return checkpoint(fingerprints(docs.select("doc_id", "text")).select("doc_id", row_key().alias("row_key"), "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    marked = marked_rows(docs)
    rooted = classes(marked, radius, most)
    ids = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    of = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that of the smallest id."""
    kept = classes(marked_rows(docs), radius).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_key").alias("__k"))
    rows = docs.withColumn("__k", row_key()).join(kept, "__k", "left_semi")
    return rows.dropDuplicates(["__k"]).select(*docs.columns)
