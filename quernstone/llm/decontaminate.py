r"""Benchmark decontamination by canonical templates.

Numbers, quantities, units and names become typed placeholders, letters become small and outer punctuation goes. Windows of
WINDOW template tokens of the documents are hash-joined with those of the benchmark items, for all documents that share a shorter block of
tokens with an item: blocks at every few tokens suffice to meet each window. Along each alignment
(document position minus item position) the filled slots must map one to one between item and document: 3 apples
and 3 pears may become 7 and 7, but not 7 and 9. Windows with slots on an alignment that breaks this do not count.

A document is contaminated by an item if MIN_RUN windows of it match (a run of 13 tokens, when they are neighbours), or all
if it has fewer, or half of all. An item shorter than a window is one window of its own length; one of under MIN_TOKENS
tokens says too little to be searched for by template, and is searched for verbatim. A template window needs more plain tokens than placeholders.

Items that these two rules shorten (any window with half or more placeholders, or under MIN_TOKENS tokens) are searched for verbatim as
well: windows of raw tokens, all of them, under the same bounds; `leaks` gives both kinds.

Names are capitalised words inside a sentence; at its start, where any word has a capital, a word stays plain.

Defined cases: null and empty texts match nothing; rows are told apart by id and text, so null ids work and repeated rows share their
result; an empty table on either side gives an empty result; further columns are ignored. All expressions are built-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpoint, row_key

WINDOW, MIN_TOKENS, MIN_RUN = 8, 5, 6
#: Rows of a side up to which it may be broadcast (some tens of MB); larger ones are shuffled.
MAX_BROADCAST_ROWS = 300_000
MARK = "\x01"
UNITS = "kg|g|mg|t|lb|lbs|oz|km|m|cm|mm|mi|ft|in|yd|l|ml|gal|s|ms|min|h|hr|hrs|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|dollars|euros|cents|usd|eur|percent|degrees|miles|meters|metres|feet|inches|kilometers|kilometres|kilograms|grams|liters|litres|mph|kmh|kw|w|v|hz|gb|mb|kb"
#: A run of digits and signs, taken whole or not at all, so long runs take linear time.
NUMBER = r"(?<![\p{L}\p{N}.,:/-])[.,:/-]*+\p{N}[\p{N}.,:/-]*+"
#: (pattern, replacement), in order.
SLOTS = (
    (rf"{NUMBER}(?:(?i:{UNITS})(?![\p{{L}}\p{{N}}])|[%°])", MARK + "q"),
    (rf"{NUMBER}(?![\p{{L}}\p{{N}}])", MARK + "n"),
    (rf"(?<=\x01n\s)(?i:{UNITS})(?![\p{{L}}\p{{N}}])", MARK + "u"),
    (r"(?<=[\p{L}\p{N},;]\s)\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", MARK + "c"),
)
#: What lies between two tokens, with the punctuation at their edges. Only loops over single characters: long runs neither recurse nor start again at each character.
BETWEEN = r"(?<![^\p{L}\p{N}\x01\s])[^\p{L}\p{N}\x01\s]*+\s[^\p{L}\p{N}\x01]*+"
#: Candidates share a block of BLOCK template tokens with an item.
BLOCK = MIN_TOKENS


def tokens(text: Column) -> Column:
    """Small-lettered tokens without outer punctuation. A space at both ends puts the edges of the text between tokens too."""
    return F.filter(F.split(F.lower(F.concat(F.lit(" "), text, F.lit(" "))), BETWEEN), lambda t: t != "")


def clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARK, " ")


def template(text: Column) -> Column:
    """Template tokens, position by position the same as tokens(clean(text))."""
    out = clean(text)
    with_numbers = out
    for pattern, to in SLOTS[:3]:
        with_numbers = F.regexp_replace(with_numbers, pattern, to)
    out = F.when(out.rlike(r"\p{N}"), with_numbers).otherwise(out)
    return tokens(F.regexp_replace(out, *SLOTS[3]))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once and not in each step of a loop in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(hashes: Column, size: int) -> Column:
    """(pos, hash) of all windows of the given size over token hashes."""
    last = F.size(hashes) - size
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(hashes, i + 1, F.lit(size)), F.lit(size)).alias("h")))
    return F.when(last >= 0, every).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def blocks(hashes: Column, stride: int) -> Column:
    """Hashes of the blocks that start at multiples of the stride."""
    last = F.size(hashes) - BLOCK
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.xxhash64(F.slice(hashes, i + 1, F.lit(BLOCK))))).otherwise(F.array().cast("array<bigint>"))


def token_hashes(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.xxhash64(t))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """item_id, size, n_windows, ipos, h, slotted, w_tokens, w_raw."""
    items = bench.where("text is not null").select("item_id", template(F.col("text")).alias("t"), tokens(clean(F.col("text"))).alias("raw")).where(F.size("t") >= MIN_TOKENS)
    items = items.withColumn("size", F.least(F.size("t"), F.lit(WINDOW)))
    starts = items.select("*", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("size"))).alias("ipos"))
    cut = starts.select("item_id", "size", "ipos", F.slice("t", F.col("ipos") + 1, F.col("size")).alias("w"), F.slice("raw", F.col("ipos") + 1, F.col("size")).alias("w_raw"))
    marks = F.size(F.filter("w", lambda t: F.startswith(t, F.lit(MARK))))
    cut = cut.withColumn("slots", marks).where(2 * F.col("slots") < F.col("size"))
    sized = cut.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    return cut.join(sized, "item_id").select("item_id", "size", "n_windows", "ipos", F.xxhash64(token_hashes(F.col("w")), F.col("size")).alias("h"), (F.col("slots") > 0).alias("slotted"), "w", "w_raw")


def candidates(docs: DataFrame, index: DataFrame, stride: int) -> DataFrame:
    """row_key of every row that shares a block with an item. A window of `size` tokens holds a whole block that starts at a multiple of size - BLOCK + 1, wherever it lies, so no row with a matching window is missed."""
    starts = index.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - BLOCK), lambda i: F.xxhash64(token_hashes(F.slice("w", i + 1, F.lit(BLOCK)))))).alias("b")).distinct()
    hashed = docs.select(row_key().alias("row_key"), let(token_hashes(template(F.col("text"))), lambda h: blocks(h, stride)).alias("__b"))
    # explode() would have the planner repeat the whole expression in a filter for non-empty arrays, also below the join
    return hashed.select("row_key", F.explode_outer("__b").alias("b")).join(maybe_broadcast(starts, starts.count()), "b", "left_semi").select("row_key").distinct()


def contaminated_pairs(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, row_key, item_id, n_windows, n_matched, coverage, reparameterised; a row for each contaminated row and item."""
    docs = docs.select("doc_id", "text")
    index = checkpoint(benchmark_windows(bench))
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect()) or [WINDOW]
    n_index = index.count()
    rows = checkpoint(candidates(docs, index, min(sizes) - BLOCK + 1))
    docs = docs.withColumn("row_key", row_key()).join(maybe_broadcast(rows, rows.count()), "row_key", "left_semi").select("doc_id", "text")
    hashed = docs.select("doc_id", row_key().alias("row_key"), let(token_hashes(template(F.col("text"))), lambda h: F.concat(*[windows(h, k) for k in sizes])).alias("__w"))
    found = hashed.select("doc_id", "row_key", F.explode_outer("__w").alias("__w")).select("doc_id", "row_key", "__w.pos", "__w.h")
    hits = found.join(maybe_broadcast(index.select("h", "item_id", "ipos", "n_windows", "slotted"), n_index), "h").select("doc_id", "row_key", "item_id", "n_windows", "pos", "ipos", "slotted")
    hits = hits.distinct()
    shifts = hits.groupBy("row_key", "item_id", "n_windows", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.first("doc_id").alias("doc_id"), F.collect_set("ipos").alias("all"), F.collect_set(F.when(F.col("slotted"), F.col("ipos"))).alias("slotted"))
    if any(r.slotted for r in index.select("slotted").distinct().collect()):
        shifts = checked_slots(docs, shifts, index)
    else:
        shifts = shifts.withColumn("broken", F.lit(False)).withColumn("changed", F.lit(False))
    good = shifts.withColumn("kept", F.when(F.col("broken"), F.array_except("all", "slotted")).otherwise(F.col("all")))
    pairs = good.groupBy("row_key", "item_id", "n_windows").agg(F.first("doc_id").alias("doc_id"), F.size(F.array_distinct(F.flatten(F.collect_list("kept")))).cast("long").alias("n_matched"), F.max(F.col("changed") & ~F.col("broken")).alias("reparameterised"))
    enough = (F.col("n_matched") >= F.least(F.lit(MIN_RUN), F.col("n_windows"))) | (2 * F.col("n_matched") >= F.col("n_windows"))
    return pairs.where(enough & (F.col("n_matched") > 0)).select("doc_id", "row_key", "item_id", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), "reparameterised")


def checked_slots(docs: DataFrame, shifts: DataFrame, index: DataFrame) -> DataFrame:
    """Add `broken` (slots do not map one to one on this alignment) and `changed` (a slot is filled otherwise than in the item)."""
    doubtful = shifts.where(F.size("slotted") > 0)
    keys = doubtful.select("row_key").distinct()
    rows = docs.withColumn("row_key", row_key()).join(maybe_broadcast(keys, keys.count()), "row_key", "left_semi")
    raws = rows.select("row_key", "text").dropDuplicates(["row_key"]).select("row_key", tokens(clean(F.col("text"))).alias("raw"))
    slots = index.where("slotted").select("item_id", "ipos", "w", "w_raw")
    at = doubtful.select("row_key", "item_id", "shift", F.explode("slotted").alias("ipos")).join(slots, ["item_id", "ipos"]).join(raws, "row_key")
    zipped = F.arrays_zip("w", "w_raw", F.slice("raw", F.col("shift") + F.col("ipos") + 1, F.size("w")).alias("d"))
    each = at.select("row_key", "item_id", "shift", F.explode(zipped).alias("z")).where(F.startswith(F.col("z.w"), F.lit(MARK))).select("row_key", "item_id", "shift", F.col("z.w").alias("kind"), F.col("z.w_raw").alias("a"), F.col("z.d").alias("b")).distinct()
    kinds = each.groupBy("row_key", "item_id", "shift", "kind").agg(F.count("*").alias("n"), F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"), F.max(F.col("a") != F.col("b")).alias("changed"))
    flags = kinds.groupBy("row_key", "item_id", "shift").agg(F.max((F.col("n") != F.col("na")) | (F.col("n") != F.col("nb"))).alias("broken"), F.max("changed").alias("changed"))
    return shifts.join(flags, ["row_key", "item_id", "shift"], "left").withColumn("broken", F.coalesce("broken", F.lit(False))).withColumn("changed", F.coalesce("changed", F.lit(False)))


def verbatim_windows(bench: DataFrame) -> DataFrame:
    """item_id, size, n_windows, ipos, h, w: all raw windows of the items of which the template index lacks some."""
    items = bench.where("text is not null").select("item_id", template(F.col("text")).alias("t"), tokens(clean(F.col("text"))).alias("raw")).where(F.size("t") > 0)
    items = items.withColumn("size", F.least(F.size("t"), F.lit(WINDOW))).withColumn("n_windows", (F.size("t") - F.col("size") + 1).cast("long"))
    starts = items.select("*", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("size"))).alias("ipos"))
    slots = F.size(F.filter(F.slice("t", F.col("ipos") + 1, F.col("size")), lambda t: F.startswith(t, F.lit(MARK))))
    lacking = starts.where((2 * slots >= F.col("size")) | (F.size("t") < MIN_TOKENS)).select("item_id").distinct()
    cut = starts.join(lacking, "item_id", "left_semi").select("item_id", "size", "n_windows", "ipos", F.slice("raw", F.col("ipos") + 1, F.col("size")).alias("w"))
    return cut.withColumn("h", F.xxhash64(token_hashes(F.col("w")), F.col("size")))


def verbatim_pairs(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """As contaminated_pairs, by windows of raw tokens."""
    docs = docs.select("doc_id", "text")
    index = checkpoint(verbatim_windows(bench))
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())
    n_index = index.count()
    # A row with a matching window shares a block with it, or the whole window where that is shorter than a block; stride as in candidates()
    long = [k for k in sizes if k >= BLOCK]
    inner = F.transform(F.sequence(F.lit(0), F.col("size") - BLOCK), lambda i: F.xxhash64(token_hashes(F.slice("w", i + 1, F.lit(BLOCK)))))
    starts = index.select(F.explode(F.when(F.col("size") >= BLOCK, inner).otherwise(F.array("h"))).alias("b")).distinct()
    parts = lambda h: F.concat(F.array().cast("array<bigint>"), *[blocks(h, k - BLOCK + 1) for k in long[:1]], *[F.transform(windows(h, k), lambda w: w["h"]) for k in sizes if k < BLOCK])
    raw = lambda: token_hashes(tokens(clean(F.col("text"))))
    keyed = docs.limit(0) if not sizes else docs
    hashed = keyed.select(row_key().alias("row_key"), let(raw(), parts).alias("__b"))
    rows = checkpoint(hashed.select("row_key", F.explode_outer("__b").alias("b")).join(maybe_broadcast(starts, starts.count()), "b", "left_semi").select("row_key").distinct())
    near = docs.withColumn("row_key", row_key()).join(maybe_broadcast(rows, rows.count()), "row_key", "left_semi").dropDuplicates(["row_key"])
    cut = near.select("doc_id", "row_key", let(raw(), lambda h: F.concat(F.array().cast("array<struct<pos:int,h:bigint>>"), *[windows(h, k) for k in sizes])).alias("__w"))
    found = cut.select("doc_id", "row_key", F.explode_outer("__w").alias("__w")).select("doc_id", "row_key", "__w.h")
    hits = found.join(maybe_broadcast(index.select("h", "item_id", "ipos", "n_windows"), n_index), "h")
    pairs = hits.groupBy("row_key", "item_id", "n_windows").agg(F.first("doc_id").alias("doc_id"), F.countDistinct("ipos").alias("n_matched"))
    enough = (F.col("n_matched") >= F.least(F.lit(MIN_RUN), F.col("n_windows"))) | (2 * F.col("n_matched") >= F.col("n_windows"))
    return pairs.where(enough).select("doc_id", "row_key", "item_id", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), F.lit(False).alias("reparameterised"))


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """contaminated_pairs, and the verbatim pairs that it lacks."""
    by_template = checkpoint(contaminated_pairs(docs, bench))
    return by_template.unionByName(verbatim_pairs(docs, bench).join(by_template, ["row_key", "item_id"], "left_anti"))


def clean_documents(docs: DataFrame, bench: DataFrame, pairs=leaks) -> DataFrame:
    """The rows that no benchmark item contaminates, by `pairs`."""
    bad = checkpoint(pairs(docs, bench).select(F.col("row_key").alias("__k")).distinct())
    return docs.withColumn("__k", row_key()).join(maybe_broadcast(bad, bad.count()), "__k", "left_anti").select(*docs.columns)
