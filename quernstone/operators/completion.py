"""A completion index: for every prefix of every entry the best entries, in bounded lists that merge.

Entries are (text, kind, confidence, language); a null language fits all. The lists are rows (prefix, rank, entry) with rank up to LIMIT. Rows are cut to the best
LIMIT of each prefix before the shuffle already (a rank with a bound is taken per task first), so a prefix that many entries share sends LIMIT rows a task.
Two indexes merge by ranking their rows together, since what is outside both lists can't be in the list of both.

Defined cases: null and empty texts are not indexed; repeated entries count once, with their highest confidence; ties go by text and kind; an empty table gives an empty index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators.autocomplete import PRIORITY

#: Entries of a prefix, and characters up to which prefixes are listed.
LIMIT, LONGEST = 10, 32
ENTRY = ["text", "kind", "confidence"]


def best(rows: DataFrame, limit: int) -> DataFrame:
    order = F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv])[F.col("kind")]
    w = Window.partitionBy("prefix").orderBy(F.desc("priority"), F.desc("confidence"), "text", "kind")
    return rows.withColumn("priority", order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("prefix", *ENTRY, "rank")


def build(entries: DataFrame, limit: int = LIMIT, longest: int = LONGEST) -> DataFrame:
    """(prefix, text, kind, confidence, rank): the best entries for each lower-case prefix of up to `longest` characters."""
    own = entries.where("text <> ''").groupBy("text", "kind").agg(F.max("confidence").alias("confidence"))
    low = F.lower("text")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length(low), F.lit(longest))), lambda i: F.substr(low, F.lit(1), i))
    return best(own.select(F.explode(prefixes).alias("prefix"), *ENTRY), limit)


def merge(one: DataFrame, other: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The index of the entries of both."""
    rows = one.drop("rank").unionByName(other.drop("rank"))
    return best(rows.groupBy("prefix", "text", "kind").agg(F.max("confidence").alias("confidence")), limit)


def complete(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, text, kind, rank) for queries (query_id, prefix) of up to LONGEST characters."""
    return queries.select("query_id", F.lower("prefix").alias("prefix")).join(index, "prefix").select("query_id", "text", "kind", "rank")
