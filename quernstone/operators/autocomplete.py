"""Prefix completion from a vocabulary and extraction of names before a cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rank of the kinds of suggestions.
PRIORITY = {"keyword": 3, "variable": 5, "function": 4, "class": 4, "import": 2, "snippet": 2, "pattern": 1}


def suggestions(queries: DataFrame, vocabulary: DataFrame, limit: int = 10, max_prefix: int = 32) -> DataFrame:
    """(query_id, text, kind): for each (query_id, prefix), entries that begin with it, by priority, then confidence, then text.

    Prefixes of the vocabulary up to max_prefix make it an equi-join, not a scan per query; longer prefixes are compared after it.
    """
    short = lambda c: F.substr(F.lower(c), F.lit(1), F.lit(max_prefix))
    v = vocabulary.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(max_prefix))), lambda i: F.substr(F.lower("text"), F.lit(1), i))))
    hits = queries.where(F.length("prefix") > 0).withColumn("key", short(F.col("prefix"))).join(v, "key").where(F.startswith(F.lower("text"), F.lower("prefix")))
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("kind")]
    w = Window.partitionBy("query_id").orderBy(F.desc("priority"), F.desc("confidence"), "text", "kind")
    return hits.withColumn("priority", rank).withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).select("query_id", "text", "kind", "r")


def before_cursor(text: Column, line: Column, column: Column) -> Column:
    """The text up to a cursor (0-based line and column)."""
    lines = F.split(text, "\n")
    return F.concat(F.array_join(F.slice(lines, F.lit(1), line), "\n"), F.when(line > 0, "\n").otherwise(""), F.substr(F.try_element_at(lines, line + 1), F.lit(1), column))


def context(before: Column) -> list[Column]:
    """Word under way, and names assigned, defined, declared and imported before the cursor."""
    names = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(before, F.lit(p), F.lit(1))))
    return [F.regexp_extract(before, r"([A-Za-z_][A-Za-z0-9_]*)$", 1).alias("prefix"), names(r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=[^=]").alias("variables"), names(r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)").alias("functions"), names(r"(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)").alias("classes"), names(r"(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_.]*)").alias("imports")]
