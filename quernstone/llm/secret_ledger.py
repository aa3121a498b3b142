r"""Secret scans over an incremental blob ledger.

Each version of each path is addressed by the SHA-256 of its content. The ledger holds the (blob, rule, version)
triples that were scanned and what each gave. A run finds by one join which rule versions each blob lacks, scans each such blob
once for just these, however many paths and versions hold it, and joins the findings back to all of them. Findings are those of the
rule versions asked for; what older versions of a rule found stays in the ledger and out of the result. `scan_into` keeps
the ledger as Parquet files to which each run adds its own; `history` tells from which version to which a path held a secret.

A rule is a regular expression with a length its group must reach. Matches are leftmost and do not overlap;
matches that are too short are dropped after matching. Offsets come from cutting the text at the matches
(split) and adding up the lengths of what lies before, so they count code points and stay inside the JVM.

Defined cases: a null text is the empty blob; copies and repeated rows share one scan and each get all findings; an
empty table or ledger is allowed; a ledger row that was written twice counts once; further columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int
    least: int
    #: Plain strings one of which each match holds, in the case given by `fold`; cheaper to look for than the pattern.
    hints: tuple[str, ...] = ()
    fold: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: Base rules, in the order that ranks kinds at one start. "[0-9a-f]{16,}" finds the same runs as "[0-9a-f]+" with 16 characters or more.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("-----BEGIN ",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 0, 1, ("eyJ",)),
)
#: Tasks over which the rows of one blob are dealt when findings go back to them.
SALTS = 16
BASE_KINDS = ("assign", "access", "hex")
#: Sorted by start, then the rank of the kind.
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,rule:string>>"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in a text."""
    whole, group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    triples = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), group.alias("group"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["gap"])
        end = start + F.length(t["whole"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule")))
        return F.struct(end.alias("at"), F.when(F.length(t["group"]) >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.aggregate(triples, zero, step, lambda acc: acc["spans"])


def may_match(text: Column, rule: Rule) -> Column:
    from functools import reduce

    if rule.hints:
        # lower() also folds other letters onto A-Z, so it can only let more texts pass
        seen = F.lower(text) if rule.fold else text
        return reduce(lambda a, b: a | b, [F.contains(seen, F.lit(h)) for h in rule.hints]) & text.rlike(rule.pattern)
    return text.rlike(rule.pattern)


def scan(blobs: DataFrame, rules: tuple[Rule, ...], text: str = "text", lacking: str | None = None) -> DataFrame:
    """Add `spans`, by start, then the rule's rank. With `lacking`, an array of rule keys, only for the rules that are in it."""
    found = []
    for i, r in enumerate(rules):
        asked = may_match(F.col(text), r)
        found.append(F.when(asked if lacking is None else F.array_contains(lacking, r.key) & asked, matches(F.col(text), r, i)).otherwise(F.array().cast(SPAN)))
    return blobs.withColumn("spans", F.array_sort(F.concat(*found)))


LEDGER = f"blob string, rules array<string>, spans {SPAN}"


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def gathered(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of the blobs with findings of these rule versions."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    held = ledger.select("blob", F.transform(F.filter("spans", lambda s: F.array_contains(wanted, s["rule"])), lambda s: s.withField("rank", rank[s["rule"]])).alias("spans"))
    return held.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))


def offered(docs: DataFrame, hits: DataFrame, text: str = "text") -> DataFrame:
    """docs with `blob` and `spans`. One blob may be the content of a third of all rows: its rows are dealt over SALTS tasks, and the few blobs with findings are offered to each."""
    addressed = docs.withColumn("__blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn("__salt", F.pmod(F.xxhash64("doc_id" if "doc_id" in docs.columns else docs.columns[0]), F.lit(SALTS)).cast("int"))
    hits = hits.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    out = addressed.join(hits, ["__blob", "__salt"], "left")
    return out.select(*[c for c in docs.columns if c not in ("blob", "spans")], F.col("__blob").alias("blob"), F.coalesce("__spans", F.array().cast(SPAN)).alias("spans"))


def scan_incremental(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with `blob` and `spans`, rows to append to the ledger).

    The ledger has a row for each scan: blob, the rule versions applied, and their spans, each with its rule version.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = docs.select(F.sha2(body, 256).alias("__blob"), body.alias("__text")).groupBy("__blob").agg(F.first("__text").alias("__text"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        fresh = scan(blobs, rules, "__text").select(F.col("__blob").alias("blob"), wanted.alias("rules"), "spans")
        hits = fresh.where(F.size("spans") > 0)
    else:
        seen = ledger.where(F.arrays_overlap("rules", wanted)).groupBy(F.col("blob").alias("__blob")).agg(F.flatten(F.collect_set("rules")).alias("__seen"))
        lacking = blobs.join(seen, "__blob", "left").withColumn("__lacking", F.when(F.col("__seen").isNull(), wanted).otherwise(F.array_except(wanted, F.col("__seen"))))
        fresh = scan(lacking.where(F.size("__lacking") > 0), rules, "__text", "__lacking").select(F.col("__blob").alias("blob"), F.col("__lacking").alias("rules"), "spans")
        hits = gathered(ledger.unionByName(fresh), rules)
    return offered(docs, hits, text), fresh


def scan_into(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with `blob` and `spans`. What the ledger (a shared folder, made if need be) lacks for them is scanned and added to it first, so a run that is done again finds its work done."""
    spark = docs.sparkSession
    empty_ledger(spark).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger)
    # the folder is listed when it is read, so the rows written are not read back by the scan that makes them
    scan_incremental(docs, known, rules, text)[1].write.mode("append").parquet(ledger)
    return offered(docs, gathered(spark.read.schema(LEDGER).parquet(ledger), rules), text)


def history(found: DataFrame, path: str = "path", version: str = "version") -> DataFrame:
    """One row for each path and secret: kind, rule, digest of the match and the first and last version that hold it."""
    each = found.select(path, version, "text", F.explode("spans").alias("s"))
    match = F.sha2(F.substr(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), 256)
    return each.select(path, F.col("s.kind").alias("kind"), F.col("s.rule").alias("rule"), match.alias("match_sha256"), version).groupBy(path, "kind", "rule", "match_sha256").agg(F.min(version).alias("first_version"), F.max(version).alias("last_version"), F.count_distinct(version).alias("n_versions"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of a scanned table."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans are replaced together."""
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1)))
    return F.when(F.size("spans") == 0, F.col(text)).otherwise(done)
