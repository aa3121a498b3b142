"""Memory store: scoped vector and lexical search, hybrid fill-up, fingerprint upsert, backlog and soft delete.

A table is never changed in place: writes give a new snapshot, which the caller saves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import exprs as x


def scoped(memories: DataFrame, agent: str | None = None, memory_type: str | None = None, project_id: int | None = None, active_only: bool = True) -> DataFrame:
    """Rows within the given scope; arguments that are None do not filter."""
    wanted = {"agent": agent, "memory_type": memory_type, "project_id": project_id}
    return memories.where(x.both([F.col("is_active")] * active_only + [F.col(k) == v for k, v in wanted.items() if v is not None]))


def contains_metadata(metadata: str, wanted: dict) -> Column:
    """JSON containment: every given key has the given value, objects recursively, and arrays as sets of plain values."""

    def tests(path: str, value) -> list[Column]:
        if isinstance(value, dict):
            # an empty object is contained in any object
            return [F.startswith(F.ltrim(F.get_json_object(metadata, path)), F.lit("{"))] + [t for k, v in value.items() for t in tests(f"{path}['{k}']", v)]
        if isinstance(value, (list, tuple)):
            held = F.from_json(F.get_json_object(metadata, path), "array<string>")
            return [F.startswith(F.ltrim(F.get_json_object(metadata, path)), F.lit("["))] + [F.array_contains(held, text(v)) for v in value]
        return [F.get_json_object(metadata, path) == F.lit(text(value))]

    def text(v) -> str:
        return v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return F.coalesce(x.both([t for k, v in wanted.items() for t in tests(f"$['{k}']", v)]), F.lit(False))


def vector_search(memories: DataFrame, query: list[float], k: int = 10, min_similarity: float | None = None) -> DataFrame:
    """The k most similar rows that have a vector; the threshold is applied after the limit. Ties go to the smaller id."""
    q = F.array(*[F.lit(float(v)) for v in query])
    scored = memories.where("embedding IS NOT NULL").withColumn("similarity", F.round(x.cosine("embedding", q), 6))
    top = scored.orderBy(F.desc("similarity"), "id").limit(k)
    return top if min_similarity is None else top.where(F.col("similarity") >= min_similarity)


def lexical_search(memories: DataFrame, query: str, k: int = 10, metadata: str | None = None) -> DataFrame:
    """Rows that hold any of the first 8 terms in the content, or any of the first 5 in the metadata; by importance, then newest. A query without terms matches as a whole."""
    found = x.terms(query)
    like = lambda c, w: F.ilike(F.col(c), F.lit(f"%{w}%"))
    match = x.either([like("content", t) for t in (found[:8] or [query])] + [like(metadata, t) for t in found[:5] if metadata])
    return memories.where(match).orderBy(F.desc("importance"), F.desc("created_seq"), "id").limit(k)


def hybrid_search(memories: DataFrame, query: str, vector: list[float], k: int = 10, min_similarity: float = 0.0) -> DataFrame:
    """Vector rows first, then lexical ones with similarity 0 until k are found; each id once. A blank query finds nothing."""
    if not query.strip():
        return memories.limit(0).select("id", "memory_type", F.lit(0.0).alias("similarity"), F.lit(0).alias("src"))
    near = vector_search(memories, vector, k, min_similarity).select("id", "memory_type", "similarity", F.lit(0).alias("src"), F.lit(0).cast("long").alias("pos"))
    order = Window.orderBy(F.desc("importance"), F.desc("created_seq"), "id")
    plain = lexical_search(memories, query, 3 * k).select("id", "memory_type", F.lit(0.0).alias("similarity"), F.lit(1).alias("src"), F.row_number().over(order).cast("long").alias("pos"))
    first = Window.partitionBy("id").orderBy("src")
    merged = near.unionByName(plain).withColumn("r", F.row_number().over(first)).where("r = 1")
    return merged.orderBy("src", F.desc("similarity"), "pos", "id").limit(k).select("id", "memory_type", "similarity", "src")


def fingerprint(content: str = "content", kind: str = "memory_type") -> Column:
    return F.sha2(F.concat(F.col(kind), F.lit("|"), F.trim(F.col(content))), 256)


def upsert(existing: DataFrame, incoming: DataFrame, scope: tuple[str, ...] = ("agent", "project_id")) -> DataFrame:
    """One active row per fingerprint and scope: the newest existing match keeps its id and takes the highest importance; the rest is inserted once.

    Gives id, memory_type, agent, project_id, importance, copies, is_new. Groups are pre-aggregated, so copies cost no skew.
    """
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1))).where("is_active").withColumn("fingerprint", fingerprint())
    newest = F.max(F.when(F.col("__new") == 0, F.struct("created_seq", "id")))
    grouped = both.groupBy("fingerprint", "memory_type", *scope).agg(newest.alias("old"), F.min(F.when(F.col("__new") == 1, F.struct("created_seq", "id"))).alias("fresh"), F.max("importance").alias("importance"), F.count("*").alias("copies"))
    return grouped.select("fingerprint", F.coalesce("old.id", "fresh.id").alias("id"), "memory_type", *scope, "importance", "copies", F.col("old").isNull().alias("is_new"))


SCOPE_KEYS = ("project_id", "session_id", "component_id")


def store(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A new snapshot (id, content, memory_type, agent, importance, metadata, updated_seq, embedding) after storing rows, in one pass: each is matched with the rows as they were before.

    A row equals an active one with its fingerprint, type and, where it has one, agent, if that row's metadata hold the row's values of SCOPE_KEYS. The newest such row takes the highest importance and the metadata keys that
    it lacks, the first value of each; other rows are added with stripped content, equal ones once. metadata is a map of strings; a row that is not active is kept as it is.
    """
    new = incoming.withColumn("content", F.trim("content")).withColumn("f", fingerprint())
    own = lambda c: F.map_filter(F.coalesce(c, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    new = new.select("id", "content", "memory_type", "agent", "importance", own(F.col("metadata")).alias("metadata"), "updated_seq", "f")
    asked = F.array(*[F.try_element_at("metadata", F.lit(k)) for k in SCOPE_KEYS])
    # equal rows are one: their first makes the row, the others add what it lacks
    group = ["f", "memory_type", "agent", "scope"]
    in_order = lambda key, m: F.transform(F.sort_array(F.collect_list(F.struct(key, F.map_entries(m).alias("e")))), lambda r: F.map_from_entries(r["e"]))
    rows = in_order("id", F.col("metadata"))
    merged = F.aggregate(rows, F.create_map().cast("map<string,string>"), lambda acc, r: F.map_concat(acc, F.map_filter(r, lambda k, v: ~F.map_contains_key(acc, k))))
    once = new.withColumn("scope", asked).groupBy(*group).agg(F.min("id").alias("new_id"), F.min_by("content", "id").alias("new_content"), F.max("importance").alias("new_importance"), merged.alias("new_metadata"), F.max("updated_seq").alias("new_seq"))
    old = existing.withColumn("f", fingerprint())
    held = old.where("is_active").select("f", "memory_type", F.col("agent").alias("old_agent"), F.col("id").alias("old_id"), F.col("metadata").alias("old_metadata"), "updated_seq")
    fits = (F.col("agent").isNull() | (F.col("agent") == F.col("old_agent"))) & F.forall(F.sequence(F.lit(1), F.lit(len(SCOPE_KEYS))), lambda i: F.element_at("scope", i).isNull() | F.coalesce(F.try_element_at("old_metadata", F.element_at(F.array(*map(F.lit, SCOPE_KEYS)), i)) == F.element_at("scope", i), F.lit(False)))
    target = once.join(held, ["f", "memory_type"]).where(fits).groupBy(*group).agg(F.max_by("old_id", F.struct("updated_seq", "old_id")).alias("old_id"))
    marked = once.alias("o").join(target.alias("t"), [F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in group], "left").select("o.*", "t.old_id")
    hits = marked.where("old_id IS NOT NULL").groupBy("old_id").agg(F.max("new_importance").alias("new_importance"), in_order("new_id", F.col("new_metadata")).alias("rows"))
    extra = F.aggregate("rows", own(F.col("metadata")), lambda acc, r: F.map_concat(acc, F.map_filter(r, lambda k, v: ~F.map_contains_key(acc, k))))
    columns = ["id", "content", "memory_type", "agent", "importance", "metadata", "updated_seq", "embedding", "is_active"]
    kept = existing.join(hits, existing["id"] == hits["old_id"], "left").withColumn("metadata", F.when(F.col("old_id").isNull(), F.col("metadata")).otherwise(extra)).withColumn("importance", F.greatest("importance", "new_importance")).select(*columns)
    added = marked.where("old_id IS NULL").select(F.col("new_id").alias("id"), F.col("new_content").alias("content"), "memory_type", "agent", F.col("new_importance").alias("importance"), F.col("new_metadata").alias("metadata"), F.col("new_seq").alias("updated_seq"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(True).alias("is_active"))
    return kept.unionByName(added)


def embedded(rows: DataFrame, dim: int = 768) -> DataFrame:
    """Add `new_embedding`, the hash embedding of the content; null for a content without words."""
    slots = embedding_from_slots(rows.select("id", embed_slots(F.col("content"), dim).alias("slots")), "id", dim).withColumnRenamed("embedding", "new_embedding")
    return rows.join(slots, "id", "left")


def updated(memories: DataFrame, changes: DataFrame, dim: int = 768) -> DataFrame:
    """A snapshot after changes (id, content, metadata; null leaves as it is): a content that differs is embedded anew, metadata are replaced."""
    c = changes.select("id", F.col("content").alias("new_content"), F.col("metadata").alias("new_metadata"))
    both = memories.join(c, "id", "left")
    differs = F.col("new_content").isNotNull() & ~F.col("new_content").eqNullSafe(F.col("content"))
    fresh = embedded(both.where(differs).select("id", F.col("new_content").alias("content")), dim).select("id", "new_embedding")
    out = both.withColumn("__differs", differs).join(fresh, "id", "left")
    return out.withColumns({"content": F.when(F.col("__differs"), F.col("new_content")).otherwise(F.col("content")), "embedding": F.when(F.col("__differs"), F.col("new_embedding")).otherwise(F.col("embedding")), "metadata": F.coalesce("new_metadata", "metadata")}).select(*memories.columns)


def backfill(memories: DataFrame, limit: int = 100, dim: int = 768, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the rows that get a vector with it, a report: scanned, reindexed, failed, candidates, failures). Rows that can't be embedded are counted and named, and stop no others; a dry run only names its candidates."""
    missing = missing_embeddings(memories, limit)
    tried = embedded(missing.select("id", "content"), dim)
    ok = F.col("new_embedding").isNotNull() & F.lit(not dry_run)
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    failed = F.col("new_embedding").isNull() & F.lit(not dry_run)
    report = tried.agg(F.count("*").alias("scanned"), F.count_if(ok).alias("reindexed"), F.count_if(failed).alias("failed"), ids(F.lit(dry_run)).alias("candidates"), ids(failed).alias("failures"))
    return tried.where(ok).select("id", F.col("new_embedding").alias("embedding")), report


def merge_metadata(old: Column, new: Column) -> Column:
    """Existing keys win; keys without a value are not added. Needs spark.sql.mapKeyDedupPolicy=LAST_WIN."""
    return F.map_concat(F.map_filter(new, lambda k, v: v.isNotNull()), old)


def missing_embeddings(memories: DataFrame, limit: int = 100) -> DataFrame:
    """Active rows without a vector, oldest first; the limit is held within 1 and 1000."""
    return memories.where("is_active AND embedding IS NULL").orderBy("created_seq", "id").limit(min(max(limit, 1), 1000))


def soft_delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """A snapshot in which the given ids are inactive."""
    return memories.join(ids.select("id", F.lit(True).alias("__gone")).distinct(), "id", "left").withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).drop("__gone")


def embed_slots(text: Column, dim: int = 768, spread: int = 8, step: int = 7919) -> Column:
    """Slots and weights of the hash embedding: token i adds 1 / (1 + 0.1 i) at (sha256(token) + step j) mod dim, for j below spread.

    The digest is reduced modulo dim eight hex digits at a time, so no number exceeds 64 bits.
    """
    base = (1 << 32) % dim
    mod = lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda acc, i: (acc * base + F.conv(F.substr(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long")) % dim)
    # in steps, so that a token's digest is made once, not for each of its digits and slots
    places = F.transform(F.transform(x.words(F.lower(text)), lambda t: F.sha2(t, 256)), mod)
    return F.flatten(F.transform(places, lambda m, i: F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda j: F.struct(((m + j * step) % dim).cast("int").alias("slot"), (1 / (1 + F.lit(0.1) * i)).alias("weight")))))


def embedding_from_slots(slots: DataFrame, key: str = "id", dim: int = 768) -> DataFrame:
    """(key, embedding): slots (array of slot and weight) summed and scaled to norm 1."""
    # from explode() the planner infers that there are slots, and makes those of all texts to find out, also of texts that a join or filter leaves out
    each = slots.select(key, F.explode_outer("slots").alias("s")).where("s IS NOT NULL")
    summed = each.groupBy(key, "s.slot").agg(F.sum("s.weight").alias("w"))
    packed = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return packed.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("n")).cast("float")).alias("embedding"))
