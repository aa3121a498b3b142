"""Queries over the memory store."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import memory as m
from quernstone.plans.literals import Literal
from quernstone.plans.registry import query
from quernstone.sources import views as v

#: A fixed query vector of 64 dimensions; dimension i holds ((i * 7) % 11 - 5) / 10.
VECTOR = [((i * 7) % 11 - 5) / 10 for i in range(64)]
SQL_VECTOR = f"CAST({VECTOR} AS DOUBLE[])"
COSINE = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {SQL_VECTOR}), 6)"
ACTIVE = "is_active AND embedding IS NOT NULL"


@query(f"WITH {v.MEMORY} SELECT id, {COSINE} AS similarity FROM memory WHERE {ACTIVE} ORDER BY similarity DESC, id LIMIT 10")
def vector_topk(spark, sf_dir):
    return m.vector_search(m.scoped(v.memory(spark, sf_dir)), VECTOR).select("id", "similarity")


@query(f"WITH {v.MEMORY} SELECT id, memory_type, {COSINE} AS similarity FROM memory WHERE {ACTIVE} AND memory_type = 'en' AND project_id = 3 ORDER BY similarity DESC, id LIMIT 5")
def vector_topk_scoped(spark, sf_dir):
    return m.vector_search(m.scoped(v.memory(spark, sf_dir), memory_type="en", project_id=3), VECTOR, 5).select("id", "memory_type", "similarity")


@query(f"WITH {v.MEMORY}, top AS (SELECT id, {COSINE} AS similarity FROM memory WHERE {ACTIVE} ORDER BY similarity DESC, id LIMIT 50) SELECT * FROM top WHERE similarity >= 0.15")
def vector_min_similarity(spark, sf_dir):
    return m.vector_search(m.scoped(v.memory(spark, sf_dir)), VECTOR, 50, 0.15).select("id", "similarity")


LEXICAL = "(content ILIKE '%thereon%' OR content ILIKE '%token%' OR content ILIKE '%heitung%')"


@query(f"WITH {v.MEMORY} SELECT id, importance FROM memory WHERE is_active AND {LEXICAL} ORDER BY importance DESC, created_seq DESC, id LIMIT 20")
def lexical_terms(spark, sf_dir):
    return m.lexical_search(m.scoped(v.memory(spark, sf_dir, False)), "thereon, token: of heitung!", 20).select("id", "importance")


@query(f"""WITH {v.MEMORY}, near AS (SELECT id, memory_type, {COSINE} AS similarity FROM memory WHERE {ACTIVE} AND project_id = 2 ORDER BY similarity DESC, id LIMIT 10),
 good AS (SELECT id, memory_type, similarity, 0 AS src, 0 AS pos FROM near WHERE similarity >= 0.1),
 lex AS (SELECT id, memory_type, CAST(0 AS DOUBLE) AS similarity, 1 AS src, row_number() OVER (ORDER BY importance DESC, created_seq DESC, id) AS pos FROM memory
   WHERE is_active AND project_id = 2 AND {LEXICAL} ORDER BY pos LIMIT 30),
 merged AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src) AS r FROM (SELECT * FROM good UNION ALL SELECT * FROM lex))
 SELECT id, memory_type, similarity, src FROM merged WHERE r = 1 ORDER BY src, similarity DESC, pos, id LIMIT 10""")
def hybrid_search(spark, sf_dir):
    return m.hybrid_search(m.scoped(v.memory(spark, sf_dir), project_id=2), "thereon token heitung", VECTOR, 10, 0.1)


@query("SELECT event_id AS id, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7")
def metadata_containment(spark, sf_dir):
    return v.metric(spark, sf_dir).where(m.contains_metadata("props", {"k": 7})).select("id", F.col("metric").alias("event_type"))


@query(f"WITH {v.MEMORY} SELECT id, created_seq FROM memory WHERE is_active AND embedding IS NULL ORDER BY created_seq, id LIMIT 100")
def missing_embeddings(spark, sf_dir):
    return m.missing_embeddings(v.memory(spark, sf_dir)).select("id", "created_seq")


UPSERT_SQL = f"""WITH {v.MEMORY}, rows AS (SELECT *, sha256(concat(memory_type, '|', trim(content, ' '))) AS fingerprint FROM memory WHERE is_active),
 grouped AS (SELECT fingerprint, memory_type, agent, project_id, max(CASE WHEN id % 2 = 0 THEN id END) AS old, min(CASE WHEN id % 2 = 1 THEN id END) AS fresh, max(importance) AS importance, count(*) AS copies
 FROM rows GROUP BY ALL) SELECT fingerprint, coalesce(old, fresh) AS id, memory_type, agent, project_id, importance, copies, old IS NULL AS is_new FROM grouped"""


@query(UPSERT_SQL)
def memory_dedup_upsert(spark, sf_dir):
    rows = v.memory(spark, sf_dir, False)
    return m.upsert(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


@query(f"WITH {v.MEMORY} SELECT memory_type, count(*) AS n FROM memory WHERE is_active AND project_id = 1 GROUP BY memory_type")
def memories_by_type(spark, sf_dir):
    return m.scoped(v.memory(spark, sf_dir, False), project_id=1).groupBy("memory_type").agg(F.count("*").alias("n"))


@query(f"WITH {v.MEMORY} SELECT id, is_active AND id % 11 <> 0 AS is_active FROM memory")
def soft_delete(spark, sf_dir):
    rows = v.memory(spark, sf_dir, False)
    return m.soft_delete(rows, rows.where("id % 11 = 0")).select("id", "is_active")


@query("""WITH r AS (SELECT doc_id AS id, MAP {'lang': lang, 'source': source} AS old FROM documents)
 SELECT id, old['lang'] AS lang, old['source'] AS source, CAST(id % 3 AS VARCHAR) AS rank FROM r""")
def metadata_merge(spark, sf_dir):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    d = v.table(spark, sf_dir, "documents")
    old, new = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), F.create_map(F.lit("lang"), F.lit("zz"), F.lit("rank"), (F.col("doc_id") % 3).cast("string"), F.lit("none"), F.lit(None).cast("string"))
    merged = d.select(F.col("doc_id").alias("id"), m.merge_metadata(old, new).alias("md"))
    return merged.select("id", F.col("md")["lang"].alias("lang"), F.col("md")["source"].alias("source"), F.col("md")["rank"].alias("rank"))


WORDS = "list_filter(string_split_regex(lower({0}), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
MOD = "list_reduce(list_prepend(0::BIGINT, [('0x' || substring(h, 1 + 8 * i, 8))::BIGINT FOR i IN range(8)]), lambda acc, d: (acc * {base} + d) % {dim})"


def embedding_sql(rows: str, dim: int = 768) -> str:
    """(id, embedding) of rows(id, content), the digest taken modulo dim eight hex digits at a time."""
    mod = MOD.format(base=(1 << 32) % dim, dim=dim)
    return f"""toks AS (SELECT id, unnest({WORDS.format("content")}) AS w, generate_subscripts({WORDS.format("content")}, 1) - 1 AS i FROM {rows}), digests AS (SELECT id, i, sha256(w) AS h FROM toks), mods AS (SELECT id, i, {mod} AS m FROM digests),
 slots AS (SELECT id, (m + j * 7919) % {dim} AS slot, sum(1 / (1 + 0.1::DOUBLE * i)) AS w FROM mods, range(8) t(j) GROUP BY ALL), norms AS (SELECT id, sqrt(sum(w * w)) AS n FROM slots GROUP BY id)"""


@query(f"WITH rows AS (SELECT item_id AS id, text AS content FROM benchmark), {embedding_sql('rows')} SELECT id, slot::INT AS slot, round((w / n)::FLOAT::DOUBLE, 6) AS weight FROM slots JOIN norms USING (id)")
def hash_embedding(spark, sf_dir):
    """The slots of the hash embedding of each benchmark item that are not 0."""
    rows = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), m.embed_slots(F.col("text")).alias("slots"))
    e = m.embedding_from_slots(rows)
    return e.select("id", F.posexplode("embedding").alias("slot", "w")).where("w <> 0").select("id", "slot", F.round(F.col("w").cast("double"), 6).alias("weight"))


BACKLOG = f"""WITH {v.MEMORY}, miss AS (SELECT id, CASE WHEN id % 9 = 0 THEN '  ' ELSE content END AS content FROM memory WHERE is_active AND (embedding IS NULL OR id % 3 = 0) ORDER BY created_seq, id LIMIT 60)"""


@query(f"""{BACKLOG}, ok AS (SELECT id, trim(content, ' ') <> '' AS ok FROM miss) SELECT count(*) AS scanned, count_if(ok)::BIGINT AS reindexed, count_if(NOT ok)::BIGINT AS failed, CAST([] AS BIGINT[]) AS candidates, coalesce(list(id ORDER BY id) FILTER (NOT ok), []) AS failures FROM ok
 UNION ALL SELECT count(*), 0, 0, list(id ORDER BY id), [] FROM miss""")
def embedding_backfill(spark, sf_dir):
    """The reports of a run and of a dry run; some contents have no word and fail."""
    k = F.col("id")
    rows = v.memory(spark, sf_dir).withColumn("embedding", F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("embedding"))).withColumn("content", F.when(k % 9 == 0, "  ").otherwise(F.col("content")))
    return m.backfill(rows, 60)[1].unionByName(m.backfill(rows, 60, dry_run=True)[1])


@query(f"""WITH {v.MEMORY}, r AS (SELECT id, content, embedding, CASE id % 4 WHEN 0 THEN concat('new ', memory_type) WHEN 1 THEN content END AS fresh FROM memory), c AS (SELECT id, coalesce(fresh, content) AS content, fresh IS NOT NULL AND fresh <> content AS differs, embedding FROM r),
 d AS (SELECT id, content FROM c WHERE differs), {embedding_sql("d", 64)}, e AS (SELECT id, list(round(w / n, 5) ORDER BY slot) AS weights FROM slots JOIN norms USING (id) GROUP BY id)
 SELECT c.id, md5(c.content) AS content_md5, CASE WHEN differs THEN weights WHEN embedding IS NOT NULL THEN [round(embedding[1]::DOUBLE, 5)] ELSE [] END AS weights, CASE WHEN c.id % 2 = 0 THEN 'changed' ELSE 'old' END AS tag FROM c LEFT JOIN e USING (id)""")
def memory_update(spark, sf_dir):
    """Half of the rows are updated, a quarter with another content."""
    k = F.col("id")
    rows = v.memory(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("tag"), F.lit("old")))
    to = rows.where("id % 4 <> 3").select("id", F.when(k % 4 == 0, F.concat(F.lit("new "), "memory_type")).when(k % 4 == 1, F.col("content")).alias("content"), F.when(k % 2 == 0, F.create_map(F.lit("tag"), F.lit("changed"))).alias("metadata"))
    out = m.updated(rows, to, 64)
    fresh = F.transform(F.filter("embedding", lambda w: w != 0), lambda w: F.round(w.cast("double"), 5))
    return out.select("id", F.md5("content").alias("content_md5"), F.when(k % 4 == 0, fresh).when(F.col("embedding").isNotNull(), F.array(F.round(F.element_at("embedding", 1).cast("double"), 5))).otherwise(F.array().cast("array<double>")).alias("weights"), F.col("metadata")["tag"].alias("tag"))


HELD = Literal(((1, "same text", "note", "a", 3, "p1", None, 10, True), (2, "same text", "note", "a", 5, "p1", None, 20, True), (3, "same text", "note", "b", 1, "p2", None, 30, True), (4, "gone", "note", "a", 9, "p1", None, 5, False), (5, "other", "fact", None, 2, None, "x", 1, True)), "id long, content string, memory_type string, agent string, importance int, project string, tag string, updated_seq long, is_active boolean")
COME = Literal(((11, "  same text ", "note", "a", 7, "p1", "t1"), (12, "same text", "note", "a", 4, "p1", "t2"), (13, "same text", "note", None, 2, None, "t3"), (14, "gone", "note", "a", 1, "p1", None), (15, "gone ", "note", "a", 6, "p1", "t4"), (16, "other", "fact", "c", 8, None, "y"), (17, "same text", "note", "a", 9, "p9", None)), "id long, content string, memory_type string, agent string, importance int, project string, tag string")


@query(Literal(
    (
        (1, "same text", 3, "p1", None, True), (2, "same text", 7, "p1", "t1", True), (3, "same text", 2, "p2", "t3", True), (4, "gone", 9, "p1", None, False), (5, "other", 2, None, "x", True),
        (14, "gone", 6, "p1", "t4", True), (16, "other", 8, None, "y", True), (17, "same text", 9, "p9", None, True),
    ),
    "id long, content string, importance int, project string, tag string, is_active boolean",
).select())
def memory_store(spark, sf_dir):
    """Rows stored against held ones; the results were worked out by hand."""
    made = lambda t: t.withColumn("metadata", F.map_filter(F.create_map(F.lit("project_id"), "project", F.lit("tag"), "tag"), lambda k, v: v.isNotNull()))
    held = made(HELD.df(spark)).withColumn("embedding", F.lit(None).cast("array<float>"))
    out = m.store(held, made(COME.df(spark)).withColumn("updated_seq", F.lit(100).cast("long")))
    return out.select("id", "content", "importance", F.col("metadata")["project_id"].alias("project"), F.col("metadata")["tag"].alias("tag"), "is_active")


JSONS = Literal(((1, '{"a": 1, "b": {"c": "x", "d": [1, 2]}}'), (2, '{"a": 1, "b": {"c": "y"}}'), (3, '{"a": 2}'), (4, None), (5, '{"b": "x", "t": ["p", "q"], "e": {}}'), (6, "not json")), "id long, metadata string")


@query(Literal(((1, "flat"), (2, "flat"), (1, "nested"), (1, "array"), (5, "list"), (5, "empty")), "id long, test string").select())
def nested_containment(spark, sf_dir):
    """The results were worked out by hand."""
    t = JSONS.df(spark)
    tests = {"flat": {"a": 1}, "nested": {"a": 1, "b": {"c": "x"}}, "array": {"b": {"d": [2]}}, "list": {"t": ["q", "p"]}, "empty": {"e": {}}}
    return t.select("id", F.explode(F.array(*[F.when(m.contains_metadata("metadata", w), F.lit(n)) for n, w in tests.items()])).alias("test")).where("test IS NOT NULL")


@query("SELECT event_id AS id FROM events WHERE event_type ILIKE '%click%' OR event_type ILIKE '%error%' OR props ILIKE '%click%' OR props ILIKE '%error%' ORDER BY value DESC, event_id DESC LIMIT 25")
def lexical_metadata(spark, sf_dir):
    """Terms in the content or in the metadata, by importance."""
    e = v.metric(spark, sf_dir).select("id", F.col("metric").alias("content"), F.col("value").alias("importance"), F.col("id").alias("created_seq"), "props")
    return m.lexical_search(e.where(F.lit(True)), "click error", 25, "props").select("id")
