"""The registered queries of this subpackage and the SQL that states the same result, where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import byte_bpe, chat_format, decontaminate, fill_middle, jaccard_join, jump_shard, lm_scoring, quality_gbt, secret_ledger, simhash, site_tree, token_align, token_fst
from quernstone.llm.common import documents, shared_folder, spread


def op1_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op2_site_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return site_tree.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op3_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    clash = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", clash), (-7, 1, "assistant", clash)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(planted)))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return pairs.drop("row_key")


def op5_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_fst.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows arrive in two runs over one ledger, which scan each blob once between them; the findings of both go back to all rows."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    secret_ledger.scan_into(docs.where(first), folder)
    return secret_ledger.report(secret_ledger.scan_into(docs, folder))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, round_trip=True))


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shard.shard(documents(spark, sf_dir), 24)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_gbt.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gbt.judge(docs, model).select("doc_id", *quality_gbt.COUNTS, "base_failed", "kept", "quality_score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(documents(spark, sf_dir).select("doc_id", "text"), "character"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir).select("doc_id", "text"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.align(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (op1_backoff_automaton, op2_site_tree_text, op3_chat_round_trip, op4_template_decontamination, op5_covering_simhash, op6_token_counts, op7_secret_scan, op8_byte_bpe, op9_jump_shards, op10_quality_rules, op11_fill_in_middle, op12_ngram_jaccard_join, op13_token_alignment)
}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Control strings, escaped or not, get a backslash each; a role with a line feed needs the other level.
CHAT_SQL = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
 l AS (SELECT *, max(CAST(contains(role, chr(10)) AS INT)) OVER (PARTITION BY conv_id) AS level, len(regexp_extract_all(role, '[<\\[]\\\\*(?:/?s>|/?INST\\])')) + len(regexp_extract_all(text, '[<\\[]\\\\*(?:/?s>|/?INST\\])')) AS marks FROM c),
 n AS (SELECT *, length(role) + length(text) + (1 - level) * marks + level * (4 * (length(role || text) - length(replace(role || text, '&', ''))) + 3 * (length(role || text) - length(replace(role || text, '<', '')))
  + 4 * (length(role || text) - length(replace(role || text, '[', ''))) + 4 * (length(role) - length(replace(role, chr(10), '')))) + CASE WHEN role = 'assistant' THEN 8 ELSE 23 END AS chars FROM l)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (1 + sum(chars))::BIGINT AS formatted_chars, max(level)::INT AS escape_level FROM n GROUP BY conv_id"""


def secret_sql() -> str:
    """Spans from the lengths of the matches and of what lies between them."""
    found, lists = [], []
    for i, r in enumerate(secret_ledger.RULES):
        p = quoted(r.pattern)
        found.append(f"regexp_extract_all(t, {p}) AS w{i}, regexp_extract_all(t, {p}, {r.group}) AS g{i}, regexp_split_to_array(t, {p}) AS s{i}")
        start = f"(list_sum([length(x) for x in s{i}[1:k]]) + coalesce(list_sum([length(x) for x in w{i}[1:k - 1]]), 0))"
        lists.append(f"list_transform(list_filter(range(1, len(w{i}) + 1), lambda k: length(g{i}[k]) >= {r.least}), lambda k: {{'a': {start}::BIGINT, 'r': {i}, 'b': ({start} + length(w{i}[k]))::BIGINT, 'k': '{r.kind}'}})")
    text = lambda kinds: f"array_to_string([x.k || ':' || x.a || ':' || x.b for x in spans if {kinds}], ',')"
    base = text("x.r < 3")
    counts = ", ".join(f"len([x for x in spans if x.k = '{k}'])::BIGINT AS n_{k}" for k in secret_ledger.BASE_KINDS)
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(found)} FROM d), p AS (SELECT doc_id, list_sort({' || '.join(lists)}) AS spans0 FROM m), q AS (SELECT doc_id, list_transform(spans0, lambda x: x) AS spans FROM p) SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {text('true')} AS spans FROM q"


FILL_MIDDLE_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
 h AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
 SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLE_SQL: dict[str, str] = {"op11_fill_in_middle": FILL_MIDDLE_SQL, "op3_chat_round_trip": CHAT_SQL, "op7_secret_scan": secret_sql()}
