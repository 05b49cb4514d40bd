"""Queries of the numbered operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import embeddings, fingerprints, importance, language, minhash, mixing, packing, quality, repeats, rollups, sharding, surrogates, trie
from tidemark.llm.workers import importable
from tidemark.sources.lineage import settle, stage_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        LLM_QUERIES[name] = lambda spark, sf_dir: fn(importable(spark), sf_dir)
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = [f"shard-{i:03d}" for i in range(64)]

SHARDING_SQL = """
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range(64) r(i)
), walks AS (
  SELECT list(('0x' || substr(md5(name || '|first'), 1, 15))::BIGINT % 6421 ORDER BY i) AS starts,
         list(('0x' || substr(md5(name || '|stride'), 1, 15))::BIGINT % 6420 + 1 ORDER BY i) AS strides
  FROM shards
), claims AS (
  SELECT 0 AS turn, [0::BIGINT for x in range(6421)] AS owner, starts, strides, -1::BIGINT AS slot FROM walks
  UNION ALL
  SELECT turn + 1,
         list_concat(list_append(owner[1:s], (turn % 64 + 1)::BIGINT), owner[s + 2:]), starts, strides, s
  FROM (SELECT turn, owner, starts, strides,
               list_filter([(starts[turn % 64 + 1] + j * strides[turn % 64 + 1]) % 6421 for j in range(6421)],
                           lambda x: owner[x + 1] = 0)[1] AS s
        FROM claims WHERE turn < 6421)
), slots AS (
  SELECT slot, ((turn - 1) % 64)::INTEGER AS shard FROM claims WHERE turn > 0
)
SELECT doc_id, slot::INTEGER AS slot, shard FROM (
  SELECT doc_id, ('0x' || substr(md5(coalesce('k' || doc_id::VARCHAR, 'n')), 1, 15))::BIGINT % 6421 AS slot FROM documents
) JOIN slots USING (slot)
"""


@query("op1_sharding", SHARDING_SQL)
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, ["doc_id"], SHARDS)


@query("op2_suffix_array_dedup")
def op2(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op3_document_fingerprints")
def op3(spark, sf_dir):
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), packing.public_files())


@query("op5_source_mixing")
def op5(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("times")


def token_totals(docs: DataFrame) -> DataFrame:
    """Load all documents, count the end token too, drop exact copies, and replay the load."""
    spark = docs.sparkSession
    counts = settle(rollups.token_counts(docs, packing.public_files()))
    load = counts.select(F.lit("insert").alias("kind"), "source", "lang", "tokenizer", "n_tokens", F.lit(None).cast("long").alias("old_tokens"))
    ended = F.col("n_tokens") + F.when(F.col("tokenizer") == "byte-bpe-50k-1", 1).otherwise(0)
    recount = counts.filter("tokenizer = 'byte-bpe-50k-1'").select(
        F.lit("revise").alias("kind"), "source", "lang", "tokenizer", ended.alias("n_tokens"), F.col("n_tokens").alias("old_tokens"))
    first = counts.groupBy("tokenizer", "digest").agg(F.min("doc_id").alias("first"))
    copies = counts.join(first, ["tokenizer", "digest"]).filter("doc_id <> first").select(
        F.lit("delete").alias("kind"), "source", "lang", "tokenizer", F.lit(None).cast("long").alias("n_tokens"), ended.alias("old_tokens"))
    ledger = stage_path(spark)
    for batch_id, changes in (("load", load), ("recount", recount), ("copies", copies), ("load", load)):
        rollups.commit(changes, ledger, batch_id)
    return rollups.totals(spark, ledger)


@query("op6_token_counts")
def op6(spark, sf_dir):
    return token_totals(table(spark, sf_dir, "documents"))


@query("op7_embedding_near_dedup")
def op7(spark, sf_dir):
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op8_pii_surrogates")
def op8(spark, sf_dir):
    return surrogates.replace_personal_data(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    scored = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "held_out", "score", "predicted")


@query("op10_minhash_near_dedup")
def op10(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def crc32_sql(bytes_: str) -> str:
    """CRC-32 of a list of bytes in SQL."""
    step = "xor(x >> 1, 3988292384 * (x & 1))"
    return (f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda a, b: "
            f"list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: {step})), 4294967295)")


RESAMPLING_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM d) GROUP BY r, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY w),
buckets AS (
  SELECT w, {crc32_sql("[('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT for i in range(octet_length(encode(w)))]")} % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), s AS (SELECT bucket, sum(n) AS s FROM dw JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN buckets USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
                  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), weights AS (
  SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE
                                               / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS ready
  FROM scored
)
SELECT doc_id, n_features AS n_words, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= ready * 10 // 100 THEN place END AS rank
FROM ranked
"""


@query("op11_importance_resampling", RESAMPLING_SQL)
def op11(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_language_id")
def op12(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


TRIE_SQL = f"""
WITH ids AS (
  SELECT c, c - c % 100 AS base, {crc32_sql("[ord(x)::BIGINT for x in string_split(c::VARCHAR, '')]")} % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, key, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS n,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations)
), rebuilt AS (
  SELECT c, 0 AS side, pos, key, n FROM ids JOIN own ON conv_id = base AND pos <= h
  UNION ALL
  SELECT c, 1 AS side, pos, key, n FROM ids JOIN own ON conv_id = c AND pos > h
), prefixes AS (
  SELECT c, row_number() OVER w AS d, n, string_agg(key, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY side, pos)
  UNION ALL
  SELECT c, 0, 0, '' FROM ids
), lengths AS (SELECT c, max(d) AS len FROM prefixes GROUP BY c),
nodes AS (
  SELECT prefix, d, left(prefix, 64 * (d - 1)) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = len), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (c) GROUP BY prefix, d
), families AS (
  SELECT v.*, (SELECT count(*) FROM nodes u WHERE u.d > 0 AND u.parent = v.prefix AND u.d = v.d + 1) AS n_children FROM nodes v
), sums AS (
  SELECT p.prefix, p.d, sum((n_convs - 1) * v.n)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM families v JOIN prefixes p ON p.c = v.conv_id AND p.d <= v.d GROUP BY p.prefix, p.d
)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM families v JOIN sums USING (prefix, d) LEFT JOIN nodes u ON v.d > 0 AND u.prefix = v.parent AND u.d = v.d - 1
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


LLM_QUERIES["pipeline"] = lambda spark, sf_dir: corpus_pipeline.run(importable(spark), sf_dir)
if corpus_pipeline.ORACLE_SQL is not None:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
