"""Token totals by source, language and tokenizer version, maintained from signed changes.

A change inserts a document's count, deletes it, or revises it. A batch of changes is summed to a few signed
totals, written to a folder of its own, and counts from the moment a one-row file names that folder for the batch's
id; of several such rows the last counts, so retried or replayed batches count once and a reader never meets a gap.
Totals are the sum over batches. Deltas carry all that is needed: no batch reads documents or earlier totals.
``compact`` brings the batches of many folders into one.

Defined results: null sources, languages and versions are groups of their own; null counts are 0; unknown kinds of
change raise; groups whose documents and tokens are both 0 are left out; empty batches add nothing; repeated
changes within a batch count each; a ledger without batches has no totals; null texts count 0 and are copies of
each other.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import WORD
from tidemark.llm.packing import encoder

GROUP = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
SUMS = [*GROUP, "n_docs", "n_tokens"]


def signed_totals(changes: DataFrame) -> DataFrame:
    """Sums of (kind, source, lang, tokenizer, n_tokens, old_tokens); kind is insert, delete or revise."""
    kind, new, old = F.col("kind"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    known = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0) \
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens = F.when(kind == "insert", new).when(kind == "delete", -old).otherwise(new - old)
    return changes.groupBy(*GROUP).agg(F.sum(known).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


def _name(spark: SparkSession, ledger: str, folder: str, batches: DataFrame) -> None:
    """Let ``folder`` hold the totals of ``batches`` (batch) from now on: one small file, there whole or not at all."""
    batches.select("batch", F.lit(folder).alias("folder"), F.lit(time.time_ns()).alias("at")).coalesce(1) \
        .write.mode("append").parquet(f"{ledger}/commits")


def commit(changes: DataFrame, ledger: str, batch_id: str) -> None:
    """Write the totals of one batch; a batch that is there already is replaced by the same sums."""
    spark, folder = changes.sparkSession, uuid.uuid4().hex
    signed_totals(changes).select(F.lit(batch_id).alias("batch"), *SUMS).coalesce(1).write.parquet(f"{ledger}/totals/{folder}")
    _name(spark, ledger, folder, spark.range(1).select(F.lit(batch_id).alias("batch")))


def _current(spark: SparkSession, ledger: str) -> tuple[DataFrame, list[str]]:
    """Totals by batch as last committed, and the folders they lie in: one row in the commits for each batch written."""
    last = spark.read.schema("batch string, folder string, at long").parquet(f"{ledger}/commits") \
        .groupBy("batch").agg(F.max_by("folder", F.struct("at", "folder")).alias("folder"))
    folders = sorted(r[0] for r in last.select("folder").distinct().collect())
    parts = spark.read.schema(f"batch string, {SCHEMA}").parquet(*[f"{ledger}/totals/{f}" for f in folders])
    place = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return parts.withColumn("folder", place).join(last, ["batch", "folder"]).select("batch", *SUMS), folders


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """Current totals of all committed batches."""
    return _current(spark, ledger)[0].groupBy(*GROUP) \
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")


def compact(spark: SparkSession, ledger: str) -> None:
    """Bring all batches into one folder. Batches keep their ids, so later replays still replace them; a batch that is
    committed meanwhile is newer than what is read here and must not be compacted at the same time."""
    rows, folders = _current(spark, ledger)
    if len(folders) > 1:
        names = spark.read.schema("batch string, folder string, at long").parquet(f"{ledger}/commits").select("batch").distinct()
        folder = uuid.uuid4().hex
        rows.coalesce(1).write.parquet(f"{ledger}/totals/{folder}")
        _name(spark, ledger, folder, names)


def token_counts(docs: DataFrame, files: tuple[str, str, str]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, copy_of) for a word count and a byte-pair vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files).ordinary
        for b in batches:
            n = [len(encode(t.as_py() or "")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "pieces"])

    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce(F.md5("text"), F.lit("")).alias("digest"), words, "text") \
        .mapInArrow(count, "doc_id long, source string, lang string, digest string, words long, pieces long") \
        .select("doc_id", "source", "lang", "digest", F.explode(F.create_map(
            F.lit("words-1"), F.col("words"), F.lit("byte-bpe-50k-1"), F.col("pieces"))).alias("tokenizer", "n_tokens"))
