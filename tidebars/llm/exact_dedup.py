"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.columns import drop_ids, materialize, text_or_empty


def normalised(text: str = "text") -> Column:
    """The text without white space of ASCII; null is the empty text."""
    return F.regexp_replace(text_or_empty(text), "[\\x09-\\x0D\\x20]+", "")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the MD5 of the normalised text. Only (hash, bytes) pairs, made distinct before the
    shuffle, are compared: a hash that more than one byte sequence shares is split further by SHA-256, so a
    collision never joins texts. The group's row with the most code points, then the smallest key, stays.
    Counts and the best row are combined on the map side, so a group of any size costs a row per task. They
    are written before they are joined back, as adaptive execution splits a skewed hash only between two
    shuffled inputs.

    Null and empty texts are equal. Rows that repeat a key of the same text share its fate. A null key
    comes after all others; a row without a key is kept only if no row of its group has one. An empty table
    gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.length(text_or_empty(text)).cast("long").alias("n"),
                       normalised(text).alias("norm"))
    keyed = materialize(rows.select("doc_id", "n", F.md5("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256")))
    variants = rows.select(F.md5("norm").alias("h"), "norm").distinct()
    collided = variants.groupBy("h").count().filter("count > 1").select("h", F.lit(True).alias("collided"))
    collided = materialize(collided)
    keyed = keyed.join(collided, "h", "left").withColumn(
        "variant", F.when(F.col("collided"), F.col("text_sha256")).otherwise("")).drop("collided")
    rank = F.struct((-F.col("n")).alias("shorter"), F.col("doc_id").isNull().alias("unknown"), "doc_id")
    best = materialize(keyed.groupBy(F.col("h").alias("g_h"), F.col("variant").alias("g_variant")).agg(
        F.count("*").alias("group_size"), F.min(rank)["doc_id"].alias("keep_id")))
    return (keyed.join(best, (F.col("h") == F.col("g_h")) & (F.col("variant") == F.col("g_variant")))
            .select(F.col("doc_id").alias(key), "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts; rows without a key always stay."""
    gone = exact_groups(docs, text, key).filter(~F.col("kept") & F.col(key).isNotNull())
    return drop_ids(docs, gone, key)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
