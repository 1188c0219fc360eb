"""Secret scanning over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.columns import materialize, text_or_empty

RULES_VERSION = 1
# fixed values: the kinds in the order in which spans of one start are listed, and their patterns. The first
# is matched as it stands and short values are dropped afterwards, as a short match uses up its text; runs of
# the other two that are too short can never hide a longer one, so their length is part of the pattern.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex"]
LEAST_VALUE = 6

SPAN = "array<struct<start:long,kind:int,end:long>>"
LEDGER = "blob string, rules int, spans " + SPAN


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all leftmost matches, found as the gaps between the parts that ``split`` leaves."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    walked = F.aggregate(
        F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("part"), found.alias("hit")),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["part"]) + F.length(x["hit"])).cast("long").alias("at"),
            F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(x["part"])).cast("long").alias("start"), F.lit(kind).alias("kind"),
                (acc["at"] + F.length(x["part"]) + F.length(x["hit"])).cast("long").alias("end")))).alias("spans")),
        lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(SPAN))


def find_spans(text: Column) -> Column:
    """All spans of a text, by start and kind; starts and ends count code points."""
    assigned = _matches(text, ASSIGN, 0)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    long_enough = F.transform(
        F.filter(F.arrays_zip(assigned.alias("span"), values.alias("value")), lambda x: F.length(x["value"]) >= LEAST_VALUE),
        lambda x: x["span"])
    assigned = F.when(F.size(assigned) > 0, long_enough).otherwise(assigned)
    return F.array_sort(F.concat(assigned, _matches(text, ACCESS, 1), _matches(text, HEX, 2)))


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger; one that was never written is empty."""
    empty = spark.createDataFrame([], LEDGER)
    if path is None:
        return empty
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LEDGER).parquet(path) if there else empty


def scan(docs: DataFrame, ledger: str | None = None, rules: int = RULES_VERSION, text: str = "text",
         path: str = "doc_id") -> DataFrame:
    """One row per input row: path, blob, spans. Every (blob, rules) pair is scanned once.

    A blob is the SHA-256 of a text. Of the rows that hold a blob, one stands for it; only blobs that the
    ledger at ``ledger`` lacks for this version of the rules are scanned, and their findings, also empty ones,
    are appended to it. Then findings are joined back to all rows. Without a path the ledger lives for this
    call alone. A failed run leaves no part of its append behind and can simply be run again.

    Null is the empty text. Rows may repeat; a null path cannot stand for a blob unless no other row holds
    it. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(path).alias("path"), text_or_empty(text).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = materialize(rows.select("path", "blob"))
    known = read_ledger(spark, ledger).filter(F.col("rules") == rules)
    unseen = (paths.groupBy("blob").agg(F.min("path").alias("path"))
              .join(known.select("blob"), "blob", "left_anti")
              .select(F.col("blob").alias("b"), F.col("path").alias("p")))
    scanned = (rows.join(unseen, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")), "left_semi")
               .select("blob", F.lit(rules).alias("rules"), find_spans(F.col("text")).alias("spans"))
               .dropDuplicates(["blob"]))
    if ledger is None:
        found = materialize(scanned)
    else:
        scanned.write.mode("append").parquet(ledger)
        found = read_ledger(spark, ledger).filter(F.col("rules") == rules).dropDuplicates(["blob"])
    some = found.filter(F.size("spans") > 0).select(F.col("blob").alias("b"), "spans")
    return (paths.join(some, F.col("blob") == F.col("b"), "left")
            .select(F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")))


def report(found: DataFrame, path: str = "doc_id") -> DataFrame:
    """Counts per kind and the spans as text."""
    names = F.array(*map(F.lit, KINDS))
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(path, *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(shown, 256).alias("base_sha256"), shown.alias("spans"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r(kind, ord, pattern, least) AS (VALUES
  ('assign', 0, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  ('access', 1, '(AKIA[A-Z0-9]+)', 20),
  ('hex', 2, '([0-9a-f]+)', 24)),
h AS (
  SELECT doc_id, kind, ord, least,
         string_split_regex(text, pattern) AS parts,
         regexp_extract_all(text, pattern, 0) AS hits, regexp_extract_all(text, pattern, 1) AS vals
  FROM t, r),
s AS (
  SELECT doc_id, kind, ord, least, i, length(hits[i]) AS n, vals[i] AS val, length(parts[i]) AS gap
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)),
p AS (
  SELECT doc_id, kind, ord, val, least, n,
         sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM s),
f AS (SELECT doc_id, kind, ord, stop - n AS start, stop FROM p WHERE length(val) >= least),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) AS spans
  FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""
