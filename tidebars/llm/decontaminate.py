"""Benchmark decontamination by winnowing: fingerprint, join, extend hits word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.columns import ascii_lower, drop_ids, materialize, text_or_empty

SPAN = 10  # words of a window
GRAM = 5  # words of a hashed gram; SPAN - GRAM + 1 grams lie in a window, so every shared one shares its least gram
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLACES = 28  # low bits of a packed fingerprint, for the position of its gram
#: The item side is broadcast up to this many fingerprints (16 bytes each), and shuffled beyond.
BROADCAST_ROWS = 100_000


def words_of(text: str | Column) -> Column:
    """Lower-cased runs of digits, a-z and characters beyond ASCII; null has none."""
    return F.array_remove(F.split(ascii_lower(text_or_empty(text)), BREAKS, -1), "")


def _packed(hashes: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from ``at`` on, with the position in its low bits."""
    gram = F.xxhash64(*[F.get(hashes, at + i) for i in range(size)])
    return F.shiftleft(F.shiftright(gram, PLACES), PLACES).bitwiseOR(at.cast("long"))


def winnowed(words: DataFrame, *keep: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Rows (keep..., print, at): the least gram hash of each window of ``span`` words, repeats left out.

    ``words`` has a column ``hashes`` (array of word hashes). Everything happens inside the row: an array of
    grams with their positions, the least of each window, and the distinct ones of these; nothing is sorted
    or shuffled.
    """
    wide = span - gram + 1
    grams = F.transform(F.sequence(F.lit(0), F.size("hashes") - gram), lambda i: _packed(F.col("hashes"), i, gram))
    least = F.transform(F.sequence(F.lit(1), F.size("grams") - wide + 1), lambda i: F.array_min(F.slice("grams", i, wide)))
    prints = (words.select(*keep, F.when(F.size("hashes") >= span, grams).alias("grams"))
              .select(*keep, F.explode_outer(F.when(F.col("grams").isNotNull(), F.array_distinct(least))).alias("now")))
    return prints.filter("now is not null").select(
        *keep, F.shiftright("now", PLACES).alias("print"), F.col("now").bitwiseAND(F.lit((1 << PLACES) - 1)).cast("int").alias("at"))


def whole(words: DataFrame, size: int, *keep: str) -> DataFrame:
    """Rows (keep..., print, at) of every run of ``size`` words, for items shorter than a window."""
    at = words.select(*keep, "hashes", F.explode(
        F.sequence(F.lit(0), F.greatest(F.size("hashes") - size, F.lit(0)))).alias("w")).filter(F.size("hashes") >= size)
    return at.select(*keep, F.shiftright(F.xxhash64(F.lit(size), *[F.get("hashes", F.col("w") + i) for i in range(size)]),
                                         PLACES).alias("print"), F.col("w").cast("int").alias("at"))


def hits(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
         item_key: str = "item_id") -> DataFrame:
    """One row per input row: key, n_words, runs array<struct<item, start, stop>> of windows that occur.

    Windows are ``SPAN`` consecutive words of an item, or all words of a shorter one. Both sides keep the
    least gram hash of every window; equal fingerprints give an alignment (document, item, offset), and
    each alignment is then compared word by word over the whole item, so hashes decide nothing by
    themselves. Fingerprints of the items are broadcast after a count shows that they are few; else both
    sides are shuffled by fingerprint. Documents meet their alignments by key.

    Null and empty texts have no words and no hits. Items that repeat are told apart by key; an item without
    a key is called ''. Repeated document rows each get a row, rows without a key also are compared. Empty
    tables on either side are fine. Other columns are not read.
    """
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    item = materialize(items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("item"),
                                    words_of(item_text).alias("words"))
                       .filter(F.size("words") > 0).distinct()
                       .withColumn("item_no", F.xxhash64("item", "words")).withColumn("hashes", hashed(F.col("words"))))
    lengths = [r[0] for r in item.filter(F.size("words") < SPAN).select(F.size("words")).distinct().collect()]
    doc = docs.select(F.col(key).alias("doc"), hashed(words_of(text)).alias("hashes"))

    prints = winnowed(item, "item_no")
    found = winnowed(doc, "doc")
    for size in sorted(lengths):  # nine at most
        prints = prints.unionByName(whole(item.filter(F.size("words") == size), size, "item_no"))
        found = found.unionByName(whole(doc, size, "doc"))
    prints = materialize(prints.withColumnRenamed("at", "item_at"))
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    aligned = (found.join(prints, "print")
               .select("doc", "item_no", (F.col("at") - F.col("item_at")).alias("offset")).distinct())
    compared = aligned.join(item.select("item_no", "item", "words"), "item_no").groupBy("doc").agg(
        F.collect_list(F.struct("item", "words", "offset")).alias("aligned")).withColumnRenamed("doc", "aligned_doc")

    size = lambda a: F.least(F.size(a["words"]), F.lit(SPAN))
    text_words = docs.select(F.col(key).alias("doc"), words_of(text).alias("words"))
    runs = F.flatten(F.transform("aligned", lambda a: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(a["words"]) - size(a)),
                 lambda j: (a["offset"] + j >= 0) & (F.slice("words", F.greatest(a["offset"] + j, F.lit(0)) + 1, size(a))
                                                     == F.slice(a["words"], j + 1, size(a)))),
        lambda j: F.struct(a["item"].alias("item"), (a["offset"] + j).alias("start"), (a["offset"] + j + size(a)).alias("stop")))))
    none = F.array().cast("array<struct<item:string,start:int,stop:int>>")
    return (text_words.join(compared, F.col("doc").eqNullSafe(F.col("aligned_doc")), "left")
            .select(F.col("doc").alias(key), F.size("words").cast("long").alias("n_words"),
                    F.when(F.col("aligned").isNull(), none).otherwise(runs).alias("runs")))


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words that lie in any window, the items with such windows, and the verdict."""
    spans = F.array_sort(F.array_distinct(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop")))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"),
                                F.greatest(acc["end"], s["stop"]).alias("end")),
        lambda acc: acc["n"].cast("long"))
    named = found.withColumn("ids", F.array_sort(F.array_distinct(F.transform("runs", lambda r: r["item"]))))
    return (named.select(key, "n_words", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
                         F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that hold a window of any item; rows without a key always stay."""
    gone = hits(docs, items, key=key).filter((F.size("runs") > 0) & F.col(key).isNotNull())
    return drop_ids(docs, gone, key)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, item_id, i, dw.size FROM dw JOIN bw USING (size, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
