"""Near-duplicate groups by min-max hashing: both ends of each permutation are banded; links are confirmed exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.columns import discard, drop_ids, materialize, text_or_empty
from tidebars.llm.components import components
from tidebars.llm.text_arrays import WordHashes, hashes_of, lower_words, shingle_set

SHINGLE = 5
PERCENT = 75
PERMUTATIONS = 144
MARKS = 768  # minima and maxima, a byte each, by which unsettled pairs are compared before their sets are
RARE = 64  # texts that a shingle may have for pairs to be found by it; pairs of the rest can only share more frequent ones
ROUND = 100_000  # pairs up to which a round of circles may grow faster than fourfold
BAND = 6  # values of a band; 48 bands: a pair of similarity 0.75 shares none with probability 8e-5, one of 0.8 5e-7
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``count`` permutations of 32-bit values."""
    draw = np.random.default_rng(20240229)
    return (draw.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, count, dtype=np.uint32))


def min_max(shingles: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of the set under every permutation, from one evaluation each."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.empty(len(factors), np.uint32), np.empty(len(factors), np.uint32)
    step = max(1, (1 << 16) // max(1, len(values)))
    for at in range(0, len(factors), step):
        permuted = factors[at:at + step, None] * values[None, :]
        permuted += summands[at:at + step, None]
        permuted.min(axis=1, out=low[at:at + step])
        permuted.max(axis=1, out=high[at:at + step])
    return low, high


def banded(low: np.ndarray, high: np.ndarray, band: int = BAND) -> np.ndarray:
    """Band keys. A band holds minima of some permutations and maxima of others, never both ends of one."""
    permutations, half = len(low), band // 2
    values = np.concatenate([low.reshape(-1, half), np.roll(high, -permutations // 2).reshape(-1, half)], axis=1).astype(np.uint64)
    keys = np.arange(len(values), dtype=np.uint64) + np.uint64(1)
    for i in range(values.shape[1]):
        keys = (keys ^ values[:, i]) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _sketches(permutations: int, band: int, shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sizes, classes, keys = [], [], []
            for text in batch["text"]:
                words = lower_words(text)
                grams = shingle_set(hashes_of(words, known), shingle)
                sizes.append(len(grams))
                classes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                keys.append(banded(*min_max(grams, *_permutations(permutations)), band) if len(grams) else [])
            yield pd.DataFrame({"doc": batch["doc"], "n": sizes, "class": classes, "bands": keys})
    return run


def _sets(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            grams = [shingle_set(hashes_of(lower_words(text), known), shingle).view(np.int64) for text in batch["text"]]
            yield pd.DataFrame({"doc": batch["doc"], "again": batch["again"], "grams": grams})
    return run


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The low bytes of more minima and maxima, which pairs are compared by before their sets are."""
    permutations = _permutations(MARKS // 2)
    for batch in batches:
        marks = [np.concatenate(min_max(np.asarray(g, np.int64).view(np.uint64), *permutations)).astype(np.uint8).view(np.int8)
                 for g in batch["grams"]]
        yield pd.DataFrame({"doc": batch["doc"], "marks": marks})


def least_equal(marks: int, percent: int) -> int:
    """Equal values of two signatures below which a pair is given up: 4.8 deviations below what is expected of a
    pair at the threshold, of which one in a million falls there."""
    share = percent / 100
    return int(marks * (share - 4.8 * (share * (1 - share) / marks) ** 0.5))


def _rare(sets: DataFrame) -> DataFrame:
    """(gram, times, owner) of the shingles that ``RARE`` texts or fewer have."""
    return (sets.select("doc", F.explode("grams").alias("gram")).groupBy("gram")
            .agg(F.count("*").alias("times"), F.min("doc").alias("owner")).filter(F.col("times") <= RARE))


def _reach(sets: DataFrame, rare: DataFrame, percent: int) -> DataFrame:
    """(reach_doc, texts, n, common, light) of the keys that may still be linked: size, how many of the shingles another
    text has too, and (times, gram) of those that few have, rarest first.

    A set with too little in common for any partner is left out. A key with several texts counts with the least size
    and the most overlap of these.
    """
    private = rare.filter("times = 1").groupBy("owner").agg(F.count("*").alias("private"))
    light = (sets.select("doc", F.explode("grams").alias("g")).join(rare.filter("times > 1"), F.col("g") == F.col("gram"))
             .groupBy(F.col("doc").alias("held_by")).agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("light")))
    sizes = sets.select("doc", F.size("grams").alias("size")).groupBy(F.col("doc").alias("reach_doc")).agg(
        F.count("*").alias("texts"), F.min("size").alias("n"), F.max("size").alias("most"))
    return (sizes.join(private, F.col("reach_doc") == F.col("owner"), "left")
            .select("reach_doc", "texts", "n", F.when(F.col("texts") > 1, F.col("most")).otherwise(
                F.col("n") - F.coalesce("private", F.lit(0))).cast("long").alias("common"))
            .filter(F.col("common") * 100 >= F.col("n") * percent)
            .join(light, F.col("reach_doc") == F.col("held_by"), "left").drop("held_by"))


def _rare_pairs(reach: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a rare shingle and may be linked.

    Shingles are put in order, the rarest first. The first that a linked pair shares has a place in both sets after
    which, itself included, enough are left for the overlap; so only such places are joined, at ``RARE`` rows each at
    most. Keys with several texts take part with all their rare shingles.
    """
    several = F.col("texts") > 1
    rows = (reach.join(groups, F.col("reach_doc") == F.col("id"), "left")
            .select(F.col("reach_doc").alias("b"), F.coalesce("component", "reach_doc").alias("c"), "n", "common", several.alias("several"),
                    F.posexplode("light").alias("at", "rare"))
            .select("b", "c", "n", F.col("rare.gram").alias("gram"),
                    F.when(F.col("several"), F.col("common")).otherwise(F.col("common") - F.col("at")).alias("rest"))
            .filter(F.col("rest") * 100 >= F.col("n") * percent))
    others = rows.select("gram", F.col("b").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    return (rows.join(others, "gram")
            .filter((F.col("a") < F.col("b")) & (F.col("c") != F.col("ca"))
                    & (F.least("rest", "ra") * (100 + percent) >= (F.col("n") + F.col("na")) * percent))
            .select("a", "b").distinct())


def _alike(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree well enough; texts whose signature is null do with any."""
    left = marks.select(F.col("doc").alias("da"), F.col("marks").alias("ma"))
    right = marks.select(F.col("doc").alias("db"), F.col("marks").alias("mb"))
    equal = F.aggregate(F.zip_with("ma", "mb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, x: s + x)
    enough = F.lit(least_equal(MARKS, percent))
    return (pairs.join(right, F.col("b") == F.col("db")).join(left, F.col("a") == F.col("da"))
            .filter(F.coalesce(equal, enough) >= enough).select("a", "b"))


def _of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of the texts that are in any pair; few pairs are broadcast, so that no other row is shuffled."""
    paired = pairs.select(F.explode(F.array("a", "b")).alias("paired")).distinct()
    return rows.join(paired, F.col("doc") == F.col("paired"), "left_semi")


def _fresh(pairs: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The written pairs that are links, by signature and then by their full sets."""
    alike = materialize(_alike(pairs, _of_pairs(marks, pairs), percent))
    links = materialize(_confirmed(alike, _of_pairs(sets, alike), percent))
    discard(alike)
    return links


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("grams").alias("y"))
    sized = pairs.join(right, "b").join(left, "a").filter(
        (F.size("x") * 100 >= F.size("y") * percent) & (F.size("y") * 100 >= F.size("x") * percent))
    both = sized.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.filter(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b")


def _placed(holders: DataFrame, groups: DataFrame) -> DataFrame:
    """A row per circle of every holder, with the component of the latter, which is looked up once per holder."""
    return (holders.join(groups, F.col("doc") == F.col("id"), "left")
            .withColumn("component", F.coalesce("component", "doc")).drop("id")
            .select("*", F.explode("slots").alias("slot")).select("*", "slot.*").drop("slots", "slot"))


def _open(placed: DataFrame) -> DataFrame:
    """The rows of circles whose members lie in several components, with the number of rows of the circle."""
    split = (placed.groupBy(F.col("hub").alias("open"))
             .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"))
             .filter("x != y").select("open", "m"))
    return placed.join(split, F.col("hub") == F.col("open")).drop("open", "component")


def _joined(groups: DataFrame, fresh: DataFrame) -> DataFrame:
    """The components with more links (a, b)."""
    if fresh.isEmpty():
        return groups
    return components(groups.filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(fresh))


def _holders(rows: DataFrame, *also: str) -> DataFrame:
    """A row per text, named by key and ``part``, with its circles as an array: one for each band at most."""
    return rows.groupBy("doc", "part", *also).agg(F.collect_list(F.struct("hub", "turn")).alias("slots"))


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT,
                shingle: int = SHINGLE, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept.

    Equal word sequences are one class, which its smallest key stands for. Representatives that share a band
    are candidates. Each bucket is tested against its smallest member, its hub, first; the buckets of one hub are one
    circle from then on, so that copies that share many bands with it take one row and not one a band. Confirmed links
    are closed to components, and only circles whose members still lie in different components go on. Of their members,
    those that share a shingle of ``RARE`` texts or fewer are paired by these, whatever their circle, where places in the
    order of rarity leave enough to share. Pairs that share none can overlap by no more than the smaller number of
    frequent shingles, so few texts are left: these are tested circle by circle, about four times as many members
    in each round, and more after a round of few pairs, so that about ``ROUND`` come out; a hash decides whose turn
    it is. They end when no untested pair of different components is left in any circle.
    So a large group of near copies costs one test per member, linked with its hub or not, and no candidate
    is left out: a pair is passed over only where the bounds leave it too little to share, which is exact, or where longer
    signatures are 4.8 deviations away from the threshold. Links are confirmed on the full shingle
    sets. What is kept between rounds is a narrow row per text; tables are deleted once nothing reads them any more.

    Null and empty texts and texts of white space have no shingles, are linked with nothing and are kept. Rows
    that repeat a key are one document, which the links of any of its rows join. A row without a key
    takes the smallest key of its class, or none, and is kept only if none has one. Empty tables give an
    empty result. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), text_or_empty(text).alias("text"))
    sketches = materialize(rows.mapInPandas(_sketches(permutations, band, shingle),
                                            f"doc {kind}, n long, class binary, bands array<long>"))
    heads = materialize(_heads(sketches.drop("bands")))
    first = materialize(sketches.filter("n > 0 and doc is not null").groupBy("class")
                        .agg(F.min(F.struct("doc", "bands")).alias("s"))
                        .select(F.xxhash64("class").alias("part"), "s.doc", "s.bands"))
    entries = first.select("doc", "part", F.explode("bands").alias("band"))
    shared = materialize(entries.groupBy("band").agg(F.count("*").alias("m"), F.min("doc").alias("hub"))
                         .filter("m > 1").drop("m"))
    members = materialize(entries.join(shared, "band").select("hub", "doc", "part").distinct())
    often = sketches.filter("doc is not null").groupBy("doc").agg((F.count("*") > 1).alias("again"))
    wanted = materialize(members.select("doc").distinct().join(often, "doc").withColumnRenamed("doc", "wanted"))
    for written in (sketches, first, shared):
        discard(written)
    made = materialize(rows.join(wanted, F.col("doc") == F.col("wanted")).select("doc", "again", "text").mapInPandas(
        _sets(shingle), f"doc {kind}, again boolean, grams array<long>"))
    sets = made.filter("not again").drop("again").unionByName(  # only repeated keys can bring repeated sets
        made.filter("again").drop("again").dropDuplicates(["doc", "grams"]))

    links = materialize(_confirmed(members.filter("doc != hub").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
                                   .distinct(), sets, percent).unionByName(_repeated(heads)))
    groups = components(links)
    untested = _holders(members.filter("doc != hub").withColumn("turn", F.lit(0.0)))
    chance = F.pmod(F.xxhash64("hub", "doc", "part"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    holders = materialize(_holders(_open(_placed(untested, groups)).withColumn("turn", chance * F.col("m"))))
    for written in (members, links):
        discard(written)
    unsettled = sets.join(holders.select(F.col("doc").alias("left")).distinct(), F.col("doc") == F.col("left"), "left_semi")
    rare = materialize(_rare(unsettled))
    reach = materialize(_reach(unsettled, rare, percent))
    discard(rare)
    marks = materialize(sets.join(reach.filter("texts = 1").select("reach_doc"), F.col("doc") == F.col("reach_doc"), "left_semi")
                        .mapInPandas(_signatures, f"doc {kind}, marks array<byte>")
                        .unionByName(reach.filter("texts > 1").select(
                            F.col("reach_doc").alias("doc"), F.lit(None).cast("array<byte>").alias("marks"))))
    pairs = materialize(_rare_pairs(reach, groups, percent))
    groups = _joined(groups, _fresh(pairs, marks, sets, percent))
    discard(pairs)
    frequent = reach.select("reach_doc", "n", F.when(F.col("texts") > 1, F.col("common")).otherwise(
        F.col("common") - F.coalesce(F.size("light"), F.lit(0))).alias("common")).filter(F.col("common") * 100 >= F.col("n") * percent)
    bounded = holders.join(frequent, F.col("doc") == F.col("reach_doc")).drop("reach_doc")
    opened, holders = holders, materialize(_holders(_open(_placed(bounded, groups)), "n", "common"))
    discard(opened)
    done, more = 0, 4
    while not holders.isEmpty():
        here = _placed(holders, groups)
        tested = here.filter(F.col("turn") < done + more).select(
            "hub", F.col("doc").alias("a"), F.col("turn").alias("t"), F.col("component").alias("c"), F.col("n").alias("na"),
            F.col("common").alias("ca"))
        pairs = materialize(
            tested.join(here.withColumnRenamed("doc", "b"), "hub")
            .filter(((F.col("turn") > F.col("t")) | ((F.col("turn") == F.col("t")) & (F.col("b") > F.col("a"))))
                    & (F.col("component") != F.col("c"))
                    & (F.least("common", "ca") * (100 + percent) >= (F.col("n") + F.col("na")) * percent))
            .select("a", "b").distinct())
        made_pairs = pairs.count()
        if made_pairs:
            groups = _joined(groups, _fresh(pairs, marks, sets, percent))
        discard(pairs)
        done, more = done + more, more * max(4, ROUND // (made_pairs + 1))
        former = holders
        holders = materialize(_holders(_open(_placed(holders, groups).filter(F.col("turn") >= done)), "n", "common"))
        discard(former)
    for written in (made, reach, marks):
        discard(written)

    return _labelled(heads, groups, key)


def _heads(sketches: DataFrame) -> DataFrame:
    """doc, n, head: the smallest key of each row's class; rows without shingles stand for themselves."""
    named = materialize(sketches.filter("n > 0").groupBy(F.col("class").alias("c")).agg(F.min("doc").alias("head")))
    return (sketches.join(named, F.col("class") == F.col("c"), "left")
            .select("doc", "n", "class", F.coalesce("head", "doc").alias("head")))


def _repeated(heads: DataFrame) -> DataFrame:
    """Links (a, b) of the keys that occur with several texts to the heads of all of these."""
    several = (heads.filter("doc is not null and n > 0").groupBy(F.col("doc").alias("d"))
               .agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x != y").select("d"))
    return heads.join(several, F.col("doc") == F.col("d")).filter("doc != head").select(
        F.col("doc").alias("a"), F.col("head").alias("b")).distinct()


def _labelled(heads: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    grouped = heads.join(groups, F.col("head") == F.col("id"), "left")
    return (grouped.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"),
                           F.coalesce("component", "head").alias("component_id"))
            .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each near-duplicate group; rows without a key always stay."""
    gone = near_groups(docs, text, key).filter(~F.col("kept") & F.col(key).isNotNull())
    return drop_ids(docs, gone, key)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
