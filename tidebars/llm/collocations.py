"""Phrase collocations from a weighted de Bruijn graph: five-word edges between four-word nodes, and what they add up to."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.columns import LOWER, UPPER, materialize, text_or_empty
from tidebars.llm.text_arrays import _FACTOR, _mixed

LONGEST = 5
LEAST = 100  # occurrences of a candidate
SHARE = 100  # percent of a candidate's occurrences that a longer one must have for it to be dropped
TOP = 2000
MOST_BITS = 28  # of the filter that is broadcast: 32 MB
SLICE = 1 << 20  # characters of a text, and words of all languages, that are worked on at once

BATCH = 1 << 16  # rows that are handed to Spark at once

_STOPS = ".,;:!?\x0a\x0b\x0c\x0d"  # fixed values: where pieces end
_TABLE = bytes.maketrans((UPPER + _STOPS).encode(), (LOWER + "." * len(_STOPS)).encode())
_STOP = re.compile(f"[{re.escape(_STOPS)}]")
_KEPT_WORDS = 400_000
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def tokens(text: str) -> Iterator[list[bytes]]:
    """Lower-cased words of a text and b"." where a piece ends; texts of over ``SLICE`` characters are cut between pieces."""
    start = 0
    while start < len(text):
        stop = _STOP.search(text, start + SLICE) if len(text) - start > SLICE else None
        end = stop.end() if stop else len(text)
        words = text[start:end].encode("utf-8", "surrogatepass").translate(_TABLE).replace(b".", b" . ").split()
        words.append(b".")
        yield words
        start = end


class _Hashes(dict):
    """64-bit hashes of the words of a language; 0 stands for the end of a piece."""

    def __init__(self, lang: str, seed: int) -> None:
        super().__init__()
        self.prefix, self.seed = lang.encode("utf-8", "surrogatepass") + b"\0", seed
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
            self[b"."] = 0
        value = self[word] = hash_word(self.prefix + word, self.seed) or 1
        return value


def hash_word(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed)


class _Tally:
    """Counts of the words of a language, as far as one set of them goes."""

    def __init__(self) -> None:
        self.found, self.size = Counter(), 0

    def add(self, words: list[bytes]) -> None:
        self.found.update(words)
        self.size = 4 * len(self.found)  # a counted word takes more room than a hash


class _Line:
    """The words of a language as hashes of eight bytes, in one array of ``SLICE``; longer pieces make it longer."""

    def __init__(self) -> None:
        self.hashes, self.size = np.empty(1 << 12, np.uint64), 0

    def add(self, words: np.ndarray) -> None:
        end = self.size + len(words)
        if end > len(self.hashes):
            self.hashes = np.concatenate([self.hashes[:self.size], np.empty(max(end, min(2 * end, SLICE)) - self.size, np.uint64)])
        self.hashes[self.size:end] = words
        self.size = end

    def taken(self) -> np.ndarray:
        return self.hashes[:self.size]


def _in_parts(out: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
    """The rows in batches, so that neither side holds all of them once more on their way to Spark."""
    if out is not None:
        for at in range(0, len(out), BATCH):
            yield out.iloc[at:at + BATCH]


def _lines(batches: Iterator[pd.DataFrame], make: Callable[[], _Tally | _Line], read: Callable[[str, list[bytes]], list[bytes] | np.ndarray],
           take: Callable[[str, _Tally | _Line], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """Gathers what ``read`` makes of the words of each language and hands it to ``take`` when all languages together
    hold ``SLICE``, the largest first; pieces stay whole. Words themselves are held for one text at a time."""
    held: dict[str, _Tally | _Line] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for words in tokens(text):
                own = held.get(lang) or held.setdefault(lang, make())
                size -= own.size
                own.add(read(lang, words))
                size += own.size
                while size >= SLICE:
                    largest = max(held, key=lambda of: held[of].size)
                    full = held.pop(largest)
                    size -= full.size
                    yield from _in_parts(take(largest, full))
                    del full
    for lang in list(held):
        yield from _in_parts(take(lang, held.pop(lang)))


def _counted(seed: int):
    """(lang, word, h, n) of the words of each slice of a task."""
    def take(lang: str, tally: _Tally) -> pd.DataFrame:
        found = tally.found
        del found[b"."]
        known = _Hashes(lang, seed)
        return pd.DataFrame({"lang": lang, "word": [w.decode("utf-8", "surrogatepass") for w in found],
                             "h": np.fromiter(map(known.__getitem__, found), np.uint64, len(found)).view(np.int64), "n": list(found.values())})

    return lambda batches: _lines(batches, _Tally, lambda lang, words: words, take)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * _FACTOR + b)


class Filter:
    """A bit for each of 2^bits ranges of hashes; what was put in is always found, little else is."""

    def __init__(self, bits: int, places: np.ndarray, masks: np.ndarray) -> None:
        self.shift = np.uint64(64 - bits)
        self.masks = np.zeros(1 << (bits - 6), np.uint64)
        self.masks[places] = masks

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.masks[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(keys: DataFrame, column: str = "h", most_bits: int = MOST_BITS) -> Filter:
    """The filter of a table of distinct hashes: 32 bits each, at most 2^most_bits, so that its size has a bound."""
    bits = min(most_bits, max(16, (32 * keys.count()).bit_length()))
    at = F.shiftrightunsigned(column, 64 - bits)
    rows = (keys.select(F.shiftright(at, 6).alias("place"), at.alias("at")).groupBy("place")
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toPandas())
    return Filter(bits, rows["place"].to_numpy(np.int64), rows["mask"].to_numpy(np.int64).view(np.uint64))


def _hashed(seed: int) -> Callable[[str, list[bytes]], np.ndarray]:
    """Hashes of words; those of all languages together are forgotten past a bound."""
    known: dict[str, _Hashes] = {}

    def read(lang: str, words: list[bytes]) -> np.ndarray:
        if lang not in known:
            known[lang] = _Hashes(lang, seed)
        own = known[lang]
        hashes = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
        if len(own) > _KEPT_WORDS // len(known):
            del known[lang]
        return hashes

    return read


def _pairs(seed: int, frequent):
    """(h, n) of the pairs of neighbours that are both frequent."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def take(lang: str, line: _Line) -> pd.DataFrame:
            hashes = line.taken()
            good = frequent.value.has(hashes) & (hashes != 0)
            at = np.flatnonzero(good[:-1] & good[1:])
            pairs, times = np.unique(pair_hash(hashes[at], hashes[at + 1]), return_counts=True)
            return pd.DataFrame({"h": pairs.view(np.int64), "n": times})

        return _lines(batches, _Line, _hashed(seed), take)
    return run


def _edges(seed: int, frequent, linked):
    """(w1..w5, n): the gram of five that begins at each word that is linked to the next; 0 where its run ends."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def take(lang: str, line: _Line) -> pd.DataFrame | None:
            hashes = line.taken()
            good = frequent.value.has(hashes) & (hashes != 0)
            link = np.zeros(len(hashes) + LONGEST, bool)
            at = np.flatnonzero(good[:-1] & good[1:])
            link[at] = linked.value.has(pair_hash(hashes[at], hashes[at + 1]))
            at = np.flatnonzero(link)
            if not len(at):
                return None
            grams = np.zeros((len(at), LONGEST), np.uint64)
            grams[:, 0], on = hashes[at], np.ones(len(at), bool)
            for i in range(1, LONGEST):
                on &= link[at + i - 1]
                grams[on, i] = hashes[at[on] + i]
            return pd.DataFrame(dict(zip([*WORDS, "n"], _tallied(grams), strict=True)))

        return _lines(batches, _Line, _hashed(seed), take)
    return run


def _tallied(grams: np.ndarray) -> list[np.ndarray]:
    """Columns of the distinct rows, and how often each occurs; sorted by hash, but compared word by word."""
    mixed = grams[:, 0].copy()
    for i in range(1, grams.shape[1]):
        mixed = _mixed(mixed * _FACTOR + grams[:, i])
    _, first, place, times = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    rows = grams[first]
    if any((grams[:, i] != rows[place, i]).any() for i in range(grams.shape[1])):
        rows, times = np.unique(grams, axis=0, return_counts=True)
    return [*rows.view(np.int64).T, times]


def vocabulary(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """(lang, word, h, n) of all words, and the seed under which no two words of any languages share a hash."""
    words = "lang string, word string, h long, n long"
    while True:
        counted = materialize(docs.mapInPandas(_counted(seed), words).groupBy("lang", "word", "h").agg(F.sum("n").alias("n")))
        if counted.select("h").groupBy("h").count().filter("count > 1").isEmpty():
            return counted, seed
        seed += 1


def graph(docs: DataFrame, seed: int, words: DataFrame, least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """(w1..w5, n): edges of the de Bruijn graph, from node w1..w4 to node w2..w5, and where w5 is 0 the grams of two to
    four words that runs end with.

    A run is a stretch of a piece in which every word and every pair of neighbours occurs ``least`` times, or passes
    for it in a filter of bounded size. No phrase that occurs so often is cut by that, at no place, so that sums of
    edges count each such phrase in full; all else would only be shuffled to be thrown away.
    """
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(filter_of(words.filter(F.col("n") >= least), most_bits=most_bits))
    pairs = materialize(docs.mapInPandas(_pairs(seed, frequent), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
                        .filter(F.col("n") >= least).select("h"))
    linked = context.broadcast(filter_of(pairs, most_bits=most_bits))
    fields = ", ".join(f"{w} long" for w in WORDS)
    return materialize(docs.mapInPandas(_edges(seed, frequent, linked), f"{fields}, n long").groupBy(*WORDS).agg(F.sum("n").alias("n")))


def flows(edges: DataFrame, size: int) -> DataFrame:
    """(p, f): how often each gram of ``size`` words occurs: what leaves the nodes that begin with it, with the ends of
    runs that do."""
    return (edges.filter(F.col(WORDS[size - 1]) != 0).groupBy(*WORDS[:size]).agg(F.sum("n").alias("f"))
            .select(F.array(*WORDS[:size]).alias("p"), "f"))


def unary_paths(edges: DataFrame, nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """(words, n): stretches of edges of one weight, as long as they go, over all edges of ``least`` or more.

    Two edges are joined at a node through which all of its occurrences come from the one and go to the other. Such
    chains have no cycles, as a piece begins somewhere. Each turn doubles the distance that an edge looks back, so
    turns grow with the logarithm of the longest chain; a chain is no longer than a piece of text.
    """
    heavy = edges.filter((F.col(WORDS[-1]) != 0) & (F.col("n") >= least)).select(F.array(*WORDS).alias("e"), "n")
    into = heavy.select(F.slice("e", 2, LONGEST - 1).alias("node"), F.col("e").alias("back"), F.col("n").alias("came"))
    through = nodes.select(F.col("p").alias("node"), "f").join(into, "node").filter("came = f").select("node", "f", "back")
    start = F.slice("e", 1, LONGEST - 1)
    state = materialize(heavy.join(through, (start == F.col("node")) & (F.col("n") == F.col("f")), "left").select(
        "e", "n", "back", F.when(F.col("back").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("far"),
        F.when(F.col("back").isNull(), F.col("e")).alias("head")))
    while not state.filter("head is null").isEmpty():
        told = state.select(F.col("e").alias("at"), F.col("back").alias("back_on"), F.col("far").alias("far_on"), F.col("head").alias("head_on"))
        state = materialize(state.filter("head is null").join(told, F.col("back") == F.col("at")).select(
            "e", "n", F.col("back_on").alias("back"), (F.col("far") + F.col("far_on")).alias("far"), F.col("head_on").alias("head"))
            .unionByName(state.filter("head is not null")))
    steps = state.groupBy("head").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(
        "far", F.element_at("e", -1).alias("word")))).alias("steps"))
    return steps.select(F.concat(F.slice("head", 1, LONGEST - 1), F.col("steps.word")).alias("words"), "n")


def _exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE,
            most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, phrase, p, a, l, r, n, score) of all phrases of two to five words that occur ``least`` times and are kept.

    a, l and r count occurrences of the phrase and of the two parts of the cut that scores lowest (ties: the shortest
    first part); n counts all words of the language; score is floor(1000 a n / (l r)), in exact decimals. A phrase is
    dropped where a longer one of up to five words that contains it has ``share`` percent of its occurrences; then
    one of one word more has it, so that neighbours in length are all that must be compared.

    Counts of five words are the edges on the graph's unary paths, those of fewer words sums of what flows out of its
    nodes with the ends of runs; counts of single words come from the vocabulary. Null languages are ``und``, null
    texts empty. No rows give no phrases. A piece without any stop is held whole in a task, a longer text is not; of other
    texts a task holds the hashes of ``SLICE`` words, however many languages they are in.
    Other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    words, seed = vocabulary(rows)
    edges = graph(rows, seed, words, least, most_bits)
    singles = words.filter(F.col("n") >= least).select(F.array("h").alias("p"), F.col("n").alias("f"))
    shorter = [materialize(flows(edges, size).filter(F.col("f") >= least)) for size in range(2, LONGEST)]
    paths = unary_paths(edges, shorter[-1], least)
    longest = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - LONGEST + 1), lambda i: F.slice(
        "words", i, LONGEST))).alias("p"), F.col("n").alias("f"))
    grams = longest
    for table in shorter:
        grams = grams.unionByName(table)
    grams = materialize(grams)
    counts = grams.unionByName(singles)
    above = (grams.filter(F.size("p") > 2).select(F.explode(F.array(
        F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1))).alias("q"), F.col("f").alias("g"))
        .groupBy("q").agg(F.max("g").alias("g")))
    kept = (grams.join(above, F.col("p") == F.col("q"), "left").filter(F.col("g").isNull() | (_exact("g") * 100 < _exact("f") * share))
            .select("p", F.col("f").alias("a")))
    cuts = kept.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    left, right = counts.select(F.col("p").alias("lp"), F.col("f").alias("l")), counts.select(F.col("p").alias("rp"), F.col("f").alias("r"))
    cuts = (cuts.join(left, F.slice("p", F.lit(1), F.col("k")) == F.col("lp"))
            .join(right, F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")) == F.col("rp")).select("p", "a", "k", "l", "r"))
    names = words.filter(F.col("n") >= least).select(F.col("h").alias("name"), "word", F.col("lang").alias("of"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    named = (kept.select("p", F.posexplode("p").alias("at", "h")).join(names, F.col("h") == F.col("name"))
             .groupBy("p").agg(F.min("of").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt"))
             .join(totals, "lang").select("p", "lang", "n", F.array_join("spelt.word", " ").alias("phrase")))
    score = F.expr("(cast(1000 * cast(a as decimal(19,0)) * n as decimal(38,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.join(named, "p").select("lang", "phrase", "p", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    return (scored.groupBy("lang", "phrase", "p", "a", "n").agg(F.min("cut").alias("cut"))
            .select("lang", "phrase", "p", "a", "cut.l", "cut.r", "n", "cut.score"))


def top_phrases(found: DataFrame, top: int = TOP, salts: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first by score, occurrences and phrase.

    The first of each of ``salts`` parts of a language are found before those of the language, so that no task reads
    more than ``top`` rows a part.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
x AS (SELECT lang, doc, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
y AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM x),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM y, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 100),
b AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, w, f, s, unnest(range(1, m - s + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS s) WHERE s < m) GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN b ON b.lang = c.lang AND b.phrase = c.phrase WHERE b.f IS NULL OR 100 * b.f < 100 * c.f),
u AS (SELECT lang, phrase, f, w, m, unnest(range(1, m)) AS cut FROM k),
s AS (
  SELECT u.lang, u.phrase, u.f AS a, p.f AS l, q.f AS r, t.n, u.cut,
         ((1000::HUGEINT * u.f * t.n) // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM u JOIN g p ON p.lang = u.lang AND p.phrase = array_to_string(w[1:cut], ' ')
  JOIN g q ON q.lang = u.lang AND q.phrase = array_to_string(w[cut + 1:], ' ') JOIN t ON t.lang = u.lang),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s),
v AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o WHERE best = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM v WHERE rank <= 2000
"""
