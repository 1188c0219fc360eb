"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.columns import text_or_empty

FIT_ROWS = 20_000  # labelled texts that fit the machine
SLOTS = 1 << 18
FACTORS = 6
TOXIC_AT = 0.7
STEMS = (4, 5, 6)  # bytes of a word's beginning that count as a term too, for inflected words
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


class Slots(dict):
    """Slots of each word seen so far, its own and those of its stems; emptied when it has grown past its bound."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        terms = [b"=" + word, *[word[:n] for n in STEMS if len(word) >= n]]
        slots = self[word] = tuple(xxhash.xxh3_64_intdigest(term) % SLOTS for term in terms)
        return slots


def slots_of(text: str, known: Slots) -> np.ndarray:
    """Distinct slots of the lower-cased words of a whole text and of their stems."""
    words = set(_TERM.findall(text.encode("utf-8", "surrogatepass").lower()))
    return np.unique(np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int32))


@dataclass
class Machine:
    """sigmoid(bias + sum of weights + sum over pairs of factor products) of the slots of a text that were learnt."""

    bias: float
    place: np.ndarray  # slot -> row of weights and factors, or -1
    weights: np.ndarray
    factors: np.ndarray

    def log_odds(self, slots: np.ndarray) -> float:
        rows = self.place[slots]
        rows = rows[rows >= 0]
        v = self.factors[rows]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum())
        return self.bias + float(self.weights[rows].sum()) + pairs

    def score(self, slots: np.ndarray) -> float:
        return float(_sigmoid(self.log_odds(slots)))


class Rows:
    """Places of the slots of each text, as one array with the text that each belongs to."""

    def __init__(self, texts: list[np.ndarray], places: int):
        self.texts, self.places = texts, places

    def batches(self, draw: np.random.Generator, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Texts in a drawn order: their numbers, all their places, and whose each is."""
        order = draw.permutation(len(self.texts))
        for at in range(0, len(order), batch):
            of = order[at:at + batch]
            yield of, np.concatenate([self.texts[i] for i in of]), np.repeat(np.arange(len(of)), [len(self.texts[i]) for i in of])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def surely_apart(rows: Rows, toxic: np.ndarray, errors: float = 3.0) -> np.ndarray:
    """Places whose share among toxic texts lies more than ``errors`` standard errors off that among others."""
    of = lambda mark: np.bincount(np.concatenate([t for t, y in zip(rows.texts, toxic, strict=True) if y == mark]),
                                  minlength=rows.places)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    with_term, others = of(1), of(0)
    pooled = (with_term + others) / (n1 + n0)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0)) + 1e-9
    return np.flatnonzero(np.abs(with_term / n1 - others / n0) / error > errors)


def growing(rows: Rows, toxic: np.ndarray, known: np.ndarray, batch: int = 64, steps: int = 640, step: float = 0.05,
            decay: float = 0.005) -> np.ndarray:
    """Places whose factors grow beyond any at the start, where all shrink but for what pairs explain of the labels.

    Every place has factors here, also those that tell nothing by themselves; ``known`` are the log odds of the texts
    without them.
    """
    draw = np.random.default_rng(7)
    factors = draw.normal(0, 0.02, (FACTORS, rows.places))
    start = np.sqrt((factors ** 2).sum(axis=0)).max()
    squares = np.ones_like(factors)
    per_turn = -(-len(rows.texts) // batch)
    for _ in range(-(-steps // per_turn) if per_turn > steps // 15 else 15):
        for of, flat, owner in rows.batches(draw, batch):
            added = lambda values: np.bincount(owner, values, len(of))  # noqa: B023, E731
            v = factors[:, flat]
            sums = np.stack([added(f) for f in v])
            wrong = _sigmoid(known[of] + 0.5 * ((sums ** 2).sum(axis=0) - added((v ** 2).sum(axis=0)))) - toxic[of]
            each = wrong[owner]
            touched = np.flatnonzero(np.bincount(flat, minlength=rows.places))
            slope = np.stack([np.bincount(flat, each * f[owner], rows.places)[touched] for f in sums])
            slope -= np.bincount(flat, each, rows.places)[touched] * factors[:, touched]
            factors *= 1 - decay
            squares[:, touched] += slope ** 2
            factors[:, touched] -= step * slope / np.sqrt(squares[:, touched])
    return np.flatnonzero(np.sqrt((factors ** 2).sum(axis=0)) > start)


def descend(rows: Rows, toxic: np.ndarray, turns: int = 40, batch: int = 256, step: float = 0.02,
            decay: float = 1e-5) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam over shuffled batches."""
    draw = np.random.default_rng(7)
    share = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-3, 1 - 1e-3))
    bias, weights, factors = np.array([np.log(share / (1 - share))]), np.zeros(rows.places), draw.normal(0, 0.01, (FACTORS, rows.places))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (bias, weights, factors)]
    count = 0
    for _ in range(turns if rows.places else 0):
        for of, flat, owner in rows.batches(draw, batch):
            added = lambda values: np.bincount(owner, values, len(of))  # noqa: B023, E731
            v = factors[:, flat]
            sums = np.stack([added(f) for f in v])
            z = bias[0] + added(weights[flat]) + 0.5 * ((sums ** 2).sum(axis=0) - added((v ** 2).sum(axis=0)))
            wrong = (_sigmoid(z) - toxic[of]) / len(of)
            each = wrong[owner]
            first = np.bincount(flat, each, rows.places)
            crossed = np.stack([np.bincount(flat, each * f[owner], rows.places) for f in sums]) - first * factors
            slopes = [np.array([wrong.sum()]), first + decay * weights, crossed + decay * factors]
            count += 1
            for value, slope, moment in zip((bias, weights, factors), slopes, moments, strict=True):
                moment[0] += 0.1 * (slope - moment[0])
                moment[1] += 0.001 * (slope ** 2 - moment[1])
                value -= step * (moment[0] / (1 - 0.9 ** count)) / (np.sqrt(moment[1] / (1 - 0.999 ** count)) + 1e-8)
    return float(bias[0]), weights, factors


def fit(texts: list[np.ndarray], toxic: np.ndarray) -> Machine:
    """A machine of the slots that tell something: alone, or with another one.

    A first machine weighs the slots whose shares differ surely. Factors of every slot that occurs then grow on what
    it leaves unexplained, and slots that pairs explain it by join the others in the machine that is fitted last.
    There is no bound on how many. Without both labels the machine knows the share of toxic texts alone.
    """
    place = np.full(SLOTS, -1, np.int32)
    if not 0 < toxic.sum() < len(toxic):
        return Machine(descend(Rows([], 0), toxic)[0], place, np.zeros(0), np.zeros((0, FACTORS)))
    used = np.unique(np.concatenate(texts))

    def among(slots: np.ndarray) -> Rows:
        place[:] = -1
        place[slots] = np.arange(len(slots))
        return Rows([r[r >= 0] for r in (place[t] for t in texts)], len(slots))

    def machine_of(slots: np.ndarray) -> Machine:
        bias, weights, factors = descend(among(slots), toxic)
        return Machine(bias, place, weights, factors.T.copy())

    every = among(used)
    alone = used[surely_apart(every, toxic)]
    machine = machine_of(alone)
    known = np.array([machine.log_odds(t) for t in texts])
    paired = used[growing(every, toxic, known)]
    chosen = np.union1d(alone, paired)
    return machine_of(chosen) if len(chosen) > len(alone) else machine


def _slotted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Slots()
    for batch in batches:
        yield pd.DataFrame({"k": batch["k"].astype(str), "toxic": batch["toxic"], "slots": [slots_of(t, known).tobytes() for t in batch["text"]]})


def held_out(key: str = "doc_id"):
    """Rows that no machine learns from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
          fit_rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on at most ``fit_rows`` labelled texts that are not held out, chosen by a hash of the key.

    Null texts count as empty, rows without key or label are not learnt from, and of several labels of a key the
    greatest counts. A text brings the driver four bytes for each of its distinct slots, at most 1 MB for a text of
    any length.
    """
    chosen = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
              .groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("k"), "k").limit(fit_rows))
    rows = docs.select(F.col(key).alias("d"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), F.col("d") == F.col("k"))
    found = rows.select("k", "toxic", "text").mapInPandas(_slotted, "k string, toxic int, slots binary").collect()
    found.sort(key=lambda r: (r["k"], bytes(r["slots"])))  # batches are drawn from one order, however rows were dealt
    return fit([np.frombuffer(r["slots"], np.int32) for r in found], np.array([r["toxic"] for r in found], float))


def score(docs: DataFrame, machine: Machine, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted, one row per input row; only the text decides.

    Texts count whole, however long. Null and empty texts have the score of a text without terms; a score of 0.7 is
    predicted toxic. Repeated rows score alike; a null key counts
    as not held out. An empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        known = Slots()
        return texts.map(lambda t: shared.value.score(slots_of(t, known))).astype("float64")

    return (docs.select(key, held_out(key).alias("held_out"), scored(text_or_empty(text)).alias("score"))
            .withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int")))
