"""Text quality from weak labels: expectation-maximisation over heuristic votes, then a hashed linear scorer."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.columns import text_or_empty

FIT_ROWS = 4_000  # texts that fit the scorer; votes and accuracies cover every row
SLOTS = 1 << 12
REJECT = 0.5
DAMPED = 100  # trigrams; shorter texts show less of their features and are closer to the prior
JUNK, GOOD, NONE = 1, 0, 2

# character classes of bytes: letters in either case, digits, blanks, line ends, bytes beyond ASCII, and the
# other signs in eight groups
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:128] = [8 + b % 8 for b in range(128)]
_CLASS[ord("a"):ord("z") + 1], _CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("0"):ord("9") + 1] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]] = 3, 4


def measures(text: str) -> dict[str, float]:
    """Counts of a whole text that the labellers look at."""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    upper, lower, beyond = count[65:91].sum(), count[97:123].sum(), count[128:].sum()
    return {
        "words": len(words), "repeats": sum(map(operator.eq, words, words[1:])),
        "upper": upper, "letters": upper + lower, "shown": len(raw) - count[9:14].sum() - count[32],
        "sameness": len(words) ** 0.5 / len(set(words)) if len(words) >= 20 else 0.3,
        "lettered": upper + lower + beyond, "stops": count[ord(".")] + count[ord("?")],
        "signs": count[[ord(c) for c in "*$%&#~^@\\<>{}|"]].sum(), "bars": count[ord("|")], "shouts": count[ord("!")],
    }


def _vote(value: float, junk_over: float, good_under: float) -> int:
    return JUNK if value > junk_over else GOOD if value < good_under else NONE


#: Each sees the measures of a text with at least ``LEAST_WORDS`` words and votes junk, good or neither.
LABELLERS = {
    "signs": lambda m: _vote(m["signs"] / m["words"], 0.3, 0.05),
    "capitals": lambda m: _vote(m["upper"] / max(1, m["letters"]), 0.5, 0.2),
    "repeats": lambda m: _vote(m["repeats"] / m["words"], 0.3, 0.05),
    "variety": lambda m: _vote(m["sameness"], 0.4, 0.25),
    "bars": lambda m: _vote(m["bars"] / m["words"], 0.2, 0.02),
    "shouts": lambda m: _vote(m["shouts"] / m["words"], 0.3, 0.05),
    "stops": lambda m: _vote(-m["stops"] / m["words"], -0.01, -0.03),
    "letters": lambda m: _vote(-m["lettered"] / max(1, m["shown"]), -0.75, -0.9),
}
LEAST_WORDS = 8


def votes(text: str) -> str:
    m = measures(text)
    if m["words"] < LEAST_WORDS:
        return str(NONE) * len(LABELLERS)
    return "".join(str(rule(m)) for rule in LABELLERS.values())


@dataclass
class VoteModel:
    """P(vote | class) of every labeller and the share of junk."""

    junk: float = 0.15
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))  # labeller, class, vote

    def posterior(self, pattern: str) -> float:
        """Probability of junk; texts on which nobody votes have the prior."""
        odds = np.log(self.junk) - np.log1p(-self.junk)
        for rates, vote in zip(self.rates, map(int, pattern), strict=True):
            if vote != NONE:
                odds += np.log(rates[JUNK, vote]) - np.log(rates[GOOD, vote])
        return float(1 / (1 + np.exp(-odds)))

    def accuracy(self) -> dict[str, float]:
        """Estimated share of right votes among the votes of each labeller."""
        share = np.array([1 - self.junk, self.junk])
        right = {}
        for name, rates in zip(LABELLERS, self.rates, strict=True):
            cast = (share[:, None] * rates[:, :NONE]).sum()
            right[name] = float((share[JUNK] * rates[JUNK, JUNK] + share[GOOD] * rates[GOOD, GOOD]) / max(cast, 1e-12))
        return right


def fit_votes(patterns: dict[str, int], turns: int = 50) -> VoteModel:
    """Expectation-maximisation over vote patterns and how many texts show each."""
    # the start lets one vote for junk outweigh the others' votes for good, as each sees one kind of junk only
    model = VoteModel(0.3, rates=np.tile(np.array([[0.9, 0.01, 0.09], [0.75, 0.2, 0.05]]), (len(LABELLERS), 1, 1)))
    if not patterns:
        return model
    cast = np.array([[int(v) for v in p] for p in patterns])
    weight = np.array(list(patterns.values()), float)
    for _ in range(turns):
        junk = np.array([model.posterior(p) for p in patterns])
        share = np.stack([weight * (1 - junk), weight * junk])
        rates = np.stack([np.stack([np.stack([(share[c] * (cast[:, i] == v)).sum() for v in (0, 1, 2)]) for c in (0, 1)])
                          for i in range(len(LABELLERS))]) + np.array([0.9, 0.1, 0.5])[None, None, :]
        model = VoteModel(float(np.clip(share[1].sum() / weight.sum(), 1e-4, 0.5)), rates / rates.sum(axis=2, keepdims=True))
    return model


def features(text: str) -> np.ndarray:
    """Hashed features: square roots of the shares of character-class trigrams, and graded word measures."""
    out = np.zeros(SLOTS, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = _CLASS[raw].astype(np.int32)
    if len(kinds) >= 3:
        grams = (kinds[:-2] * 16 + kinds[1:-1]) * 16 + kinds[2:]
        out += np.sqrt(np.bincount(grams, minlength=4096)[:4096].reshape(-1, SLOTS).sum(axis=0) / len(grams))
        out *= len(grams) / (len(grams) + DAMPED)
    m = measures(text)
    if m["words"] >= LEAST_WORDS:
        graded = {"repeats": m["repeats"] / m["words"], "variety": min(1.0, m["sameness"]),
                  "stops": min(1.0, m["stops"] / m["words"])}
        for name, value in graded.items():
            out[(hash_name(name) + int(value * 20)) % SLOTS] += m["words"] / (m["words"] + LEAST_WORDS)
    return out


def hash_name(name: str) -> int:
    return sum((i + 1) * 131 * ord(c) for i, c in enumerate(name))


def fit_scorer(rows: np.ndarray, junk: np.ndarray, turns: int = 400, step: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights and bias of a logistic scorer of soft labels, by full-batch gradients with momentum."""
    used = np.flatnonzero(rows.any(axis=0)) if len(junk) else np.zeros(0, np.int64)
    seen = rows[:, used].astype(np.float64)
    weights, speed = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    start = float(np.clip(junk.mean() if len(junk) else 0.05, 1e-3, 0.5))
    weights[-1] = np.log(start / (1 - start))
    for _ in range(turns if len(junk) else 0):
        wrong = 1 / (1 + np.exp(-(seen @ weights[:-1] + weights[-1]))) - junk
        slope = np.append(seen.T @ wrong / len(junk) + decay * weights[:-1], wrong.mean())
        speed = 0.9 * speed - step * slope
        weights = weights + speed
    out = np.zeros(rows.shape[1] + 1)
    out[used], out[-1] = weights[:-1], weights[-1]
    return out


def _voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch["text"].map(votes).value_counts().rename_axis("pattern").reset_index(name="n")


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Scorer weights from unlabelled texts.

    The votes on every row are counted by pattern (at most 3^8), which is all that reaches the driver; the
    scorer is then fitted on at most ``fit_rows`` texts, chosen by a hash of their keys, with the posterior
    probability of their pattern as label.
    """
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    counted = rows.select("text").mapInPandas(_voted, "pattern string, n long").groupBy("pattern").agg(F.sum("n"))
    patterns = {p: int(n) for p, n in counted.collect()}
    model = fit_votes(patterns)
    total = sum(patterns.values())
    share = min(1.0, fit_rows / max(1, total))
    bounds = int(share * 1_000_000) + 1

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"junk": [model.posterior(votes(t)) for t in batch["text"]],
                                "x": [features(t).astype(np.float16).tobytes() for t in batch["text"]]})

    sample = (rows.filter(F.pmod(F.xxhash64("key", F.length("text")), F.lit(1_000_000)) < bounds).select("text")
              .mapInPandas(sampled, "junk double, x binary").limit(fit_rows).collect())
    x = np.array([np.frombuffer(r["x"], np.float16) for r in sample], np.float32).reshape(len(sample), SLOTS)
    return fit_scorer(x, np.array([r["junk"] for r in sample]))


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "junk") -> DataFrame:
    """``docs`` with the probability of junk as one more column."""
    kept = weights.astype(np.float64)

    @F.pandas_udf("double")
    def junk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: float(1 / (1 + np.exp(-(features(t) @ kept[:-1] + kept[-1])))))

    return docs.withColumn(name, junk(text_or_empty(docs[text])))


def keep_good(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that the scorer rejects.

    Null, empty and very short texts give no evidence and stay; repeated rows get the same decision; an empty
    table stays empty. Every other column passes through untouched.
    """
    scored = score(docs, train(docs, text, key), text, "_junk_probability")
    return scored.filter(F.col("_junk_probability") < REJECT).drop("_junk_probability")
