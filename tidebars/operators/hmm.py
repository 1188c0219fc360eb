"""Hidden-state model of bars: inputs, fit, state names and filtered probabilities, over series cut into blocks.

What a block of rows does to the state is one small matrix, the product of its rows' transitions and densities.
Those of a series, one row per block, give the probabilities with which each block begins and what the rows after it
say about its end; with these every block is worked out by itself. A step of the fit adds up what its blocks found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.operators.blocks import BLOCK, FINE, OWN, ROW, ROWS, block_window, blocked, own_rows, run_stages
from tidebars.schema import SERIES
from tidebars.session import materialize, spread

# fixed values
STATE_CYCLE = ("low_vol_trend", "high_vol_trend", "ranging")
MIN_ROWS, FIRST_SEED, RESTARTS, MAX_ITER, TOLERANCE, VARIANCE_PRIOR = 50, 42, 10, 1000, 1e-2, 1e-2
COVARIANCES = ("diag", "full", "spherical", "tied")
NEAREST_ROUNDS = 10  # of moving the starting means to the middle of the rows nearest to them
INPUTS = ["realized_vol", "autocorrelation"]

PARAMS = ("symbol string, timeframe string, seed int, log_likelihood double, n_samples long, start array<double>, "
          "transitions array<array<double>>, means array<array<double>>, covariances array<array<array<double>>>")


def daily_features(bars: DataFrame) -> DataFrame:
    """realized_vol (10 returns, 5 at least) and lag-1 autocorrelation (20 returns, 10 pairs at least).

    ``bar_number`` counts the daily bars of the series, also those without a volatility yet.
    """
    w = block_window()
    vol, ac = w.rowsBetween(-9, 0), w.rowsBetween(-19, 0)
    r, p = F.col("_t_r"), F.col("_t_p")
    previous = F.lag("close").over(w)
    pairs = F.count(F.when(r.isNotNull() & p.isNotNull(), 1)).over(ac)
    stages = [
        {"_t_r": (F.col("close") - previous) / F.nullif(previous, F.lit(0.0))},
        {"_t_p": F.lag("_t_r").over(w)},
        {"_t_n": F.count("_t_r").over(vol), "_t_sd": F.stddev_samp("_t_r").over(vol),
         "_t_cov": F.when(pairs >= 10, F.covar_samp("_t_r", "_t_p").over(ac)),
         "_t_var": F.when(F.count("_t_r").over(ac) >= 10, F.var_samp("_t_r").over(ac))},
        {"realized_vol": F.when(F.col("_t_n") >= 5, F.col("_t_sd")),
         # greatest and least skip nulls, so the missing ratio is settled first
         "autocorrelation": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(
             F.col("_t_cov") / F.nullif(F.col("_t_var"), F.lit(0.0)), F.lit(0.0))))},
    ]
    out = own_rows(run_stages(blocked(bars.select(*SERIES, "ts", "close"), back=24), stages), keep_row=True)
    return out.filter(F.col("realized_vol").isNotNull()).select(
        *SERIES, "ts", F.col(ROW).alias("bar_number"), "realized_vol", "autocorrelation")


def _scan(maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running products of small matrices, scaled, with the logs of the scales; by doubling."""
    out = maps / maps.max(axis=(1, 2), keepdims=True)
    logs = np.log(maps.max(axis=(1, 2)))
    distance = 1
    while distance < len(out):
        product = out[:-distance] @ out[distance:]
        scale = product.max(axis=(1, 2))
        nxt, nlogs = out.copy(), logs.copy()
        nxt[distance:] = product / scale[:, None, None]
        nlogs[distance:] = logs[distance:] + logs[:-distance] + np.log(scale)
        out, logs, distance = nxt, nlogs, distance * 2
    return out, logs


def _emissions(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities per row and state, divided by the row's largest, and the logs of those divisors."""
    d = x.shape[1]
    log = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covs)):
        diff = x - m
        log[:, k] = -0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c), diff)
                            + np.linalg.slogdet(c)[1] + d * np.log(2 * np.pi))
    top = log.max(axis=1)
    return np.maximum(np.exp(log - top[:, None]), 1e-300), top


@dataclass
class Model:
    """Parameters of one model: start (k), transitions (k, k), means (k, d), covariances (k, d, d)."""

    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.start, self.trans.ravel(), self.means.ravel(), self.covs.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray, states: int, d: int = len(INPUTS)) -> Model:
        parts = np.split(np.asarray(flat, float), np.cumsum([states, states * states, states * d]))
        return cls(parts[0], parts[1].reshape(states, states), parts[2].reshape(states, d), parts[3].reshape(states, d, d))


def _row_maps(x: np.ndarray, model: Model, first: bool) -> tuple[np.ndarray, float]:
    """What each row does to the state before it, scaled, and the log of all scales; a series' first row has no transition."""
    b, top = _emissions(x, model.means, model.covs)
    maps = model.trans[None] * b[:, None, :]
    if first:
        maps[0] = np.diag(b[0])
    return maps, float(top.sum())


def block_map(x: np.ndarray, model: Model, first: bool) -> tuple[np.ndarray, float]:
    """The product of a block's row maps, scaled, and the log of its scale."""
    maps, log = _row_maps(x, model, first)
    while True:
        scale = maps.max(axis=(1, 2))
        maps, log = maps / scale[:, None, None], log + float(np.log(scale).sum())
        if len(maps) == 1:
            return maps[0], log
        if len(maps) % 2:
            maps = np.concatenate([maps, np.eye(maps.shape[1])[None]])
        maps = maps[::2] @ maps[1::2]


def block_alphas(x: np.ndarray, model: Model, first: bool, entering: np.ndarray) -> np.ndarray:
    """State probabilities of each row of a block given all rows up to it; ``entering`` are those before the block."""
    alphas = entering @ _scan(_row_maps(x, model, first)[0])[0]
    return alphas / alphas.sum(axis=1, keepdims=True)


@dataclass
class Sums:
    """What a step of the fit adds up: over rows, or with ``+`` over blocks."""

    start: np.ndarray
    pairs: np.ndarray
    weight: np.ndarray
    moved: np.ndarray  # of rows less the old mean
    scatter: np.ndarray  # about the old mean

    def __add__(self, other: Sums) -> Sums:
        return Sums(*(a + b for a, b in zip(vars(self).values(), vars(other).values(), strict=True)))

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in vars(self).values()])

    @classmethod
    def of(cls, flat: np.ndarray, k: int, d: int = len(INPUTS)) -> Sums:
        parts = np.split(np.asarray(flat, float), np.cumsum([k, k * k, k, k * d]))
        return cls(parts[0], parts[1].reshape(k, k), parts[2], parts[3].reshape(k, d), parts[4].reshape(k, d, d))


def block_sums(x: np.ndarray, model: Model, first: bool, entering: np.ndarray, leaving: np.ndarray) -> Sums:
    """A block's share of a step; ``leaving`` is what the rows after it say about the state at its end."""
    maps, _ = _row_maps(x, model, first)
    alpha = entering @ _scan(maps)[0]
    alpha /= alpha.sum(axis=1, keepdims=True)
    beta = np.tile(leaving / leaving.max(), (len(x), 1))
    if len(x) > 1:
        beta[:-1] = (beta[-1] @ _scan(maps[:0:-1].transpose(0, 2, 1))[0])[::-1]
    gamma = alpha * (beta / beta.sum(axis=1, keepdims=True))
    gamma /= gamma.sum(axis=1, keepdims=True)
    before = np.vstack([entering[None], alpha[:-1]])
    pair = before[:, :, None] * maps * beta[:, None, :]
    if first:
        pair = pair[1:]
    pair = pair / pair.sum(axis=(1, 2), keepdims=True)
    away = x[:, None, :] - model.means[None]
    return Sums(gamma[0] if first else np.zeros(len(leaving)), pair.sum(axis=0), gamma.sum(axis=0),
                np.einsum("nk,nkd->kd", gamma, away), np.einsum("nk,nkd,nke->kde", gamma, away, away))


def updated(model: Model, sums: Sums, covariance: str) -> Model:
    """The model after a step."""
    d = model.means.shape[1]
    trans = sums.pairs / np.maximum(sums.pairs.sum(axis=1)[:, None], 1e-300)
    shift = sums.moved / sums.weight[:, None]
    scatter = sums.scatter - sums.weight[:, None, None] * shift[:, :, None] * shift[:, None, :]
    if covariance == "tied":
        covs = np.repeat(((scatter.sum(axis=0) + VARIANCE_PRIOR * np.eye(d)) / sums.weight.sum())[None], len(shift), axis=0)
    else:
        covs = (scatter + VARIANCE_PRIOR * np.eye(d)) / np.maximum(sums.weight, 1e-5)[:, None, None]
        if covariance in ("diag", "spherical"):
            covs = covs * np.eye(d)
        if covariance == "spherical":
            covs = np.stack([np.eye(d) * np.trace(c) / d for c in covs])
    return Model(sums.start, trans, model.means + shift, covs)


def filtered(x: np.ndarray, start: np.ndarray, trans: np.ndarray, means: np.ndarray, covs: np.ndarray
             ) -> tuple[np.ndarray, float]:
    """State probabilities of each row given the rows up to it, and the log-likelihood of all rows."""
    model = Model(start, trans, means, covs)
    whole, log = block_map(x, model, True)
    return block_alphas(x, model, True, start), float(np.log((start @ whole).sum()) + log)


def _nearest(x: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the rows nearest to each mean."""
    member = ((x[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)[:, None] == np.arange(len(means))
    return member.sum(axis=0).astype(float), member.T @ x


def _first_model(means: np.ndarray, n: float, total: np.ndarray, squares: np.ndarray) -> Model:
    k, d = means.shape
    spread_out = np.diag((squares - total ** 2 / n) / (n - 1)) + 1e-3 * np.eye(d)
    return Model(np.full(k, 1 / k), np.full((k, k), 1 / k), means, np.repeat(spread_out[None], k, axis=0))


def fit(x: np.ndarray, states: int, covariance: str, seed: int, max_iter: int, tolerance: float) -> dict:
    """Expectation maximization from one random start, over a series of one block."""
    means = x[np.random.default_rng(seed).choice(len(x), states, replace=False)]
    for _ in range(NEAREST_ROUNDS):
        count, total = _nearest(x, means)
        means = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], means)
    centre = x - x.mean(axis=0)
    model, likelihood = _first_model(means, len(x), centre.sum(axis=0), (centre ** 2).sum(axis=0)), -np.inf
    for _ in range(max_iter):
        now = filtered(x, model.start, model.trans, model.means, model.covs)[1]
        model = updated(model, block_sums(x, model, True, model.start, np.ones(states)), covariance)
        if now - likelihood < tolerance:
            break
        likelihood = now
    return {"log_likelihood": filtered(x, model.start, model.trans, model.means, model.covs)[1], "start": model.start,
            "transitions": model.trans, "means": model.means, "covariances": model.covs}


def _check_rows(symbol: str, timeframe: str, n: int) -> None:
    if n < MIN_ROWS:
        raise ValueError(f"{symbol} {timeframe}: {n} daily rows, at least {MIN_ROWS} are needed")


def packed(features: DataFrame, rows: int = ROWS) -> DataFrame:
    """(symbol, timeframe, block, n, x): the inputs of a block of rows in one array, with the rows of the series."""
    cut = blocked(features.select(*SERIES, "ts", *INPUTS), rows=rows, total="n").filter(F.col(OWN))
    grouped = cut.groupBy(*SERIES, F.col(BLOCK).alias("block")).agg(
        F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("ts", *INPUTS))).alias("_x"))
    return grouped.select(*SERIES, "block", "n", F.flatten(F.transform("_x", lambda r: F.array(*[r[c] for c in INPUTS]))).alias("x"))


_KEYS = "symbol string, timeframe string"
_MODELS = f"{_KEYS}, models array<double>, likelihoods array<double>, done array<boolean>"


def _inputs(x) -> np.ndarray:
    return np.asarray(x, float).reshape(-1, len(INPUTS))


def _per_seed(flat, seeds: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(seeds, -1)


def _block_maps(states: int, seeds: int):
    """One row per block and all seeds: the block's maps and the logs of their scales."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            maps, logs = [], []
            for x, models, block in zip(batch["x"], batch["models"], batch["block"], strict=True):
                got = [block_map(_inputs(x), Model.of(m, states), block == 0) for m in _per_seed(models, seeds)]
                maps.append(np.concatenate([m.ravel() for m, _ in got]))
                logs.append([log for _, log in got])
            yield batch[[*SERIES, "block", "models"]].assign(maps=maps, logs=logs)
    return run


def _carried(states: int, seeds: int):
    """For the blocks of one series, one row each: what enters and what leaves each of them, and the log-likelihood."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        models = [Model.of(m, states) for m in _per_seed(group["models"].iloc[0], seeds)]
        maps = np.stack([_per_seed(m, seeds).reshape(seeds, states, states) for m in group["maps"]])
        logs = np.stack([np.asarray(v, float) for v in group["logs"]]).sum(axis=0)
        enter, leave = np.empty((len(group), seeds, states)), np.ones((len(group), seeds, states))
        for s, model in enumerate(models):
            vector = model.start
            for i in range(len(group)):
                enter[i, s] = vector
                vector = vector @ maps[i, s]
                logs[s] += np.log(vector.sum())
                vector = vector / vector.sum()
            for i in range(len(group) - 1, 0, -1):
                vector = maps[i, s] @ leave[i, s]
                leave[i - 1, s] = vector / vector.max()
        return group[[*SERIES, "block"]].assign(enter=list(enter.reshape(len(group), -1)), leave=list(leave.reshape(len(group), -1)),
                                               log_likelihoods=[logs] * len(group))
    return run


def _carries(blocks: DataFrame, models: DataFrame, states: int, seeds: int) -> DataFrame:
    maps = blocks.join(models.select(*SERIES, "models"), list(SERIES)).mapInPandas(
        _block_maps(states, seeds), f"{_KEYS}, block long, models array<double>, maps array<double>, logs array<double>")
    return maps.groupBy(*SERIES).applyInPandas(
        _carried(states, seeds), f"{_KEYS}, block long, enter array<double>, leave array<double>, log_likelihoods array<double>")


def _added_up(work):
    """Adds up the arrays that ``work`` makes of each row, by series, before they leave a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                made, key = np.asarray(work(row), float), (row.symbol, row.timeframe)
                total[key] = [total[key][0] + made, row] if key in total else [made, row]
        yield pd.DataFrame([(*key, made, row.models, getattr(row, "likelihoods", None), getattr(row, "done", None), getattr(row, "log_likelihoods", None))
                            for key, (made, row) in total.items()],
                           columns=[*SERIES, "sums", "models", "likelihoods", "done", "log_likelihoods"])
    return run


_SUMS = f"{_KEYS}, sums array<double>, models array<double>, likelihoods array<double>, done array<boolean>, log_likelihoods array<double>"


def _start_models(blocks: DataFrame, states: int, seeds: list[int]) -> DataFrame:
    """The models that a fit of each series starts from: rows drawn by each seed, moved to the middle of those nearest."""
    d, n_seeds = len(INPUTS), len(seeds)
    lengths = materialize(blocks.groupBy(*SERIES).agg(F.max("n").alias("n")))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(row.symbol, row.timeframe, at, s * states + i) for row in batch.itertuples() for s, seed in enumerate(seeds)
                                for i, at in enumerate(np.random.default_rng(seed).choice(row.n, states, replace=False))],
                               columns=[*SERIES, "at", "slot"])

    wanted = lengths.mapInPandas(drawn, f"{_KEYS}, at long, slot int")
    numbered = blocks.select(*SERIES, "block", "x", F.size("x").alias("_size"))
    before = numbered.select(*SERIES, "block", (F.col("_size") / d).cast("long").alias("rows"))
    # rows before each block: one row per block
    offsets = before.withColumn("first", F.coalesce(F.sum("rows").over(
        Window.partitionBy(*SERIES).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = wanted.join(offsets, list(SERIES)).filter((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("rows")))
    means = places.join(numbered, [*SERIES, "block"]).select(*SERIES, "slot", F.slice(
        "x", ((F.col("at") - F.col("first")) * d + 1).cast("int"), F.lit(d)).alias("m"))
    models = materialize(means.groupBy(*SERIES).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("slot", "m"))), lambda c: c["m"])).alias("models")))

    def near(row) -> np.ndarray:
        return np.concatenate([np.column_stack(_nearest(_inputs(row.x), m.reshape(states, d))).ravel() for m in _per_seed(row.models, n_seeds)])

    def moved(group: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum(np.stack(list(group["sums"])), axis=0).reshape(n_seeds, states, d + 1)
        old = _per_seed(group["models"].iloc[0], n_seeds).reshape(n_seeds, states, d)
        new = np.where(sums[..., :1] > 0, sums[..., 1:] / np.maximum(sums[..., :1], 1), old)
        return group[list(SERIES)].iloc[:1].assign(models=[new.ravel()])

    for _ in range(NEAREST_ROUNDS):
        models = materialize(blocks.join(models, list(SERIES)).mapInPandas(_added_up(near), _SUMS)
                             .groupBy(*SERIES).applyInPandas(moved, f"{_KEYS}, models array<double>"))
    first = materialize(blocks.filter("block = 0").select(*SERIES, F.slice("x", 1, d).alias("origin")))

    def moments(row) -> np.ndarray:
        x = _inputs(row.x) - np.asarray(row.likelihoods, float)  # the origin travels in that column
        return np.concatenate([[len(x)], x.sum(axis=0), (x ** 2).sum(axis=0)])

    def begun(group: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum(np.stack(list(group["sums"])), axis=0)
        flat = [_first_model(m.reshape(states, d), sums[0], sums[1:1 + d], sums[1 + d:]).flat() for m in _per_seed(group["models"].iloc[0], n_seeds)]
        return group[list(SERIES)].iloc[:1].assign(models=[np.concatenate(flat)], likelihoods=[[-np.inf] * n_seeds], done=[[False] * n_seeds])

    return materialize(blocks.join(models, list(SERIES)).join(first.withColumnRenamed("origin", "likelihoods"), list(SERIES))
                       .mapInPandas(_added_up(moments), _SUMS).groupBy(*SERIES).applyInPandas(begun, _MODELS))


def _fit_over_blocks(blocks: DataFrame, states: int, covariance: str, seeds: list[int], max_iter: int, tolerance: float) -> DataFrame:
    """The fit of series of several blocks: each step is one pass for the blocks' maps and one for their sums."""
    n_seeds, models = len(seeds), _start_models(blocks, states, seeds)

    def share(row) -> np.ndarray:
        enter, leave = _per_seed(row.enter, n_seeds), _per_seed(row.leave, n_seeds)
        return np.concatenate([
            np.zeros(states + states ** 2 + states + 2 * states + 4 * states) if row.done[s] else
            block_sums(_inputs(row.x), Model.of(m, states), row.block == 0, enter[s], leave[s]).flat()
            for s, m in enumerate(_per_seed(row.models, n_seeds))])

    def step(group: pd.DataFrame) -> pd.DataFrame:
        sums = _per_seed(np.sum(np.stack(list(group["sums"])), axis=0), n_seeds)
        row, flat, likelihoods, done = group.iloc[0], [], [], []
        for s, m in enumerate(_per_seed(row["models"], n_seeds)):
            now, before = row["log_likelihoods"][s], row["likelihoods"][s]
            flat.append(m if row["done"][s] else updated(Model.of(m, states), Sums.of(sums[s], states), covariance).flat())
            done.append(bool(row["done"][s] or now - before < tolerance))
            likelihoods.append(now)
        return group[list(SERIES)].iloc[:1].assign(models=[np.concatenate(flat)], likelihoods=[likelihoods], done=[done])

    for _ in range(max_iter):
        carries = _carries(blocks, models, states, n_seeds)
        models = materialize(blocks.join(models, list(SERIES)).join(carries, [*SERIES, "block"]).mapInPandas(_added_up(share), _SUMS)
                             .groupBy(*SERIES).applyInPandas(step, _MODELS))
        if models.filter(F.exists("done", lambda x: ~x)).isEmpty():
            break
    ended = _carries(blocks, models, states, n_seeds).filter("block = 0").select(*SERIES, "log_likelihoods")
    lengths = blocks.filter("block = 0").select(*SERIES, "n")

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                for s, m in enumerate(_per_seed(row.models, n_seeds)):
                    model = Model.of(m, states)
                    rows.append((row.symbol, row.timeframe, seeds[s], row.log_likelihoods[s], row.n, model.start.tolist(), model.trans.tolist(),
                                 model.means.tolist(), model.covs.tolist()))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in PARAMS.split(", ")])

    return models.join(ended, list(SERIES)).join(lengths, list(SERIES)).mapInPandas(told, PARAMS)


def fit_states(features: DataFrame, states: int = 3, covariance: str = "diag", restarts: int = RESTARTS,
               first_seed: int = FIRST_SEED, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE, rows: int = ROWS) -> DataFrame:
    """Best parameters per series (one row each) over ``restarts`` starting points.

    Series are cut into blocks of about ``rows`` rows. One that has a single block (eleven years of daily bars) is
    fitted in its task, as its sums are the totals; longer ones take a Spark step of the same sums after the other.
    Both give the same parameters. Series with fewer than 50 rows are an error, raised by the job.
    """
    if covariance not in COVARIANCES:
        raise ValueError(f"covariance must be one of {', '.join(COVARIANCES)}")
    blocks = materialize(packed(features, rows))
    seeds = list(range(first_seed, first_seed + restarts))
    tasks = blocks.filter(F.col("n") * len(INPUTS) == F.size("x")).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _check_rows(row.symbol, row.timeframe, row.n)
                got = fit(_inputs(row.x), states, covariance, row.seed, max_iter, tolerance)
                yield pd.DataFrame([{
                    "symbol": row.symbol, "timeframe": row.timeframe, "seed": row.seed, "log_likelihood": got["log_likelihood"], "n_samples": row.n,
                    **{k: got[k].tolist() for k in ("start", "transitions", "means", "covariances")}}])

    fits = spread(tasks, *SERIES, "seed").mapInPandas(one, PARAMS)
    longer = blocks.filter(F.col("n") * len(INPUTS) != F.size("x"))
    if not longer.isEmpty():
        fits = fits.unionByName(_fit_over_blocks(longer, states, covariance, seeds, max_iter, tolerance))
    rank = F.struct(F.round("log_likelihood", 6), -F.col("seed"))  # equal optima, up to rounding, go by the seed
    return fits.groupBy(*SERIES).agg(F.max_by(F.struct(*[c for c in fits.columns if c not in SERIES]), rank)
                                     .alias("_best")).select(*SERIES, "_best.*")


def name_states(params: DataFrame) -> DataFrame:
    """(symbol, timeframe, state_index, state): names from mean volatility and autocorrelation.

    Three states: least autocorrelated is ranging, of the others the more volatile is high_vol_trend.
    Two: by volatility. More: by volatility, cycling through the names.
    """
    means = F.transform("means", lambda m, i: F.struct(
        F.element_at(m, 1).alias("vol"), F.element_at(m, 2).alias("ac"), i.alias("i")))
    table = params.select(*SERIES, F.size("means").alias("n"), means.alias("m"))
    by_vol = F.array_sort(F.col("m"))
    by_ac = F.array_sort(F.transform("m", lambda s: F.struct(s["ac"].alias("ac"), s["i"].alias("i"))))
    table = table.withColumns({"by_vol": F.transform(by_vol, lambda s: s["i"]), "ranging": by_ac[0]["i"]})
    trends = F.filter("by_vol", lambda i: i != F.col("ranging"))
    order = (
        F.when(F.col("n") == 3, F.array(trends[0], F.try_element_at(trends, F.lit(2)), F.col("ranging")))
        .otherwise(F.col("by_vol")))
    named = table.withColumn("order", order).select(*SERIES, F.posexplode("order").alias("pos", "state_index"))
    cycle = F.array(*[F.lit(s) for s in STATE_CYCLE])
    return named.select(*SERIES, "state_index", F.element_at(cycle, (F.col("pos") % 3 + 1).cast("int")).alias("state"))


def filter_states(features: DataFrame, params: DataFrame, rows: int = 2 * FINE) -> DataFrame:
    """Most likely state and its probability at every row, from that row and earlier ones only.

    Blocks of ``rows`` rows are worked out by themselves once it is known what enters them. Series without
    parameters have no rows.
    """
    numbered = blocked(features.select(*SERIES, "ts", *INPUTS), rows=rows).filter(F.col(OWN)).select(
        *SERIES, F.col(BLOCK).alias("block"), "ts", *INPUTS)
    blocks = materialize(numbered.groupBy(*SERIES, "block").agg(F.sort_array(F.collect_list(F.struct("ts", *INPUTS))).alias("_x"))
                         .select(*SERIES, "block", F.col("_x.ts").alias("ts"),
                                 F.flatten(F.transform("_x", lambda r: F.array(*[r[c] for c in INPUTS]))).alias("x")))
    models = materialize(params.select(*SERIES, F.size("start").alias("k"), F.concat(
        F.col("start"), F.flatten("transitions"), F.flatten("means"), F.flatten(F.flatten("covariances"))).alias("models")))
    states = models.agg(F.max("k"), F.min("k")).first()
    if states[0] != states[1]:
        raise ValueError("models of one call have the same number of states")
    if states[0] is None:
        return features.withColumns({"state_index": F.lit(None).cast("int"), "hmm_prob": F.lit(None).cast("double"),
                                     "hmm_state": F.lit(None).cast("string")}).limit(0)
    k = states[0]
    enter = _carries(blocks, models, k, 1).select(*SERIES, "block", "enter")

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                probs = block_alphas(_inputs(row.x), Model.of(row.models, k), row.block == 0, np.asarray(row.enter, float))
                yield pd.DataFrame({"symbol": row.symbol, "timeframe": row.timeframe, "ts": row.ts, "state_index": probs.argmax(axis=1),
                                    "hmm_prob": probs.max(axis=1)})

    scored = blocks.join(models, list(SERIES)).join(enter, [*SERIES, "block"]).mapInPandas(
        one, f"{_KEYS}, ts timestamp, state_index int, hmm_prob double")
    named = scored.join(name_states(params), [*SERIES, "state_index"])
    return features.join(named, [*SERIES, "ts"]).withColumnRenamed("state", "hmm_state")


PARAM_FIELDS = ["seed", "log_likelihood", "n_samples", "start", "transitions", "means", "covariances"]


def save_params(params: DataFrame, path: str) -> None:
    """Store fitted parameters; those stored before at this place are replaced."""
    params.select(*SERIES, *PARAM_FIELDS).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMS).parquet(path)


def state_report(states: DataFrame) -> DataFrame:
    """Rows, share, mean volatility and mean autocorrelation per series and state."""
    by = states.groupBy(*SERIES, "hmm_state").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("realized_vol").alias("mean_vol"), F.avg("autocorrelation").alias("mean_ac"))
    total = states.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_all"))
    return by.join(total, list(SERIES)).withColumn("share", F.col("rows") / F.col("_all")).drop("_all")


def transition_matrix(params: DataFrame) -> DataFrame:
    """The fitted matrix as rows (symbol, timeframe, from_state, to_state, probability)."""
    names = name_states(params)
    cells = params.select(*SERIES, F.posexplode("transitions").alias("i", "_row")).select(
        *SERIES, "i", F.posexplode("_row").alias("j", "probability"))
    source = names.select(*SERIES, F.col("state_index").alias("i"), F.col("state").alias("from_state"))
    target = names.select(*SERIES, F.col("state_index").alias("j"), F.col("state").alias("to_state"))
    return cells.join(source, [*SERIES, "i"]).join(target, [*SERIES, "j"]).drop("i", "j")


def observed_transitions(states: DataFrame, column: str = "hmm_state", keys: Sequence[str] = SERIES) -> DataFrame:
    """How often one state followed another."""
    pairs = own_rows(blocked(states.select(*keys, "ts", column), back=1, keys=keys).withColumn(
        "from_state", F.lag(column).over(block_window(keys))))
    return pairs.filter(F.col("from_state").isNotNull()).groupBy(
        *keys, "from_state", F.col(column).alias("to_state")).agg(F.count(F.lit(1)).alias("times"))
