"""Language-model scores by a hierarchical Pitman-Yor model, seated by Gibbs sweeps over partitioned counts.

The root restaurant serves all words; every previous word, however rare, and the start of a text has a restaurant
of its own with the root as parent, known by the word's 64-bit hash. A bucket is a range of words by hash. It holds
its words' (word, previous word, count) triples and their tables, so a frequent context is spread over all buckets.
A restaurant's number of tables is kept in the bucket of the word that it follows: before a sweep each bucket adds up
its tables by restaurant, the restaurant's bucket adds up these sums and answers. Only totals of the root and of the
start reach the driver.

Texts are numbered once: a block of them is a row of word hashes and of tokens as places among these. Counts, requests
and scores are made from blocks. Shuffled messages go as soon as what is made of them is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.columns import discard, materialize, set_for, text_or_empty

BLOCK_TOKENS = 1_000_000  # tokens (five characters each) that are numbered together and make one set of counts or requests
TURNS = 4  # blocks are scored in so many turns, of which each drops its messages
BUCKETS = 2  # buckets of words for each shuffle partition: a task holds one at a time
BUCKET_TOKENS = 500_000  # a smaller input gets fewer, as each bucket writes to each other one
BURN_IN, SAMPLES = 1, 2
#: Every query here is written and not run again, so its shuffle files go when it ends; rows are large, so few go to Python at once.
FRUGAL = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
ONE_BY_ONE = 32  # customers of a dish seated singly; later ones come in batches of an eighth of those seated
STRENGTH = 1.0
END = b""  # no word is empty
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))  # as a context: the start of a text
DIRECT, START, WORD = 0, 1, 2  # kinds of context: the root itself, the start of a text, a word told by its hash
BASE = 0.1


@dataclass
class Block:
    """Texts as numbers: words sorted by (bucket, hash), tokens of all texts, and their (word, word before) keys."""

    buckets: int
    hashes: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    def parts(self) -> Iterator[tuple[int, slice, slice]]:
        """(bucket, its words, its distinct keys)."""
        owner = (self.hashes % np.uint64(self.buckets)).astype(np.int64)
        distinct = self.distinct()
        edges = np.flatnonzero(np.diff(owner)) + 1
        for start, stop in zip(np.append(0, edges), np.append(edges, len(owner)), strict=True):
            if stop > start:
                lo, hi = np.searchsorted(distinct, [start << 32, stop << 32])
                yield int(owner[start]), slice(start, stop), slice(int(lo), int(hi))

    def distinct(self) -> np.ndarray:
        if not hasattr(self, "_distinct"):
            self._distinct, self._counts = np.unique(self.keys, return_counts=True)
        return self._distinct

    def counts(self) -> np.ndarray:
        self.distinct()
        return self._counts


def numbers_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, the end token first, tokens of all texts as places among them, and tokens of each text."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    begins = pieces.offsets.to_numpy()
    words = pieces.flatten()
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at either end leaves empty pieces
    before = np.append(0, np.cumsum(filled))[begins - begins[0]]
    words = words.filter(pa.array(filled)).dictionary_encode()
    known = words.dictionary.view(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [END, *known]), np.uint64, len(known) + 1)
    sizes = np.diff(before)
    ends = np.cumsum(sizes + 1) - 1
    tokens = np.zeros(int(sizes.sum()) + len(sizes), np.uint32)
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = words.indices.to_numpy().astype(np.uint32) + 1
    return hashes, tokens, sizes + 1


def block_from(hashes: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, buckets: int) -> Block:
    """Before the first word of a text stands the end token, the first of ``hashes``."""
    order = np.lexsort((hashes, hashes % np.uint64(buckets)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    flat = rank[tokens]
    keys = flat << 32
    keys[1:] |= flat[:-1]
    keys[:1] |= rank[0]
    return Block(buckets, hashes[order], flat, sizes, keys)


def _utf8(texts: list[str]) -> pa.Array:
    return pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()).view(pa.large_string())


def block_of(texts: list[str], buckets: int) -> Block:
    return block_from(*numbers_of(_utf8(texts)), buckets)


_ZSTD = pa.Codec("zstd", compression_level=1)


def lean(values: np.ndarray) -> bytes:
    """Whole numbers, most of them small, in few bytes: all first bytes, all second ones and so on, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return bytes([kind.itemsize]) + len(planes).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def full(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(_ZSTD.decompress(memoryview(data)[9:], size), np.uint8)
    return np.ascontiguousarray(planes.reshape(data[0], -1).T).view(f"u{data[0]}").ravel().astype(np.int64)


def few(hashes: np.ndarray) -> bytes:
    """Hashes, many of them repeated: how many differ, these, and the place of each among them."""
    distinct, at = np.unique(hashes, return_inverse=True)
    return len(distinct).to_bytes(8, "little") + distinct.tobytes() + lean(at)


def places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that differ, sorted, and the place of each hash among them."""
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, np.uint64, n, 8), full(memoryview(data)[8 + 8 * n:])


def many(data: bytes) -> np.ndarray:
    distinct, at = places(data)
    return distinct[at]


COUNTS = "bucket int, words binary, lens binary, prev binary, n binary"


def _numbered(limit: int):
    names = ["block", "turn", "n", "ids", "held", "sizes", "words", "tokens"]

    def row(at: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        hashes, tokens, sizes = numbers_of(rows["text"].cast(pa.large_string()).combine_chunks())
        lists = [pa.ListArray.from_arrays([0, len(rows)], rows[c].combine_chunks()) for c in ("doc_id", "held_out")]
        task = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 32 | at], pa.int64()), pa.array([(task + at) % TURNS], pa.int32()), pa.array([len(tokens)], pa.int64()), *lists,
             *(pa.array([x], pa.binary()) for x in (lean(sizes), hashes.tobytes(), lean(tokens)))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = 0, [], 0
        for batch in batches:
            ends, at = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False) // 5 + 1), 0
            while at < len(ends):
                past = int(ends[at - 1]) if at else 0
                stop = min(int(np.searchsorted(ends, past + limit - size)) + 1, len(ends))
                held.append(batch.slice(at, stop - at))
                size, at = size + int(ends[stop - 1]) - past, stop
                if size >= limit:
                    yield row(made, held)
                    made, held, size = made + 1, [], 0
        if held:
            yield row(made, held)
    return run


def number(docs: DataFrame, text: str = "text", key: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Written blocks of all texts: (block, turn, n, ids, held, sizes, words, tokens).

    A block is what a task reads one after another, ``block_tokens`` of five characters each, however long a text is; ``n`` are its tokens.
    ``words`` are hashes in order of appearance, after the end token; ``tokens`` are places among them.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), text_or_empty(text).alias("text"))
    with set_for(docs.sparkSession, FRUGAL):
        return materialize(rows.mapInArrow(
            _numbered(block_tokens),
            f"block long, turn int, n long, ids array<{kind}>, held array<boolean>, sizes binary, words binary, tokens binary"))


def _counted(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                hashes, tokens, sizes = np.frombuffer(row.words, np.uint64), full(row.tokens), full(row.sizes)
                learnt = ~np.asarray(row.held, bool)
                tokens = tokens[np.repeat(learnt, sizes)]
                there = np.bincount(tokens, minlength=len(hashes)) > 0
                if not there[0]:
                    continue  # every text has an end
                block = block_from(hashes[there], (np.cumsum(there) - 1)[tokens], sizes[learnt], buckets)
                counts = block.counts()
                yield pd.DataFrame([(*_packed(block, *part), lean(counts[part[2]])) for part in block.parts()],
                                   columns=["bucket", "words", "lens", "prev", "n"])
    return run


def _packed(block: Block, bucket: int, words: slice, keys: slice) -> tuple:
    """A bucket's words, how many contexts each has, and the hashes of these."""
    pairs = block.distinct()[keys]
    lens = np.bincount((pairs >> 32) - words.start, minlength=words.stop - words.start)
    return bucket, block.hashes[words].tobytes(), lean(lens), few(block.hashes[pairs & 0xFFFFFFFF])


_SAMPLES = "array<struct<tables:binary,root_customers:binary,root_tables:binary>>"
STATE = f"bucket int, words binary, lens binary, before binary, counts binary, drawn {_SAMPLES}"
_STATE = ["bucket", "words", "lens", "before", "counts", "drawn"]


def spelled_out(state: DataFrame) -> DataFrame:
    """Adds what ``before``, ``counts`` and ``drawn`` hold as plain 64-bit numbers, and the kinds of contexts; made only if read."""
    @F.pandas_udf("binary")
    def hashes(before: pd.Series) -> pd.Series:
        return before.map(lambda b: many(b).tobytes())

    @F.pandas_udf("binary")
    def kinds(before: pd.Series) -> pd.Series:
        return before.map(lambda b: np.where(many(b) == END_HASH, START, WORD).astype(np.uint16).tobytes())

    @F.pandas_udf("binary")
    def numbers(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: full(c).tobytes())

    @F.pandas_udf(_SAMPLES)
    def samples(drawn: pd.Series) -> pd.Series:
        names = ("tables", "root_customers", "root_tables")
        return drawn.map(lambda d: [{k: full(s[k]).tobytes() for k in names} for s in d])

    return state.withColumns({"prev": hashes("before"), "ctx": kinds("before"), "n": numbers("counts"), "samples": samples("drawn")})


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The state of a bucket out of the counts of all blocks: pairs by (word, hash before), a table each to begin with."""
    words = np.concatenate([np.repeat(np.frombuffer(w, np.uint64), full(k))
                            for w, k in zip(rows["words"], rows["lens"], strict=True)])
    prev = np.concatenate([many(c) for c in rows["prev"]])
    counts = np.concatenate([full(n) for n in rows["n"]])
    order = np.lexsort((prev, words))
    words, prev = words[order], prev[order]
    first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (prev[1:] != prev[:-1])))
    counts = np.add.reduceat(counts[order].astype(np.int64), first)
    distinct, lens = np.unique(words[first], return_counts=True)
    prev = prev[first]
    sample = {"tables": lean(np.ones(len(prev), np.int64)), "root_customers": lean(lens), "root_tables": lean(np.ones(len(distinct), np.int64))}
    return pd.DataFrame([(key[0], distinct.tobytes(), lens.astype(np.int32).tobytes(), few(prev), lean(counts), [sample])], columns=_STATE)


def seat(counts: np.ndarray, opens: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers come in one after another.

    ``opens`` is (strength + discount * tables of the restaurant) times the parent's probability of the dish:
    a customer opens a table with weight ``opens`` and joins one with weight seated - discount * tables.
    """
    order = np.argsort(-counts, kind="stable")
    left, weight = counts[order], opens[order]
    tables = np.minimum(left, 1).astype(np.float64)
    seated = 1
    while len(left):
        batch = 1 if seated < ONE_BY_ONE else seated // 8
        active = int(np.searchsorted(-left, -seated, side="left"))  # dishes with more customers than seated
        if not active:
            break
        chance = weight[:active] / (weight[:active] + np.maximum(seated - discount * tables[:active], 1e-9))
        now = np.minimum(batch, left[:active] - seated)
        tables[:active] += draw.random(active) < chance if batch == 1 else draw.binomial(now, chance)
        seated += batch
    out = np.empty(len(tables), np.int64)
    out[order] = tables
    return out


@dataclass
class Totals:
    """Numbers over all buckets: customers and tables of the start of a text (at its number) and of the root."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: int
    root_tables: int


@dataclass
class Model:
    tokens: int
    types: int
    contexts: np.ndarray  # words known by number rather than by hash: none
    buckets: int
    discounts: tuple[float, float]  # of the root and of its children
    totals: list[Totals] = field(default_factory=list)

    def root(self, customers: np.ndarray, tables: np.ndarray, totals: Totals) -> np.ndarray:
        """Predictive probabilities of the root; absent words have neither customers nor tables."""
        d = self.discounts[0]
        new = (STRENGTH + d * totals.root_tables) / (STRENGTH + totals.root_customers) / (self.types + 1)
        return np.maximum(customers - d * tables, 0) / (STRENGTH + totals.root_customers) + new

    def child(self, context: np.ndarray, counts: np.ndarray, tables: np.ndarray, parent: np.ndarray, totals: Totals) -> np.ndarray:
        """Predictive probabilities in contexts by number, DIRECT meaning the root itself."""
        value = self.served(self.excess(counts, tables), totals.customers[context], totals.tables[context], parent)
        return np.where(context == DIRECT, parent, value)

    def excess(self, counts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """What a dish's customers weigh in its own restaurant."""
        return np.maximum(counts - self.discounts[1] * tables, 0)

    def served(self, excess: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Predictive probabilities in restaurants of so many customers and tables."""
        return (excess + (STRENGTH + self.discounts[1] * tables) * parent) / (STRENGTH + customers)


def _restaurants(before: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct restaurants by (bucket, hash), the buckets that hold them, where each begins, and the place of every pair's."""
    ctx, at = places(before)
    order = np.argsort(ctx % np.uint64(buckets), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    holders, starts = np.unique(ctx[order] % np.uint64(buckets), return_index=True)
    return ctx[order], holders.astype(np.int64), starts, rank[at]


def _told(buckets: int):
    """A bucket's tables by restaurant, a row per bucket that holds the restaurants."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ctx, holders, starts, at = _restaurants(row.before, buckets)
                tables = np.bincount(at, full(row.drawn[-1]["tables"]), len(ctx)).astype(np.int64)
                stops = np.append(starts[1:], len(ctx))
                yield pd.DataFrame([(int(h), row.bucket, ctx[i:j].tobytes(), lean(tables[i:j]))
                                    for h, i, j in zip(holders, starts, stops, strict=True)],
                                   columns=["holder", "bucket", "ctx", "tables"])
    return run


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Tables of a bucket's restaurants: an answer to each bucket that told some, and all of them as bucket -1."""
    parts = [np.frombuffer(c, np.uint64) for c in rows["ctx"]]
    ctx, at = np.unique(np.concatenate(parts), return_inverse=True)
    tables = np.bincount(at, np.concatenate([full(t) for t in rows["tables"]]), len(ctx)).astype(np.int64)
    ends = np.cumsum([len(p) for p in parts])
    answers = [lean(tables[part]) for part in np.split(at, ends[:-1])]
    return pd.DataFrame({"holder": int(key[0]), "bucket": [*rows["bucket"], -1], "tables": [*answers, tables.tobytes()]})


def _exchanged(state: DataFrame, buckets: int) -> DataFrame:
    told = state.select("bucket", "before", F.slice("drawn", -1, 1).alias("drawn")).mapInPandas(
        _told(buckets), "holder int, bucket int, ctx binary, tables binary")
    return materialize(told.groupBy("holder").applyInPandas(_added, "holder int, bucket int, tables binary"))


def _sweep(model: Model, number: int, keep: bool):
    """Seats all customers of a bucket anew, given the tables of the last sweep."""
    totals = model.totals[-1]

    def run(key: tuple, state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return pd.DataFrame(columns=_STATE)
        row = state.iloc[0]
        last, lens, counts = row["drawn"][-1], np.frombuffer(row["lens"], np.int32), full(row["counts"])
        owner = np.repeat(np.arange(len(lens)), lens)
        draw = np.random.default_rng([number, key[0]])
        told = np.concatenate([full(t) for t in answers.sort_values("holder")["tables"]])
        parent = model.root(full(last["root_customers"]), full(last["root_tables"]), totals)
        at = _restaurants(row["before"], model.buckets)[3]
        tables = seat(counts, (STRENGTH + model.discounts[1] * told[at]) * parent[owner], model.discounts[1], draw)
        customers = np.bincount(owner, tables, len(lens)).astype(np.int64)
        weight = (STRENGTH + model.discounts[0] * totals.root_tables) / (model.types + 1)
        root_tables = seat(customers, np.full(len(customers), weight), model.discounts[0], draw)
        sample = {"tables": lean(tables), "root_customers": lean(customers), "root_tables": lean(root_tables)}
        return pd.DataFrame([(key[0], *row[_STATE[1:-1]], [*(row["drawn"] if keep else []), sample])], columns=_STATE)
    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens and types of a task's buckets, customers and tables of the start and of the root in the last sample."""
    sums = np.zeros(6, np.int64)
    for batch in batches:
        for row in batch.itertuples():
            last, n = row.drawn[-1], full(row.counts)
            start = many(row.before) == END_HASH
            sums += [n.sum(), len(row.lens) // 4, n[start].sum(), full(last["tables"])[start].sum(),
                     full(last["root_customers"]).sum(), full(last["root_tables"]).sum()]
    yield pd.DataFrame([sums], columns=list("abcdef"))


def _totals(state: DataFrame) -> tuple[int, int, Totals]:
    """Tokens, types, totals of the last sample."""
    summed = state.select("lens", "before", "counts", F.slice("drawn", -1, 1).alias("drawn")).mapInPandas(
        _summed, ", ".join(f"{c} long" for c in "abcdef"))
    tokens, types, customers, tables, *root = (int(x or 0) for x in summed.agg(*[F.sum(c) for c in "abcdef"]).first())
    return tokens, types, Totals(np.array([0, customers]), np.array([0, tables]), *root)


def held_out(key: str = "doc_id"):
    """Rows that the model does not learn from; a missing key is learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> tuple[Model, DataFrame]:
    """The model's totals and its state, a row per bucket, from all rows that are not held out.

    ``restaurants`` of the state: per sample, the tables of the restaurants that follow the bucket's words, in their
    order; each word is followed as often as it occurs, so its count is the number of customers.
    """
    blocks = number(docs, text, key, block_tokens)
    trained = fit(blocks)
    discard(blocks)
    return trained


def fit(blocks: DataFrame) -> tuple[Model, DataFrame]:
    """``train`` on texts that are numbered already."""
    spark = blocks.sparkSession
    size = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = min(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_TOKENS + 1)
    with set_for(spark, FRUGAL):
        state = materialize(blocks.select("held", "sizes", "words", "tokens").mapInPandas(_counted(buckets), COUNTS)
                            .groupBy("bucket").applyInPandas(_merged, STATE))
        tokens, types, now = _totals(state)
        model = Model(tokens, types, np.zeros(0, np.uint64), buckets, (0.8, 0.8), [now])
        tables = _exchanged(state, buckets)
        kept = []
        for turn in range(1, 1 + BURN_IN + SAMPLES):
            before, heard = state, tables
            answers = heard.filter("bucket >= 0").select("bucket", "holder", "tables")
            state = materialize(before.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(
                _sweep(model, turn, keep=turn > BURN_IN + 1), STATE))
            discard(before)
            if turn <= BURN_IN + 1:
                discard(heard)
            now = _totals(state)[2]
            model.totals = [*model.totals, now] if turn > BURN_IN + 1 else [now]
            tables = _exchanged(state, buckets)
            if turn > BURN_IN:
                kept.append(tables.filter("bucket < 0").select(F.col("holder").alias("bucket"), F.col("tables").alias(f"_{turn}")))
    for own in kept:
        state = state.join(own, "bucket")
    names = [own.columns[1] for own in kept]
    return model, spelled_out(state.withColumn("restaurants", F.array(*names)).drop(*names))


def _requests(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block = block_from(np.frombuffer(row.words, np.uint64), full(row.tokens), full(row.sizes), model.buckets)
                yield pd.DataFrame([(row.block, *_packed(block, *part)) for part in block.parts()],
                                   columns=["block", "bucket", "words", "lens", "prev"])
    return run


ANSWER = "block long, bucket int, times binary, roots array<binary>, restaurants array<binary>, n binary, tables binary"


def _answers(model: Model):
    """Per word: times seen, and by sample its customers and tables in the root and the tables of the restaurant that
    follows it; per pair its customers and, where these are more than one, its tables in all samples."""
    def run(key: tuple, asked: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if len(state):
            row = state.iloc[0]
            words, counts = np.frombuffer(row["words"], np.uint64), full(row["counts"])
            owner = np.repeat(np.arange(len(words)), np.frombuffer(row["lens"], np.int32))
            ctx, rank = places(row["before"])
            keys = (owner << 32) | rank
            known = np.bincount(owner, counts, len(words)).astype(np.int64)
            roots = [full(s[name]) for s in row["drawn"] for name in ("root_customers", "root_tables")]
            restaurants = [np.frombuffer(tables, np.int64) for tables in row["restaurants"]]
            seats = sum(full(s["tables"]) for s in row["drawn"])
        out = []
        for request in asked.itertuples():
            wanted, (before, which) = np.frombuffer(request.words, np.uint64), places(request.prev)
            of = np.repeat(np.arange(len(wanted)), full(request.lens))
            if len(state):
                at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
                there = words[at] == wanted
                place = np.minimum(np.searchsorted(ctx, before), len(ctx) - 1)
                pair = (at[of] << 32) | place[which]
                pair_at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                pair_there = there[of] & (ctx[place] == before)[which] & (keys[pair_at] == pair)
                by_word = [np.where(there, x[at], 0) for x in (known, *roots, *restaurants)]
                n, tables = (np.where(pair_there, x[pair_at], 0) for x in (counts, seats))
            else:
                by_word = [np.zeros(len(wanted), np.int64)] * (1 + 3 * len(model.totals))
                n = tables = np.zeros(len(of), np.int64)
            times, *rest = map(lean, by_word)
            out.append((request.block, int(key[0]), times, rest[:2 * len(model.totals)], rest[2 * len(model.totals):], lean(n), lean(tables[n > 1])))
        return pd.DataFrame(out, columns=["block", "bucket", "times", "roots", "restaurants", "n", "tables"])
    return run


SCORES = "doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(model: Model):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row = rows.select(["sizes", "words", "tokens"]).to_pylist()[0]
        block = block_from(np.frombuffer(row["words"], np.uint64), full(row["tokens"]), full(row["sizes"]), model.buckets)
        by_bucket = {answer["bucket"]: answer for answer in answers.to_pylist()}
        pairs, size, samples = block.distinct(), len(block.hashes), len(model.totals)
        times, parents, restaurants = np.empty(size, np.int64), np.empty((samples, size)), np.empty((samples, size), np.int64)
        excess = np.empty(len(pairs))
        for bucket, words, keys in block.parts():
            answer = by_bucket[bucket]
            times[words] = full(answer["times"])
            for i, totals in enumerate(model.totals):
                parents[i, words] = model.root(full(answer["roots"][2 * i]), full(answer["roots"][2 * i + 1]), totals)
                restaurants[i, words] = full(answer["restaurants"][i])
            n = full(answer["n"])
            tables = samples * n  # a table each for single customers
            tables[n > 1] = full(answer["tables"])
            excess[keys] = model.excess(n, tables / samples)
        word, before = pairs >> 32, pairs & 0xFFFFFFFF
        total = sum(model.served(excess, times[before], restaurants[i][before], parents[i][word]) for i in range(samples))
        logs = np.log10(total / samples)
        starts = np.append(0, np.cumsum(block.sizes)[:-1])
        base = np.log10((times + BASE) / (model.tokens + BASE * (model.types + 1)))
        known = np.add.reduceat((times > 0)[block.tokens].astype(np.int64), starts)
        scores = np.add.reduceat(logs[np.searchsorted(pairs, block.keys)], starts)
        ids, held = (rows[c].combine_chunks().flatten() for c in ("ids", "held"))
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": block.sizes, "n_known": known,
                         "train_tokens": np.full(len(known), model.tokens), "base_score": np.add.reduceat(base[block.tokens], starts), "score": scores})
    return run


def score(docs: DataFrame, model: Model, state: DataFrame, text: str = "text", key: str = "doc_id",
          block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per input row; written.

    A block of texts asks each bucket once for its distinct (word, word before) pairs and gets what it holds of them
    and of the restaurants that follow its words, in the same order; it works out the predictive probabilities, averaged
    over the samples, and adds up their logarithms per text. Null is the empty text, which is one end token. Repeated
    rows score alike. An empty table gives an empty result; with nothing to learn from, every word is unseen. Other
    columns are not read.
    """
    blocks = number(docs, text, key, block_tokens)
    rated = rate(blocks, model, state, key)
    discard(blocks)
    return rated


def rate(blocks: DataFrame, model: Model, state: DataFrame, key: str = "doc_id") -> DataFrame:
    """``score`` of texts that are numbered already; every turn's messages go once its rows are written."""
    spark = blocks.sparkSession
    shape = SCORES.format(kind=blocks.schema["ids"].dataType.elementType.simpleString())
    known, out = state.select(*_STATE, "restaurants"), spark.createDataFrame([], shape)
    with set_for(spark, FRUGAL):
        for (turn,) in sorted(blocks.select("turn").distinct().collect()):
            mine = blocks.filter(F.col("turn") == turn)
            asked = mine.select("block", "sizes", "words", "tokens").mapInPandas(
                _requests(model), "block long, bucket int, words binary, lens binary, prev binary")
            answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(_answers(model), ANSWER)
            out = out.unionByName(materialize(mine.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(model), shape)))
    return out.withColumnRenamed("doc_id", key) if key != "doc_id" else out


def train_and_score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``score`` of the rows that the model is trained on and of those held out, which are numbered once for both."""
    blocks = number(docs, text, key)
    rated = rate(blocks, *fit(blocks), key)
    discard(blocks)
    return rated
