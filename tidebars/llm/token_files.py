"""Token ids of documents in binary files of Simple-8b blocks: written in order of the key, read back block by block."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.llm import simple8b
from tidebars.llm.columns import materialize, new_folder, text_or_empty

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BLOCK = 1 << 16  # ids of a block
BLOCKS_PER_FILE = 512

# fixed values of the file format: magic, bytes of the block, shard, block of the shard, ids and documents of the
# shard before the block, ids, words, offsets, escapes and directory entries of the block
HEAD = struct.Struct("<8sQIIQQIIIII4x")
MAGIC = b"SIMPLE8B"
NO_KEY, GOES_ON, ENDS = 1, 2, 4  # flags of directory entries: null key; began in an earlier block; ends in this one

PIECES = "shard int, start long, document long, doc_id long, whole boolean, n long"

#: Parts that are coded alike as lines of one text: what comes before and after them are line feeds of their own.
LINE = re.compile(r"[ \n]?\S(?:[^\n]*\S)?")
_KEPT_PARTS = 400_000
_CHUNK = 1 << 21  # bytes of the texts that are cut at a time, if a text is not longer


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    """The tokenizer of a file, once per worker; strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary)
    coder.encode_special_tokens = True
    return coder


class _Parts(dict):
    """Numbers of the parts of texts seen so far; unknown ones queue up until they are encoded together."""

    def __init__(self, known: Iterable[tuple[str, int]] = ()) -> None:
        super().__init__(known)
        self.fresh: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        self.fresh.append(part)
        return number


def _marked(*ranges: tuple[int, int]) -> np.ndarray:
    """Whether a byte lies in one of the ranges, ends included."""
    marks = np.zeros(256, bool)
    for low, high in ranges:
        marks[low:high + 1] = True
    return marks


# bytes of UTF-8; white space beyond ASCII has the encodings C2 85, C2 A0, E1 9A 80, E2 80 80-AF, E2 81 9F and E3 80 80
_BLANK = _marked((0x0A, 0x0A), (0x20, 0x20))
_STOP = _marked((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_SEPARATOR = _BLANK | _STOP
_VISIBLE = _marked((0x21, 0x7E), (0x80, 0xFF))
_ALNUM = _marked((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_LATIN = _marked((0xC3, 0xC9))  # first bytes of U+00C0 to U+027F, letters but for two signs
_SIGN = _marked((0x97, 0x97), (0xB7, 0xB7))  # second bytes of these signs
_SPACE_SECOND = _marked((0x80, 0x81), (0x85, 0x85), (0x9A, 0x9A), (0xA0, 0xA0))
_SPACE_FIRST = _marked((0xC2, 0xC2), (0xE1, 0xE3))
_SPACE_LAST = _marked((0x80, 0xAF))
_SPACE_BEFORE_LAST = _marked((0x80, 0x81), (0x9A, 0x9A), (0xC2, 0xC2))


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 where byte-level pre-tokenizers begin a match in any case.

    These are before a single blank or line feed between characters that are no white space, and before a stop after
    an ASCII letter or digit or a Latin letter of two bytes. Next to some characters that share bytes with white
    space no cut is made.
    """
    at = np.flatnonzero(_SEPARATOR[data])
    at = at[(at >= 2) & (at < len(data) - 2)]
    here, last, first, after, second = data[at], data[at - 1], data[at - 2], data[at + 1], data[at + 2]
    stop = _STOP[here] & (_ALNUM[last] | (_LATIN[first] & (last >= 0x80) & ~((first == 0xC3) & _SIGN[last])))
    blank = (_BLANK[here] & _VISIBLE[last] & _VISIBLE[after] & ~(_SPACE_LAST[last] & _SPACE_BEFORE_LAST[first])
             & ~(_SPACE_FIRST[after] & _SPACE_SECOND[second]))
    return at[stop | blank]


def _chunks(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """Runs of texts of about ``_CHUNK`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, "right")), at + 1)
        yield texts[at:end]
        at = end


class PartCoder:
    """Encodes texts by the library, each different part between safe cuts once while it is remembered.

    Past ``_KEPT_PARTS`` remembered parts, the half of them stays that occurred in most chunks of texts lately.
    """

    def __init__(self, vocabulary: str) -> None:
        self.coder, self.parts, self.ids, self.used = tokenizer(vocabulary), _Parts(), np.zeros(1 << 16, np.uint32), 0
        self.table = np.zeros((3, 0), np.int64)  # by number: begin, size, chunks that it occurred in
        feed = self.coder.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None

    def _store(self, ids: np.ndarray) -> int:
        """Where in the store the ids begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(self.used, np.uint32)])
        self.ids[at:self.used] = ids
        return at

    def _learn(self) -> None:
        parts, self.parts.fresh = self.parts.fresh, []
        if not parts:
            return
        begins, sizes = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        lines = [i for i, p in enumerate(parts) if LINE.fullmatch(p)] if self.feed is not None else []
        others = range(len(parts))
        if lines:  # one text of a line each; the line feed's id stands before each, and belongs to those that begin with it
            own = [parts[i][0] == "\n" for i in lines]
            text = "".join([parts[i] if feed else "\n" + parts[i] for i, feed in zip(lines, own, strict=True)])
            ids = np.array(self.coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            feeds = np.flatnonzero(ids == self.feed)
            if len(feeds) == len(lines):
                first = feeds + ~np.array(own)
                begins[lines], sizes[lines] = self._store(ids) + first, np.append(feeds[1:], len(ids)) - first
                others = sorted(set(others).difference(lines))
        if others:
            coded = [e.ids for e in self.coder.encode_batch_fast([parts[i] for i in others], add_special_tokens=False)]
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            at = self._store(np.fromiter(chain.from_iterable(coded), np.uint32, int(size.sum())))
            begins[others], sizes[others] = at + np.cumsum(size) - size, size
        self.table = np.concatenate([self.table, np.stack([begins, sizes, np.zeros_like(sizes)])], axis=1)

    def _forget(self) -> None:
        begins, sizes, uses = self.table
        stay = np.zeros(len(uses), bool)
        stay[np.argsort(-uses, kind="stable")[:_KEPT_PARTS // 2]] = True
        self.parts = _Parts(zip(compress(self.parts, stay.tolist()), count()))
        sizes = sizes[stay]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(begins[stay] - ends + sizes, sizes) + np.arange(sizes.sum())]
        self.used = len(self.ids)
        self.table = np.stack([ends - sizes, sizes, uses[stay] // 2])

    def chunks(self, texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of a run of texts after one another, and where each text's end."""
        for some in _chunks(texts):
            some = pc.fill_null(pa.concat_arrays([some]), "")
            data = np.frombuffer(some.buffers()[2] or b"", np.uint8)
            edges = np.frombuffer(some.buffers()[1], np.int32)[some.offset:some.offset + len(some) + 1]
            begins = np.zeros(int(edges[-1]) + 1, bool)
            begins[_cuts(data[:edges[-1]])] = True
            begins[edges] = True
            begins[:edges[0]] = False
            places = np.flatnonzero(begins).astype(np.int32)
            parts = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), some.buffers()[2] or pa.py_buffer(b"")).dictionary_encode()
            distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
            numbers = np.fromiter(map(self.parts.__getitem__, distinct), np.int64, len(distinct))
            self._learn()
            self.table[2, numbers] += 1
            at, sizes = self.table[:2, numbers[parts.indices.to_numpy()]]
            ends = np.append(0, np.cumsum(sizes))
            ids = self.ids[np.repeat(at - ends[:-1], sizes) + np.arange(ends[-1])]
            if len(self.parts) > _KEPT_PARTS:
                self._forget()
            yield ids, ends[np.searchsorted(places, edges[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [part for ids, ends in self.chunks(pa.array(texts, pa.string())) for part in np.split(ids, ends[:-1])]


@lru_cache(maxsize=1)
def part_coder(vocabulary: str) -> PartCoder:
    """One per worker, which remembers parts from task to task."""
    return PartCoder(vocabulary)


class _Writer:
    """Fills blocks of a shard with the ids of document after document."""

    def __init__(self, shard: int, size: int) -> None:
        self.shard, self.size, self.blocks, self.ids_before, self.docs_before = shard, size, 0, 0, 0
        self._open(0)

    def _open(self, begun: int) -> None:
        self.parts, self.held, self.entries, self.begun = [], 0, [], begun

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[bytes]:
        at, no_key = 0, NO_KEY if key is None else 0
        while at < len(ids):
            take = min(self.size - self.held, len(ids) - at)
            self.entries.append((key or 0, no_key | GOES_ON * (at > 0) | ENDS * (at + take == len(ids)), self.held))
            self.parts.append(ids[at:at + take])
            self.begun += at == 0
            self.held, at = self.held + take, at + take
            if self.held == self.size:
                yield self.close()

    def close(self) -> bytes:
        ids = np.concatenate(self.parts)
        words, offsets, places, escapes = simple8b.encode(ids)
        keys, flags, begins = zip(*self.entries, strict=True)
        body = b"".join((words.tobytes(), escapes.tobytes(), np.array(keys, np.int64).tobytes(), offsets.tobytes(), places.tobytes(),
                         np.array(begins, np.uint32).tobytes(), np.array(flags, np.uint8).tobytes()))
        size = -(-(HEAD.size + len(body) + 1) // 8) * 8  # with the line feed that the text writer puts after it
        head = HEAD.pack(MAGIC, size, self.shard, self.blocks, self.ids_before, self.docs_before, len(ids), len(words),
                         len(offsets), len(places), len(keys))
        self.ids_before, self.docs_before, self.blocks = self.ids_before + len(ids), self.docs_before + self.begun, self.blocks + 1
        self._open(0)
        return (head + body).ljust(size - 1, b"\0")


def _blocks(vocabulary: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer = part_coder(vocabulary), _Writer(TaskContext.get().partitionId(), size)
        for batch in batches:
            keys = iter(batch["doc_id"].to_pylist())
            for ids, ends in coder.chunks(batch["text"].cast(pa.string())):
                ids = np.insert(ids, ends, np.uint32(end_id))
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                for begin, end in zip([0, *ends], ends):
                    for block in writer.add(next(keys), ids[begin:end]):
                        yield _row(block)
        if writer.held:
            yield _row(writer.close())
    return run


def _row(block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"data": pa.array([block], pa.binary())})


def write_ids(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", vocabulary: str | None = None,
              end_id: int = END_ID, block: int = BLOCK, blocks_per_file: int = BLOCKS_PER_FILE) -> None:
    """Encode every text and write the ids, ``end_id`` after each document, in ascending order of the key.

    The key is an integer; rows without one come first, rows that repeat one are ordered by text. A shard is a
    range of keys; its task encodes row after row, so that no table of ids stands between. Blocks of ``block`` ids
    cut long documents; a file takes ``blocks_per_file`` of them, so that files are bounded however long the texts
    of a range are. A block holds Simple-8b words, the offset of every 256th, escapes and a directory of
    (key, flags, begin), and is a multiple of eight bytes long; Spark's text writer puts it down, whose line feed
    is the block's last byte. Null and empty texts have the end id only. An empty table writes no blocks. Other
    columns are not read.
    """
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    ranged = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    (ranged.mapInArrow(_blocks(vocabulary or default_vocabulary(), end_id, block), "data binary")
     .select(F.col("data").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", blocks_per_file).text(path))


class Block:
    """A block of a file: its head and directory, and its ids, whole or from any place to any other."""

    def __init__(self, data: memoryview) -> None:
        magic, self.bytes, self.shard, self.number, self.ids_before, self.docs_before, self.n, *counts = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no block of token ids")
        words, offsets, escapes, entries = counts
        at, parts = HEAD.size, []
        for kind, count in ((np.uint64, words), (np.uint64, escapes), (np.int64, entries), (np.uint32, offsets),
                            (np.uint32, escapes), (np.uint32, entries), (np.uint8, entries)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.words, self.escapes, self.keys, self.offsets, self.places, self.begins, self.flags = parts

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        return simple8b.decode(self.words, self.offsets, self.places, self.escapes, begin, self.n if end is None else end)

    def pieces(self) -> dict[str, pa.Array]:
        """A row per document of the block, with the part of it that lies here."""
        goes_on = (self.flags & GOES_ON) > 0
        begins = self.begins.astype(np.int64)
        columns = {"shard": np.full(len(begins), self.shard, np.int32), "start": self.ids_before + begins,
                   "document": self.docs_before + np.cumsum(~goes_on) - 1, "doc_id": pa.array(self.keys, mask=(self.flags & NO_KEY) > 0),
                   "whole": ~goes_on & ((self.flags & ENDS) > 0), "n": np.diff(begins, append=self.n)}
        return {name: pa.array(column) for name, column in columns.items()}


def blocks_of(content: bytes | pa.Buffer) -> Iterator[Block]:
    view, at = memoryview(content), 0
    while at < len(view):
        block = Block(view[at:])
        yield block
        at += block.bytes


def _read(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                for block in blocks_of(content.as_buffer()):
                    parts = np.split(block.ids().astype("<u4"), block.begins[1:].astype(np.int64))
                    values = (pa.array([zlib.crc32(part) for part in parts], pa.int64()) if column == "crc32"
                              else pa.array([part.astype(np.int64) for part in parts], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_pydict(block.pieces() | {column: values})
    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, start, document, doc_id, whole, n, ids): a row for every block that a document has ids in.

    ``start`` counts the ids of the shard before the row and ``document`` its documents; ordered by shard and start
    the rows give all ids. A task holds one file, which the writer bounds. A folder without blocks gives no rows.
    """
    return _files(spark, path).mapInArrow(_read("ids"), f"{PIECES}, ids array<long>")


_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; the highest bit stands for 1."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return product


def joined_crc32(first: int, second: int, size: int) -> int:
    """The CRC-32 of bytes followed by ``size`` others, from the CRC-32 of each."""
    shift, power = 1 << 31, 1 << 23  # 1, and x to the 8th
    while size:
        if size & 1:
            shift = _times(shift, power)
        power, size = _times(power, power), size >> 1
    return _times(shift, first) ^ second


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums = []
        for parts in batch.pop("parts"):
            crc = 0
            for part in parts:
                crc = joined_crc32(crc, part["crc32"], 4 * part["n"])
            sums.append(crc)
        yield batch.assign(ids_crc32=sums)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), a row per document, from the files alone.

    Files are decoded block by block; sums of documents that lie in several blocks are joined. ``start`` is the
    document's place among the ids of all files.
    """
    pieces = materialize(_files(spark, path).mapInArrow(_read("crc32"), f"{PIECES}, crc32 long"))
    shards = pieces.groupBy(F.col("shard").alias("s")).agg(F.sum("n").alias("ids"))
    before = shards.select("s", F.coalesce(F.sum("ids").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    one = pieces.filter("whole").select("shard", "doc_id", "start", "n", F.col("crc32").alias("ids_crc32"))
    cut = (pieces.filter("not whole").groupBy("shard", "document")
           .agg(F.max("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n"),
                F.sort_array(F.collect_list(F.struct("start", "n", "crc32"))).alias("parts"))
           .select("shard", "doc_id", "start", "n", "parts")
           .mapInPandas(_joined, "shard int, doc_id long, start long, n long, ids_crc32 long"))
    return (one.unionByName(cut).join(F.broadcast(before), F.col("shard") == F.col("s"))
            .select("doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32"))


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the ids of all documents to a new folder and sum up what the files hold."""
    path = new_folder(docs.sparkSession, "ids")
    write_ids(docs, path, text, key)
    return summaries(docs.sparkSession, path)
