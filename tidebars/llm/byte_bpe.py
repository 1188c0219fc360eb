"""Byte-level BPE by a local rank file: encode whole texts, decode ids to raw bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.columns import text_or_empty

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE = 1 << 16
#: Before one blank between ASCII letters or digits the pattern always begins a new match.
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str | None = None) -> tiktoken.Encoding:
    """The encoding of a rank file, once per worker; without special tokens."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text, cut only where the pattern begins a new match in any case."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str, coder: tiktoken.Encoding, size: int = PIECE) -> list[int]:
    if len(text) <= size:
        return coder.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, size):
        ids += coder.encode_ordinary(piece)
    return ids


def _coded(ranks: str, pattern: str | None, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(ranks, pattern)
        for batch in batches:
            for at in range(0, len(batch), 512):  # ids of a few texts at a time
                part = batch.iloc[at:at + 512]
                ids = [encode_text(text, coder, size) for text in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids, "decoded": [coder.decode_bytes(i) for i in ids]})
    return run


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", ranks: str | None = None,
           pattern: str | None = None, piece: int = PIECE) -> DataFrame:
    """key, ids array<int>, decoded binary (the bytes that the ids stand for), one row per input row.

    Null is the empty text, which has no ids and no bytes. Long texts are cut at blanks between ASCII letters
    or digits, where a match begins anyway; without such a place a text is encoded in one call. Only a batch of
    rows is held in a task; nothing is shuffled. Other columns are not read; null and repeated keys stay.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    out = rows.mapInPandas(_coded(ranks or default_ranks(), pattern, piece),
                           f"doc_id {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("doc_id", key) if key != "doc_id" else out


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens and the hashes of ids and decoded bytes."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
