"""Prefix trie of conversations: sorted shards finish their own nodes, those on paths of splitters are reduced."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.columns import materialize, text_or_empty

KEY = 16  # bytes of a turn in a path
SHARD_TURNS = 200_000
SAMPLED = 20  # conversations per shard from which splitters are chosen
SPLITTER_BYTES = 8_000_000
ENDS = 512  # conversation numbers in a row of ends

NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FOUND = f"{NODE}, above int, node int, shard int, part int, ends binary"


def paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, keys, sizes): for each conversation in order the MD5 of every turn's role and text, and the text's code points.

    Turns come in order of ``turn``, null first; equal ones in order of role, length and MD5. Null role and text are
    empty. Rows without a conversation belong to none. Texts are not shuffled: a turn takes 16 bytes and its length.
    """
    said, spoken = text_or_empty(F.col(text)), text_or_empty(F.col(role).cast("string"))
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), spoken.alias("role"), F.length(said).alias("size"),
                 F.md5(F.concat(F.octet_length(spoken).cast("string"), F.lit(":"), spoken, said)).alias("key")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.size").alias("sizes"))


def rebuilt(own: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations of ``paths`` whose first h turns are those of the conversation that begins their group of ``group``.

    h is the CRC-32 of the decimal number modulo ``heads``. A conversation that begins no table row lends no turns; one
    that has no more than h turns of its own adds none. (conv_id, path, sizes); keys are joined to binary paths.
    """
    own = materialize(own)
    first = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("keys", 1, heads - 1).alias("base_keys"), F.slice("sizes", 1, heads - 1).alias("base_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.withColumn("h", h).join(first, F.col("conv_id") - F.col("conv_id") % group == F.col("base"), "left")

    def whole(mine: str, lent: str):
        rest = F.slice(mine, F.col("h") + 1, F.greatest(F.size(mine) - F.col("h"), F.lit(0)))
        return F.when(F.col(lent).isNull(), rest).otherwise(F.concat(F.slice(lent, F.lit(1), F.col("h")), rest))

    return joined.select("conv_id", F.unhex(F.array_join(whole("keys", "base_keys"), "")).alias("path"), whole("sizes", "base_sizes").alias("sizes"))


def _splitters(convs: DataFrame, shards: int, most_bytes: int) -> list[tuple[bytes, int]]:
    """Up to shards - 1 (path, conv_id) that part the conversations into about equal shares of turns, ``most_bytes`` together."""
    sample = (convs.select("conv_id", "path").orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLED * shards)
              .withColumn("size", F.octet_length("path")))
    sample = materialize(sample)
    size = sample.agg(F.sum("size")).first()[0] or 0
    if size > SAMPLED * most_bytes:  # paths so long that the sample itself must be thinned out
        sample = sample.filter(F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(size // (SAMPLED * most_bytes) + 1)) == 0)
    rows = sorted((bytes(r["path"]), r["conv_id"]) for r in sample.select("path", "conv_id").toLocalIterator())
    if not rows:
        return []
    load = np.cumsum([KEY + len(path) for path, _ in rows])
    at = np.unique(np.searchsorted(load, load[-1] * np.arange(1, shards) / shards))
    chosen = [rows[i] for i in at if i > 0]
    while len(chosen) > 1 and sum(len(path) + KEY for path, _ in chosen) > most_bytes:
        chosen = chosen[1::2]
    return chosen


class Skeleton:
    """The trie of the splitters' paths, numbered in order of the paths; node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]) -> None:
        self.splitters, self.parents, self.depths, self.lines = splitters, [-1], [0], []
        line, before = [0], b""
        for path, _ in splitters:
            line = line[:_common(before, path) + 1]
            for depth in range(len(line), len(path) // KEY + 1):
                self.parents.append(line[-1])
                self.depths.append(depth)
                line.append(len(self.parents) - 1)
            self.lines.append(np.array(line, np.int32))
            before = path

    def near(self, shard: int) -> list[tuple[bytes, np.ndarray]]:
        """The splitters on both sides of a shard with the nodes of their paths: no other skeleton node has members in it."""
        return [(self.splitters[i][0], self.lines[i]) for i in (shard - 1, shard) if 0 <= i < len(self.splitters)]


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * KEY:middle * KEY] == b[low * KEY:middle * KEY]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    __slots__ = ("ends", "first", "held", "leaves", "members", "node", "saved", "size", "children")

    def __init__(self, node: int, size: int) -> None:
        self.node, self.size = node, size  # node: number in the skeleton, -1 of others
        self.first, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = [] if node >= 0 else None
        self.held: list[list] = []


class _Shard:
    """Goes through the sorted conversations of a shard and yields rows as nodes end."""

    def __init__(self, shard: int, skeleton: Skeleton) -> None:
        self.shard, self.near = shard, skeleton.near(shard)
        self.stack, self.path, self.part = [_Node(0, 0)], b"", 0
        self.rows: list[tuple] = []

    def add(self, conv: int, path: bytes, sizes: np.ndarray) -> None:
        self._close(_common(self.path, path) + 1)
        depth = len(self.stack)
        line = max(((_common(path, p), nodes) for p, nodes in self.near), key=lambda x: x[0], default=(0, np.zeros(1, np.int32)))
        for d in range(depth, len(path) // KEY + 1):
            self.stack.append(_Node(int(line[1][d]) if d <= line[0] else -1, int(sizes[d - 1])))
        self.path = path
        top = self.stack[-1]
        top.members += 1
        top.first = conv if top.first is None else min(top.first, conv)
        if top.node < 0:
            if top.ends is None:
                top.ends = hashlib.sha256(str(conv).encode())
            else:
                top.ends.update(b",%d" % conv)
        else:
            top.ends.append(conv)
            if len(top.ends) == ENDS:
                self._hand_over(top)

    def _hand_over(self, top: _Node) -> None:
        self.rows.append((None,) * 8 + (None, top.node, self.shard, self.part, b",".join(b"%d" % c for c in top.ends)))
        self.part, top.ends = self.part + 1, []

    def _close(self, depth: int) -> None:
        """Ends all nodes from ``depth`` on."""
        while len(self.stack) > depth:
            top = self.stack.pop()
            if top.node >= 0:
                self._partial(top, len(self.stack))
                continue
            above = self.stack[-1]
            top.leaves = top.leaves or 1
            top.saved += (top.members - 1) * top.size
            done = [top.first, len(self.stack), None, top.members, top.children, top.leaves, top.saved,
                    (top.ends or hashlib.sha256()).hexdigest(), None]
            for child in top.held:
                child[2] = top.first
                self.rows.append((*child, None, self.shard, None, None))
            if above.node >= 0:
                done[8] = above.node
                self.rows.append((*done, None, self.shard, None, None))
            else:
                above.held.append(done)
            above.first = top.first if above.first is None else min(above.first, top.first)
            above.members, above.children = above.members + top.members, above.children + 1
            above.leaves, above.saved = above.leaves + top.leaves, above.saved + top.saved

    def _partial(self, top: _Node, depth: int) -> None:
        if top.ends:
            self._hand_over(top)
        if top.members:
            self.rows.append((top.first, depth, None, top.members, top.children, top.leaves, top.saved, None, None, top.node, self.shard, None, None))

    def close(self) -> None:
        self._close(0)

    def taken(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")], dtype=object)


def _shards(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for batch in batches:
            for conv, path, sizes, shard in zip(batch["conv_id"], batch["path"], batch["sizes"], batch["shard"], strict=True):
                if at is None or at.shard != shard:
                    if at is not None:
                        at.close()
                        yield at.taken()
                    at = _Shard(shard, shared.value)
                at.add(conv, path, sizes)
                if len(at.rows) >= 10_000:
                    yield at.taken()
        if at is not None:
            at.close()
            yield at.taken()
    return run


def _dealt(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitters = shared.value.splitters
        for batch in batches:
            yield batch.assign(shard=[bisect_right(splitters, (path, conv)) for path, conv in zip(batch["path"], batch["conv_id"], strict=True)])
    return run


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's ends, whose rows come one after another."""
    node, told = None, None
    for batch in batches:
        out = []
        for at, ends in zip(batch["node"], batch["ends"], strict=True):
            if at == node:
                told.update(b"," + ends)
            else:
                if node is not None:
                    out.append((node, told.hexdigest()))
                node, told = at, hashlib.sha256(ends)
        yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, told.hexdigest())], columns=["node", "ends_sha256"])


def _reduced(partial: pd.DataFrame, skeleton: Skeleton, sizes: np.ndarray) -> pd.DataFrame:
    """Whole figures of all skeleton nodes: what shards found below them, added up along the paths."""
    parents, count = np.array(skeleton.parents), len(skeleton.parents)
    own = np.zeros((4, count), np.int64)  # members, children, leaves, saved
    first = np.full(count, np.iinfo(np.int64).max)
    nodes = partial["node"].to_numpy()
    for i, column in enumerate(("members", "children", "leaves", "saved")):
        own[i, nodes] = partial[column].to_numpy(np.int64)
    first[nodes] = partial["first"].to_numpy(np.int64)
    members, children, leaves, saved = own
    children = children + np.bincount(parents[1:], minlength=count)
    leaves = leaves + (children == 0)
    for node in range(count - 1, 0, -1):  # a child's number is above its parent's
        saved[node] += (members[node] - 1) * sizes[node]
        above = parents[node]
        members[above] += members[node]
        leaves[above] += leaves[node]
        saved[above] += saved[node]
        first[above] = min(first[above], first[node])
    return pd.DataFrame({"node": np.arange(count, dtype=np.int32), "conv_id": first, "depth": np.array(skeleton.depths, np.int32),
                         "above": first[np.maximum(parents, 0)], "n_convs": members,
                         "n_children": children, "n_leaves": leaves, "saved_tokens": saved})


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS, splitter_bytes: int = SPLITTER_BYTES) -> DataFrame:
    """One row per node of the prefix trie of (conv_id, path, sizes): figures of its members and of its subtree.

    conv_id is the smallest member and parent_conv_id the parent's; n_convs counts members, n_children and n_leaves
    nodes; saved_tokens adds up, over the subtree, what members after the first would repeat of the node's last text.

    Splitters part the conversations, in order of (path, conv_id), into shards, also within a group of equal ones.
    Only prefixes of splitters can have members in several shards. This skeleton, held under ``splitter_bytes`` by
    taking fewer splitters, is broadcast; a shard finishes all its other nodes in one pass and hands over what it
    found directly below each skeleton node, which is added up by node and then along the paths. A node's conversation
    numbers go in rows of 512, shard after shard, through one hash, as SHA-256 is sequential.

    A conversation is a row of 16 bytes and a length per turn; one without turns ends in the root. Repeated numbers
    are members each. No conversations give no rows, not even a root.
    """
    spark = convs.sparkSession
    convs = materialize(convs)
    total = convs.agg(F.count("*"), F.sum(F.size("sizes"))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ((total[0] or 0) + (total[1] or 0)) // shard_turns + 1)
    skeleton = Skeleton(_splitters(convs, shards, splitter_bytes) if shards > 1 else [])
    shared = spark.sparkContext.broadcast(skeleton)
    fields = "conv_id long, path binary, sizes array<int>"
    dealt = convs.mapInPandas(_dealt(shared), f"{fields}, shard int")
    found = materialize(dealt.repartitionById(len(skeleton.splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
                        .mapInPandas(_shards(shared), FOUND))
    if not total[0]:
        return found.select(*_columns())
    partial = (found.filter("node is not null and ends is null").groupBy("node").agg(
        F.min("conv_id").alias("first"), F.sum("n_convs").alias("members"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).toPandas())
    rows = spark.createDataFrame(_reduced(partial, skeleton, _last_sizes(convs, skeleton)),
                                 "node int, conv_id long, depth int, above long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    rows = rows.withColumn("parent_conv_id", F.when(F.col("node") > 0, F.col("above"))).drop("above")
    ends = (found.filter("ends is not null").select("node", "shard", "part", "ends").repartition(F.col("node"))
            .sortWithinPartitions("node", "shard", "part").select("node", "ends").mapInPandas(_ends, "node int, ends_sha256 string"))
    top = rows.join(ends.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    below = rows.select(F.col("node").alias("n"), F.col("conv_id").alias("c"))
    local = (found.filter("node is null").join(F.broadcast(below), F.col("above") == F.col("n"), "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "c")))
    return local.select(*_columns()).unionByName(top.select(*_columns()))


def _columns() -> list:
    return [F.col(c.split()[0]).cast("long") if c.split()[0] == "depth" else F.col(c.split()[0]) for c in NODE.split(", ")]


def _last_sizes(convs: DataFrame, skeleton: Skeleton) -> np.ndarray:
    """Code points of the last text of every skeleton node, from the splitters' own rows."""
    sizes = np.zeros(len(skeleton.parents), np.int64)
    if skeleton.splitters:
        wanted = convs.sparkSession.createDataFrame([(c,) for _, c in skeleton.splitters], "c long").distinct()
        lines = {(path, c): line for (path, c), line in zip(skeleton.splitters, skeleton.lines, strict=True)}
        for row in convs.join(F.broadcast(wanted), F.col("conv_id") == F.col("c")).select("conv_id", "path", "sizes").toLocalIterator():
            line = lines.get((bytes(row["path"]), row["conv_id"]))
            if line is not None:
                sizes[line[1:]] = row["sizes"]
    return sizes


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    return trie(rebuilt(paths(turns)))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), length(coalesce(text, '')),
           md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, sha256(list([role, text]) OVER w::VARCHAR) AS path, length(text) AS size
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
m AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS size FROM c UNION ALL SELECT * FROM p),
n AS (SELECT depth, path, min(conv_id) AS first, count(*) AS n_convs, any_value(size) AS size FROM m GROUP BY depth, path),
e AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
f AS (SELECT depth, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM m JOIN e USING (conv_id, depth) GROUP BY depth, path),
up AS (SELECT DISTINCT x.depth, x.path, y.depth AS above_depth, y.path AS above FROM m x JOIN m y ON x.conv_id = y.conv_id AND y.depth <= x.depth),
k AS (SELECT above_depth AS depth, above AS path, count(*) AS n_children FROM up WHERE above_depth = depth - 1 GROUP BY 1, 2),
s AS (
  SELECT up.above_depth AS depth, up.above AS path, count(*) FILTER (k.n_children IS NULL) AS n_leaves,
         sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM up JOIN n ON n.depth = up.depth AND n.path = up.path LEFT JOIN k ON k.depth = up.depth AND k.path = up.path GROUP BY 1, 2)
SELECT n.first AS conv_id, n.depth::BIGINT AS depth, q.first AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       s.saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM n JOIN s USING (depth, path) LEFT JOIN k USING (depth, path) LEFT JOIN f USING (depth, path)
LEFT JOIN up ON up.depth = n.depth AND up.path = n.path AND up.above_depth = n.depth - 1
LEFT JOIN n q ON q.depth = up.above_depth AND q.path = up.above
"""
