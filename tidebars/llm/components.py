"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.columns import discard, materialize


FEW = 250_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every linked id and the smallest id that it reaches, itself included.

    Alternates two steps until nothing changes: every id hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. Each is an aggregate (combined on the map side) and an equi-join,
    so a node with very many links is never gathered in one place, and chains shrink by a factor a turn.
    Each turn is a written table, which cuts lineage and survives lost executors. Links are pairs of two
    different ids; repeated and reversed ones do no harm; no links give an empty result. Up to ``FEW`` links, of
    16 bytes each, are read as one partition and their aggregates broadcast, so that no step shuffles anything.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                        .filter("hi > lo").distinct())
    state = _state(edges)
    while True:
        few = state[0] <= FEW
        side = F.broadcast if few else _as_is
        if few:
            edges = edges.coalesce(1)
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("n")).agg(F.least(F.min("lo"), F.col("n")).alias("m"))
        large = (both.select(F.col("hi").alias("n"), F.col("lo").alias("v")).filter("v > n").join(side(least), "n")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest = large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m"))
        small = (large.select(F.col("hi").alias("n"), F.col("lo").alias("v")).join(side(lowest), "n").filter("v > m")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")))
        former, edges = edges, materialize(small.unionByName(lowest.select(F.col("n").alias("hi"), F.col("m").alias("lo"))).distinct())
        now = _state(edges)
        discard(former)
        if now == state:
            break
        state = now
    if few:
        edges = edges.coalesce(1)
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def _as_is(side: DataFrame) -> DataFrame:
    return side


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]
