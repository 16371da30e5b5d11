"""Connected components of an edge table as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Alternates two steps until the edge set stands still: each node links its larger neighbours, then its smaller
    ones, to the smallest node it knows. Every step is a min aggregation (combined before the shuffle, so that a hub
    is no burden) and an equi join; each round is written to the shared folder, which cuts lineage. Nulls and
    self-links are dropped; an empty table gives an empty result. Raises if MAX_ROUNDS pass without an end.
    """
    spark = scratch.spark
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = scratch.keep(now, f"{name}_0")
    state = _state(now)
    for n in range(1, MAX_ROUNDS + 1):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = scratch.keep(small, f"{name}_{n}")
        scratch.drop(f"{name}_{n - 1}")
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    del spark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
