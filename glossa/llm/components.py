"""Connected components by alternating large-star and small-star steps on shared tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours are hung on the least node they meet. edges: a > b, distinct."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the least node of its component) for every node but the roots. edges: a, b (64-bit)."""
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc_0")
    state = None
    for k in itertools.count(1):  # ends, as every round hangs some node lower
        now = scratch.table(_star(_star(now, True), False), f"cc_{k}")
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"cc_{k - 1}")
        if state == tuple(found):
            break
        state = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
