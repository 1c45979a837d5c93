"""What is known at a point where control flows join: facts of both ways, merged. Column expressions throughout.

A state that can't be reached (dead) changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.columns import union_pair


def join_block_states(a: Column, b: Column) -> Column:
    """struct(must, may, always, never, dead): what surely happened on both ways, what may have on either."""
    live = F.struct(
        F.array_sort(F.array_intersect(a.must, b.must)).alias("must"), F.array_sort(F.array_union(a.may, b.may)).alias("may"), (a.always & b.always).alias("always"), (a.never & b.never).alias("never"), F.lit(False).alias("dead")
    )
    return F.when(a.dead, b).when(b.dead, a).otherwise(live)


def join_element_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    """local, min_size, truthy: sizes that arrays have at least on both ways, and the indexes that are truthy on both."""
    met = a.join(b.select("local", F.col("min_size").alias("s"), F.col("truthy").alias("t")), "local")
    return met.select("local", F.least("min_size", "s").alias("min_size"), F.array_sort(F.array_intersect("truthy", "t")).alias("truthy")).filter("min_size > 0 OR size(truthy) > 0")


def join_key_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    """local, keys, complete: keys that a hash has on both ways; complete only if both say so of the same keys."""
    met = a.join(b.select("local", F.col("keys").alias("k"), F.col("complete").alias("c")), "local")
    same = F.array_sort("keys") == F.array_sort("k")
    return met.select("local", F.array_sort(F.array_intersect("keys", "k")).alias("keys"), (F.col("complete") & F.col("c") & same).alias("complete"))


def join_receiver_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    """local, class, attribute, type: attributes of receivers that nothing else holds, known on both ways; types are joined pairwise."""
    met = a.join(b.withColumnRenamed("type", "other"), ["local", "class", "attribute"])
    return met.select("local", "class", "attribute", union_pair("type", "other").alias("type"))


def self_effects(own: DataFrame, calls: DataFrame, reach) -> DataFrame:
    """class, method, ivars, opaque: instance variables that a method or what it calls on itself writes.

    own: class, method, ivars, opaque; calls: class, method, callee; reach: the closure of glossa.plans.fixpoint.
    """
    node = lambda m: F.concat_ws("#", "class", m)
    edges = calls.select(node("method").alias("src"), node("callee").alias("dst"))
    found = reach(own.select(node("method").alias("root")), edges)
    facts = own.select(node("method").alias("node"), "ivars", "opaque")
    # a callee that nothing describes may do anything
    met = found.join(facts, "node", "left")
    by = met.groupBy("root").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("ivars", F.array().cast("array<string>")))))).alias("ivars"), F.max(F.coalesce("opaque", F.lit(True))).alias("opaque"))
    return by.select(F.substring_index("root", "#", 1).alias("class"), F.substring_index("root", "#", -1).alias("method"), "ivars", "opaque")
