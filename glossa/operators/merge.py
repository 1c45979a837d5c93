"""Merging declarations from several sources, and keeping the right one of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How declarations of a kind merge, whoever declares them; `module flag` depends on both sides. Fixed values.
RULES = {
    "method": "add_if_absent", "constant": "add_if_absent", "type_params": "add_if_absent", "dirty_pattern": "add_if_absent", "superclass": "add_if_absent",
    "mixin": "append_dedup", "ivar": "append_dedup",
}
USER_SOURCE = "ruby_source"


def merge_rule(source: Column, declaration: Column, user_defined: Column) -> Column:
    """The rule for a declaration: an external source may not change whether a user's class is a module."""
    table = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    return F.when(declaration == "is_module", F.when(user_defined & (source != USER_SOURCE), "keep_existing").otherwise("override")).otherwise(table[declaration])


def merge_declarations(rows: DataFrame) -> DataFrame:
    """One pass over declarations (class, declaration, key, value, source, user_defined, ord) in the order of ord.

    add_if_absent and keep_existing: the first of a key stays; append_dedup: each value once, where it came first; override: the last.
    The first row of a key always stays in some form, as there is nothing to keep before it.
    """
    ruled = rows.withColumn("rule", merge_rule(F.col("source"), F.col("declaration"), F.col("user_defined")))
    key = ["class", "declaration", "key"]
    appended = ruled.filter("rule = 'append_dedup'").groupBy(*key, "value").agg(F.min("ord").alias("ord"), F.min_by("source", "ord").alias("source"))
    single = ruled.filter("rule <> 'append_dedup'").groupBy(*key).agg(
        F.min(F.struct("ord", "value", "source")).alias("first"), F.max(F.when(F.col("rule") == "override", F.struct("ord", "value", "source"))).alias("last")
    )
    kept = F.coalesce(F.when(F.col("declaration") == "is_module", F.col("last")), F.col("first"))
    single = single.select(*key, kept.alias("k")).select(*key, "k.value", "k.ord", "k.source")
    return appended.select(*key, "value", "ord", "source").unionByName(single)


def merge_preserving_user(external: DataFrame, user: DataFrame, key: list[str]) -> DataFrame:
    """All user declarations, and the external ones whose key no user declaration has."""
    return user.unionByName(external.join(user.select(*key).distinct(), key, "left_anti"))


def drop_external(methods: DataFrame, classes: DataFrame, origins: list[str]) -> DataFrame:
    """methods without those of some classes that came from external origins (before a reload)."""
    gone = classes.select("class").distinct().withColumn("gone", F.lit(True))
    marked = methods.join(gone, "class", "left")
    return marked.filter(~(F.coalesce("gone", F.lit(False)) & F.col("origin").isin(origins))).drop("gone")


def last_declarations(methods: DataFrame) -> DataFrame:
    """Of methods with one name the last stays, in the order of declaration."""
    last = Window.partitionBy("class", "name", "singleton").orderBy(F.desc("ord"))
    return methods.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")


def last_keywords(arguments: DataFrame) -> DataFrame:
    """site_id, keyword, type: of repeated keywords the last counts."""
    return arguments.filter("keyword IS NOT NULL").groupBy("site_id", "keyword").agg(F.max_by("type", "pos").alias("type"))


def file_facts(facts: DataFrame, file: str) -> DataFrame:
    return facts.filter(F.col("file") == file)


def enabled(automatic: Column, on: Column, off: Column) -> Column:
    """Libraries found and forced on, without those forced off."""
    return F.array_sort(F.array_except(F.array_union(automatic, on), off))


def apply_spec(spec: Column) -> Column:
    """struct(automatic, on, off) of "auto,+x,-y", read from left to right: the last sign of a library counts; "none" drops the automatic ones."""
    tokens = F.filter(F.transform(F.split(spec, ","), lambda t: F.trim(t)), lambda t: t != "")
    name = lambda t: F.regexp_replace(t, "^[+-]", "")
    last = F.filter(tokens, lambda t, i: ~F.exists(F.slice(tokens, i + 2, F.size(tokens)), lambda later: name(later) == name(t)))
    return F.struct(
        (~F.array_contains(tokens, "none")).alias("automatic"),
        F.transform(F.filter(last, lambda t: ~t.startswith("-") & ~t.isin("auto", "none")), name).alias("on"),
        F.transform(F.filter(last, lambda t: t.startswith("-")), name).alias("off"),
    )
