"""Type coverage: how many sites and declarations are typed, untyped or unknown; type holes and their reasons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.udf import arrow
from glossa.functions import levels, terms
from glossa.operators.lookup import resolve_constants

SCHEMA_VERSION = 1


@arrow("int")
def type_level(t: pd.Series, scope: pd.Series, method: pd.Series) -> pd.Series:
    return pd.Series([levels.level(terms.loads(x), s or "", m) for x, s, m in zip(t, scope, method)], dtype="int32")


@arrow("int")
def call_level(receiver: pd.Series, result: pd.Series, scope: pd.Series, method: pd.Series) -> pd.Series:
    return pd.Series([levels.call_level(terms.loads(r), terms.loads(x), s or "", m) for r, x, s, m in zip(receiver, result, scope, method)], dtype="int32")


def folded(observations: Column) -> Column:
    """struct(kind, level) of a site's observations in order, as levels.fold has it. JVM-side, as a site may have any number of them."""
    state = lambda kind, now, stuck: F.struct(kind.alias("kind"), now.cast("int").alias("level"), stuck.alias("stuck"))
    explicit = lambda o: F.coalesce(o["explicit"], F.lit(False))

    def priority(kind: Column) -> Column:
        found = F.lit(0)
        for name, n in levels.PRIORITY.items():
            found = F.when(kind == name, n).otherwise(found)
        return found

    def step(s: Column, o: Column) -> Column:
        other = (o["level"] < s["level"]) | (o["level"] == s["level"]) & (priority(o["kind"]) > priority(s["kind"]))
        joined = F.when(o["kind"] == s["kind"], state(s["kind"], F.greatest(s["level"], o["level"]), F.lit(False)))
        joined = joined.otherwise(state(F.when(other, o["kind"]).otherwise(s["kind"]), F.least(s["level"], o["level"]), F.lit(False)))
        return F.when(explicit(o), state(F.lit("constant_reference"), F.lit(levels.UNKNOWN), F.lit(True))).when(s["stuck"], s).otherwise(joined)

    first = F.element_at(observations, 1)
    rest = F.slice(observations, F.lit(2), F.size(observations))
    return F.aggregate(rest, state(first["kind"], first["level"], explicit(first)), step)


def observed_levels(sites: DataFrame) -> DataFrame:
    """sites (file, start, end, ord, kind, name, type, receiver, scope, method, explicit) with their level.

    Values whose name looks like a constant are constant references, unknown while untyped. Empty spans don't count.
    """
    constant = F.substring_index("name", "::", -1).rlike(r"^\p{Lu}")
    kind = F.when((F.col("kind") == "value") & constant, "constant_reference").otherwise(F.col("kind"))
    rows = sites.filter("start < end").withColumn("kind", kind)
    plain = type_level("type", "scope", "method")
    level = (
        F.when(F.col("explicit"), 0).when(F.col("kind") == "method_call", call_level("receiver", "type", "scope", "method"))
        .when((F.col("kind") == "constant_reference") & F.col("type").isin('["untyped"]', '["todo"]'), 0).otherwise(plain)
    )
    return rows.withColumn("level", level)


def coalesced_sites(observed: DataFrame) -> DataFrame:
    """file, start, end, kind, level: one row for each span, folded in the order of observation."""
    by = observed.groupBy("file", "start", "end").agg(
        F.array_sort(F.collect_list(F.struct("ord", "kind", "level", "explicit"))).alias("o"), F.min_by("name", "ord").alias("name"), F.min_by("scope", "ord").alias("scope")
    )
    return by.withColumn("f", folded(F.col("o"))).select("file", "start", "end", "name", "scope", "f.kind", "f.level")


def promote_constants(sites: DataFrame, constants: DataFrame) -> DataFrame:
    """Unknown constant references judged again against the whole workspace. constants: path, level (classes: typed)."""
    rows = sites.withColumn("id", F.struct("file", "start", "end"))
    unknown = rows.filter("kind = 'constant_reference' AND level = 0")
    found = resolve_constants(unknown.select("id", "name", "scope"), constants.filter("level > 0")).join(constants, "path").select("id", F.col("level").alias("now"))
    return rows.join(found, "id", "left").withColumn("level", F.coalesce("now", "level")).drop("id", "now")


def declaration_sites(methods: DataFrame, params: DataFrame, ivars: DataFrame) -> DataFrame:
    """kind, level of declared slots of user classes: parameters, returns, instance variables (the least of their types)."""
    own = methods.filter(~F.col("origin").isin("rbs_file", "rbi", "synthetic_dsl"))
    none = F.lit(None).cast("string")
    given = params.join(own.select("class", "name", "singleton").distinct(), ["class", "name", "singleton"], "left_semi")
    slots = given.select(F.lit("method_parameter").alias("kind"), F.when(F.col("type").isNull(), 0).otherwise(type_level("type", "class", "name")).alias("level"))
    returns = own.select(F.lit("method_return").alias("kind"), F.when(F.col("ret").isNull(), 0).otherwise(type_level("ret", "class", "name")).alias("level"))
    held = ivars.withColumn("l", type_level("type", "class", none)).groupBy("class", "ivar").agg(F.coalesce(F.min("l"), F.lit(1)).alias("level"))
    return slots.union(returns).union(held.select(F.lit("instance_variable").alias("kind"), "level"))


def counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """total, typed, untyped, unknown and both percentages (0 of nothing is 0)."""

    def share(part):
        return F.when(F.col("total") == 0, 0.0).otherwise(part * 100.0 / F.col("total"))

    n = [F.count_if(F.col("level") == k).alias(name) for k, name in levels.NAMES.items()]
    found = rows.groupBy(*by).agg(F.count("level").alias("total"), *n)
    return found.withColumn("type_coverage_percent", share(F.col("typed"))).withColumn("tracking_coverage_percent", share(F.col("typed") + F.col("untyped")))


def report(references: DataFrame, declarations: DataFrame, discovered: int, analyzed: int) -> DataFrame:
    """One row with the JSON report."""
    columns = ["total", "typed", "untyped", "unknown", "type_coverage_percent", "tracking_coverage_percent"]
    kinds = counts(references.select("kind", "level").unionByName(declarations), ["kind"])
    by_kind = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.struct(*columns))))).alias("by_kind"))
    one = [counts(x, []).select(F.struct(*columns).alias(name)) for x, name in ((declarations, "declarations"), (references, "references"))]
    row = by_kind.crossJoin(F.broadcast(one[0])).crossJoin(F.broadcast(one[1]))
    files = F.struct(F.lit(discovered).alias("discovered"), F.lit(analyzed).alias("analyzed")).alias("files")
    return row.select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), files, "declarations", "references", "by_kind")).alias("value"))


# holes


@arrow("string")
def hole_reason(t: pd.Series, annotated: pd.Series) -> pd.Series:
    return pd.Series([levels.hole_reason(terms.loads(x), bool(a)) for x, a in zip(t, annotated)], dtype="object")


@arrow("boolean")
def has_hole(t: pd.Series) -> pd.Series:
    return t.map(lambda x: levels.has_hole(terms.loads(x)))


def type_holes(methods: DataFrame, params: DataFrame, ivars: DataFrame) -> DataFrame:
    """file, class, member, slot, kind, reason, type of declared types with holes, in canonical order."""
    none = F.lit(None).cast("string")
    held = ivars.filter(has_hole("type")).select("file", "class", F.col("ivar").alias("member"), none.alias("slot"), F.lit("instance_variable").alias("kind"), hole_reason("type", F.lit(False)).alias("reason"), "type")
    back = methods.filter(has_hole("ret")).select("file", "class", F.col("name").alias("member"), none.alias("slot"), F.lit("method_return").alias("kind"), hole_reason("ret", "annotated").alias("reason"), F.col("ret").alias("type"))
    noted = params.join(methods.select("class", "name", "singleton", "file", "annotated"), ["class", "name", "singleton"]).filter(has_hole("type"))
    why = F.when(F.col("annotated") & (F.col("type") == '["untyped"]'), "explicit_untyped").when(F.col("kind") != "block", "missing_call_site").otherwise(hole_reason("type", "annotated"))
    taken = noted.select("file", "class", F.col("name").alias("member"), F.col("pname").alias("slot"), F.lit("method_parameter").alias("kind"), why.alias("reason"), "type")
    return held.union(back).union(taken).orderBy(F.asc_nulls_first("file"), "class", "member", F.asc_nulls_first("slot"))


def hole_counts(holes: DataFrame, by: str) -> DataFrame:
    """by: kind or reason."""
    return holes.groupBy(by).agg(F.count("*").alias("n"))
