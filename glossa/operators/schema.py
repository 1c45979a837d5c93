"""Methods that a database schema gives to model classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import inflect, terms
from glossa.functions.columns import nullable_accessor

BOOL = terms.dumps(terms.BOOL)


def model_classes(tables: DataFrame, models: DataFrame | None = None, project: inflect.Inflections = inflect.NONE) -> DataFrame:
    """table, class: the namespaced name if that model exists (models: class), else the flat one."""
    named = tables.select("table").distinct().withColumn("flat", inflect.classify(F.col("table"), project)).withColumn("spaced", inflect.namespaced_class(F.col("table"), project))
    if models is None:
        return named.select("table", F.col("flat").alias("class"))
    known = models.select(F.col("class").alias("spaced")).distinct().withColumn("there", F.lit(True))
    return named.join(known, "spaced", "left").select("table", F.when(F.col("there"), F.col("spaced")).otherwise(F.col("flat")).alias("class"))


def table_models(models: DataFrame) -> DataFrame:
    """table, class of models. models: class, superclass, table_name (null: computed from the class and its namespace).

    A model whose superclass is a model with a table of its own shares that table (single table inheritance).
    """
    parts = F.split("class", "::")
    own = inflect.pluralize(inflect.underscore(F.element_at(parts, -1)))
    prefix = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), inflect.underscore)
    computed = F.when(F.size(parts) > 1, F.concat(F.array_join(prefix, "_"), F.lit("_"), own)).otherwise(own)
    named = models.withColumn("own", F.coalesce("table_name", computed))
    parents = named.select(F.col("class").alias("superclass"), F.col("own").alias("parent_table"))
    return named.join(parents, "superclass", "left").select("class", F.coalesce(F.when(F.col("table_name").isNull(), F.col("parent_table")), "own").alias("table"))


def associations(keys: DataFrame, columns: DataFrame, classes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """table, name, target_class, nullable of foreign keys; a column that is missing counts as nullable."""
    if overrides is not None:
        only = overrides.groupBy("table").agg(F.count("*").alias("n"), F.first("class").alias("one")).filter("n = 1").select("table", "one")
        classes = classes.join(only, "table", "left").select("table", F.coalesce("one", "class").alias("class"))
    nulls = columns.groupBy("table", "column").agg(F.min_by("nullable", "pos").alias("nullable"))
    targets = classes.select(F.col("table").alias("references"), F.col("class").alias("target_class"))
    defined = columns.select("table").distinct()
    found = keys.join(defined, "table", "left_semi").join(nulls, ["table", "column"], "left").join(targets, "references", "left")
    flat = F.coalesce("target_class", inflect.classify(F.col("references")))
    return found.select("table", "pos", F.regexp_replace("column", "_id$", "").alias("name"), flat.alias("target_class"), F.coalesce("nullable", F.lit(True)).alias("nullable"))


def accessors(columns: DataFrame, classes: DataFrame, links: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """class, name, param, ret, ord: reader, writer and predicate of each column, reader and writer of each association.

    The first method of a name stays; methods that exist (class, name) are not added.
    """
    typed = columns.join(classes, "table").withColumn("type", nullable_accessor(F.col("type"), F.col("nullable")))
    rows = typed.select("class", "pos", F.col("column").alias("base"), "type", F.lit(0).alias("late"))
    if links is not None:
        target = F.concat(F.lit('["class","'), F.col("target_class"), F.lit('"]'))
        linked = links.join(classes, "table").withColumn("type", nullable_accessor(target, F.col("nullable")))
        rows = rows.unionByName(linked.select("class", "pos", F.col("name").alias("base"), "type", F.lit(1).alias("late")))
    none = F.lit(None).cast("string")
    made = F.array(
        F.struct(F.col("base").alias("name"), none.alias("param"), F.col("type").alias("ret"), F.lit(0).alias("k")),
        F.struct(F.concat("base", F.lit("=")).alias("name"), F.col("type").alias("param"), F.col("type").alias("ret"), F.lit(1).alias("k")),
        F.struct(F.concat("base", F.lit("?")).alias("name"), none.alias("param"), F.lit(BOOL).alias("ret"), F.lit(2).alias("k")),
    )
    rows = rows.select("class", "pos", "late", F.explode(F.when(F.col("late") == 1, F.slice(made, 1, 2)).otherwise(made)).alias("m")).select("class", "late", "pos", "m.*")
    first = Window.partitionBy("class", "name").orderBy("late", "pos", "k")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    if existing is not None:
        rows = rows.join(existing.select("class", "name").distinct(), ["class", "name"], "left_anti")
    return rows.select("class", "name", "param", "ret", (F.col("late") * F.lit(1 << 40) + F.col("pos") * 4 + F.col("k")).alias("ord"))


#: Names of methods that track an attribute's changes: (before, after, nullable result, kind). Fixed values.
DIRTY = [
    ("", "_changed?", "bool"), ("", "_change", "pair"), ("", "_was", "value"), ("", "_will_change!", "untyped"), ("", "_previously_changed?", "bool"),
    ("", "_previous_change", "pair"), ("", "_previously_was", "value"), ("restore_", "!", "untyped"), ("clear_", "_change", "untyped"),
    ("saved_change_to_", "?", "bool"), ("saved_change_to_", "", "pair"), ("", "_before_last_save", "value"), ("will_save_change_to_", "?", "bool"),
    ("", "_change_to_be_saved", "pair"), ("", "_in_database", "value"),
]


def dirty_methods(columns: DataFrame, classes: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """class, name, ret of change tracking methods. used: (class, name) that are referenced; only those are made."""
    shapes = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k")) for a, b, k in DIRTY])
    rows = columns.join(classes, "table").select("class", "column", "type", F.explode(shapes).alias("s"))
    value = nullable_accessor(F.col("type"), F.lit(True))
    ret = (
        F.when(F.col("s.k") == "bool", F.lit(BOOL)).when(F.col("s.k") == "untyped", F.lit('["untyped"]'))
        .when(F.col("s.k") == "pair", F.concat(F.lit('["union",[["tuple",['), value, F.lit(","), value, F.lit(']],["nil"]]]'))).otherwise(value)
    )
    rows = rows.select("class", F.concat("s.a", "column", "s.b").alias("name"), ret.alias("ret"))
    return rows if used is None else rows.join(used.select("class", "name").distinct(), ["class", "name"], "left_semi")
