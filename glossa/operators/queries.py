"""Point queries over facts: hover, receivers, definitions, lenses, explanations.

sites: file, start, end, ord, kind, name, type, receiver, symbol, class_context, method_context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.columns import displayed, non_nil, rendered
from glossa.operators.lookup import definition_targets, dispatch, innermost
from glossa.operators.provenance import explain
from glossa.operators.render import hover_text


def hover(points: DataFrame, sites: DataFrame) -> DataFrame:
    """file, offset, name, type, text of what stands at each position (file, offset)."""
    found = innermost(points, sites).filter("span IS NOT NULL")
    return found.select("file", "offset", F.col("span.name").alias("name"), displayed(F.col("span.type")).alias("type"), hover_text(displayed(F.col("span.type"))).alias("text"))


def receivers(points: DataFrame, sites: DataFrame) -> DataFrame:
    """file, offset, receiver of the innermost call around each position."""
    found = innermost(points, sites.filter("kind = 'method_call'"))
    return found.select("file", "offset", F.col("span.receiver").alias("receiver"))


def definitions(points: DataFrame, sites: DataFrame, defined: DataFrame) -> DataFrame:
    """Where the symbol at each position is defined. defined: symbol, file, line."""
    return definition_targets(points, sites, defined)


def type_definitions(points: DataFrame, sites: DataFrame, classes: DataFrame) -> DataFrame:
    """Where the class of the value at each position is declared; nil is left out of its type."""
    found = innermost(points, sites).filter("span IS NOT NULL").select("file", "offset", non_nil(F.col("span.type")).alias("t"))
    named = found.withColumn("class", F.when(F.col("t").rlike('^\\["(class|singleton|generic)"'), F.get_json_object("t", "$[1]")))
    return named.join(classes.select("class", F.col("file").alias("def_file"), F.col("line").alias("def_line")), "class", "left").select("file", "offset", "class", "def_file", "def_line")


def explanations(points: DataFrame, sites: DataFrame, links: DataFrame, max_depth: int = 5) -> DataFrame:
    """How the type at the first position came about, as JSON lines. links: src, dst, kind, ord between symbols."""
    at = innermost(points, sites).filter("span IS NOT NULL").select(F.col("span.symbol").alias("id")).first()
    rows = explain(sites.select(F.col("symbol").alias("id"), rendered("type").alias("type")).distinct(), links, at["id"] if at else "", max_depth)
    return rows.select(F.to_json(F.struct("step", "depth", "node", "type", "truncated")).alias("value"))


def guarded_receivers(calls: DataFrame, surface: DataFrame) -> DataFrame:
    """calls (site_id, arms: classes of a union, guards: names asked with respond_to?) with the arms that answer all guards.

    surface: class, name. If no arm answers them all, the arms stay as they are.
    """
    arms = calls.withColumn("arm", F.explode("arms")).withColumn("guard", F.explode_outer("guards"))
    has = surface.select(F.col("class").alias("arm"), F.col("name").alias("guard"), F.lit(1).alias("has")).distinct()
    met = arms.join(has, ["arm", "guard"], "left").groupBy("site_id", "arm").agg(F.min(F.coalesce(F.col("has"), F.when(F.col("guard").isNull(), 1).otherwise(0))).alias("all"))
    kept = met.filter("all = 1").groupBy("site_id").agg(F.array_sort(F.collect_set("arm")).alias("kept"))
    return calls.join(kept, "site_id", "left").withColumn("arms", F.coalesce("kept", "arms")).drop("kept")


def inbound_sites(own: DataFrame, workspace: DataFrame, methods: DataFrame) -> DataFrame:
    """A file's call sites and those of the whole workspace that call its methods (class, name)."""
    target = methods.select("class", F.col("name").alias("method")).distinct()
    return own.unionByName(workspace.join(target, ["class", "method"], "left_semi").select(*own.columns)).distinct()


def subclass_returns(calls: DataFrame, paths: DataFrame, methods: DataFrame) -> DataFrame:
    """class, name, ret: what a parent's call on self gives when only its subclasses define the method."""
    own = dispatch(calls.select("class", "name", "singleton").distinct(), paths, methods).filter("owner IS NULL").select("class", "name", "singleton")
    below = paths.filter("class <> owner").select(F.col("owner").alias("class"), F.col("class").alias("sub"))
    found = own.join(below, "class").join(methods.select(F.col("class").alias("sub"), "name", "singleton", "ret"), ["sub", "name", "singleton"])
    from glossa.functions.columns import union_type

    return found.groupBy("class", "name", "singleton").agg(F.array_sort(F.collect_set("ret")).alias("r")).withColumn("ret", union_type("r")).drop("r")


def input_files(spark, paths: list[str], expand) -> DataFrame:
    """ord, path of files given on a command line: arguments keep their order, a folder's files are sorted. expand(path): its files or None."""
    out: list[str] = []
    for p in paths:
        out += sorted(expand(p)) if expand(p) is not None else [p]
    return spark.createDataFrame(list(enumerate(dict.fromkeys(out))), "ord int, path string")


def replayed_files(methods: DataFrame, changed: DataFrame) -> DataFrame:
    """Files whose bodies depend on parameters that got a type only after the merge. changed: class, name, singleton."""
    waits = methods.filter(F.col("ret").rlike('"(param|keyword_param)"'))
    return waits.join(changed.select("class", "name", "singleton").distinct(), ["class", "name", "singleton"], "left_semi").select("file").distinct()


def in_order(results: DataFrame, files: DataFrame) -> DataFrame:
    """Results of files (path) in the order in which the files were given (path, ord)."""
    return results.join(files, "path").orderBy("ord")


def type_edges(rows: DataFrame) -> DataFrame:
    """file, symbol, kind of the classes that terms name. rows: file, kind, type."""
    from glossa.functions.columns import referenced_classes
    from glossa.operators.dependencies import edges_of_types

    return edges_of_types(rows, referenced_classes)


def pending(files: DataFrame, marks: DataFrame) -> DataFrame:
    """files with pending: whether a scan has been asked for and not yet answered (marks: file, asked, done)."""
    last = marks.groupBy("file").agg(F.max("asked").alias("a"), F.max("done").alias("d"))
    return files.join(last, "file", "left").withColumn("pending", F.coalesce(F.col("d").isNull() & F.col("a").isNotNull() | (F.col("a") > F.col("d")), F.lit(False))).drop("a", "d")


def reload_types(methods: DataFrame, declared: DataFrame, old_classes: DataFrame, origins: list[str]) -> tuple[DataFrame, DataFrame]:
    """methods after one signature file was read again, and the classes (class) that it touched: those it declared before or does now."""
    from glossa.operators.merge import drop_external

    touched = old_classes.select("class").union(declared.select("class")).distinct()
    left = drop_external(methods, touched, origins)
    return left.unionByName(declared.select(*methods.columns)), touched
