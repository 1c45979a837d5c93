"""Signature files as declaration tables, and signatures in comments."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import signatures, terms
from glossa.functions.udf import arrow

DECLARATIONS = "file string, ord int, row string, owner string, name string, singleton boolean, kind string, type string, type_params array<string>, overloads string, error string"


def declarations(texts: DataFrame) -> DataFrame:
    """DECLARATIONS of signature files (file, content); a file that doesn't parse gives one row with the error."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DECLARATIONS.split(", ")]
        for batch in batches:
            out = []
            for file, content in zip(batch["file"], batch["content"]):
                try:
                    rows = signatures.parse_declarations(content or "")
                except signatures.SignatureError as error:
                    rows = [{"row": "error", "ord": 0, "error": str(error)}]
                for r in rows:
                    r = r | {"file": file, "type": terms.dumps(r["type"]) if r.get("type") else None, "overloads": json.dumps(r["overloads"]) if r.get("overloads") is not None else None}
                    out.append({n: r.get(n) for n in names})
            yield pd.DataFrame(out, columns=names).astype({"singleton": "boolean", "ord": "int32"})

    return texts.select("file", "content").mapInPandas(parsed, DECLARATIONS)


def methods(declared: DataFrame) -> DataFrame:
    """class, name, singleton, overload, method type (JSON), visibility, file, ord."""
    kind = "array<string>"
    rows = declared.filter("row = 'method'").withColumn("o", F.from_json("overloads", kind))
    return rows.select(F.col("owner").alias("class"), "name", "singleton", F.col("kind").alias("visibility"), "file", "ord", F.posexplode("o").alias("overload", "signature"))


def classes(declared: DataFrame) -> DataFrame:
    """file, class, superclass, is_module."""
    up = F.get_json_object("type", "$[1]")
    return declared.filter("row = 'class'").select("file", F.col("name").alias("class"), up.alias("superclass"), (F.col("kind") != "class").alias("is_module"), "type_params")


def mixins(declared: DataFrame) -> DataFrame:
    return declared.filter("row = 'mixin'").select(F.col("owner").alias("class"), F.col("name").alias("module"), "kind", "ord", "file")


def constants(declared: DataFrame) -> DataFrame:
    return declared.filter("row = 'constant'").select("owner", "name", "type", F.when(F.col("kind") != "constant", F.col("kind")).alias("alias_kind"), "file")


def classes_of_files(declared: DataFrame) -> DataFrame:
    """file, classes: the index for loading only what is needed."""
    return classes(declared).groupBy("file").agg(F.array_sort(F.collect_set("class")).alias("classes"))


def files_for(index: DataFrame, needed: DataFrame) -> DataFrame:
    """Files that declare any needed class."""
    return index.select("file", F.explode("classes").alias("class")).join(needed.select("class").distinct(), "class", "left_semi").select("file").distinct()


def apply_method_aliases(methods_: DataFrame, aliases: DataFrame) -> DataFrame:
    """methods with those that aliases (class, name, singleton, old) give; an alias whose source is missing waits for a later call."""
    source = methods_.withColumnRenamed("name", "old")
    kept = [c for c in methods_.columns if c not in ("class", "name", "singleton")]
    made = aliases.select("class", "name", "singleton", "old").join(source, ["class", "old", "singleton"]).select("class", "name", "singleton", *kept)
    have = methods_.select("class", "name", "singleton").distinct()
    return methods_.unionByName(made.join(have, ["class", "name", "singleton"], "left_anti"))


def resolve_aliases(raw: dict[str, tuple], rounds: int = 8) -> dict[str, tuple]:
    """Type aliases whose types name other aliases, replaced up to a depth; what is left of a cycle is untyped."""
    out = dict(raw)
    for _ in range(rounds):
        after = {n: terms.transform(t, lambda x: out.get(x[1], x) if x[0] == "class" and x[1] in out else x) for n, t in out.items()}
        if after == out:
            break
        out = after
    return {n: terms.transform(t, lambda x: terms.UNTYPED if x[0] == "class" and x[1] in raw else x) for n, t in out.items()}


@arrow("string")
def type_term(text: pd.Series) -> pd.Series:
    """Signature text of a type as a JSON term; null if it doesn't parse."""

    def one(s):
        try:
            return None if s is None else terms.dumps(signatures.parse_type(s))
        except signatures.SignatureError:
            return None

    return text.map(one)


@arrow("string")
def method_type(text: pd.Series) -> pd.Series:
    """Method type text as JSON overloads; null if it doesn't parse."""

    def one(s):
        try:
            return None if s is None else json.dumps(signatures.parse_method_type(s))
        except signatures.SignatureError:
            return None

    return text.map(one)


@arrow("string")
def checked_signature(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else signatures.checked_signature(s))


# comments


def source_lines(texts: DataFrame) -> DataFrame:
    """file, line (from 1), text."""
    return texts.select("file", F.posexplode(F.split("content", "\r?\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")


def signature_comments(lines: DataFrame) -> DataFrame:
    """file, line, kind (method, rbs, assertion, self_bind, alias), body of comments that carry types."""
    text = F.col("text")
    own, tail = r"^\s*#:\s*(.*?)\s*$", r"^.*\S.*?#:\s*(.*?)\s*$"
    bound = r"^\s*#:\s*self\s+as\s+(.*?)\s*$"
    kind = (
        F.when(text.rlike(bound), "self_bind").when(text.rlike(r"^\s*#:\s*type\s+\w+\s*="), "alias").when(text.rlike(own), "method")
        .when(text.rlike(r"^\s*#\s*@rbs\b"), "rbs").when(text.rlike(tail), "assertion")
    )
    body = (
        F.when(kind == "self_bind", F.regexp_extract(text, bound, 1)).when(kind == "rbs", F.regexp_extract(text, r"#\s*@rbs\s*:?\s*(.*?)\s*$", 1))
        .when(kind.isin("method", "alias"), F.regexp_extract(text, own, 1)).otherwise(F.regexp_extract(text, tail, 1))
    )
    return lines.select("file", "line", kind.alias("kind"), body.alias("body")).filter("kind IS NOT NULL")


def attach_to_definitions(comments: DataFrame, lines: DataFrame) -> DataFrame:
    """file, def_line, bodies: the run of method comments right above each def, in order; a blank or other line ends it."""
    marked = lines.join(comments.filter("kind = 'method'").select("file", "line", "body"), ["file", "line"], "left")
    marked = marked.withColumn("is_def", F.col("text").rlike(r"^\s*(private\s+|public\s+|protected\s+)?def\s")).withColumn("plain", F.col("body").isNull())
    # runs of comment lines: the number of other lines so far names the run
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = marked.withColumn("run", F.sum(F.col("plain").cast("int")).over(w))
    above = runs.filter("NOT plain").groupBy("file", "run").agg(F.max("line").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x.body).alias("bodies"))
    defs = runs.filter("is_def").select("file", F.col("line").alias("def_line"))
    return defs.join(above.select("file", (F.col("last") + 1).alias("def_line"), "bodies"), ["file", "def_line"])


def required_features(lines: DataFrame) -> DataFrame:
    """file, line, feature of literal require lines."""
    feature = F.regexp_extract("text", r"""^\s*require\s*\(?\s*["']([^"']+)["']""", 1)
    return lines.select("file", "line", feature.alias("feature")).filter("feature <> ''")


def versions(ruby_version: Column, tool_versions: Column, gemfile: Column) -> Column:
    """The Ruby version of a project: its version file, else its tool versions, else its Gemfile; null if none tells."""
    number = r"(\d+\.\d+(?:\.\d+)?)"
    found = [F.regexp_extract(ruby_version, number, 1), F.regexp_extract(tool_versions, rf"(?m)^ruby\s+{number}", 1), F.regexp_extract(gemfile, rf"""(?m)^\s*ruby\s+["']~?>?\s*{number}""", 1)]
    return F.coalesce(*[F.nullif(F.coalesce(x, F.lit("")), F.lit("")) for x in found])


def locked_gems(lockfile: DataFrame) -> DataFrame:
    """gem, version of a lock file's text (content)."""
    rows = lockfile.select(F.explode(F.split("content", "\n")).alias("line"))
    pattern = r"^    ([\w.-]+) \(([^)]+)\)$"
    return rows.filter(F.col("line").rlike(pattern)).select(F.regexp_extract("line", pattern, 1).alias("gem"), F.regexp_extract("line", pattern, 2).alias("version"))


def version_parts(text: Column) -> Column:
    """struct(major, minor) of a version."""
    return F.struct(F.regexp_extract(text, r"^(\d+)", 1).try_cast("int").alias("major"), F.coalesce(F.regexp_extract(text, r"^\d+\.(\d+)", 1).try_cast("int"), F.lit(0)).alias("minor"))


def active_libraries(gems: DataFrame, markers: DataFrame) -> DataFrame:
    """Libraries any of whose marker gems is locked. markers: library, gem."""
    return markers.join(gems.select("gem").distinct(), "gem", "left_semi").select("library").distinct()


def feature_files(features: DataFrame, required: DataFrame) -> DataFrame:
    """Signature files of required standard library features. features: feature, file; required: feature."""
    return features.join(required.select("feature").distinct(), "feature", "left_semi").select("file").distinct()


def external_folders(spark, root: str, names: tuple[str, ...] = ("sig", "rbi", "sorbet/rbi", ".gem_rbs_collection")) -> list[str]:
    """The folders of a project that hold signature files."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    return [f"{root}/{n}" for n in names if (p := jvm.Path(f"{root}/{n}")).getFileSystem(conf).exists(p)]
