"""Declarations as signature text: a block for each class, in the order of classes.

methods: class, name, singleton, origin, private, ord, overloads (JSON list of method types), explicit; constants: owner, name, type, alias_kind,
ord; mixins: class, module, kind, ord; classes: class, superclass, is_module, type_params, ord.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import signatures, terms
from glossa.functions.columns import rendered
from glossa.functions.udf import arrow
from glossa.operators.merge import last_declarations


def _freeze(x):
    return terms._freeze(x)


def _thaw(m: dict) -> dict:
    """A method type from JSON: its types become terms again."""
    params = [{**p, "type": _freeze(p["type"])} for p in m["params"]]
    return {**m, "params": params, "ret": _freeze(m["ret"]), "block": _thaw(m["block"]) | {"required": m["block"].get("required", True)} if m.get("block") else None}


@arrow("string")
def method_line(name: pd.Series, overloads: pd.Series, singleton: pd.Series, private: pd.Series, explicit: pd.Series) -> pd.Series:
    """A method's declaration; parameters of inferred signatures are widened."""

    def one(n, text, s, p, e):
        ms = [_thaw(m) for m in json.loads(text)]
        if not e:
            ms[0] = {**ms[0], "params": [{**q, "type": terms.widen(q["type"])} for q in ms[0]["params"]]}
        return signatures.render_method(n, ms, bool(s), bool(p))

    return pd.Series([one(*x) for x in zip(name, overloads, singleton, private, explicit)], dtype="object")


def constant_line(name: Column, term: Column, alias_kind: Column) -> Column:
    """NAME: Type, or class NAME = Target."""
    target = F.get_json_object(term, "$[1]")
    return F.when(alias_kind.isNotNull() & term.startswith('["singleton"'), F.concat(alias_kind, F.lit(" "), name, F.lit(" = "), target)).otherwise(F.concat(name, F.lit(": "), rendered(term)))


def renderable(methods: DataFrame, synthetic: bool = False) -> DataFrame:
    """Methods from sources; with synthetic also generated ones."""
    external = F.col("origin").isin("rbs_file", "rbi", "synthetic_dsl")
    return methods.filter(~external | (F.col("origin") == "synthetic_dsl")) if synthetic else methods.filter(~external)


def class_texts(classes: DataFrame, mixins: DataFrame, constants: DataFrame, methods: DataFrame, synthetic: bool = False) -> DataFrame:
    """class, ord, text of every class with something to show."""

    def lines(rows: DataFrame, by: str, name: str) -> DataFrame:
        got = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: F.concat(F.lit("  "), F.replace(x.line, F.lit("\n"), F.lit("\n  "))))
        return rows.groupBy(F.col(by).alias("class")).agg(got.alias(name))

    shown = last_declarations(renderable(methods, synthetic)).withColumn("line", method_line("name", "overloads", "singleton", "private", "explicit"))
    mixed = mixins.withColumn("line", F.concat_ws(" ", "kind", "module"))
    held = constants.filter("owner <> 'Object'").withColumn("line", constant_line(F.col("name"), F.col("type"), F.col("alias_kind")))
    rows = classes.join(lines(mixed, "class", "m"), "class", "left").join(lines(held, "owner", "c"), "class", "left").join(lines(shown, "class", "d"), "class", "left")
    rows = rows.filter("m IS NOT NULL OR c IS NOT NULL OR d IS NOT NULL")
    generic = F.when(F.size(F.coalesce("type_params", F.array().cast("array<string>"))) > 0, F.concat(F.lit("["), F.array_join("type_params", ", "), F.lit("]"))).otherwise("")
    up = F.when(F.col("superclass").isNotNull(), F.concat(F.lit(" < "), "superclass")).otherwise("")
    head = F.concat(F.when(F.col("is_module"), "module ").otherwise("class "), "class", generic, up)
    parts = F.filter(F.array(*[F.array_join(p, "\n") for p in ("m", "c", "d")]), lambda p: p.isNotNull())
    return rows.select("class", "ord", F.concat(head, F.lit("\n"), F.array_join(parts, "\n\n"), F.lit("\nend")).alias("text"))


def whole_text(classes: DataFrame, mixins: DataFrame, constants: DataFrame, methods: DataFrame, synthetic: bool = False) -> DataFrame:
    """value: lines to write, top-level constants first, then classes in order, a blank line between them."""
    top = constants.filter("owner = 'Object'").select(F.lit(None).alias("ord"), constant_line(F.col("name"), F.col("type"), F.col("alias_kind")).alias("value"))
    texts = class_texts(classes, mixins, constants, methods, synthetic).select("ord", F.concat("text", F.lit("\n")).alias("value"))
    return texts.unionByName(top.withColumn("ord", F.col("ord").cast(texts.schema["ord"].dataType))).orderBy(F.asc_nulls_first("ord"), "value").select("value")


def file_text(classes: DataFrame, mixins: DataFrame, constants: DataFrame, methods: DataFrame, file: str) -> DataFrame:
    """The text of one file's declarations."""
    own = methods.filter(F.col("file") == file)
    return whole_text(classes.filter(F.col("file") == file), mixins.filter(F.col("file") == file), constants.filter(F.col("file") == file), own)


def hover_text(term: Column, limit: int = 512) -> Column:
    """A type as hover text, cut at a limit."""
    text = rendered(term)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def code_lenses(methods: DataFrame, file: str) -> DataFrame:
    """line, text of a file's methods."""
    own = renderable(methods).filter(F.col("file") == file)
    return own.select("line", method_line("name", "overloads", "singleton", "private", "explicit").alias("text")).orderBy("line")
