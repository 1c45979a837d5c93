"""Types across calls: parameters from call sites, overloads, declarations to load.

Facts: methods (class, name, singleton, ret, ...), params (class, name, singleton, idx, pname, kind, default_type), call_sites (site_id, class,
method, singleton, open_splat), call_args (site_id, pos, keyword, type), where types are JSON terms and class is the receiver's.
"""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.udf import arrow
from glossa.functions import binding, terms
from glossa.functions.columns import union_type
from glossa.operators.lookup import dispatch
from glossa.operators.merge import last_keywords
from glossa.plans.fixpoint import cut


@arrow("string")
def _bind(params: pd.Series, positional: pd.Series, keywords: pd.Series, open_splat: pd.Series) -> pd.Series:
    """Arguments by parameter. All sides come as JSON text, so that calls of one shape are bound once in a batch."""

    @functools.cache
    def bound(ps, args, words, at):
        ps = [(p["pname"], p["kind"], terms.loads(p["default_type"]) if p.get("default_type") else None) for p in json.loads(ps)]
        words = {w["keyword"]: terms.loads(w["type"]) for w in json.loads(words or "[]")}
        found = binding.bind(ps, [terms._freeze(t) for t in json.loads(args or "[]")], words, open_at=at)
        return json.dumps([{"pname": n, "type": terms.dumps(t)} for n, t in found.items()])

    at = [None if pd.isna(x) else int(x) for x in open_splat]
    return pd.Series([bound(*x) for x in zip(params, positional, keywords, at)], dtype="object")


def bound_arguments(sites: DataFrame, args: DataFrame, params: DataFrame) -> DataFrame:
    """site_id, class, name, singleton, pname, type: every call's arguments bound to the parameters of its target.

    sites: site_id, owner, method, singleton, open_splat (position of a splat of unknown length, or null).
    """
    positional = args.filter("keyword IS NULL").groupBy("site_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda a: a.type), ","), F.lit("]")).alias("positional"))
    keywords = last_keywords(args).groupBy("site_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("keyword", "type")))).alias("keywords"))
    by = params.groupBy("class", "name", "singleton").agg(F.to_json(F.array_sort(F.collect_list(F.struct("idx", "pname", "kind", "default_type")))).alias("params"))
    target = sites.filter("owner IS NOT NULL").select("site_id", F.col("owner").alias("class"), F.col("method").alias("name"), "singleton", "open_splat")
    rows = target.join(by, ["class", "name", "singleton"]).join(positional, "site_id", "left").join(keywords, "site_id", "left")
    rows = rows.withColumn("b", F.explode(F.from_json(_bind("params", "positional", "keywords", F.col("open_splat").cast("double")), "array<struct<pname:string,type:string>>")))
    return rows.select("site_id", "class", "name", "singleton", "b.pname", "b.type")


def parameter_types(bound: DataFrame) -> DataFrame:
    """class, name, singleton, pname, type: what all calls give a parameter. Distinct types are gathered map-side first."""

    @arrow("string")
    def merged(types: pd.Series) -> pd.Series:
        def one(texts):
            got: list = []
            for t in texts if texts is not None else []:
                got = terms.append_argument(got, terms.loads(t))
            known = [t for t in got if t != terms.UNTYPED] if any(t not in (terms.UNTYPED, terms.NIL) for t in got) else got
            return terms.dumps(terms.merge_arguments(known))

        return types.map(one)

    by = bound.groupBy("class", "name", "singleton", "pname").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return by.withColumn("type", merged("types")).drop("types")


def infer_parameters(sites: DataFrame, args: DataFrame, params: DataFrame, methods: DataFrame, paths: DataFrame) -> DataFrame:
    """parameter_types of all calls, each dispatched along its receiver's lookup path."""
    calls = sites.select("site_id", "class", F.col("method").alias("name"), "singleton", "open_splat")
    found = dispatch(calls, paths, methods).select("site_id", "owner", F.col("name").alias("method"), "singleton", "open_splat")
    return parameter_types(bound_arguments(found, args, params))


def needed_classes(methods: DataFrame, classes: DataFrame, attempted: DataFrame, references) -> DataFrame:
    """Classes that types name and nothing has declared or tried to load. references: a column function on terms."""
    named = methods.select(F.explode(references("ret")).alias("class")).distinct()
    return named.join(classes.select("class"), "class", "left_anti").join(attempted.select("class"), "class", "left_anti")


def load_until_closed(methods: DataFrame, classes: DataFrame, load, references, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Declarations loaded until types name no class that could still be; an error if max_rounds don't do. load(classes) -> (classes, methods)."""
    attempted, k = classes.select("class").limit(0), 0
    while not (need := cut(needed_classes(methods, classes, attempted, references))).isEmpty():
        if k == max_rounds:
            raise RuntimeError(f"types still name unloaded classes after {max_rounds} rounds")
        more_classes, more_methods = load(need)
        attempted = cut(attempted.union(need))
        classes = cut(classes.unionByName(more_classes.join(classes.select("class"), "class", "left_anti")))
        methods, k = cut(methods.unionByName(more_methods)), k + 1
    return classes, methods


def accepted_overloads(calls: DataFrame, overloads: DataFrame) -> DataFrame:
    """calls (site_id, class, name, positional, keywords, block) with the overloads that fit; all of them if not exactly one does."""

    @arrow("boolean")
    def accepts(params: pd.Series, positional: pd.Series, keywords: pd.Series, block: pd.Series) -> pd.Series:
        def one(ps, n, words, b):
            ps = [(p["pname"], p["kind"], p["default_type"]) for p in ps]
            return binding.accepts(ps, int(n), list(words if words is not None else []), None if pd.isna(b) else bool(b))

        return pd.Series([one(*x) for x in zip(params, positional, keywords, block)], dtype="bool")

    met = calls.join(overloads, ["class", "name"]).withColumn("fits", accepts("params", "positional", "keywords", "block"))
    count = met.groupBy("site_id").agg(F.sum(F.col("fits").cast("int")).alias("n"))
    return met.join(count, "site_id").filter(F.col("fits") | (F.col("n") != 1)).drop("n", "fits")


def column_arguments(calls: DataFrame, columns: DataFrame) -> DataFrame:
    """site_id, type of calls that pick columns by name (names: array): one column's type or the tuple of several; null if one is unknown."""
    asked = calls.select("site_id", "class", F.posexplode("names").alias("pos", "name"))
    found = asked.join(columns.select("class", "name", "ret"), ["class", "name"], "left")
    by = found.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ret"))).alias("r"), F.max(F.col("ret").isNull() | (F.col("ret") == '["untyped"]')).alias("miss"))
    many = F.concat(F.lit('["tuple",['), F.array_join(F.transform("r", lambda x: x.ret), ","), F.lit("]]"))
    return by.select("site_id", F.when(~F.col("miss"), F.when(F.size("r") == 1, F.col("r")[0].ret).otherwise(many)).alias("type"))


def delegate_signatures(delegations: DataFrame, methods: DataFrame) -> DataFrame:
    """class, name, ret of delegated methods. delegations: class, name, to_class, to_method."""
    target = methods.select(F.col("class").alias("to_class"), F.col("name").alias("to_method"), "ret")
    return delegations.join(target, ["to_class", "to_method"], "left").select("class", "name", F.coalesce("ret", F.lit('["untyped"]')).alias("ret"))


def ivar_types(writes: DataFrame) -> DataFrame:
    """class, ivar, type over all writes."""
    by = writes.groupBy("class", "ivar").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return by.withColumn("type", union_type("types")).drop("types")
