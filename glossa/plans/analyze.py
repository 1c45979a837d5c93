"""From Ruby sources to signatures: the whole analysis as a sequence of DataFrame jobs.

1. facts of every file, in parallel; 2. what class-level calls generate; 3. lookup paths; 4. instance variables and parameters from all
call sites; 5. returns to a fixpoint; 6. text. Each step reads the tables of the one before, whose lineage is cut where a loop follows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import terms
from glossa.functions.columns import referenced_classes, union_type_keeping_untyped, widened
from glossa.functions.udf import arrow
from glossa.operators import bodies, calls, extensions, flows, generators, generics, lookup, merge, recursion, render
from glossa.plans.fixpoint import cut
from glossa.sources import ddl, ruby, syntax

METHOD = ["class", "name", "singleton", "ret", "origin", "visibility", "file", "line", "ord"]


@arrow("string")
def with_known(term: pd.Series, params: pd.Series, ivars: pd.Series) -> pd.Series:
    """A body's type with its parameters and instance variables in place; what isn't known stays."""

    def one(text, ps, vs):
        if '"param"' not in text and '"keyword_param"' not in text and '"ivar"' not in text:
            return text
        ps = {p["key"]: terms.loads(p["type"]) for p in (ps if ps is not None else [])}
        vs = {v["ivar"]: terms.loads(v["type"]) for v in (vs if vs is not None else [])}

        def put(x):
            if x[0] == "param":
                return ps.get(str(x[1]), terms.UNTYPED)
            if x[0] == "keyword_param":
                return ps.get(x[1], terms.UNTYPED)
            return vs.get(x[1], x) if x[0] == "ivar" else x

        return terms.dumps(bodies.settled(terms.transform(terms.loads(text), put)))

    return pd.Series([one(*x) for x in zip(term, params, ivars)], dtype="object")


@arrow("string")
def signature(params: pd.Series, ret: pd.Series, variables: pd.Series, form: pd.Series, args: pd.Series, required: pd.Series) -> pd.Series:
    """A method type (JSON overloads) of parameters (pname, kind, type) and a return, with type parameters and block where there are any.

    variables: (idx, variable, bound) by place among positional parameters; form: the return with parameters in place; args: what the block is given; required: whether it must be.
    """

    def one(ps, r, vs, f, ys, must):
        names = {int(v["idx"]): v["variable"] for v in (vs if vs is not None else [])}
        t, place, rows, types = terms.widen(terms.display(terms.loads(r))), 0, [], {}
        if names:
            shown = generics.with_variables(terms.loads(f), names)
            names = {} if terms.is_deferred(shown) else names
            t = terms.widen(shown) if names else t
        for p in ps if ps is not None else []:
            kind = terms.loads(p["type"])
            if p["kind"] in ("required", "optional", "rest"):
                types[place] = terms.cls(names[place]) if p["kind"] == "required" and place in names else kind
                kind, place = types[place], place + 1
            rows.append({"name": p["pname"], "kind": p["kind"], "type": kind})
        block = None
        if ys is not None:
            given = [terms.display(terms.transform(terms.loads(y), lambda x: types.get(x[1], terms.UNTYPED) if x[0] == "param" else x)) for y in ys]
            back = terms.cls(names[generics.BLOCK]) if generics.BLOCK in names else terms.UNTYPED
            block = {"type_params": [], "params": [{"name": "", "kind": "required", "type": y} for y in given], "block": None, "ret": back, "required": bool(must)}
        declared = [v["variable"] + (f" < {v['bound']}" if v["bound"] else "") for v in vs] if names else []
        return json.dumps([{"type_params": declared, "params": rows, "block": block, "ret": t}])

    return pd.Series([one(*x) for x in zip(params, ret, variables, form, args, required)], dtype="object")


@arrow("string")
def renamed(term: pd.Series, names: pd.Series) -> pd.Series:
    """A term with class names resolved. names: array of struct(name, class)."""

    def one(text, table):
        table = {r["name"]: r["class"] for r in (table if table is not None else [])}
        if not table:
            return text

        def put(x):
            return (x[0], table.get(x[1], x[1]), *x[2:]) if x[0] in ("class", "singleton", "generic") else x

        return terms.dumps(terms.transform(terms.loads(text), put))

    return pd.Series([one(*x) for x in zip(term, names)], dtype="object")


def resolve_names(rows: DataFrame, classes: DataFrame, term: str, owner: str = "class") -> DataFrame:
    """rows whose terms name classes as the owner's namespace sees them."""
    named = rows.select(F.col(owner).alias("owner"), F.explode(referenced_classes(term)).alias("name")).distinct().withColumn("id", F.struct("owner", "name"))
    found = lookup.resolve_class_names(named, classes).filter("class <> name").groupBy("owner").agg(F.collect_list(F.struct("name", "class")).alias("_names"))
    met = rows.join(found.withColumnRenamed("owner", owner), owner, "left")
    return met.withColumn(term, F.when(F.col("_names").isNotNull(), renamed(term, "_names")).otherwise(F.col(term))).select(*rows.columns)


def resolve_callers(sites: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Call sites whose receiver class is resolved from the class that the call stands in."""
    # the reader lists a call before the method or class that it stands in
    after = Window.partitionBy("file").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    holder = F.first(F.when(F.col("row").isin("class", "method"), F.col("class")), ignorenulls=True).over(after)
    scope = rows.filter("row IN ('class', 'method', 'call')").withColumn("owner", holder).filter("row = 'call' AND owner IS NOT NULL").select(F.concat_ws(":", "file", F.col("ord").cast("string")).alias("site_id"), "owner")
    named = sites.join(scope, "site_id", "left").select("site_id", F.coalesce("owner", F.lit("")).alias("owner"), F.col("class").alias("name")).withColumn("id", F.col("site_id"))
    found = lookup.resolve_class_names(named.drop("site_id"), classes).select(F.col("id").alias("site_id"), F.col("class").alias("resolved"))
    return sites.join(found, "site_id", "left").withColumn("class", F.coalesce("resolved", "class")).drop("resolved")


def with_bodies(methods: DataFrame, found: DataFrame) -> DataFrame:
    """methods (file, line, name, ret, ...) with what their bodies are worth (bodies.method_returns), where that says more than the last line."""
    found = found.groupBy("file", "line", "name").agg(F.first("ret").alias("worth"))
    vague = F.col("worth").isNull() | F.contains("worth", F.lit('["untyped"]')) & ~F.contains("ret", F.lit('["untyped"]'))
    return methods.join(found, ["file", "line", "name"], "left").withColumn("ret", F.when(vague, F.col("ret")).otherwise(F.col("worth"))).select(*methods.columns)


class Analysis:
    """Tables of one run over texts (file, content)."""

    def __init__(self, texts: DataFrame, active: DataFrame | None = None, deep: bool = True):
        """deep: what methods return is worked out from all ways through their bodies; else only from last lines that are simple."""
        rows = cut(ruby.facts(texts))
        t = ruby.tables(rows)
        self.nodes = cut(syntax.nodes(texts)) if deep else None
        if deep:
            self.values = cut(bodies.values(self.nodes))
            self.forms = cut(bodies.method_returns(self.nodes, self.values))
            t["methods"] = with_bodies(t["methods"], self.forms)
        known = t["classes"].select("class").distinct()
        t["methods"], t["ivars"] = resolve_names(t["methods"], known, "ret"), resolve_names(t["ivars"], known, "type")
        where = resolve_callers(t["sites"], rows, known)
        t["sites"] = where
        self.classes = t["classes"].groupBy("class").agg(F.max("superclass").alias("superclass"), F.max("is_module").alias("is_module"), F.min(F.struct("file", "ord")).alias("o")).select("class", "superclass", "is_module", "o.file", "o.ord")
        self.mixins, self.constants, self.params, self.sites, self.args, self.writes = (t[k] for k in ("mixins", "constants", "params", "sites", "args", "ivars"))
        self.paths = cut(lookup.ancestors(self.classes.select("class", "superclass"), self.mixins))
        self.own = t["methods"].select("class", "name", "singleton", "ret", F.lit("source").alias("origin"), "visibility", "file", "line", "ord")
        self._parameters()
        self._variables()
        macros = t["macros"]
        aliased = generators.aliases(macros, self.own.withColumn("param", F.lit(None).cast("string")))
        more = generators.attributes(macros.filter("NOT singleton"), self.ivars)
        for rows in (generators.struct_members(macros), aliased, extensions.extension_methods(macros, t["mixins"].withColumn("line", F.lit(0)), active)):
            more = more.unionByName(rows)
        more = more.select("class", "name", "singleton", "ret", "origin", F.lit("public").alias("visibility"), "file", "line", F.col("line").alias("ord"))
        self.methods = cut(merge.last_declarations(merge.merge_preserving_user(more, self.own, ["class", "name", "singleton"])))
        self._returns()

    def _parameters(self) -> None:
        """Parameters from all calls; arguments that themselves wait for a value tell nothing yet."""
        waits = F.col("type").rlike('"(param|keyword_param|ivar|method_return|receiver_method)"')
        known = self.args.withColumn("type", F.when(waits, F.lit('["bot"]')).otherwise(F.col("type")))
        self.parameters = cut(calls.infer_parameters(self.sites, known, self.params, self.own, self.paths))
        positional = self.params.filter(F.col("kind").isin("required", "optional", "rest"))
        spot = (F.row_number().over(Window.partitionBy("class", "name", "singleton").orderBy("idx")) - 1).cast("string")
        keyed = positional.withColumn("key", spot).unionByName(self.params.filter(F.col("kind").startswith("keyword")).withColumn("key", F.col("pname")))
        met = keyed.join(self.parameters, ["class", "name", "singleton", "pname"], "left")
        self.bound = cut(met.withColumn("type", widened(F.coalesce(F.nullif("type", F.lit('["untyped"]')), "default_type", F.lit('["untyped"]')))))
        typed = self.bound.select("class", "name", "singleton", "idx", "pname", "kind", "type")
        others = self.params.filter(F.col("kind").isin("double_rest", "block")).select("class", "name", "singleton", "idx", "pname", "kind", F.lit('["untyped"]').alias("type"))
        self.typed_params = typed.unionByName(others)
        self.by_method = self.bound.groupBy("class", "name", "singleton").agg(F.collect_list(F.struct("key", "type")).alias("ps"))

    def _variables(self) -> None:
        """Instance variables over all writes, where parameters have their types."""
        none = F.array().cast("array<struct<ivar:string,type:string>>")
        rows = self.writes.join(self.by_method, ["class", "name", "singleton"], "left").withColumn("type", with_known("type", "ps", none))
        by = rows.groupBy("class", "ivar").agg(F.array_sort(F.collect_set("type")).alias("types"))
        self.ivars = cut(by.withColumn("type", widened(union_type_keeping_untyped("types"))).drop("types"))

    def _returns(self) -> None:
        """Returns to a fixpoint, once parameters and variables are in place."""
        held = self.ivars.groupBy("class").agg(F.collect_list(F.struct("ivar", "type")).alias("vs"))
        rows = self.methods.join(self.by_method, ["class", "name", "singleton"], "left").join(held, "class", "left")
        self.resolved, self.rounds = recursion.resolve_returns(rows.withColumn("ret", with_known("ret", "ps", "vs")).select(*self.methods.columns), self.paths)

    def _generic(self, rows: DataFrame) -> DataFrame:
        """rows (class, name, singleton, ...) with variables, form, args and required: type parameters and blocks that bodies give their methods."""
        if self.nodes is None:
            none = F.lit(None)
            return rows.withColumns({"variables": none.cast("array<struct<idx:int,variable:string,bound:string>>"), "form": none.cast("string"), "args": none.cast("array<string>"), "required": none.cast("boolean")})
        contracts = generics.block_contracts(self.nodes, self.values, bodies.definitions(self.nodes))
        places = self.bound.filter("kind IN ('required', 'optional', 'rest')").select("class", "name", F.col("key").cast("int").alias("idx"), "pname", "type")
        forms = self.forms.groupBy("class", "name", "singleton").agg(F.last("form").alias("form"), F.count("*").alias("n")).filter("n = 1").drop("n")
        found = generics.method_variables(forms, places, flows.param_flows(bodies.parameter_uses(self.nodes)), contracts)
        met = rows.join(forms, ["class", "name", "singleton"], "left").join(contracts.dropDuplicates(["class", "name", "singleton"]), ["class", "name", "singleton"], "left")
        return met.join(found, ["class", "name"], "left")

    def signatures(self, generic: bool = True) -> DataFrame:
        """class, name, singleton, origin, private, ord, overloads, explicit, file, line. generic: with type parameters; else parameters and returns are those of the calls."""
        ps = self.typed_params.groupBy("class", "name", "singleton").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "pname", "kind", "type"))), lambda p: F.struct(p.pname, p.kind, p.type)).alias("ps"))
        setter = F.array(F.struct(F.lit("value").alias("pname"), F.lit("required").alias("kind"), F.col("ret").alias("type")))
        rows = self.resolved.join(ps, ["class", "name", "singleton"], "left").withColumn("ps", F.when(F.col("ps").isNull() & F.col("name").rlike("^[A-Za-z_].*=$"), setter).otherwise(F.col("ps")))
        rows = self._generic(rows)
        return rows.select("class", "name", "singleton", F.when(F.col("origin") == "synthetic_dsl", "source_dsl").otherwise(F.col("origin")).alias("origin"), (F.col("visibility") != "public").alias("private"), "ord", signature("ps", F.when(F.col("name") == "initialize", '["void"]').otherwise(F.col("ret")), F.when((F.col("name") != "initialize") & F.lit(generic), F.col("variables")), "form", "args", "required").alias("overloads"), F.lit(False).alias("explicit"), "file", "line")

    def text(self, generic: bool = True) -> DataFrame:
        """value: the signature text, class by class. generic: see signatures."""
        classes = self.classes.withColumn("type_params", F.array().cast("array<string>"))
        return render.whole_text(classes.withColumn("ord", F.struct("file", "ord")), self.mixins, self.constants, self.signatures(generic))


def analyze(spark: SparkSession, path: str, production: bool = True) -> Analysis:
    """The analysis of all Ruby files below a path."""
    return Analysis(ddl.scan(spark, path, production=production).select("file", "content"))
