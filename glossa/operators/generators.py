"""Declarations that class-level calls generate: method rows from facts.

calls: class, method, names (array of literal names), options (map of literal options), file, line, ord. All generators return
METHODS rows: class, name, singleton, param, ret, origin, file, line. Types are JSON terms.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import inflect, returns, terms
from glossa.functions.udf import arrow
from glossa.plans.fixpoint import dealt
from glossa.operators.lookup import resolve_class_names

UNTYPED, BOOL, STRING = (terms.dumps(t) for t in (terms.UNTYPED, terms.BOOL, terms.STRING))
METHODS = ["class", "name", "singleton", "param", "ret", "origin", "file", "line"]


def _class(name: Column) -> Column:
    return F.concat(F.lit('["class",'), F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit("]"))


def _maybe(term: Column) -> Column:
    return F.concat(F.lit('["union",['), term, F.lit(',["nil"]]]'))


def _rows(df: DataFrame, *made: Column) -> DataFrame:
    """Each row as several methods: structs of name, param, ret (and singleton)."""
    rows = df.withColumn("m", F.explode(F.array(*made)))
    return rows.select("class", "m.name", F.col("m.singleton"), "m.param", "m.ret", F.lit("synthetic_dsl").alias("origin"), "file", "line")


def _method(name: Column, ret: Column, param: Column | None = None, singleton: bool | Column = False) -> Column:
    own = F.lit(singleton) if isinstance(singleton, bool) else singleton
    return F.struct(name.alias("name"), (F.lit(None).cast("string") if param is None else param).alias("param"), ret.alias("ret"), own.alias("singleton"))


def _named(calls: DataFrame, *methods: str) -> DataFrame:
    """A row for each literal name of the calls of some methods: column n."""
    return calls.filter(F.col("method").isin(*methods)).withColumn("n", F.explode("names"))


def _option(name: str) -> Column:
    return F.try_element_at("options", F.lit(name))


def attributes(calls: DataFrame, ivars: DataFrame) -> DataFrame:
    """attr_reader, attr_writer, attr_accessor; types from the instance variables (class, ivar, type)."""
    rows = _named(calls, "attr_reader", "attr_writer", "attr_accessor").withColumn("ivar", F.concat(F.lit("@"), "n"))
    rows = rows.join(ivars.select("class", "ivar", "type"), ["class", "ivar"], "left").withColumn("t", F.coalesce("type", F.lit(UNTYPED)))
    made = _rows(rows.withColumn("k", F.col("method")), _method(F.when(F.col("k") != "attr_writer", F.col("n")), F.col("t")), _method(F.when(F.col("k") != "attr_reader", F.concat("n", F.lit("="))), F.col("t"), F.col("t")))
    return made.filter("name IS NOT NULL").withColumn("origin", F.lit("source_dsl"))


def mixins(calls: DataFrame) -> DataFrame:
    """class, module, kind, ord of include, extend, prepend; of several arguments the last is applied first."""
    rows = calls.filter(F.col("method").isin("include", "extend", "prepend")).select("class", F.col("method").alias("kind"), "ord", F.posexplode(F.reverse("names")).alias("i", "module"))
    return rows.select("class", "module", "kind", (F.col("ord") * 1000 + F.col("i")).alias("ord"))


def aliases(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """alias_method new, old: the old method's signature under the new name."""
    pairs = calls.filter(F.col("method").isin("alias", "alias_method") & (F.size("names") == 2)).select("class", F.get("names", F.lit(0)).alias("new"), F.get("names", F.lit(1)).alias("name"), "file", "line")
    own = methods.select("class", "name", "singleton", "param", "ret")
    return pairs.join(own, ["class", "name"]).select("class", F.col("new").alias("name"), "singleton", "param", "ret", F.lit("source").alias("origin"), "file", "line")


def defined_methods(calls: DataFrame) -> DataFrame:
    """define_method with literal names; ret is what the block was found to give (option `ret`, a JSON term)."""
    return _rows(_named(calls, "define_method", "define_singleton_method"), _method(F.col("n"), F.coalesce(_option("ret"), F.lit(UNTYPED)), singleton=F.col("method") == "define_singleton_method"))


def module_functions(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """module_function: instance methods mirrored on the module itself (all that follow, or those named)."""
    named = _named(calls, "module_function").select("class", F.col("n").alias("name")).distinct()
    every = calls.filter((F.col("method") == "module_function") & (F.size("names") == 0)).groupBy("class").agg(F.min("line").alias("from"))
    own = methods.filter("NOT singleton")
    some = own.join(named, ["class", "name"], "left_semi").select(*METHODS)
    rest = own.join(every, "class").filter(F.col("line") > F.col("from")).select(*METHODS)
    return some.union(rest).distinct().withColumn("singleton", F.lit(True))


def delegations(calls: DataFrame) -> DataFrame:
    """class, name, to, to_method, allow_nil of delegate ..., to: and of forwarding definitions."""
    plain = _named(calls, "delegate").withColumn("to", _option("to"))
    prefix = F.when(_option("prefix") == "true", F.concat("to", F.lit("_"))).when(_option("prefix").isNotNull(), F.concat(_option("prefix"), F.lit("_"))).otherwise("")
    rails = plain.select("class", F.concat(prefix, "n").alias("name"), "to", F.col("n").alias("to_method"), (F.coalesce(_option("allow_nil"), F.lit("false")) == "true").alias("allow_nil"))
    many = calls.filter("method = 'def_delegators'").select("class", F.explode(F.slice("names", F.lit(2), F.size("names"))).alias("n"), F.get("names", F.lit(0)).alias("to"))
    one = calls.filter("method = 'def_delegator'").select("class", F.coalesce(F.get("names", F.lit(2)), F.get("names", F.lit(1))).alias("name"), F.get("names", F.lit(0)).alias("to"), F.get("names", F.lit(1)).alias("to_method"))
    no = F.lit(False)
    return rails.unionByName(many.select("class", F.col("n").alias("name"), "to", F.col("n").alias("to_method"), no.alias("allow_nil"))).unionByName(one.withColumn("allow_nil", no))


def delegated(found: DataFrame, methods: DataFrame) -> DataFrame:
    """METHODS of delegations: the target's type is what the method or reader `to` returns."""
    to = methods.select("class", F.col("name").alias("to"), F.get_json_object("ret", "$[1]").alias("target"))
    known = methods.select(F.col("class").alias("target"), F.col("name").alias("to_method"), F.col("param"), F.col("ret"))
    rows = found.withColumn("to", F.regexp_replace("to", "^[:@]+", "")).join(to, ["class", "to"], "left").join(known, ["target", "to_method"], "left")
    ret = F.coalesce("ret", F.lit(UNTYPED))
    ret = F.when(F.col("allow_nil") & (ret != UNTYPED), _maybe(ret)).otherwise(ret)
    return rows.select("class", "name", F.lit(False).alias("singleton"), "param", ret.alias("ret"), F.lit("synthetic_dsl").alias("origin"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))


def struct_members(calls: DataFrame) -> DataFrame:
    """Struct.new and Data.define members: readers, and writers for structs."""
    rows = _named(calls, "Struct.new", "Data.define").withColumn("t", F.coalesce(_option("type"), F.lit(UNTYPED)))
    made = _rows(rows, _method(F.col("n"), F.col("t")), _method(F.when(F.col("method") == "Struct.new", F.concat("n", F.lit("="))), F.col("t"), F.col("t")))
    return made.filter("name IS NOT NULL")


def enum_values(calls: DataFrame) -> DataFrame:
    """class, enum, value, prefix, suffix of enum declarations: the first name is the enum, the rest its values."""
    rows = calls.filter("method = 'enum' AND size(names) > 0").withColumn("enum", F.get("names", F.lit(0)))
    mark = lambda o: F.when(_option(o) == "true", F.col("enum")).otherwise(_option(o))
    return rows.select("class", "enum", F.explode(F.slice("names", F.lit(2), F.size("names"))).alias("value"), mark("prefix").alias("prefix"), mark("suffix").alias("suffix"), "file", "line")


def enum_methods(values: DataFrame) -> DataFrame:
    """Predicate, bang method, scopes for each value; the mapping for each enum."""
    rows = values.withColumn("n", inflect.enum_method_name(F.col("value"), F.col("prefix"), F.col("suffix")))
    relation = F.concat(F.lit(f'["generic","{returns.RELATION_CLASS}",['), _class(F.col("class")), F.lit("]]"))
    each = _rows(rows, _method(F.concat("n", F.lit("?")), F.lit(BOOL)), _method(F.concat("n", F.lit("!")), F.lit(BOOL)), _method(F.col("n"), relation, singleton=True), _method(F.concat(F.lit("not_"), "n"), relation, singleton=True))
    whole = values.select("class", "enum", "file", "line").distinct()
    return each.unionByName(_rows(whole, _method(inflect.pluralize(F.col("enum")), F.lit('["hash",["string"],["untyped"]]'), singleton=True)))


def associations(calls: DataFrame, classes: DataFrame, project: inflect.Inflections = inflect.NONE) -> DataFrame:
    """class, name, target, many, optional of association calls.

    The target is the class whose association is the inverse, else class_name, source or the name as a class, from the owner's namespace outward.
    """
    kinds = {"belongs_to": False, "has_one": False, "has_many": True, "has_and_belongs_to_many": True}
    rows = _named(calls, *kinds).withColumn("many", F.col("method").isin("has_many", "has_and_belongs_to_many"))
    base = F.coalesce(_option("source"), F.col("n"))
    guessed = F.when(F.col("many"), inflect.classify(base, project)).otherwise(F.array_join(F.transform(F.split(base, "_"), lambda p: inflect.camelize(p, project)), ""))
    rows = rows.withColumn("guess", F.coalesce(_option("class_name"), guessed)).withColumn("id", F.struct("class", "n"))
    found = resolve_class_names(rows.select("id", F.col("class").alias("owner"), F.col("guess").alias("name")), classes).select("id", F.col("class").alias("resolved"))
    other = _named(calls, *kinds).select(F.col("class").alias("inverse_class"), F.col("n").alias("inverse"), F.try_element_at("options", F.lit("class_name")).alias("points_to"))
    inverse = rows.filter(_option("inverse_of").isNotNull()).join(other, (_option("inverse_of") == F.col("inverse")) & (F.col("points_to") == F.col("class"))).groupBy("id").agg(F.min("inverse_class").alias("by_inverse"))
    rows = rows.join(found, "id").join(inverse, "id", "left")
    optional = F.when(F.col("method") == "belongs_to", F.coalesce(_option("optional"), F.lit("false")) == "true").otherwise(True)
    return rows.select("class", F.col("n").alias("name"), F.coalesce("by_inverse", "resolved").alias("target"), "many", optional.alias("optional"), F.col("method").alias("kind"), "file", "line")


def association_methods(found: DataFrame) -> DataFrame:
    """Reader and writer; build_, create_ and reload_ for one, _ids for many."""
    one, target = ~F.col("many"), _class(F.col("target"))
    proxy = F.concat(F.lit(f'["generic","{returns.PROXY_CLASS}",['), target, F.lit("]]"))
    value = F.when(F.col("many"), proxy).when(F.col("optional"), _maybe(target)).otherwise(target)
    ids = F.concat(inflect.singularize(F.col("name")), F.lit("_ids"))
    made = _rows(
        found, _method(F.col("name"), value), _method(F.concat("name", F.lit("=")), value, value),
        *[_method(F.when(one, F.concat(F.lit(p), "name")), target) for p in ("build_", "create_")], _method(F.when(one, F.concat(F.lit("reload_"), "name")), value),
        _method(F.when(F.col("many"), ids), F.lit('["array",["integer"]]')),
    )
    return made.filter("name IS NOT NULL")


def relation_methods(models: DataFrame, version: tuple[int, int] = (99, 0)) -> DataFrame:
    """Class methods that models (class, primary_key: JSON term or null) answer like relations."""
    rows = [(m, terms.dumps(returns.ANSWERS[answer]), block) for m, answer, receivers, since, block, _ in returns.RELATION_METHODS if "model" in receivers.split() and since <= version]
    table = models.sparkSession.createDataFrame(rows, "name string, ret string, block string")
    key = F.coalesce("primary_key", F.lit('["integer"]'))
    ret = F.replace(F.replace(F.replace("ret", F.lit('["relation"]'), F.concat(F.lit(f'["generic","{returns.RELATION_CLASS}",['), _class(F.col("class")), F.lit("]]"))), F.lit('["model"]'), _class(F.col("class"))), F.lit('["primary_key"]'), key)
    out = models.crossJoin(F.broadcast(table)).withColumn("ret", ret)
    return out.select("class", "name", F.lit(True).alias("singleton"), F.lit(None).cast("string").alias("param"), "ret", F.lit("synthetic_dsl").alias("origin"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))


def typed_attributes(calls: DataFrame, keyword_type) -> DataFrame:
    """attribute :name, :type: reader, writer, predicate. keyword_type: a column function of type keywords."""
    rows = calls.filter("method = 'attribute' AND size(names) > 0").withColumn("n", F.get("names", F.lit(0)))
    kind = F.coalesce(F.try_element_at("names", F.lit(2)), F.lit(""))
    base = keyword_type(kind)
    value = F.when(_option("default").isNull() & (base != UNTYPED), _maybe(base)).otherwise(base)
    return _rows(rows, _method(F.col("n"), value), _method(F.concat("n", F.lit("=")), value, value), _method(F.concat("n", F.lit("?")), F.lit(BOOL)))


#: Methods that a framework class gives to what inherits from it: (name, return, on the class). Fixed values.
FRAMEWORK = {
    "ActiveJob::Base": [("perform_later", terms.UNTYPED, True), ("perform_now", terms.UNTYPED, True), ("set", terms.UNTYPED, True), ("queue_as", terms.UNTYPED, True)],
    "ActiveModel::Serializer": [("object", terms.UNTYPED, False), ("scope", terms.UNTYPED, False), ("attributes", ("hash", terms.SYMBOL, terms.UNTYPED), False), ("instance_options", ("hash", terms.SYMBOL, terms.UNTYPED), False)],
}
DELIVERY = terms.dumps(terms.cls("ActionMailer::MessageDelivery"))


def framework_methods(paths: DataFrame) -> DataFrame:
    """METHODS of classes below a framework class. paths: class, owner."""
    table = paths.sparkSession.createDataFrame([(base, n, s, terms.dumps(t)) for base, ms in FRAMEWORK.items() for n, t, s in ms], "owner string, name string, singleton boolean, ret string")
    rows = paths.filter("class <> owner").join(F.broadcast(table), "owner")
    return rows.select("class", "name", "singleton", F.lit(None).cast("string").alias("param"), "ret", F.lit("synthetic_dsl").alias("origin"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))


def mailer_actions(methods: DataFrame, paths: DataFrame) -> DataFrame:
    """Public instance methods of mailers as class methods that give a delivery."""
    mailers = paths.filter("owner = 'ActionMailer::Base' AND class <> owner").select("class").distinct()
    own = methods.join(mailers, "class", "left_semi").filter("NOT singleton AND coalesce(visibility, 'public') = 'public'")
    return own.select("class", "name", F.lit(True).alias("singleton"), "param", F.lit(DELIVERY).alias("ret"), F.lit("synthetic_dsl").alias("origin"), "file", "line")


def includer_bound(dsl: DataFrame, mixed: DataFrame, paths: DataFrame) -> DataFrame:
    """Calls in a module's included block, made on every class that mixes the module in directly.

    dsl: module, requires (an ancestor that the class must have, or null) and call columns; mixed: class, module.
    """
    rows = dsl.join(dealt(mixed.select("class", "module"), "module").distinct(), "module")
    has = paths.select("class", F.col("owner").alias("requires")).distinct()
    free = rows.filter("requires IS NULL")
    bound = rows.filter("requires IS NOT NULL").join(has, ["class", "requires"], "left_semi").select(*free.columns)
    return free.unionByName(bound)


# routes


ACTIONS = ["index", "create", "new", "show", "update", "destroy", "edit"]


def resource_actions(only: Column, except_: Column) -> Column:
    """The actions of a resource: only, without except."""
    return F.array_except(F.coalesce(only, F.array(*map(F.lit, ACTIONS))), F.coalesce(except_, F.array().cast("array<string>")))


def dynamic_segments(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p.startswith(":") | p.startswith("*")))


def route_name(name: Column) -> Column:
    """admin/report-list -> admin_report_list."""
    return F.translate(F.regexp_replace(name, "^/+|/+$", ""), "-/", "__")


VERBS = ("get", "post", "put", "patch", "delete", "match")


class Routes:
    """Route helpers of one routes file: a walk over its nested calls.

    A call is a dict: method, names, options, calls (those in its block), arity (of a direct helper's block).
    """

    def __init__(self):
        self.concerns: dict[str, list] = {}
        self.active: list[str] = []
        self.found: dict[str, int] = {}

    def add(self, name: str | None, arity: int) -> None:
        if name:
            self.found[name] = max(arity, self.found.get(name, 0))

    @staticmethod
    def _segments(path: str) -> int:
        return sum(p[:1] in (":", "*") for p in path.split("/"))

    @staticmethod
    def _plain(name: str) -> str:
        return name.strip("/").replace("-", "_").replace("/", "_")

    @staticmethod
    def _singular(word: str) -> str:
        import re

        for pattern, cut, ending in inflect.SINGULAR_RULES:
            if re.search(pattern, word):
                return word[: len(word) - cut] + ending
        return word

    def name(self, scope: dict, leaf: str | None) -> str | None:
        """The helper's name: action, scope prefixes and the resource, as its level asks."""
        level, res = scope["level"], scope["resource"]
        own = {"collection": lambda: [res["collection"]], "member": lambda: [res["member"]], "new": lambda: ["new", *scope["prefix"], res["member"]]}
        if level == "new" and leaf is None:
            return "_".join(own["new"]())
        tail = own[level]() if level in ("collection", "member") else [res["member"]] if level == "new" else []
        parts = [leaf, *scope["prefix"], *tail] if level in ("collection", "member", "new") else [*scope["prefix"], res["member"] if level == "resources" else None, leaf]
        if level == "new" and leaf is not None:
            parts = [leaf, "new", *scope["prefix"], *tail]
        return "_".join(p for p in parts if p) or None

    def member(self, scope: dict) -> dict:
        res = scope["resource"]
        inner = {**scope, "level": "member"}
        if res["shallow"]:
            inner |= {"prefix": scope["shallow_prefix"], "args": scope["shallow_args"]}
        return inner | {"args": inner["args"] + (not res["singular"])}

    def nested(self, scope: dict) -> dict:
        if scope["level"] != "resources":
            return scope
        inner = self.member(scope)
        return inner | {"prefix": [*inner["prefix"], scope["resource"]["member"]], "level": "plain", "resource": None}

    def sub(self, scope: dict, kind: str) -> dict | None:
        if scope["level"] != "resources":
            return None
        return self.member(scope) if kind == "member" else {**scope, "level": kind} if kind in ("collection", "new") else None

    def walk(self, calls: list[dict], scope: dict | None = None) -> dict[str, int]:
        scope = scope or {"prefix": [], "args": 0, "shallow_prefix": [], "shallow_args": 0, "shallow": False, "actions": None, "level": "plain", "resource": None}
        for call in calls or []:
            self.call(call, scope)
        return self.found

    def call(self, call: dict, scope: dict) -> None:
        method, names, o, inner = call["method"], call.get("names") or [], call.get("options") or {}, call.get("calls") or []
        actions = None
        if "only" in o or "except" in o:
            listed = lambda v: v if isinstance(v, list) else [v]
            actions = [a for a in (listed(o["only"]) if "only" in o else ACTIONS) if a not in (listed(o["except"]) if "except" in o else [])]
        if method == "namespace":
            at = self.nested(scope)
            if names:
                n = self._segments(o.get("path", names[0]))
                at = at | {"prefix": [*at["prefix"], o.get("as", names[0])], "shallow_prefix": [*at["shallow_prefix"], o.get("as", names[0])], "args": at["args"] + n, "shallow_args": at["shallow_args"] + n}
            self.walk(inner, at)
        elif method == "scope":
            path = names[0] if names else o.get("path")
            at = {**scope, "args": scope["args"] + (self._segments(path) if path else 0), "shallow_args": scope["shallow_args"] + (self._segments(o["shallow_path"]) if "shallow_path" in o else 0)}
            at["prefix"] = [*scope["prefix"], o["as"]] if "as" in o else scope["prefix"]
            at["shallow_prefix"] = [*scope["shallow_prefix"], o["shallow_prefix"]] if "shallow_prefix" in o else scope["shallow_prefix"]
            at["shallow"] = scope["shallow"] or o.get("shallow") is True
            at["actions"] = actions if actions is not None else scope["actions"]
            self.walk(inner, at)
        elif method == "shallow":
            self.walk(inner, {**scope, "shallow": True})
        elif method in ("resources", "resource"):
            self.resources(call, {**self.nested(scope)}, method == "resource", actions)
        elif method in ("member", "collection", "new") and scope["level"] == "resources":
            self.walk(inner, self.sub(scope, method))
        elif method == "root":
            self.add(self.name(scope, "root"), scope["args"])
        elif method == "direct":
            self.add(names[0] if names else None, call.get("arity") or 0)
        elif method == "concern":
            if names:
                self.concerns[names[0]] = inner
        elif method == "concerns":
            for n in names:
                self.concern(n, scope)
        elif method in VERBS:
            self.verb(call, scope)
        else:
            self.walk(inner, scope)

    def concern(self, name: str, scope: dict) -> None:
        if name not in self.active and name in self.concerns:
            self.active.append(name)
            self.walk(self.concerns[name], scope)
            self.active.pop()

    def resources(self, call: dict, scope: dict, singular: bool, actions: list[str] | None) -> None:
        o = call.get("options") or {}
        shallow = scope["shallow"] or o.get("shallow") is True
        actions = actions if actions is not None else scope["actions"] if scope["actions"] is not None else ACTIONS
        has = lambda *a: any(x in actions for x in a)
        for n in call.get("names") or []:
            n = o.get("as", n)
            res = {"member": n if singular else self._singular(n), "collection": n, "singular": singular, "shallow": shallow and not singular}
            at = {**scope, "shallow": shallow, "level": "resources", "resource": res}
            if has("create") if singular else has("index", "create"):
                self.add(self.name({**at, "level": "collection"}, None), at["args"])
            if has("new"):
                self.add(self.name({**at, "level": "new"}, None), at["args"])
            member = self.member(at)
            if has("show", "update", "destroy"):
                self.add(self.name(member, None), member["args"])
            if has("edit"):
                self.add(self.name(member, "edit"), member["args"])
            self.walk(call.get("calls") or [], at)
            for c in o.get("concerns", []) if isinstance(o.get("concerns", []), list) else [o["concerns"]]:
                self.concern(c, at)

    def verb(self, call: dict, scope: dict) -> None:
        import re

        o, names = call.get("options") or {}, call.get("names") or []
        if scope["level"] == "resources":
            at = self.sub(scope, o["on"]) if "on" in o else self.member(scope) if scope["resource"]["singular"] else self.nested(scope)
        else:
            at = scope
        if at is None or "as" in o and o["as"] in (False, None):
            return
        path = names[0] if names else None
        inside = at["level"] in ("member", "collection", "new")
        leaf = o.get("as")
        if leaf is None and path and re.fullmatch(r"[A-Za-z0-9_\-/]+", path) and not (inside and path in ACTIONS):
            leaf = path
        if leaf is None and not inside:
            return
        self.add(self.name(at, self._plain(leaf) or None if leaf else None), at["args"] + (self._segments(path) if path else 0))


def route_helpers(files: DataFrame) -> DataFrame:
    """name, arity of route helpers. files: file, calls (JSON array of nested calls); of one name the greatest arity counts."""

    @arrow("array<struct<name:string,arity:int>>")
    def helpers(calls):
        return calls.map(lambda text: [{"name": n, "arity": a} for n, a in sorted(Routes().walk(json.loads(text)).items())])

    import pandas as pd

    helpers.__wrapped__.__annotations__.update(calls=pd.Series, **{"return": pd.Series})
    rows = files.select(F.explode(helpers("calls")).alias("h")).select("h.*")
    return rows.groupBy("name").agg(F.max("arity").alias("arity"))


def route_methods(helpers: DataFrame, module: str = "RouteHelpers") -> DataFrame:
    """x_path and x_url with as many parameters as the path has segments."""
    rows = helpers.withColumn("suffix", F.explode(F.array(F.lit("path"), F.lit("url"))))
    params = F.transform(F.sequence(F.lit(1), F.greatest("arity", F.lit(1))), lambda i: F.concat(F.lit("arg"), (i - 1).cast("string")))
    return rows.select(F.lit(module).alias("class"), F.concat_ws("_", "name", "suffix").alias("name"), F.when(F.col("arity") > 0, params).otherwise(F.array().cast("array<string>")).alias("params"), F.lit(STRING).alias("ret"))


# compile-time extensions


class Extensions:
    """Rules that add method rows: each is (name, marker gems, function of the facts), tried in the order of registration."""

    def __init__(self):
        self.rules: list[tuple[str, tuple[str, ...], object]] = []

    def register(self, name: str, gems: tuple[str, ...] = ()):
        def add(f):
            self.rules.append((name, gems, f))
            return f

        return add

    def markers(self, spark) -> DataFrame:
        """library, gem."""
        return spark.createDataFrame([(n, g) for n, gems, _ in self.rules for g in gems], "library string, gem string")

    def apply(self, calls: DataFrame, active: set[str] | None = None) -> DataFrame | None:
        """METHODS and priority of all active rules (rules without marker gems always are); of one method the first rule's stays."""
        out = None
        for k, (name, gems, f) in enumerate(self.rules):
            if not gems or active is None or name in active:
                rows = f(calls).select(*METHODS).withColumn("priority", F.lit(k))
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            return None
        key = ["class", "name", "singleton"]
        return out.groupBy(*key).agg(F.min_by(F.struct(*[c for c in out.columns if c not in key]), "priority").alias("m")).select(*key, "m.*")
