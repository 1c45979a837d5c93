"""Type variables: their names, what calls bind them to, and signatures that show them with their blocks.

Calls of one method with equal arguments are one shape. A shape's arguments meet the parameters of its method in one join, each pair is unified for itself, and what
the pairs say of a variable is gathered by shape. A variable is a class term whose name the signature declares.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import terms
from glossa.functions.columns import merged_arguments, rendered, widened
from glossa.functions.udf import arrow
from glossa.plans.fixpoint import cut, few

METHOD = ["class", "name"]
UNTYPED = terms.dumps(terms.UNTYPED)


def variable_names(bases: list[str], taken: list[str] = ()) -> list[str]:
    """A name for each parameter: its capital, or where capitals meet the least of longer beginnings, then of the capitals of its words, that tell them apart; else numbered."""
    words = [re.sub(r"^\d+", "", re.sub(r"[^A-Za-z0-9]", "", b)) for b in bases]
    first = [w[:1].upper() or "T" for w in words]
    ways = [lambda k: words[k][:2].capitalize(), lambda k: words[k][:3].capitalize(), lambda k: "".join(p[0].upper() for p in (re.sub(r"^[^A-Za-z]+", "", x) for x in bases[k].split("_")) if p)]
    names = list(first)
    for capital in dict.fromkeys(first):
        group = [k for k, c in enumerate(first) if c == capital]
        if len(group) > 1:
            tried = ([way(k) for k in group] for way in ways)
            chosen = next((t for t in tried if len(set(t)) == len(t)), [f"{capital}{n}" for n in range(1, len(group) + 1)])
            for k, name in zip(group, chosen):
                names[k] = name
    for k, name in enumerate(names):
        if name in taken or name in names[:k]:
            names[k] = next(n for n in (f"{name}{i}" for i in itertools.count(1)) if n not in taken and n not in names)
    return names


@arrow("array<string>")
def named_variables(bases: pd.Series) -> pd.Series:
    return bases.map(lambda b: variable_names(list(b)))


def inferred_type_params(params: DataFrame, flows: DataFrame) -> DataFrame:
    """class, name, idx, variable, bound, shown of parameters that a method's form makes type parameters.

    params: class, name, idx, pname, type (rendered). A parameter that is passed through may be of any type; one that is constrained keeps its callers'
    types as a bound, and stays as it is where they say nothing (untyped, bot, nil); one that is called is a proc that gives the variable.
    """
    silent = (F.col("flow") == "constrained") & F.col("type").isin("untyped", "bot", "nil")
    rows = params.join(flows, [*METHOD, "idx"]).filter(~silent)
    # procs come last, and are named for what they return
    called = F.col("flow") == "called"
    base = F.when(called, "return").otherwise(F.col("pname"))
    by = rows.groupBy(*METHOD).agg(F.array_sort(F.collect_list(F.struct(called.alias("proc"), "idx", base.alias("base"), "flow", "type"))).alias("ps"))
    by = by.withColumn("names", named_variables(F.transform("ps", lambda p: p["base"]))).withColumn("p", F.explode(F.arrays_zip("ps", "names")))
    variable, flow = F.col("p.names"), F.col("p.ps.flow")
    shown = F.when(flow == "called", F.concat(F.lit("^(*untyped) -> "), variable)).otherwise(variable)
    return by.select(*METHOD, F.col("p.ps.idx").alias("idx"), variable.alias("variable"), F.when(flow == "constrained", F.col("p.ps.type")).alias("bound"), shown.alias("shown"))


def unify(pattern, given, variables: set[str], bound: dict) -> None:
    """Adds to bound what given makes of the variables in pattern. A variable never binds to a term that names it."""
    head = pattern[0]
    if head == "class" and pattern[1] in variables:
        if not any(x == pattern for x in terms.walk(given)):
            bound.setdefault(pattern[1], []).append(given)
        return
    if head == "union":
        plain = [p for p in pattern[1] if not any(x[0] == "class" and x[1] in variables for x in terms.walk(p))]
        rest = [g for g in (given[1] if given[0] == "union" else [given]) if g not in plain and terms.LITERAL_BASE.get(g[0]) not in plain]
        for p in pattern[1]:
            if p not in plain and rest:
                unify(p, rest[0] if len(rest) == 1 else terms.union_keeping_untyped(rest), variables, bound)
        return
    if given[0] == "union":
        for arm in given[1]:
            unify(pattern, arm, variables, bound)
        return
    if head == "array" and pattern[1] and given[0] in ("array", "tuple"):
        for x in [given[1]] if given[0] == "array" else given[1]:
            if x:
                unify(pattern[1], x, variables, bound)
    elif head == "hash" and given[0] in ("hash", "record"):
        pairs = [given[1:]] if given[0] == "hash" else [(terms.SYMBOL if k[0] == "sym" else terms.STRING, v) for k, v, _ in given[1]]
        for k, v in pairs:
            for p, x in ((pattern[1], k), (pattern[2], v)):
                if p and x:
                    unify(p, x, variables, bound)
    elif head == "tuple" and given[0] == "tuple" and len(pattern[1]) == len(given[1]) or head == "generic" and given[0] == "generic" and pattern[1] == given[1]:
        for p, x in zip(pattern[-1], given[-1]):
            unify(p, x, variables, bound)


@arrow("array<struct<variable:string,term:string>>")
def unified(pattern: pd.Series, given: pd.Series, variables: pd.Series) -> pd.Series:
    """What an argument makes of the variables of a parameter."""

    def one(p, g, names):
        bound: dict = {}
        unify(terms.loads(p), terms.loads(g), set(names), bound)
        return [{"variable": v, "term": terms.dumps(terms.widen(t))} for v, ts in bound.items() for t in ts]

    return pd.Series([one(*x) for x in zip(pattern, given, variables)], dtype="object")


@arrow("string")
def put_in(term: pd.Series, known: pd.Series) -> pd.Series:
    """A term with its variables (structs of variable and term) in place."""

    def one(text, rows):
        table = {r["variable"]: terms.loads(r["term"]) for r in (rows if rows is not None else [])}
        return terms.dumps(terms.transform(terms.loads(text), lambda x: table.get(x[1], x) if x[0] == "class" else x))

    return pd.Series([one(*x) for x in zip(term, known)], dtype="object")


@arrow("boolean")
def within(term: pd.Series, bound: pd.Series) -> pd.Series:
    """Whether every arm of a term is an arm of the bound (a literal counts as its class); null bound: always."""

    def one(t, b):
        if b is None:
            return True
        allowed = terms.flatten([terms.loads(b)])
        return all(x in allowed or terms.LITERAL_BASE.get(x[0]) in allowed for x in terms.flatten([terms.loads(t)]))

    return pd.Series([one(*x) for x in zip(term, bound)], dtype="bool")


def instantiated(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """site_id, ret of each call: its method's return with the variables that its arguments bind.

    calls: site_id, class, name, args (terms). signatures: class, name, variables (array of struct(name, bound)), params (terms), ret. What several
    arguments say of a variable is joined. A variable that nothing binds, or that leaves its bound, is the bound, or untyped without one.
    """
    shapes = cut(calls.select(*METHOD, "args").distinct().withColumn("shape", F.monotonically_increasing_id()))
    names = F.transform("variables", lambda v: v["name"])
    of = signatures.select(*METHOD, names.alias("names"), F.posexplode("params").alias("pos", "pattern"))
    given = shapes.select("shape", *METHOD, F.posexplode("args").alias("pos", "given"))
    said = given.join(of, [*METHOD, "pos"]).select("shape", F.explode(unified("pattern", "given", "names")).alias("b")).select("shape", "b.*")
    by = said.groupBy("shape", "variable").agg(F.array_sort(F.collect_set("term")).alias("ts"))
    by = by.select("shape", "variable", merged_arguments("ts").alias("term"))
    wanted = shapes.select("shape", *METHOD).join(signatures.select(*METHOD, F.explode("variables").alias("v")), METHOD).select("shape", F.col("v.name").alias("variable"), F.col("v.bound").alias("bound"))
    met = wanted.join(by, ["shape", "variable"], "left")
    fits = F.col("term").isNotNull() & within(F.coalesce("term", F.lit(UNTYPED)), F.col("bound"))
    met = met.withColumn("term", F.when(fits, F.col("term")).otherwise(F.coalesce("bound", F.lit(UNTYPED))))
    known = met.groupBy("shape").agg(F.collect_list(F.struct("variable", "term")).alias("known"))
    rows = shapes.join(signatures.select(*METHOD, "ret"), METHOD).join(known, "shape", "left")
    # as structs, so that missing arguments are equal
    call = F.struct(*METHOD, "args").alias("call")
    return calls.select("site_id", call).join(few(rows.select(call, put_in("ret", "known").alias("ret"))), "call").select("site_id", "ret")


#: The place that stands for what a method's block gives, among those of its parameters.
BLOCK = 1 << 20


def with_variables(t, names: dict[int, str]):
    """t with parameters (and the block's value) that it gives as they are replaced by their variables; not within calls on them."""
    place = BLOCK if t[0] == "block_return" else t[1] if t[0] == "param" else None
    if place is not None:
        return terms.cls(names[place]) if place in names else t
    if t[0] in ("union", "tuple"):
        parts = [with_variables(x, names) for x in t[1]]
        return terms.union_keeping_untyped(parts, keep_empty=True) if t[0] == "union" else (t[0], tuple(parts))
    if t[0] == "array":
        return (t[0], t[1] and with_variables(t[1], names))
    if t[0] == "hash":
        return (t[0], t[1] and with_variables(t[1], names), t[2] and with_variables(t[2], names))
    if t[0] == "record":
        return (t[0], tuple((k, with_variables(v, names), o) for k, v, o in t[1]))
    return t


@arrow("array<int>")
def given_as_they_are(form: pd.Series, args: pd.Series) -> pd.Series:
    """Places of the parameters that a body's form, or what it yields, gives as they are; none where the form waits for anything else."""

    def one(text, yielded):
        places: set[int] = set()

        class Seen(dict):
            def __contains__(self, k):
                places.add(k)
                return True

            def __missing__(self, k):
                return "T"

        if terms.is_deferred(with_variables(terms.loads(text), Seen())):
            return []
        for y in yielded if yielded is not None else []:
            if (t := terms.loads(y))[0] == "param":
                places.add(t[1])
        return sorted(places)

    return pd.Series([one(*x) for x in zip(form, args)], dtype="object")


def method_variables(forms: DataFrame, params: DataFrame, flows: DataFrame, contracts: DataFrame) -> DataFrame:
    """class, name, variables (array of struct(idx, variable, bound)): the type parameters that methods' forms give them, BLOCK for what the block gives.

    forms: class, name, singleton, form (the body's term, parameters and block in place); params: class, name, idx, pname, type (term); flows: class, name, idx, flow;
    contracts: see block_contracts.
    """
    asked = forms.join(contracts.select(*METHOD, "singleton", "args"), [*METHOD, "singleton"], "left")
    given = asked.select(*METHOD, F.explode(given_as_they_are("form", "args")).alias("idx")).distinct()
    block = given.filter(F.col("idx") == BLOCK)
    flows = flows.filter("flow <> 'called'").select(*METHOD, F.col("idx").cast("int").alias("idx"), "flow").union(block.select(*METHOD, "idx", F.lit("pass_through")))
    known = params.select(*METHOD, F.col("idx").cast("int").alias("idx"), "pname", rendered("type").alias("type")).union(block.select(*METHOD, "idx", F.lit("return"), F.lit("untyped")))
    found = inferred_type_params(known.join(given, [*METHOD, "idx"], "left_semi"), flows)
    return found.groupBy(*METHOD).agg(F.array_sort(F.collect_list(F.struct("idx", "variable", "bound"))).alias("variables"))


def block_contracts(nodes: DataFrame, values: DataFrame, definitions: DataFrame) -> DataFrame:
    """class, name, singleton, args (for each place the types yielded there), required: the blocks that methods yield to.

    A method that asks block_given? does without one.
    """
    defs = definitions.select("file", F.col("node").alias("scope"), *METHOD, "singleton")
    yields = nodes.filter("kind = 'yield'").select("file", "scope", F.col("node").alias("parent"))
    given = nodes.filter("up = 'yield' AND slot = 'arg' AND kind NOT IN ('blockarg', 'splat')").select("file", "parent", "node", "ord").join(values, ["file", "node"])
    places = yields.join(given, ["file", "parent"]).groupBy("file", "scope", "ord").agg(F.array_sort(F.collect_set("term")).alias("ts"))
    places = places.select("file", "scope", "ord", widened(merged_arguments("ts")).alias("term"))
    args = places.groupBy("file", "scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]).alias("args"))
    asks = nodes.filter("kind = 'call' AND name = 'block_given?'").select("file", "scope").distinct().withColumn("asks", F.lit(True))
    found = yields.select("file", "scope").distinct().join(args, ["file", "scope"], "left").join(asks, ["file", "scope"], "left").join(defs, ["file", "scope"])
    return found.select(*METHOD, "singleton", F.coalesce("args", F.array().cast("array<string>")).alias("args"), F.col("asks").isNull().alias("required"))
