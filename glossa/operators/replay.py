"""Bodies replayed for what their callers give: a method whose value depends on its parameters has one return for each tuple of argument types.

Each distinct (method, argument types) is evaluated once, however many calls share it, as a method of its own: its body's form with the arguments in place goes
into the fixpoint of returns beside all other methods, and the result is joined back to the calls.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import terms
from glossa.functions.udf import arrow
from glossa.operators import bodies
from glossa.operators.recursion import resolve_returns
from glossa.plans.fixpoint import cut

KEYS = ["class", "name", "singleton"]


@arrow("string")
def with_arguments(form: pd.Series, args: pd.Series) -> pd.Series:
    """A body's form with argument types in the places of its parameters; a parameter that isn't given is untyped, calls on what is known are carried out."""

    def one(text, given):
        known = [terms.loads(a) for a in given]

        def put(x):
            if x[0] == "param":
                return known[x[1]] if x[1] < len(known) else terms.UNTYPED
            return terms.UNTYPED if x[0] in ("keyword_param", "block_return") else x

        return terms.dumps(bodies.settled(terms.transform(terms.loads(text), put)))

    return pd.Series([one(*x) for x in zip(form, args)], dtype="object")


def replayed(calls: DataFrame, forms: DataFrame, methods: DataFrame, paths: DataFrame) -> DataFrame:
    """site_id, ret of each call whose target's value depends on its parameters.

    calls: site_id, class (the method's owner), name, singleton, args (terms by place). forms: class, name, singleton, form (see bodies.method_returns). methods
    (class, name, singleton, ret) and paths are what other calls in the bodies are resolved by. Calls of methods that give the same whatever they are given are left out.
    """
    asks = forms.filter(F.contains("form", F.lit('["param",')))
    tuples = calls.select(*KEYS, "args").distinct().join(asks, KEYS)
    own = F.concat("name", F.lit("("), F.array_join("args", ","), F.lit(")"))
    rows = cut(tuples.select(*KEYS, "args", own.alias("own"), with_arguments("form", "args").alias("ret")))
    every = methods.select(*KEYS, "ret").unionByName(rows.select("class", F.col("own").alias("name"), "singleton", "ret"))
    found, _ = resolve_returns(every, paths)
    told = rows.select(*KEYS, "args", "own").join(found.select("class", F.col("name").alias("own"), "singleton", "ret"), ["class", "own", "singleton"])
    return calls.join(told, [*KEYS, "args"]).select("site_id", "ret")
