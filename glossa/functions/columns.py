"""Term functions as Arrow-batched column functions. Terms are JSON strings; a null term is untyped."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import functions as F

from glossa.functions.udf import arrow
from glossa.functions import returns, terms


def _one(f, kind: str):
    """A function of one term as a column function; equal terms of a batch are computed once."""

    @arrow(kind)
    def column(t: pd.Series) -> pd.Series:
        known = functools.cache(lambda text: f(terms.loads(text)))
        return t.map(known, na_action=None) if len(t) else t

    return column


def _term(f):
    def g(t):
        out = f(t)
        return None if out is None else terms.dumps(out)

    return _one(g, "string")


def _two(f):
    """A function of two terms as a column function."""

    @arrow("string")
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        known = functools.cache(lambda x, y: terms.dumps(f(terms.loads(x), terms.loads(y))))
        return pd.Series([known(x, y) for x, y in zip(a, b)], dtype="object")

    return column


def _many(f):
    """A function of a list of terms (array column, in its order); equal lists of a batch are computed once."""

    @arrow("string")
    def column(ts: pd.Series) -> pd.Series:
        known = functools.cache(lambda x: terms.dumps(f([terms.loads(t) for t in x])))
        return ts.map(lambda x: known(tuple(x) if x is not None else ()))

    return column


union_type = _many(terms.union_of)
union_type_keeping_untyped = _many(terms.union_keeping_untyped)
union_type_keeping_empty = _many(lambda ts: terms.union_keeping_untyped(ts, keep_empty=True))
merged_arguments = _many(terms.merge_arguments)
#: The type of [*a, *b, ...]; what has no to_a stands for itself.
splatted = _many(lambda ts: terms.splat_array(ts, lambda _: "missing"))
union_pair = _two(terms.union_with)
safe_navigation = _two(terms.safe_navigation)
replace_self = _two(terms.replace_self)
replace_instance = _two(terms.replace_instance)
truthy = _term(terms.project_truthy)
falsy = _term(terms.project_falsy)
non_nil = _term(terms.project_non_nil)
widened = _term(terms.widen)
widened_argument = _term(terms.widen_argument)
tuple_to_array = _term(terms.tuple_to_array)
displayed = _term(terms.display)
rendered = _one(terms.render, "string")
symbolic = _one(terms.symbolic, "string")
deferred_receiver = _one(terms.has_deferred_receiver, "boolean")
is_deferred = _one(terms.is_deferred, "boolean")
has_hole = _one(terms.contains_hole, "boolean")
referenced_classes = _one(terms.references, "array<string>")
heads = _one(lambda t: t[0], "string")


@arrow("string")
def known_return(receiver: pd.Series, method: pd.Series) -> pd.Series:
    """What a method of a well-known receiver returns; null if that isn't known."""

    @functools.cache
    def one(r, m):
        found = returns.known_return(terms.loads(r), m)
        return None if found is None else terms.dumps(found)

    return pd.Series([one(r, m) for r, m in zip(receiver, method)], dtype="object")


@arrow("string")
def records_receiver(receiver: pd.Series, method: pd.Series, block: pd.Series) -> pd.Series:
    """The array of records that a relation call runs on; null if the relation itself answers."""
    found = [returns.records_receiver(terms.loads(r), m, bool(b)) for r, m, b in zip(receiver, method, block)]
    return pd.Series([None if t is None else terms.dumps(t) for t in found], dtype="object")


@arrow("array<string>")
def canonical_order(ts: pd.Series) -> pd.Series:
    """Terms of an array in the canonical order."""
    return ts.map(lambda x: [terms.dumps(t) for t in sorted(map(terms.loads, x), key=terms.sort_key)])


def nullable_accessor(term: F.Column, nullable: F.Column) -> F.Column:
    """The type of a column's accessor: an untyped one stays untyped. JVM-side; term is never a union here."""
    untyped, nil = '["untyped"]', '["nil"]'
    return F.when(nullable & (term != untyped), F.concat(F.lit('["union",['), term, F.lit(f",{nil}]]"))).otherwise(term)


def union_agg(term: str, by: list[str], rows, mode=union_type, name: str = "type"):
    """The join of a column's terms in each group: distinct terms are gathered map-side, then normalized."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(term)).alias("_terms")).withColumn(name, mode("_terms")).drop("_terms")
