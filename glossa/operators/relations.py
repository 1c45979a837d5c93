"""Calls on models, relations and association proxies: what their arguments, their block and the chain before them make of the answer.

The table of methods says what a call answers and what refines it; the refinements are one ordered decision over the shape of the arguments:
a literal list of columns reads the columns' types, a grouped relation calculates a hash, several ids or a list of them find an array, a limit takes an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import returns, terms
from glossa.operators.calls import column_arguments

UNTYPED, NIL, INTEGER = (terms.dumps(t) for t in (terms.UNTYPED, terms.NIL, terms.INTEGER))


def method_table(spark, version: tuple[int, int] = (99, 0)) -> DataFrame:
    """name, receiver, ret (with holes), form (with a block), refines: the methods that a version has. A fixed table of a few hundred rows."""
    rows = [(m, r, terms.dumps(returns.ANSWERS[a]), form, refines) for m, a, receivers, since, form, refines in returns.RELATION_METHODS if since <= version for r in receivers.split()]
    return spark.createDataFrame(rows, "name string, receiver string, ret string, form string, refines string")


def _array(term: Column) -> Column:
    return F.concat(F.lit('["array",'), term, F.lit("]"))


def _is(term: Column, *heads: str) -> Column:
    """Whether a term has one of these heads."""
    return F.coalesce(F.regexp_extract(term, r'^\["(\w+)"', 1).isin(*heads), F.lit(False))


def relation_calls(calls: DataFrame, columns: DataFrame, version: tuple[int, int] = (99, 0)) -> DataFrame:
    """site_id, ret: what each call returns; calls that the version doesn't have are left out.

    calls: site_id, receiver (model, relation or proxy), class (the model), primary_key (term or null), name, args (terms), names (literal column names
    or null), grouped (whether the chain groups), block. columns: class, name, ret.
    """
    model = F.concat(F.lit('["class","'), F.col("class"), F.lit('"]'))
    key = F.coalesce("primary_key", F.lit(INTEGER))
    relation = F.when(F.col("receiver") == "proxy", F.lit(returns.PROXY_CLASS)).otherwise(F.lit(returns.RELATION_CLASS))
    met = calls.join(F.broadcast(method_table(calls.sparkSession, version)), ["name", "receiver"])
    picked = column_arguments(met.filter(F.contains("refines", F.lit("column")) & (F.size("names") > 0)).select("site_id", "class", "names"), columns)
    met = met.join(picked.select("site_id", F.col("type").alias("row")), "site_id", "left")
    put = F.col("ret")
    for hole, value in (('["relation"]', F.concat(F.lit('["generic","'), relation, F.lit('",['), model, F.lit("]]"))), ('["model"]', model), ('["primary_key"]', key)):
        put = F.replace(put, F.lit(hole), value)
    first = F.get("args", F.lit(0))
    several = (F.size("args") > 1) | _is(first, "array", "tuple") | F.coalesce(F.startswith(first, F.lit('["class","Range')) | F.startswith(first, F.lit('["generic","Range')), F.lit(False))
    counted = F.when(F.col("name") == "count", F.lit(INTEGER)).otherwise(F.lit(UNTYPED))
    maybe = F.when(_is(F.col("row"), "untyped", "union", "nil"), F.col("row")).otherwise(F.concat(F.lit('["union",['), F.col("row"), F.lit(f",{NIL}]]")))
    refines = lambda what: F.contains("refines", F.lit(what))
    ret = (
        F.when(F.col("block") & (F.col("form") == "anything"), F.lit(UNTYPED))
        .when(F.col("block") & (F.col("form") == "records") & (F.col("name") == "select"), _array(model))
        .when(F.col("block") & (F.col("form") == "records") & (F.col("name") == "find"), F.concat(F.lit('["union",['), model, F.lit(f",{NIL}]]")))
        .when(F.col("grouped") & refines("groups"), F.concat(F.lit(f'["hash",{UNTYPED},'), counted, F.lit("]")))
        .when((F.col("refines") == "ids") & several, _array(model))
        .when((F.col("refines") == "limit") & (F.size("args") > 0), _array(model))
        .when((F.col("refines") == "columns") & F.col("row").isNotNull(), _array(F.col("row")))
        .when(refines("column") & F.col("row").isNotNull(), maybe)
        .otherwise(put)
    )
    return met.select("site_id", ret.alias("ret"))
