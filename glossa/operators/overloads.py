"""Overloads chosen by the types of a call's arguments, over an index of ancestors.

Every class has its ancestors with their distance (`ancestry`), so that whether an argument fits a parameter, and how closely, is one equi-join on (class of
the argument, class of the parameter); overloads of a call are never compared with each other. An overload takes a call if all its arguments fit; of those that do, the least sum
of distances is the most specific. Ties are kept, and where no overload takes a call all of them are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.columns import widened
from glossa.plans.fixpoint import FEW, cut, dealt

#: How far from everything a parameter without a type is.
ANY = 1 << 20


def ancestry(paths: DataFrame) -> DataFrame:
    """class, ancestor, distance: by the place of the ancestor in the class's lookup path (class, owner, rank)."""
    by = paths.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("rank", "owner"))).alias("path"))
    return by.select("class", F.posexplode(F.transform("path", lambda p: p["owner"])).alias("distance", "ancestor"))


def _arms(term: str) -> F.Column:
    """The arms of a term, or the term itself."""
    return F.when(F.startswith(F.col(term), F.lit('["union",')), F.transform(F.from_json(F.get_json_object(term, "$[1]"), "array<array<string>>"), lambda a: F.to_json(a))).otherwise(F.array(F.col(term)))


#: What an answer depends on: calls that agree in these are answered once.
FORM = ["class", "name", "args"]


def typed_overloads(calls: DataFrame, args: DataFrame | None, overloads: DataFrame, params: DataFrame, ancestors: DataFrame) -> DataFrame:
    """site_id, overload: the most specific overloads that take each call.

    calls: site_id, class, name; args: site_id, pos, type (terms), or None where calls have their args themselves, as an array of pos and type in this order. overloads: class, name,
    overload, positional (how many parameters); params: class, name, overload, pos, type. A literal counts as its class; an argument of several types fits as far as its worst one;
    an untyped argument fits everything alike. Calls of one form are judged once, so only forms are paired with overloads; calls meet their form's answer in one join.
    """
    if args is not None:
        by = args.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("args"))
        calls = cut(calls.join(by, "site_id", "left"))
    forms = cut(calls.select(*FORM).distinct().withColumn("form", F.monotonically_increasing_id()))
    found = _judged(forms, overloads, params, ancestors).groupBy("form").agg(F.collect_list("overload").alias("overloads"))
    # one column, as nulls within are equal
    answers = cut(forms.join(found, "form").select(F.struct(*FORM).alias("asked"), "overloads"))
    calls = calls.select("site_id", F.struct(*FORM).alias("asked"))
    if answers.limit(FEW + 1).count() <= FEW:
        answers = F.broadcast(answers)
    else:
        calls = dealt(calls, "asked")
    return calls.join(answers, "asked").select("site_id", F.explode("overloads").alias("overload"))


def _judged(forms: DataFrame, overloads: DataFrame, params: DataFrame, ancestors: DataFrame) -> DataFrame:
    """form, overload: the most specific overloads that take each form (form, class, name, args)."""
    met = forms.select("form", "class", "name", F.coalesce(F.size("args"), F.lit(0)).alias("given")).join(overloads, ["class", "name"])
    given = forms.select("form", F.explode("args").alias("a")).select("form", "a.pos", widened("a.type").alias("type"))
    arms = given.select("form", "pos", F.explode(_arms("type")).alias("arm"))
    asked = met.select("form", "class", "name", "overload").join(params, ["class", "name", "overload"]).select("form", "overload", "pos", F.col("type").alias("wanted"))
    pairs = asked.join(arms, ["form", "pos"])
    kind = lambda c: F.when(F.startswith(c, F.lit('["class","')), F.get_json_object(c, "$[1]"))
    # only what parameters ask for
    asked_for = params.select(kind(F.col("type")).alias("of")).filter("of IS NOT NULL").distinct()
    of = cut(ancestors.select(F.col("class").alias("own"), F.col("ancestor").alias("of"), "distance").join(asked_for, "of", "left_semi"))
    pairs = pairs.withColumn("own", kind(F.col("arm"))).withColumn("of", kind(F.col("wanted"))).join(of, ["own", "of"], "left")
    untyped = F.lit('["untyped"]')
    far = F.when(F.col("arm") == F.col("wanted"), 0).when(F.col("wanted") == untyped, ANY).when(F.col("arm") == untyped, 0).otherwise(F.col("distance"))
    by = pairs.withColumn("far", far).groupBy("form", "overload", "pos").agg(F.max("far").alias("far"), F.max(F.col("far").isNull()).alias("miss"))
    by = by.groupBy("form", "overload").agg(F.sum("far").alias("far"), F.max("miss").alias("miss"), F.count("*").alias("placed"))
    judged = met.join(by, ["form", "overload"], "left")
    n = F.col("given")
    fits = (F.col("positional") == n) & ((n == 0) | ~F.coalesce("miss", F.lit(True)) & (F.col("placed") == n))
    judged = judged.withColumn("score", F.when(fits, F.coalesce("far", F.lit(0))))
    least = judged.groupBy("form").agg(F.min("score").alias("least"))
    return judged.join(least, "form").filter(F.col("least").isNull() | (F.col("score") == F.col("least"))).select("form", "overload")
