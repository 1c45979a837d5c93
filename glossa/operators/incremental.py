"""Returns kept up to date: after an edit only what follows from it is deleted and derived again.

A call is known by the name it asks for and the class it asks; a method that changed, came or went concerns the calls of its name whose receiver's lookup path
leads through its class. Their methods are affected, and so are those that call them, and so on: a semi-naive closure from the changed methods upward,
along calls as they stand before and after the edit. Affected methods go back to what their bodies say and into the fixpoint; all others stay finished and are
only joined where something asks for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.recursion import CALL, KEYS, parts, resolve_returns, waits
from glossa.plans.fixpoint import cut


def call_sites(raw: DataFrame) -> DataFrame:
    """KEYS, receiver, member, on_class: what each method's body calls, as far as its form tells. raw: methods with the terms of their bodies."""
    open_ = raw.filter(waits()).select(*KEYS, parts("ret", "class", "singleton").alias("p"))
    return open_.select(*KEYS, F.explode(F.array_union("p.direct", "p.inner")).alias("c")).select(*KEYS, "c.*").distinct()


def changed_methods(before: DataFrame, after: DataFrame) -> DataFrame:
    """KEYS of methods whose bodies differ, that came or that went. before, after: raw methods of the files that an edit touched."""
    a = before.groupBy(*KEYS).agg(F.array_sort(F.collect_list("ret")).alias("was"))
    b = after.groupBy(*KEYS).agg(F.array_sort(F.collect_list("ret")).alias("is"))
    return a.join(b, KEYS, "full_outer").filter(~F.col("was").eqNullSafe(F.col("is"))).select(*KEYS)


def affected(changed: DataFrame, sites: DataFrame, paths: DataFrame) -> DataFrame:
    """KEYS of all methods that follow from the changed ones (themselves too). sites: see call_sites; paths: class, owner, rank."""
    found = last = cut(changed.select(*KEYS).distinct())
    owners = paths.select(F.col("class").alias("receiver"), F.col("owner")).distinct()
    while True:
        asked = last.select(F.col("class").alias("owner"), F.col("name").alias("member"), F.col("singleton").alias("on_class")).join(owners, "owner").select(*CALL).distinct()
        new = cut(sites.join(asked, CALL, "left_semi").select(*KEYS).distinct().join(found, KEYS, "left_anti"))
        if new.isEmpty():
            return found
        found, last = cut(found.union(new)), new


def updated_returns(resolved: DataFrame, before: DataFrame, after: DataFrame, sites: DataFrame, raw: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The resolved methods after an edit, and the KEYS that were derived again.

    resolved: class, name, singleton, ret, as they were; before, after: the raw methods of the touched files, as they were and are; sites: call sites of all methods
    before the edit; raw: all raw methods after it; paths: lookup paths after it.
    """
    hit = affected(changed_methods(before, after), sites.unionByName(call_sites(after)).distinct(), paths)
    again = raw.join(hit, KEYS, "left_semi").select(*KEYS, "ret")
    # what is finished doesn't go into the fixpoint, and what waits for nobody's method is left as it was
    rest = resolved.join(hit, KEYS, "left_anti").select(*KEYS, "ret")
    found, _ = resolve_returns(again.unionByName(rest), paths)
    return found, hit
