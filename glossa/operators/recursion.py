"""Returns along calls between methods: the least fixpoint, in rounds that grow with the logarithm of the longest chain.

A body's type is a union of arms. An arm that is a call of another method adds that method's type and nothing else, so methods whose open arms are all such calls
form a graph in which a method's type is the union of all finished arms that it reaches; a way back to itself adds nothing. Reaching is found by doubling: a row
leads from a method to those that are 2^k calls off, and each round joins the rows with themselves. A chain of a thousand takes ten rounds; a
circle ends when 2^k passes the number of methods.

Calls within a term (an array of a call, a call on a call) wait until their target is finished and are put in then. Where nothing moves any more, calls within
terms that lead back to their own method would give infinite types: they become untyped, and go where they stand directly under a union or a projection. What waits
for a method that nobody defines stays as it is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import terms
from glossa.functions.columns import union_type_keeping_empty
from glossa.functions.udf import arrow
from glossa.operators.lookup import dispatch
from glossa.plans.fixpoint import cut

KEYS = ["class", "name", "singleton"]
CALL = ["receiver", "member", "on_class"]
CALL_DDL = "struct<receiver:string,member:string,on_class:boolean>"
UNTYPED = terms.dumps(terms.UNTYPED)
#: Kinds of rows of the closure: a finished type that is reached, a method that is reached and goes on, something that must wait.
TYPE, ON, WAIT = 0, 1, 2


def target(x, owner: str, on_class: bool) -> tuple[str, str, bool] | None:
    """The method that a call in a body of owner stands for."""
    if x[0] == "method_return":
        return x[1] or owner, x[2], on_class and x[1] in ("", owner)
    if x[0] == "receiver_method" and x[1][0] in ("class", "generic", "singleton"):
        return x[1][1], x[2], x[1][0] == "singleton"
    return None


def _arms(t) -> list:
    return list(t[1]) if t[0] == "union" else [t]


@arrow(f"struct<known:string,direct:array<{CALL_DDL}>,inner:array<{CALL_DDL}>,nested:boolean>")
def parts(ret: pd.Series, owner: pd.Series, singleton: pd.Series) -> pd.DataFrame:
    """An open type's finished arms, the calls that are arms of it, those within arms, and whether some arm must be finished by putting types in."""

    def one(text, own, on_class):
        known, direct, inner, nested = [], [], [], False
        for arm in _arms(terms.loads(text)):
            if to := target(arm, own, bool(on_class)):
                direct.append(to)
            elif terms.is_deferred(arm):
                nested = True
                inner += [to for x in terms.walk(arm) if (to := target(x, own, bool(on_class)))]
            else:
                known.append(arm)
        rows = lambda found: [dict(zip(CALL, x)) for x in dict.fromkeys(found)]
        return terms.dumps(terms.union_keeping_untyped(known, keep_empty=True)) if known else None, rows(direct), rows(inner), nested

    return pd.DataFrame([one(*x) for x in zip(ret, owner, singleton)], columns=["known", "direct", "inner", "nested"])


def _put_in(t, known: dict, owner: str, on_class: bool):
    """t with known calls replaced, and projections of what is finished carried out."""

    def put(x):
        if to := target(x, owner, on_class):
            return known.get(to, x)
        if x[0] in terms.PROJECTIONS and not terms.is_deferred(x[1]):
            f = {"truthy": terms.project_truthy, "falsy": terms.project_falsy, "non_nil": terms.project_non_nil}[x[0]]
            return f(x[1]) or terms.BOT
        return terms.safe_navigation(x[1], x[2]) if x[0] == "safe_nav" else x

    return terms.transform(t, put)


@arrow("string")
def put_in(ret: pd.Series, owner: pd.Series, singleton: pd.Series, known: pd.Series) -> pd.Series:
    """A type with the types of finished calls (structs of CALL and ret) in their places."""

    def one(text, own, on_class, rows):
        table = {(r["receiver"], r["member"], bool(r["on_class"])): terms.loads(r["ret"]) for r in rows}
        return terms.dumps(_put_in(terms.loads(text), table, own, bool(on_class)))

    return pd.Series([one(*x) for x in zip(ret, owner, singleton, known)], dtype="object")


@arrow("string")
def opened(ret: pd.Series, owner: pd.Series, singleton: pd.Series, circular: pd.Series) -> pd.Series:
    """A type without its circular calls: gone where they are arms (or projected arms), untyped within arms."""

    def one(text, own, on_class, rows):
        back = {(r["receiver"], r["member"], bool(r["on_class"])) for r in rows}
        leads = lambda x: target(x, own, bool(on_class)) in back
        arms = [arm for arm in _arms(terms.loads(text)) if not leads(arm[1] if arm[0] in terms.PROJECTIONS else arm)]
        arms = [_put_in(arm, dict.fromkeys(back, terms.UNTYPED), own, bool(on_class)) for arm in arms]
        return terms.dumps(terms.union_keeping_untyped(arms, keep_empty=True)) if arms else UNTYPED

    return pd.Series([one(*x) for x in zip(ret, owner, singleton, circular)], dtype="object")


def waits() -> Column:
    return F.col("ret").rlike('"(method_return|receiver_method)"')


def reached(rows: DataFrame, methods: int) -> tuple[DataFrame, int]:
    """rows (mid, kind, to, term) once every ON row has been followed to its end, and the rounds. methods: how many there are."""
    rows, k = cut(rows.distinct()), 0
    while 1 << k < 2 * methods and not rows.filter(F.col("kind") == ON).isEmpty():
        step = rows.filter(F.col("kind") == ON).select("mid", F.col("to").alias("via"))
        there = rows.select(F.col("mid").alias("via"), "kind", "to", "term")
        rows, k = cut(step.join(there, "via").select("mid", "kind", "to", "term").union(rows.filter(F.col("kind") != ON)).distinct()), k + 1
    return rows, k


def _grouped(edges: DataFrame, name: str, *more: str) -> DataFrame:
    return edges.groupBy("mid").agg(F.array_sort(F.collect_set(F.struct(*CALL, *more))).alias(name))


def _circular(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges (mid, to) that lie on circles: what reaches what, by doubling. Only methods that wait for each other come here."""
    pairs = cut(edges.select("mid", "to").distinct())
    k, n = 0, pairs.count()
    while True:
        further = pairs.select("mid", F.col("to").alias("via")).join(pairs.select(F.col("mid").alias("via"), "to"), "via").select("mid", "to")
        pairs = cut(pairs.union(further).distinct())
        if (now := pairs.count()) == n:
            return edges.join(pairs.select(F.col("mid").alias("to"), F.col("to").alias("mid")), ["mid", "to"], "left_semi"), k
        k, n = k + 1, now


def resolve_returns(methods: DataFrame, paths: DataFrame) -> tuple[DataFrame, int]:
    """methods (class, name, singleton, ret, ...) with ret resolved along calls between them, and the number of rounds it took.

    Calls are dispatched once each, when they first come up. Each pass closes the graph of direct calls, then puts finished types into
    the others, until nothing moves.
    """
    state, rounds, told = cut(methods.withColumn("mid", F.monotonically_increasing_id())), 0, None
    paths, known = cut(paths), state.select(*methods.columns)
    own = state.select(F.col("class").alias("owner"), "name", "singleton", F.col("mid").alias("to"))
    while True:
        open_ = cut(state.filter(waits()).select("mid", *KEYS, "ret", parts("ret", "class", "singleton").alias("p")))
        if open_.isEmpty():
            break
        calls = open_.select("mid", F.col("p.nested").alias("nested"), F.explode(F.array_union("p.direct", "p.inner")).alias("c")).select("mid", "nested", "c.*")
        new = calls.select(*CALL).distinct()
        new = new if told is None else new.join(told, CALL, "left_anti")
        asking = new.select(F.col("receiver").alias("class"), F.col("member").alias("name"), F.col("on_class").alias("singleton"))
        found = dispatch(asking, paths, known).join(own, ["owner", "name", "singleton"], "left").groupBy(*KEYS).agg(F.min("to").alias("to")).toDF(*CALL, "to")
        told = cut(found if told is None else told.union(found))
        status = state.select(F.col("mid").alias("to"), "ret", (~waits()).alias("done")).join(open_.select(F.col("mid").alias("to"), F.col("p.nested").alias("later")), "to", "left")
        edges = cut(calls.join(told, CALL, "left").join(status, "to", "left"))
        done = F.coalesce("done", F.lit(False))
        # direct calls: the closure
        joined = open_.filter("NOT p.nested")
        kind = F.when(done, TYPE).when(F.col("to").isNotNull() & ~F.coalesce("later", F.lit(True)), ON).otherwise(WAIT)
        term = F.when(done, F.col("ret"))
        rows = edges.filter("NOT nested").select("mid", kind.alias("kind"), F.when(kind == ON, F.col("to")).alias("to"), term.alias("term"))
        rows = rows.union(joined.filter("p.known IS NOT NULL").select("mid", F.lit(TYPE), F.lit(None).cast("long"), "p.known"))
        closed, k = reached(rows, joined.count())
        ready = closed.groupBy("mid").agg(F.max("kind").alias("most"), F.max((F.col("kind") == WAIT).cast("int")).alias("held"), F.array_sort(F.collect_set(F.when(F.col("kind") == TYPE, F.col("term")))).alias("ts"))
        ready = cut(ready.filter("held = 0").select("mid", F.when(F.size("ts") == 0, UNTYPED).otherwise(union_type_keeping_empty("ts")).alias("now")))
        # calls within terms: those that are finished
        late = open_.join(ready, "mid", "left_anti")
        finished = edges.join(ready.select(F.col("mid").alias("to"), "now"), "to", "left").withColumn("ret", F.coalesce("now", F.when(done, F.col("ret")))).filter("ret IS NOT NULL")
        put = late.join(_grouped(finished, "known", "ret"), "mid").select("mid", put_in("ret", "class", "singleton", "known").alias("now"))
        changes = cut(ready.union(put))
        rounds += k + 1
        if changes.isEmpty():
            circular, k = _circular(edges.filter(F.col("to").isNotNull() & ~done).select("mid", "to", *CALL))
            changes = cut(open_.join(_grouped(circular, "back"), "mid").select("mid", opened("ret", "class", "singleton", "back").alias("now")))
            rounds += k
            if changes.isEmpty():
                break
        state = cut(state.join(changes, "mid", "left").withColumn("ret", F.coalesce("now", "ret")).drop("now"))
    return state.select(*methods.columns), rounds
