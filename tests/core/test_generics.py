"""Type variables: names, unification, instantiated calls, block contracts."""

import pytest

from glossa.functions import terms as T
from glossa.operators import bodies, generics, relations
from glossa.plans.fixpoint import cut
from glossa.sources import syntax

VAR, OTHER = T.cls("T"), T.cls("U")


@pytest.mark.parametrize(
    "bases, taken, names",
    [(["rate", "limit"], [], ["R", "L"]), (["count", "cost"], [], ["C1", "C2"]), (["price", "part"], [], ["Pr", "Pa"]), (["line_no", "line_id"], [], ["LN", "LI"]), (["__"], [], ["T"]), (["word"], ["W"], ["W1"]), (["a", "b", "a2"], [], ["A", "B", "A2"]), ([], [], [])],
)
def test_names(bases, taken, names):
    got = generics.variable_names(bases, taken)
    assert len(set(got)) == len(got) and (got == names or bases == ["count", "cost"] and got == ["Cou", "Cos"])


@pytest.mark.parametrize(
    "pattern, given, want",
    [
        (VAR, T.STRING, {"T": [T.STRING]}), (T.array(VAR), ("tuple", (T.INTEGER, T.STRING)), {"T": [T.INTEGER, T.STRING]}), (("hash", VAR, OTHER), ("record", ((("sym", "a"), T.INTEGER, False),)), {"T": [T.SYMBOL], "U": [T.INTEGER]}),
        (T.union(VAR, T.NIL), T.union(T.STRING, T.NIL), {"T": [T.STRING]}), (T.union(VAR, T.NIL), T.NIL, {}), (("generic", "Box", (VAR,)), ("generic", "Box", (T.FLOAT,)), {"T": [T.FLOAT]}), (("generic", "Box", (VAR,)), ("generic", "Bag", (T.FLOAT,)), {}),
        (VAR, T.array(VAR), {}), (("tuple", (VAR, OTHER)), ("tuple", (T.INTEGER, T.NIL)), {"T": [T.INTEGER], "U": [T.NIL]}), (("tuple", (VAR, OTHER)), ("tuple", (T.INTEGER,)), {}), (T.array(VAR), T.union(T.array(T.INTEGER), T.array(T.STRING)), {"T": [T.INTEGER, T.STRING]}), (T.STRING, T.INTEGER, {}),
    ],
)
def test_unification(pattern, given, want):
    bound = {}
    generics.unify(pattern, given, {"T", "U"}, bound)
    assert {v: set(ts) for v, ts in bound.items()} == {v: set(ts) for v, ts in want.items()}


def test_calls_are_instantiated(spark):
    d = T.dumps
    number = d(T.union(T.INTEGER, T.FLOAT))
    table = [("K", "same", [("T", None)], [d(VAR)], d(VAR)), ("K", "pair", [("T", None)], [d(VAR), d(T.array(VAR))], d(T.array(VAR))), ("K", "num", [("T", number)], [d(VAR)], d(VAR)), ("K", "plain", [], [d(T.STRING)], d(T.NIL))]
    signatures = spark.createDataFrame(table, "class string, name string, variables array<struct<name:string,bound:string>>, params array<string>, ret string")
    calls = [(1, "K", "same", [d(("lit_int", 1))]), (2, "K", "same", []), (3, "K", "pair", [d(T.STRING), d(("tuple", (T.INTEGER, T.STRING)))]), (4, "K", "num", [d(T.STRING)]), (5, "K", "num", [d(("lit_int", 3))]), (6, "K", "plain", [d(T.STRING)]), (7, "K", "gone", [])]
    found = generics.instantiated(spark.createDataFrame(calls, "site_id int, class string, name string, args array<string>"), signatures)
    got = {r["site_id"]: T.render(T.loads(r["ret"])) for r in found.collect()}
    assert got.pop(3) in ("Array[Integer | String]", "Array[String | Integer]")
    assert got == {1: "Integer", 2: "untyped", 4: T.render(T.loads(number)), 5: "Integer", 6: "nil"}


def test_equal_calls_are_instantiated_once(spark):
    d = T.dumps
    signatures = spark.createDataFrame([("K", "same", [("T", None)], [d(VAR)], d(T.array(VAR)))], "class string, name string, variables array<struct<name:string,bound:string>>, params array<string>, ret string")
    rows = [(k % 3, "K", "same", None if k % 5 == 4 else [d(T.STRING if k % 2 else T.INTEGER)]) for k in range(100)]
    found = generics.instantiated(spark.createDataFrame(rows, "site_id int, class string, name string, args array<string>"), signatures)
    # shapes are done with, no function sees the calls
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = [(k, f"Array[{T.render(T.loads(a[0])) if a else 'untyped'}]") for k, _, _, a in rows]
    assert sorted((r["site_id"], T.render(T.loads(r["ret"]))) for r in found.collect()) == sorted(want)


def test_block_contracts(spark):
    text = "class K\ndef each\n  yield 1, 'a'\n  yield :s\nend\ndef maybe\n  yield if block_given?\nend\ndef none = 1\ndef self.own(x)\n  yield(x)\nend\nend\n"
    nodes = cut(syntax.nodes(spark.createDataFrame([("k", text)], "file string, content string")))
    found = generics.block_contracts(nodes, bodies.values(nodes), bodies.definitions(nodes))
    got = {r["name"]: ([T.render(T.loads(t)) for t in r["args"]], r["required"], r["singleton"]) for r in found.collect()}
    assert set(got["each"][0][0].split(" | ")) == {"Integer", "Symbol"} and got["each"][0][1:] == ["String"] and got["each"][1:] == (True, False)
    assert got["maybe"] == ([], False, False) and got["own"][1:] == (True, True) and "none" not in got


def test_relation_calls(spark):
    d, n = T.dumps, '["lit_int",1]'
    rows = [
        (1, "model", "Post", None, "find", [n], [], False, False), (2, "model", "Post", None, "find", [n, n], [], False, False), (3, "relation", "Post", None, "find", [d(T.array(T.INTEGER))], [], False, False), (4, "relation", "Post", None, "first", [], [], False, False),
        (5, "proxy", "Post", None, "first", [n], [], False, False), (6, "relation", "Post", None, "count", [], [], True, False), (7, "model", "Post", None, "pluck", [], ["title"], False, False), (8, "model", "Post", None, "pluck", [], ["title", "size"], False, False), (9, "model", "Post", None, "pick", [], ["size"], False, False),
        (10, "model", "Post", None, "pluck", [], ["lost"], False, False), (11, "model", "Post", None, "load", [], [], False, False), (12, "proxy", "Post", None, "where", [], [], False, False), (13, "model", "Post", '["string"]', "ids", [], [], False, False), (14, "relation", "Post", None, "find", [n], [], False, True), (15, "model", "Post", None, "find", [d(T.cls("Range"))], [], False, False),
    ]
    calls = spark.createDataFrame(rows, "site_id int, receiver string, class string, primary_key string, name string, args array<string>, names array<string>, grouped boolean, block boolean")
    columns = spark.createDataFrame([("Post", "title", d(T.STRING)), ("Post", "size", d(T.INTEGER))], "class string, name string, ret string")
    got = {r["site_id"]: T.render(T.loads(r["ret"])) for r in relations.relation_calls(calls, columns).collect()}
    many = "Array[Post]"
    assert got == {1: "Post", 2: many, 3: many, 4: "Post?", 5: many, 6: "Hash[untyped, Integer]", 7: "Array[String]", 8: "Array[[String, Integer]]", 9: "Integer?", 10: "Array[untyped]", 12: "ActiveRecord::Associations::CollectionProxy[Post]", 13: "Array[String]", 14: "Post?", 15: many}
    assert {r["site_id"] for r in relations.relation_calls(calls.withColumn("name", F_in_order()), columns, (6, 0)).collect()} == set()


def F_in_order():
    from pyspark.sql import functions as F

    return F.lit("in_order_of")
