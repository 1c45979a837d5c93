"""Replayed bodies and overloads by type."""

from glossa.functions import terms as T
from glossa.operators import bodies, overloads, replay
from glossa.plans.fixpoint import cut
from glossa.sources import syntax

D = T.dumps


def test_one_return_for_each_callers_type(spark):
    source = "class K\n  def same(x) = x\n  def wrap(x, y) = [x, y]\n  def loud(x) = x.upcase\n  def deep(x) = [x.helper]\n  def fixed = 1\nend\nclass Other\n  def helper = 'h'\nend\n"
    forms = cut(bodies.method_returns(cut(syntax.nodes(spark.createDataFrame([("k", source)], "file string, content string"))))).select("class", "name", "singleton", "form", "ret")
    paths = spark.createDataFrame([("K", "K", [0]), ("Other", "Other", [0])], "class string, owner string, rank array<int>")
    rows = [(1, "same", [D(T.STRING)]), (2, "same", [D(("lit_int", 2))]), (3, "same", [D(T.STRING)]), (4, "wrap", [D(T.NIL), D(T.FLOAT)]), (5, "wrap", [D(T.NIL)]), (6, "loud", [D(("lit_str", "a"))]), (7, "deep", [D(T.cls("Other"))]), (8, "fixed", []), (9, "same", [])]
    calls = spark.createDataFrame([(i, "K", n, False, a) for i, n, a in rows], "site_id int, class string, name string, singleton boolean, args array<string>")
    got = {r["site_id"]: T.render(T.loads(r["ret"])) for r in replay.replayed(calls, forms.drop("ret"), forms.drop("form"), paths).collect()}
    assert got == {1: "String", 2: "2", 3: "String", 4: "[nil, Float]", 5: "[nil, untyped]", 6: "String", 7: '["h"]', 9: "untyped"}


def test_the_most_specific_overload_is_kept(spark):
    paths = [("Dog", "Dog", [0]), ("Dog", "Pet", [1]), ("Dog", "Animal", [2]), ("Cat", "Cat", [0]), ("Cat", "Animal", [1]), ("Rock", "Rock", [0])]
    ancestors = overloads.ancestry(spark.createDataFrame(paths, "class string, owner string, rank array<int>"))
    table = [(0, [T.cls("Animal")]), (1, [T.cls("Pet")]), (2, [T.cls("Animal"), T.INTEGER]), (3, [T.UNTYPED]), (4, [T.cls("Cat")]), (5, [])]
    known = spark.createDataFrame([("K", "m", k, len(ps)) for k, ps in table], "class string, name string, overload int, positional int")
    params = spark.createDataFrame([("K", "m", k, i, D(t)) for k, ps in table for i, t in enumerate(ps)], "class string, name string, overload int, pos int, type string")
    given = {1: [T.cls("Dog")], 2: [T.cls("Cat")], 3: [T.cls("Dog"), ("lit_int", 1)], 4: [T.cls("Rock")], 5: [T.union(T.cls("Dog"), T.cls("Cat"))], 6: [], 7: [T.cls("Dog"), T.STRING], 8: [T.UNTYPED]}
    calls = spark.createDataFrame([(k, "K", "m") for k in given], "site_id int, class string, name string")
    args = spark.createDataFrame([(k, i, D(t)) for k, ts in given.items() for i, t in enumerate(ts)], "site_id int, pos int, type string")
    got = {}
    for r in overloads.typed_overloads(calls, args, known, params, ancestors).collect():
        got.setdefault(r["site_id"], set()).add(r["overload"])
    assert got == {1: {1}, 2: {4}, 3: {2}, 4: {3}, 5: {0}, 6: {5}, 7: set(range(6)), 8: {0, 1, 3, 4}}


def test_calls_of_one_form_are_judged_once(spark, monkeypatch):
    """Forms, not calls, meet the overloads; calls without arguments, of no known method and repeated ones get what they got."""
    met, real = [], overloads.cut
    monkeypatch.setattr(overloads, "cut", lambda df: met.append(stored := real(df)) or stored)
    known = spark.createDataFrame([("K", "m", 0, 1), ("K", "m", 1, 1), ("K", "m", 2, 0)], "class string, name string, overload int, positional int")
    params = spark.createDataFrame([("K", "m", 0, 0, D(T.INTEGER)), ("K", "m", 1, 0, D(T.STRING))], "class string, name string, overload int, pos int, type string")
    rows = [(k, "K", "m", [] if k % 4 == 3 else [(0, D((T.INTEGER, T.STRING, T.SYMBOL)[k % 4]))]) for k in range(400)] + [(0, "K", "m", [(0, D(T.INTEGER))]), (900, "K", "m", None), (901, "K", "other", [])]
    calls = spark.createDataFrame(rows, "site_id int, class string, name string, args array<struct<pos:int,type:string>>")
    ancestors = overloads.ancestry(spark.createDataFrame([("A", "A", [0])], "class string, owner string, rank array<int>"))
    got = sorted(tuple(r) for r in overloads.typed_overloads(calls, None, known, params, ancestors).collect())
    one = {0: [0], 1: [1], 2: [0, 1, 2], 3: [2]}
    assert got == sorted([(k, o) for k in range(400) for o in one[k % 4]] + [(0, 0), (900, 2)])
    assert met and max(df.count() for df in met) <= 6
