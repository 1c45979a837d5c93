import json

import pytest
from pyspark.sql import functions as F

from glossa.operators import dependencies as D
from glossa.operators import lookup as L
from glossa.operators import merge as M
from glossa.operators import provenance as P


@pytest.fixture(scope="module")
def trace(spark, tmp_path_factory):
    records = [{"id": "Cart#total", "type": "Float", "deps": ["Price#sum", "Tax#rate"]}]
    records += [{"id": "Price#sum", "type": "Integer", "deps": [f"Good{k}#cents" for k in range(130)]}, {"id": "Tax#rate", "type": "Float", "deps": [f"Country{k}.vat" for k in range(90)]}]
    records += [{"id": "Loop#x", "type": "old"}, {"id": "Loop#x", "type": "untyped", "deps": ["Loop#y", "Gone#z"], "file": "a.rb", "line": 3, "callers": [{"file": "b.rb", "line": i, "type": "Integer", "in": "T#m"} for i in range(7)]}, {"id": "Loop#y", "kind": "unresolved", "deps": ["Loop#x"]}]
    path = tmp_path_factory.mktemp("trace") / "t.jsonl"
    path.write_text("\n".join([*map(json.dumps, records), "", '{"no": 1}']))
    return P.read_trace(spark, str(path)).cache()


def test_levels_and_why(spark, trace):
    root = spark.createDataFrame([("Cart#total",)], "root string")
    sizes = P.level_sizes(P.levels(trace, root))
    assert {r["depth"]: r["size"] for r in sizes.collect()} == {0: 1, 1: 2, 2: 220}
    assert P.closure(trace, root).count() == 3
    text = P.why(trace, "Cart#total")
    assert len(text) == 4 and text[-1] == "... 220 more declarations in 1 more levels; search the trace file for the rest"


def test_cycles_and_duplicates(spark, trace):
    assert trace.filter("id = 'Loop#x'").first()["type"] == "untyped"
    text = P.why(trace, "Loop#x")
    assert text[0] == "Loop#x: untyped  a.rb:3" and sum("caller" in t and "more" not in t for t in text) == 5
    assert "    ... 2 more callers in the trace" in text and "└─ Gone#z  (not in trace)" in text
    assert any(t.startswith("│  └─ Loop#x") and t.endswith("(see above)") for t in text)
    assert [r["id"] for r in P.find(trace, "#x").collect()] == ["Loop#x"]
    assert [r["id"] for r in P.find(trace, "Loop#y").collect()] == ["Loop#y"]


def test_dependency_files(spark):
    refs = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("d", "X")], "file string, symbol string")
    edges = spark.createDataFrame([("a", "X", "mixin"), ("d", "X", "constant")], "file string, symbol string, kind string")
    x = spark.createDataFrame([("X",)], "symbol string")
    files = lambda df: sorted(r["file"] for r in df.collect())
    assert files(D.referencing_files(refs, x)) == ["a", "b", "d"]
    assert files(D.referencing_files_by_kind(refs, edges, x, ["mixin"], True)) == ["a", "b"]
    assert files(D.dependent_files(refs, edges, x, ["mixin"])) == ["a"]
    defs = spark.createDataFrame([("a", "X")], "file string, symbol string")
    kinds = refs.withColumn("kind", F.when(F.col("file") == "a", "inheritance").otherwise("constant"))
    assert D.external_references(refs, defs).count() == 3 and D.external_references(kinds, defs).count() == 4


def test_bag_fingerprints(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2)], "k string, v int")
    b = spark.createDataFrame([("k", 2), ("k", 1), ("k", 2)], "k string, v int")
    one = spark.createDataFrame([("k", 2)], "k string, v int")
    f = lambda df: D.bag_fingerprint(df, ["k"], ["v"])
    assert D.changed(f(a), f(b), ["k"]).isEmpty()
    assert not D.changed(f(a), f(a.distinct()), ["k"]).isEmpty()
    assert D.changed(D.combine(f(a), f(one), ["k"]), f(a.union(one)), ["k"]).isEmpty()
    assert D.changed(D.remove(f(a), f(one), ["k"]), f(a.distinct()), ["k"]).isEmpty()


def test_lookup_paths(spark):
    classes = spark.createDataFrame([("Base", None), ("Child", "Base"), ("M", None), ("N", None), ("P", None)], "class string, superclass string")
    mixins = spark.createDataFrame([("Child", "M", "include", 0), ("Child", "N", "include", 1), ("Child", "P", "prepend", 2)], "class string, module string, kind string, ord int")
    methods = spark.createDataFrame([(c, n, False) for c, n in [("Base", "x"), ("M", "x"), ("N", "x"), ("Child", "y"), ("P", "y"), ("Base", "z")]], "class string, name string, singleton boolean")
    paths = L.ancestors(classes, mixins).cache()
    order = [r["owner"] for r in paths.filter("class = 'Child'").orderBy("rank").collect()]
    assert order == ["P", "Child", "N", "M", "Base"]
    calls = spark.createDataFrame([("Child", n, False) for n in "xyzw"], "class string, name string, singleton boolean")
    assert {r["name"]: r["owner"] for r in L.dispatch(calls, paths, methods).collect()} == {"x": "N", "y": "P", "z": "Base", "w": None}


def test_constants(spark):
    reads = spark.createDataFrame([(1, "C", "A::B"), (2, "C", "X"), (3, "::C", "A::B"), (4, "D", "A")], "id int, name string, scope string")
    consts = spark.createDataFrame([("A::C",), ("C",)], "path string")
    assert {r["id"]: r["path"] for r in L.resolve_constants(reads, consts).collect()} == {1: "A::C", 2: "C", 3: "C", 4: None}


def test_innermost_span(spark):
    import random

    rng = random.Random(3)
    spans = [("f", s, s + rng.choice([1, 5, 40, 300, 5000]), i) for i, s in enumerate(rng.sample(range(6000), 300))]
    points = [("f", rng.randrange(7000)) for _ in range(200)]
    got = L.innermost(spark.createDataFrame(points, "file string, offset long"), spark.createDataFrame(spans, "file string, start long, end long, ord int")).collect()
    for r in got:
        best = min(((e - s, o) for _, s, e, o in spans if s <= r["offset"] < e), default=None)
        assert (r["span"] and (r["span"]["end"] - r["span"]["start"], r["span"]["ord"])) == best


def test_points_meet_few_of_many_spans(spark, joined_rows):
    spans = [("f", -k % 700 - 350, k % 650 + 400, k) for k in range(3000)]
    found = L.innermost(spark.createDataFrame([("f", o) for o in range(-400, 600)], "file string, offset long"), spark.createDataFrame(spans, "file string, start long, end long, ord int"))
    for r in found.collect():
        best = min(((e - s, o) for _, s, e, o in spans if s <= r["offset"] < e), default=None)
        assert (r["span"] and (r["span"]["end"] - r["span"]["start"], r["span"]["ord"])) == best
    assert joined_rows(found) <= 11 * 1000


def test_includers(spark):
    schema = "class string, module string, kind string, ord int"
    mixins = spark.createDataFrame([("H", "M", "include", 0)], schema)
    paths = spark.createDataFrame([("H", "H")], "class string, owner string")
    methods = spark.createDataFrame([("H", "a")], "class string, name string")
    none = spark.createDataFrame([], "class string, why string")
    calls = spark.createDataFrame([("M", "a"), ("M", "b"), ("Lonely", "c")], "module string, name string")
    got = {tuple(r)[:2]: r["resolvable"] for r in L.resolvable_via_includers(calls, mixins, paths, methods, none).collect()}
    assert got == {("M", "a"): True, ("M", "b"): False, ("Lonely", "c"): True}


def test_merge_rules(spark):
    rows = [("A", "method", "x", "1", "rbs", True, 1), ("A", "method", "x", "2", "ruby_source", True, 0), ("A", "mixin", "m", "M", "rbs", True, 2), ("A", "mixin", "m", "N", "rbs", True, 1), ("A", "mixin", "m", "M", "rbi", True, 5), ("A", "is_module", "", "no", "ruby_source", True, 0), ("A", "is_module", "", "yes", "rbs", True, 1), ("B", "is_module", "", "no", "rbi", False, 0), ("B", "is_module", "", "yes", "rbs", False, 1)]
    got = M.merge_declarations(spark.createDataFrame(rows, "class string, declaration string, key string, value string, source string, user_defined boolean, ord int"))
    assert {(r["class"], r["declaration"], r["value"]) for r in got.collect()} == {("A", "method", "2"), ("A", "mixin", "N"), ("A", "mixin", "M"), ("A", "is_module", "no"), ("B", "is_module", "yes")}
    spec = spark.createDataFrame([("auto, +x, -y, +y, -x",)], "s string").select(M.apply_spec(F.col("s")).alias("p")).first()["p"]
    assert (spec["on"], spec["off"]) == (["y"], ["x"])


def test_completion(spark):
    df = spark.createDataFrame([("user.na",), ("Foo::B",), ("x.send(:up",), ("if lo",), ("a&.b",), ("",)], "t string")
    got = [r["c"] and (r["c"]["kind"], r["c"]["receiver"], r["c"]["prefix"]) for r in df.select(L.completion_context(F.col("t")).alias("c")).collect()]
    assert got == [("method", "user", "na"), ("constant", "Foo", "B"), ("send", "x", "up"), ("identifier", "", "lo"), ("method", "a", "b"), None]


def test_lookup_paths_of_random_graphs(spark):
    """Cyclic graphs against all simple paths."""
    import random

    from glossa.plans.fixpoint import ranked_reach

    rng, edges = random.Random(5), []
    for g in range(60):
        for n in range(6):
            for k, m in enumerate(rng.sample(range(6), rng.randrange(4))):
                edges.append((f"g{g}n{n}", f"g{g}n{m}", k))
    out = {}
    for s, d, k in edges:
        out.setdefault(s, []).append((k, d))
    want = {}

    def walk(root, at, path, seen):
        if path < want.get((root, at), [9]):
            want[root, at] = path
        for k, d in out.get(at, []):
            if d not in seen:
                walk(root, d, [*path, k], seen | {d})

    for n in {s for s, _, _ in edges} | {d for _, d, _ in edges}:
        walk(n, n, [], {n})
    df = spark.createDataFrame(edges, "src string, dst string, ord int")
    found = ranked_reach(df, spark.createDataFrame([], "class string"))
    assert {(r["class"], r["owner"]): list(r["rank"]) for r in found.collect()} == want
