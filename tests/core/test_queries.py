import json

from glossa.operators import queries as Q

SITES = "file string, start long, end long, ord int, kind string, name string, type string, receiver string, symbol string"


def sites(spark):
    rows = [("f", 0, 20, 0, "value", "whole", '["string"]', None, "A#x"), ("f", 5, 10, 1, "method_call", "call", '["union",[["class","User"],["nil"]]]', '["class","Repo"]', "Repo#find"), ("f", 5, 10, 2, "value", "late", '["integer"]', None, "A#z")]
    return spark.createDataFrame(rows, SITES)


def points(spark, *offsets):
    return spark.createDataFrame([("f", o) for o in offsets], "file string, offset long")


def test_positions(spark):
    got = {r["offset"]: (r["name"], r["text"]) for r in Q.hover(points(spark, 3, 5, 9, 10, 30), sites(spark)).collect()}
    assert got == {3: ("whole", "String"), 5: ("call", "User?"), 9: ("call", "User?"), 10: ("whole", "String")}
    assert Q.receivers(points(spark, 7), sites(spark)).first()["receiver"] == '["class","Repo"]'
    defined = spark.createDataFrame([("Repo#find", "repo.rb", 4)], "symbol string, file string, line int")
    assert [(r["def_file"], r["def_line"]) for r in Q.definitions(points(spark, 6), sites(spark), defined).collect()] == [("repo.rb", 4)]
    edge = sites(spark).filter("start = 5")
    assert [r["def_line"] for r in Q.definitions(points(spark, 10), edge, defined).collect()] == [4]
    classes = spark.createDataFrame([("User", "user.rb", 1)], "class string, file string, line int")
    assert [(r["class"], r["def_file"]) for r in Q.type_definitions(points(spark, 6), sites(spark), classes).collect()] == [("User", "user.rb")]


def test_explanations(spark):
    links = spark.createDataFrame([("Repo#find", f"C{i}", "call", i) for i in range(20)] + [("C1", "Repo#find", "call", 0)], "src string, dst string, kind string, ord int")
    rows = [json.loads(r["value"]) for r in Q.explanations(points(spark, 6), sites(spark), links).collect()]
    assert len(rows) == 17 and rows[0]["node"] == "Repo#find" and rows[0]["truncated"] and rows[0]["type"] == "User?"


def test_guards_and_subclasses(spark):
    calls = spark.createDataFrame([(1, ["A", "B"], ["x"]), (2, ["A", "B"], ["zz"]), (3, ["A"], [])], "site_id int, arms array<string>, guards array<string>")
    surface = spark.createDataFrame([("A", "x")], "class string, name string")
    assert {r["site_id"]: r["arms"] for r in Q.guarded_receivers(calls, surface).collect()} == {1: ["A"], 2: ["A", "B"], 3: ["A"]}
    paths = spark.createDataFrame([("P", "P", [0]), ("S", "S", [0]), ("S", "P", [1]), ("T", "P", [1]), ("T", "T", [0])], "class string, owner string, rank array<int>")
    methods = spark.createDataFrame([("S", "m", False, '["string"]'), ("T", "m", False, '["integer"]')], "class string, name string, singleton boolean, ret string")
    asked = spark.createDataFrame([("P", "m", False)], "class string, name string, singleton boolean")
    assert Q.subclass_returns(asked, paths, methods).first()["ret"] == '["union",[["integer"],["string"]]]'


def test_files(spark):
    found = Q.input_files(spark, ["z.rb", "lib", "z.rb"], lambda p: ["lib/b.rb", "lib/a.rb"] if p == "lib" else None)
    assert [r["path"] for r in found.orderBy("ord").collect()] == ["z.rb", "lib/a.rb", "lib/b.rb"]
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    marks = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "file string, asked int, done int")
    assert {r["file"]: r["pending"] for r in Q.pending(files, marks).collect()} == {"a": False, "b": True, "c": False}
    methods = spark.createDataFrame([("A", "m", "rbs_file"), ("B", "n", "source")], "class string, name string, origin string")
    after, touched = Q.reload_types(methods, spark.createDataFrame([("C", "k", "rbs_file")], "class string, name string, origin string"), spark.createDataFrame([("A",)], "class string"), ["rbs_file"])
    assert sorted(r["class"] for r in after.collect()) == ["B", "C"] and sorted(r["class"] for r in touched.collect()) == ["A", "C"]


def test_reports(spark):
    from glossa.operators import reports as R

    holes = spark.createDataFrame([("f", "K", "m", None, "method_return", "unknown", "x"), ("f", "K", "n", "a", "method_parameter", "missing_call_site", "x"), ("f", "K", "o", "a", "method_parameter", "missing_call_site", "x")], "file string, class string, member string, slot string, kind string, reason string, type string")
    top = R.hole_report(holes).first()
    assert (top["reason"], top["n"], top["examples"]) == ("missing_call_site", 2, ["K#n a", "K#o a"])
    assert {(r["what"], r["value"]): r["n"] for r in R.hole_summary(holes).collect()}["reason", "unknown"] == 1
    one = spark.createDataFrame([("class K",)], "value string")
    rows = spark.createDataFrame([(1, "x")], "line int, text string")
    assert json.loads(R.file_report(one, rows, rows.limit(0), rows).first()["value"]) == {"signatures": "class K", "diagnostics": [{"line": 1, "text": "x"}], "hovers": [], "lenses": [{"line": 1, "text": "x"}]}
    seed = R.scenario_seed(holes, spark.createDataFrame([("f", "class K; end")], "file string, content string")).first()["value"]
    assert seed.startswith("## K m unknown") and "class K; end" in seed
