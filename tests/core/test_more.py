"""Operators that no other test reaches."""

import json

from pyspark.sql import functions as F

from glossa.functions import inflect
from glossa.functions import terms as T
from glossa.functions.columns import rendered
from glossa.operators import generators as G
from glossa.operators import lookup as L
from glossa.operators import provenance as P
from glossa.operators import queries as Q
from glossa.operators import schema
from glossa.sources import ddl
from glossa.sources import signatures as S
from glossa.streaming import workspace as W


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_models_and_their_tables(spark):
    models = spark.createDataFrame([("User", "Base", None), ("Admin::Report", "Base", None), ("Guest", "User", None), ("Legacy", "Base", "old_things")], "class string, superclass string, table_name string")
    assert rows(schema.table_models(models)) == {("User", "users"), ("Admin::Report", "admin_reports"), ("Guest", "users"), ("Legacy", "old_things")}
    tables = spark.createDataFrame([("admin_reports",), ("users",)], "table string")
    assert rows(schema.model_classes(tables, models)) == {("admin_reports", "Admin::Report"), ("users", "User")}
    keys = spark.createDataFrame([("f", "users", 1, "thing_id", "old_things")], "file string, table string, pos int, column string, references string")
    columns = spark.createDataFrame([("f", "users", 1, "x", "[]", True)], "file string, table string, pos int, column string, type string, nullable boolean")
    classes = schema.model_classes(tables.union(spark.createDataFrame([("old_things",)], "table string")))
    (found,) = schema.associations(keys, columns, classes, schema.table_models(models)).collect()
    assert (found["name"], found["target_class"], found["nullable"]) == ("thing", "Legacy", True)


def test_project_files(spark, tmp_path):
    found = inflect.project_inflections(["ActiveSupport::Inflector.inflections(:en) do |inflect|", "  inflect.irregular 'person', 'people'", '  inflect.acronym "API"'])
    assert found == inflect.Inflections({"people": "person"}, {"api": "API"})
    df = spark.createDataFrame([("3.2.1\n", None, None), (None, "nodejs 20\nruby 3.1.0", None), (None, None, "source 'x'\nruby '~> 2.7'"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(S.versions(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["3.2.1", "3.1.0", "2.7", None]
    lock = spark.createDataFrame([("GEM\n  specs:\n    rails (7.1.2)\n      activesupport (= 7.1.2)\n    aasm (5.5.0)\n",)], "content string")
    gems = S.locked_gems(lock)
    assert rows(gems) == {("rails", "7.1.2"), ("aasm", "5.5.0")}
    markers = spark.createDataFrame([("aasm", "aasm"), ("devise", "devise")], "library string, gem string")
    assert rows(S.active_libraries(gems, markers)) == {("aasm",)}
    assert tuple(gems.filter("gem = 'rails'").select(S.version_parts(F.col("version")).alias("v")).first()["v"]) == (7, 1)
    for name, text in {"db/schema.rb": 'create_table "a" do |t|\n  t.string "x"\nend\n', "db/structure.sql": "CREATE TABLE b (\n x text\n);\n", "sig/a.rbs": "class A end"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    columns, keys = ddl.schema_columns(spark, str(tmp_path))
    assert {r["table"] for r in columns.collect()} == {"a"} and keys is None
    (tmp_path / "db/schema.rb").unlink()
    assert {r["table"] for r in ddl.schema_columns(spark, str(tmp_path))[0].collect()} == {"b"}
    assert S.external_folders(spark, str(tmp_path)) == [f"{tmp_path}/sig"]
    features = spark.createDataFrame([("json", "json.rbs"), ("set", "set.rbs")], "feature string, file string")
    assert rows(S.feature_files(features, spark.createDataFrame([("json",)], "feature string"))) == {("json.rbs",)}


def test_aliases(spark):
    raw = {"id": T.INTEGER, "ids": T.array(T.cls("id")), "loop": T.array(T.cls("loop"))}
    assert S.resolve_aliases(raw)["ids"] == T.array(T.INTEGER)
    assert not any(x == T.cls("loop") for x in T.walk(S.resolve_aliases(raw)["loop"]))
    methods = spark.createDataFrame([("A", "x", False, "sig")], "class string, name string, singleton boolean, ret string")
    aliases = spark.createDataFrame([("A", "y", False, "x"), ("A", "z", False, "gone")], "class string, name string, singleton boolean, old string")
    assert {r["name"] for r in S.apply_method_aliases(methods, aliases).collect()} == {"x", "y"}


def test_completion_lists(spark):
    asked = spark.createDataFrame([(1, "A::B", "C"), (2, "", "c")], "id int, scope string, prefix string")
    constants = spark.createDataFrame([("A", "Cat", "x"), ("", "Cat", "y"), ("", "Cow", "z"), ("", "Dog", "w")], "owner string, name string, type string")
    got = {(r["id"], r["name"]): r["type"] for r in L.constant_completion(asked, constants).collect()}
    assert got == {(1, "Cat"): "x", (1, "Cow"): "z"}
    one = lambda *names: spark.createDataFrame([(2, n) for n in names], "id int, name string")
    ranked = L.identifier_completion(asked.select("id", "prefix"), one("cat"), one("cat", "call"), one("constant"))
    assert [(r["name"], r["kind"]) for r in ranked.filter("id = 2").orderBy("rank").collect()] == [("cat", "local"), ("call", "method"), ("constant", "constant"), ("case", "keyword"), ("class", "keyword")]
    capital = L.identifier_completion(spark.createDataFrame([(2, "B")], "id int, prefix string"), one("Bx"), one("By"), one("Bz"))
    assert [r["name"] for r in capital.orderBy("rank").collect()] == ["Bz", "Bx", "By"]
    assert L.builtin_interfaces(spark).filter("interface = '_Range'").count() == 3


def test_incomplete_surfaces(spark):
    paths = spark.createDataFrame([("A", "A"), ("A", "Gone"), ("B", "B"), ("C", "C"), ("C", "B"), ("R", "R"), ("R", "Rails::X")], "class string, owner string")
    classes = spark.createDataFrame([("A", True), ("B", True), ("C", True), ("R", True), ("Rails::X", False), ("Module", False)], "class string, user_defined boolean")
    methods = spark.createDataFrame([("B", "method_missing")], "class string, name string")
    assert rows(L.incomplete_classes(paths, classes, methods, ["Rails"])) == {("A", "unknown_ancestor"), ("B", "method_missing"), ("C", "method_missing"), ("R", "runtime_namespace"), ("Module", "universal")}
    mixins = spark.createDataFrame([("M", "N"), ("N", "O"), ("O", "M")], "class string, module string")
    assert ("M", "O") in rows(L.reachable_modules(mixins))


def test_trace_records(spark, tmp_path):
    schema_ = "id string, owner string, kind string, type string, raw_type string, origin string, file string, line int"
    body = T.dumps(("union", (("method_return", "", "y"), ("ivar", "@z"), ("receiver_method", ("singleton", "B"), "make"))))
    declared = spark.createDataFrame([("A#x", "A", "method", "String", body, "source", "a.rb", 1), ("A#y", "A", "method", "Integer", '["integer"]', "source", "a.rb", 2)], schema_)
    calls = spark.createDataFrame([("A#x", "b.rb", 9, "Integer", "B#go"), ("A#x", "b.rb", 9, "Integer", "B#go")], "id string, file string, line int, type string, in string")
    found = P.trace_records(declared, calls)
    assert found.filter("id = 'A#x'").first()["deps"] == ["A#y", "A@z", "B.make"] and len(found.filter("id = 'A#x'").first()["callers"]) == 1
    P.write_trace(found, str(tmp_path / "t"))
    again = P.read_trace(spark, str(tmp_path / "t"))
    assert again.count() == 2 and P.why(again, "A#x")[0] == "A#x: String  [source]  a.rb:1"
    df = spark.createDataFrame([("A", "m", True), ("A", "m", False)], "o string, m string, s boolean")
    assert [r[0] for r in df.select(P.method_id(F.col("o"), F.col("m"), F.col("s"))).collect()] == ["A.m", "A#m"]
    assert T.symbolic(("safe_nav", ("param", 0), T.STRING)) == "param(0)&.String" and T.escape('a"b#{c}') == 'a\\"b\\#{c}'


def test_sites_and_order(spark):
    kind = "site_id int, class string, method string"
    own, every = spark.createDataFrame([(1, "A", "x")], kind), spark.createDataFrame([(2, "B", "y"), (3, "A", "z")], kind)
    methods = spark.createDataFrame([("B", "y")], "class string, name string")
    assert {r["site_id"] for r in Q.inbound_sites(own, every, methods).collect()} == {1, 2}
    files = spark.createDataFrame([(1, "a"), (0, "b")], "ord int, path string")
    assert [r["v"] for r in Q.in_order(spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int"), files).collect()] == [2, 1]
    bodies = spark.createDataFrame([("f", "A", "m", False, '["param",0]'), ("g", "A", "n", False, '["nil"]')], "file string, class string, name string, singleton boolean, ret string")
    assert rows(Q.replayed_files(bodies, bodies)) == {("f",)}
    assert rows(Q.type_edges(spark.createDataFrame([("f", "return", '["union",[["class","A"],["generic","B",[["class","C"]]]]]')], "file string, kind string, type string"))) == {("f", "return", "A"), ("f", "return", "B"), ("f", "return", "C")}
    stamps = spark.createDataFrame([("a", 1, 2, 3)], "file string, mtime_ns long, len long, content_hash long")
    assert W.unchanged(stamps.union(spark.createDataFrame([("b", 1, 2, 3)], stamps.schema)), stamps).count() == 1
    assert W.watched_changes(spark.createDataFrame([("f", 1, "deleted", None)], "file string, generation long, event string, content string")).first()["op"] == "delete"


def test_framework_generators(spark):
    models = spark.createDataFrame([("Post", None), ("Odd", '["string"]')], "class string, primary_key string")
    got = {(r["class"], r["name"]): r["t"] for r in G.relation_methods(models, (7, 0)).select("class", "name", rendered("ret").alias("t")).collect()}
    assert got["Post", "where"] == "ActiveRecord::Relation[Post]" and got["Odd", "ids"] == "Array[String]" and got["Post", "first"] == "Post?" and ("Post", "with") not in got
    paths = spark.createDataFrame([("J", "ActiveJob::Base"), ("Mail", "ActionMailer::Base"), ("ActiveJob::Base", "ActiveJob::Base")], "class string, owner string")
    assert {r["class"] for r in G.framework_methods(paths).collect()} == {"J"}
    methods = spark.createDataFrame([("Mail", "hello", False, None, "[]", "public", "f", 1), ("Mail", "help", False, None, "[]", "private", "f", 1)], "class string, name string, singleton boolean, param string, ret string, visibility string, file string, line int")
    assert [(r["name"], r["singleton"]) for r in G.mailer_actions(methods, paths).collect()] == [("hello", True)]
    dsl = spark.createDataFrame([("M", None, "scope"), ("M", "Base", "validates")], "module string, requires string, method string")
    mixed = spark.createDataFrame([("A", "M"), ("B", "M")], "class string, module string")
    bound = G.includer_bound(dsl, mixed, spark.createDataFrame([("A", "Base"), ("B", "B")], "class string, owner string"))
    assert {(r["class"], r["method"]) for r in bound.collect()} == {("A", "scope"), ("B", "scope"), ("A", "validates")}
    df = spark.createDataFrame([(["index", "show"], ["show"]), (None, None)], "o array<string>, e array<string>")
    assert [r[0] for r in df.select(G.resource_actions(F.col("o"), F.col("e"))).collect()] == [["index"], G.ACTIONS]
    assert json.loads(T.dumps(T.map_children(("tuple", (T.NIL, T.INTEGER)), lambda t: T.STRING))) == ["tuple", [["string"], ["string"]]]
    assert T.replace_self(T.array(("self",)), T.cls("A")) == T.array(T.cls("A")) and T.replace_instance(("instance",), T.cls("A")) == T.cls("A")
    assert T.tuple_to_array(("tuple", (T.NIL,))) == T.array(T.NIL) and T.display(("union", (T.STRING, ("param", 0))))[0] == "union"
