import json

import pytest
from pyspark.sql import functions as F

from glossa.functions import returns as R
from glossa.functions import terms as T
from glossa.functions.columns import rendered
from glossa.operators import generators as G
from glossa.operators import render

CALLS = "class string, method string, names array<string>, options map<string,string>, file string, line int, ord int"


@pytest.fixture(scope="module")
def calls(spark):
    rows = [
        ("User", "attr_accessor", ["name"], {}), ("User", "include", ["A", "B"], {}), ("User", "enum", ["status", "active", "old"], {"prefix": "true"}),
        ("User", "has_many", ["line_items"], {}), ("Admin::User", "belongs_to", ["account"], {"optional": "true"}), ("User", "delegate", ["title"], {"to": "account", "prefix": "true", "allow_nil": "true"}),
        ("P", "Struct.new", ["x", "y"], {}), ("User", "alias_method", ["nick", "name"], {}), ("Util", "module_function", [], {}), ("User", "attribute", ["age", "integer"], {}),
        ("User", "define_method", ["dyn"], {"ret": '["string"]'}),
    ]
    return spark.createDataFrame([(*r, "f.rb", i, i) for i, r in enumerate(rows)], CALLS).cache()


def shown(df):
    return {r["name"]: r["t"] for r in df.select("name", rendered("ret").alias("t")).collect()}


def test_attributes_and_members(spark, calls):
    ivars = spark.createDataFrame([("User", "@name", '["string"]')], "class string, ivar string, type string")
    assert shown(G.attributes(calls, ivars)) == {"name": "String", "name=": "String"}
    assert set(shown(G.struct_members(calls))) == {"x", "x=", "y", "y="}
    assert [(r["module"]) for r in G.mixins(calls).orderBy("ord").collect()] == ["B", "A"]
    assert shown(G.defined_methods(calls)) == {"dyn": "String"}
    assert shown(G.typed_attributes(calls, lambda k: F.when(k == "integer", '["integer"]').otherwise('["untyped"]'))) == {"age": "Integer?", "age=": "Integer?", "age?": "bool"}


def test_enums_and_associations(spark, calls):
    got = shown(G.enum_methods(G.enum_values(calls)))
    assert got["status_active?"] == "bool" and got["not_status_old"] == "ActiveRecord::Relation[User]" and got["statuses"] == "Hash[String, untyped]"
    classes = spark.createDataFrame([("LineItem",), ("Admin::Account",), ("Account",)], "class string")
    found = G.associations(calls, classes)
    assert {(r["name"], r["target"], r["optional"]) for r in found.collect()} == {("line_items", "LineItem", True), ("account", "Admin::Account", True)}
    got = shown(G.association_methods(found))
    assert got["line_items"] == "ActiveRecord::Associations::CollectionProxy[LineItem]" and got["account"] == "Admin::Account?" and got["line_item_ids"] == "Array[Integer]" and got["build_account"] == "Admin::Account"


def test_delegation_and_module_functions(spark, calls):
    schema = "class string, name string, singleton boolean, param string, ret string, origin string, file string, line int"
    methods = spark.createDataFrame([("User", "account", False, None, '["class","Account"]', "source", "f", 1), ("Account", "title", False, None, '["string"]', "source", "f", 1), ("Util", "a", False, None, '["string"]', "source", "f", 1), ("Util", "b", False, None, '["string"]', "source", "f", 99), ("User", "name", False, None, '["string"]', "source", "f", 1)], schema)
    assert shown(G.delegated(G.delegations(calls), methods)) == {"account_title": "String?"}
    assert [(r["name"], r["singleton"]) for r in G.module_functions(calls, methods).collect()] == [("b", True)]
    assert shown(G.aliases(calls, methods)) == {"nick": "String"}


def test_returns():
    assert R.known_return(T.STRING, "upcase") == T.STRING and R.known_return(("lit_int", 1), "digits") == T.array(T.INTEGER)
    assert R.known_return(T.array(T.FLOAT), "sort") == T.array(T.FLOAT) and R.known_return(T.NIL, "to_s") is None
    assert R.known_return(("hash", T.SYMBOL, T.INTEGER), "invert") == ("hash", T.INTEGER, T.SYMBOL)
    assert R.known_return(T.cls("Date"), "strftime") == T.STRING and R.known_return(T.cls("ActiveSupport::TimeWithZone"), "tomorrow") == T.cls("ActiveSupport::TimeWithZone")
    post = T.cls("Post")
    assert T.render(R.relation_return("where", "model", post)) == "ActiveRecord::Relation[Post]"
    assert T.render(R.relation_return("first", "relation", post)) == "Post?"
    assert R.relation_return("with", "model", post, version=(7, 0)) is None and R.relation_return("load", "model", post) is None
    assert R.relation_return("delete", "proxy", post) == T.array(post) and R.relation_return("delete", "relation", post) == T.INTEGER
    rel = ("generic", R.RELATION_CLASS, (post,))
    assert R.records_receiver(rel, "length", False) == T.array(post) and R.records_receiver(rel, "select", True) == T.array(post)
    assert R.records_receiver(rel, "select", False) is None and R.records_receiver(rel, "map", False, {"map"}) == T.array(post)


def test_routes(spark):
    def call(method, *names, calls=None, **options):
        return {"method": method, "names": list(names), "options": options, "calls": calls or []}

    tree = [
        call("root"), call("resources", "users", calls=[call("resources", "posts", only=["index", "show"]), call("get", "preview", on="member"), call("get", "search", on="collection")]),
        call("namespace", "admin", calls=[call("resource", "profile"), call("resources", "categories", except_=None)]), call("get", "about-us"), call("get", "files/:id", as_=None),
        call("concern", "likable", calls=[call("resources", "likes", only="index"), call("concerns", "likable")]), call("resources", "photos", only=[], concerns=["likable"]),
        call("resources", "blogs", shallow=True, calls=[call("resources", "notes")]),
    ]
    for c in tree:
        c["options"].pop("as_", None)
    found = {r["name"]: r["arity"] for r in G.route_helpers(spark.createDataFrame([("routes.rb", json.dumps(tree))], "file string, calls string")).collect()}
    assert found["root"] == 0 and found["users"] == 0 and found["new_user"] == 0 and found["user"] == 1 and found["edit_user"] == 1
    assert found["user_posts"] == 1 and found["user_post"] == 2 and "new_user_post" not in found
    assert found["preview_user"] == 1 and found["search_users"] == 0
    assert found["admin_profile"] == 0 and found["edit_admin_profile"] == 0 and found["admin_category"] == 1 and found["new_admin_category"] == 0
    assert found["about_us"] == 0 and found["photo_likes"] == 1
    assert found["blog_notes"] == 1 and found["note"] == 1 and "photos" not in found
    rows = G.route_methods(spark.createDataFrame([("user", 1)], "name string, arity int")).collect()
    assert {(r["name"], tuple(r["params"])) for r in rows} == {("user_path", ("arg0",)), ("user_url", ("arg0",))}
    df = spark.createDataFrame([("a/:id/*rest", "admin/report-list")], "p string, n string").select(G.dynamic_segments(F.col("p")), G.route_name(F.col("n")))
    assert tuple(df.first()) == (2, "admin_report_list")


def test_extensions(spark, calls):
    ext = G.Extensions()

    @ext.register("first")
    def first(c):
        return G.defined_methods(c)

    @ext.register("second", ("gem_x",))
    def second(c):
        return G.defined_methods(c).withColumn("ret", F.lit('["nil"]'))

    assert shown(ext.apply(calls)) == {"dyn": "String"} and ext.markers(spark).first()["gem"] == "gem_x"


def test_rendered_text(spark):
    from glossa.functions import signatures as S

    classes = spark.createDataFrame([("B", "A", False, [], 1), ("A", None, True, ["T"], 0), ("E", None, False, [], 2)], "class string, superclass string, is_module boolean, type_params array<string>, ord int")
    mixins = spark.createDataFrame([("B", "M", "include", 0)], "class string, module string, kind string, ord int")
    constants = spark.createDataFrame([("B", "X", '["integer"]', None, 0), ("Object", "TOP", '["singleton","B"]', "class", 0)], "owner string, name string, type string, alias_kind string, ord int")
    sig = lambda text: json.dumps(S.parse_method_type(text))
    methods = spark.createDataFrame([("B", "m", False, "source", False, 0, sig("(1 a) -> nil"), False), ("B", "m", False, "source", True, 1, sig("(1 a) -> String | () -> nil"), False), ("A", "z", True, "source", False, 0, sig("() -> 1"), True), ("E", "hidden", False, "rbi", False, 0, sig("() -> nil"), True)], "class string, name string, singleton boolean, origin string, private boolean, ord int, overloads string, explicit boolean")
    text = [r["value"] for r in render.whole_text(classes, mixins, constants, methods).collect()]
    assert text == ["class TOP = B", "module A[T]\n  def self.z: () -> 1\nend\n", "class B < A\n  include M\n\n  X: Integer\n\n  private def m: (Integer a) -> String\n               | () -> nil\nend\n"]
