from pyspark.sql import functions as F

from glossa.functions import flow
from glossa.functions.columns import rendered
from glossa.operators import extensions as X
from glossa.plans.fixpoint import reach


def test_rules(spark):
    calls = spark.createDataFrame(
        [("Job", "aasm.state", ["open", "shut"], "f", 1), ("Job", "aasm.event", ["close"], "f", 2), ("Doc", "has_rich_text", ["body"], "f", 3), ("Doc", "cache_index", ["slug"], "f", 4), ("Doc", "kredis_unique_list", ["tags"], "f", 5), ("Doc", "unknown", ["x"], "f", 6), ("Doc", "include", ["ImageUploader::Attachment(:photo)"], "f", 7)],
        "class string, method string, names array<string>, file string, line int",
    )
    mixins = spark.createDataFrame([("W", "Sidekiq::Job", "f", 1), ("Post", "Discard::Model", "f", 1), ("Post", "Draper::Decoratable", "f", 1)], "class string, module string, file string, line int")
    got = {(r["class"], r["name"]): r["t"] for r in X.extension_methods(calls, mixins).select("class", "name", rendered("ret").alias("t")).collect()}
    assert got["Job", "open?"] == "bool" and got["Job", "may_close?"] == "bool" and got["Doc", "body"] == "ActionText::RichText?"
    assert got["Doc", "fetch_by_slug"] == "Doc?" and got["W", "perform_async"] == "String?" and got["Post", "kept"] == "ActiveRecord::Relation[Post]"
    assert got["Doc", "photo"] == "Shrine::UploadedFile?" and got["Doc", "photo_url"] == "String" and got["Post", "decorate"] == "PostDecorator"
    few = X.extension_methods(calls, mixins, spark.createDataFrame([("aasm",)], "library string"))
    assert {r["class"] for r in few.collect()} == {"Job", "Doc"} and few.filter("name LIKE 'fetch%'").isEmpty()
    lists = {r["name"]: r["t"] for r in X.typed_lists(calls).select("name", rendered("ret").alias("t")).collect()}
    assert lists == {"tags": "Kredis::Types::UniqueList", "tags=": "Kredis::Types::UniqueList"}
    assert X.markers(spark).filter("library = 'gettext'").count() == 3


def test_receivers_and_scopes(spark):
    calls = spark.createDataFrame([(1, "String", "shellescape", False), (2, "ParseError", "message", False), (3, "Sidekiq", "logger", True), (4, "Thing", "pathmap", False), (5, "MailWorker", "jid", False), (6, "UserPolicy", "can?", False), (7, "Oj", "dump", True)], "site_id int, class string, name string, singleton boolean")
    got = {r["site_id"]: r["t"] for r in X.receiver_returns(calls).select("site_id", rendered("ret").alias("t")).collect()}
    assert got == {1: "String", 2: "String", 3: "Logger", 5: "String?", 6: "bool", 7: "String"}
    rows = X.scope_helpers(spark.createDataFrame([("admin_user",)], "scope string"), spark.createDataFrame([("A",)], "class string"))
    assert {r["name"]: r["t"] for r in rows.select("name", rendered("ret").alias("t")).collect()} == {"current_admin_user": "AdminUser?", "admin_user_signed_in?": "bool", "authenticate_admin_user!": "untyped", "admin_user_session": "untyped"}


def test_flow_joins(spark):
    kind = "struct<must:array<string>,may:array<string>,always:boolean,never:boolean,dead:boolean>"
    s = lambda must, may, always=False, dead=False: (must, may, always, False, dead)
    df = spark.createDataFrame([(s(["a", "b"], ["a", "b"], True), s(["b", "c"], ["b", "c"])), (s(["a"], ["a"], dead=True), s(["c"], ["c"], True))], f"a {kind}, b {kind}")
    got = [r["j"] for r in df.select(flow.join_block_states(F.col("a"), F.col("b")).alias("j")).collect()]
    assert (got[0]["must"], got[0]["may"], got[0]["always"]) == (["b"], ["a", "b", "c"], False) and got[1]["must"] == ["c"]
    arrays = lambda rows: spark.createDataFrame(rows, "local string, min_size int, truthy array<int>")
    assert [tuple(r) for r in flow.join_element_facts(arrays([("x", 3, [0, 1]), ("y", 1, [])]), arrays([("x", 2, [1, 2])])).collect()] == [("x", 2, [1])]
    hashes = lambda rows: spark.createDataFrame(rows, "local string, keys array<string>, complete boolean")
    rows = flow.join_key_facts(hashes([("h", ["a", "b"], True), ("g", ["a"], True)]), hashes([("h", ["b"], True), ("g", ["a"], True)])).orderBy("local").collect()
    assert [tuple(r) for r in rows] == [("g", ["a"], True), ("h", ["b"], False)]
    held = lambda t: spark.createDataFrame([("l", "K", "name", t)], "local string, class string, attribute string, type string")
    assert flow.join_receiver_facts(held('["nil"]'), held('["untyped"]')).first()["type"] == '["nil"]'


def test_self_effects(spark):
    own = spark.createDataFrame([("K", "a", ["@x"], False), ("K", "b", ["@y"], False), ("K", "c", [], False)], "class string, method string, ivars array<string>, opaque boolean")
    calls = spark.createDataFrame([("K", "a", "b"), ("K", "b", "a"), ("K", "c", "gone")], "class string, method string, callee string")
    got = {r["method"]: (r["ivars"], r["opaque"]) for r in flow.self_effects(own, calls, reach).collect()}
    assert got == {"a": (["@x", "@y"], False), "b": (["@x", "@y"], False), "c": ([], True)}
