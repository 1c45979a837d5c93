import pytest
from pyspark.sql import functions as F

from glossa.functions import inflect, terms
from glossa.functions.columns import rendered
from glossa.operators import schema
from glossa.sources import ddl

SQL = """
CREATE TABLE depot.parcels (
    number bigint NOT NULL,
    fragile boolean DEFAULT false NOT NULL,
    sheet jsonb,
    rules jsonb NOT NULL,
    weight numeric(8,3),
    arrives date,
    marks text[],
    key text NOT NULL,
    heavy tinyint(1),
    travels interval,
    shelf int4range,
    price numrange,
    goose_id bigint NOT NULL,
    label character varying(40),
    PRIMARY KEY (number)
);
CREATE TABLE IF NOT EXISTS "geese" (
    "ring number" text,
    KEY by_ring (ring)
);
CREATE TABLE unfinished (
    id int,
"""
KEYS = """
ALTER TABLE ONLY depot.parcels
    ADD CONSTRAINT carried_by FOREIGN KEY (goose_id) REFERENCES depot.geese(id);
ALTER TABLE ONLY depot.parcels
    ADD CONSTRAINT sent_by FOREIGN KEY (sender_id) REFERENCES depot.clients(id);
ALTER TABLE ONLY depot.parcels
    ADD CONSTRAINT packed_by FOREIGN KEY (packer) REFERENCES depot.clients(id);
"""


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([("db/structure.sql", SQL.replace("CREATE TABLE unfinished", KEYS + "CREATE TABLE unfinished"))], "file string, content string")


def test_structure_columns(spark, texts):
    rows = ddl.structure_columns(texts).filter("table = 'parcels'")
    shown = {r["column"]: (r["t"], r["nullable"]) for r in rows.select("column", rendered("type").alias("t"), "nullable").collect()}
    assert shown == {
        "number": ("Integer", False), "fragile": ("bool", False), "sheet": ("untyped", True), "rules": ("untyped", False), "weight": ("BigDecimal", True), "arrives": ("Date", True), "marks": ("Array[String]", True),
        "key": ("String", False), "heavy": ("bool", True), "travels": ("ActiveSupport::Duration", True), "shelf": ("Integer", True), "price": ("untyped", True), "goose_id": ("Integer", False), "label": ("String", True),
    }
    tables = {r["table"] for r in ddl.structure_columns(texts).collect()}
    assert tables == {"parcels", "geese"}
    assert [r["column"] for r in ddl.structure_columns(texts).filter("table = 'geese'").collect()] == ["ring number"]


def test_accessors_and_associations(spark, texts):
    columns, keys = ddl.structure_columns(texts), ddl.structure_foreign_keys(texts)
    classes = schema.model_classes(columns, project=inflect.Inflections({"geese": "goose"}))
    assert {tuple(r) for r in classes.collect()} == {("parcels", "Parcel"), ("geese", "Goose")}
    links = schema.associations(keys, columns, classes)
    assert {(r["name"], r["target_class"], r["nullable"]) for r in links.collect()} == {("goose", "Goose", False), ("sender", "Client", True)}
    rows = schema.accessors(columns, classes, links, spark.createDataFrame([("Parcel", "label")], "class string, name string"))
    ret = {r["name"]: r["t"] for r in rows.filter("class = 'Parcel'").select("name", rendered("ret").alias("t")).collect()}
    assert ret["fragile?"] == "bool" and ret["weight"] == "BigDecimal?" and ret["goose"] == "Goose" and ret["sender="] == "Client?" and ret["sheet"] == "untyped"
    assert "label" not in ret and "label=" in ret and "sender?" not in ret
    dirty = schema.dirty_methods(columns, classes, spark.createDataFrame([("Parcel", "label_was"), ("Parcel", "label_change")], "class string, name string"))
    assert {r["name"]: r["t"] for r in dirty.select("name", rendered("ret").alias("t")).collect()} == {"label_was": "String?", "label_change": "[String?, String?]?"}


def test_inflections(spark):
    words = {"movies": "movie", "databases": "database", "categories": "category", "vertices": "vertex", "matrices": "matrix", "wives": "wife", "wolves": "wolf", "hives": "hive", "analyses": "analysis", "boxes": "box", "statuses": "status", "heroes": "hero", "users": "user", "class": "class", "s": "s", "ties": "ty"}
    df = spark.createDataFrame(list(words.items()), "w string, s string").select("w", "s", inflect.singularize(F.col("w")).alias("got"))
    assert {r["w"]: r["got"] for r in df.collect()} == words
    df = spark.createDataFrame([("admin_users", "LineItem", "city"), ("users", "HTMLPage", "boy")], "t string, n string, p string")
    got = df.select(inflect.classify(F.col("t")), inflect.namespaced_class(F.col("t")), inflect.underscore(F.col("n")), inflect.pluralize(F.col("p")), inflect.classify(F.lit("api_keys"), inflect.Inflections({}, {"api": "API"}))).collect()
    assert [tuple(r) for r in got] == [("AdminUser", "Admin::User", "line_item", "cities", "APIKey"), ("User", None, "h_t_m_l_page", "boys", "APIKey")]


def test_ruby_schema(spark):
    text = 'create_table "orders", id: :uuid, force: :cascade do |t|\n  t.string "name"\n  t.integer :n, default: 0\n  t.daterange "d", null: false\n  t.text "tags", array: true\n  t.bigint "u"\n  t.check_constraint "u IS NOT NULL"\nend\n'
    rows = ddl.ruby_schema_columns(spark.createDataFrame([("db/schema.rb", text)], "file string, content string"))
    got = {r["column"]: (r["t"], r["nullable"]) for r in rows.select("column", rendered("type").alias("t"), "nullable").collect()}
    assert got == {"id": ("String", False), "name": ("String", True), "n": ("Integer", False), "d": ("Range[Date]", False), "tags": ("Array[String]", True), "u": ("Integer", False)}


def test_checked_not_null(spark):
    df = spark.createDataFrame([("(geese.name IS NOT NULL)",), ("a IS NOT NULL AND b",), ('"x" is not null',)], "e string")
    assert [r[0] for r in df.select(ddl.checked_not_null(F.col("e"))).collect()] == ["name", None, "x"]


def test_scope(spark):
    df = spark.createDataFrame([("app/a.rb",), ("spec/a.rb",), (".git/a.rb",), ("vendor/a.rb",)], "p string")
    assert [r[0] for r in df.select(ddl.in_scope(F.col("p"), True)).collect()] == [True, False, False, False]
    assert terms.loads(None) == terms.UNTYPED
