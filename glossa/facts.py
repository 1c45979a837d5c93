"""Small code facts with known results, for the `fact_*` queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import inflect, terms
from glossa.functions.columns import rendered
from glossa.operators import lookup, schema
from glossa.sources import ddl

DDL = """
CREATE TABLE depot.parcels (
    number bigint NOT NULL,
    fragile boolean DEFAULT false NOT NULL,
    sheet jsonb,
    weight numeric(8,3),
    arrives date,
    marks text[],
    key text NOT NULL,
    goose_id bigint NOT NULL,
    label character varying(40),
    PRIMARY KEY (number)
);
CREATE TABLE `geese` (
    tame tinyint(1) NOT NULL,
    `ring` varchar(9),
    KEY by_ring (ring)
);
ALTER TABLE ONLY depot.parcels
    ADD CONSTRAINT carried_by FOREIGN KEY (goose_id) REFERENCES depot.geese(id);
"""
STRUCTURE_COLUMNS = [
    ("parcels", "number", "Integer", False), ("parcels", "fragile", "bool", False), ("parcels", "sheet", "untyped", True), ("parcels", "weight", "BigDecimal", True), ("parcels", "arrives", "Date", True),
    ("parcels", "marks", "Array[String]", True), ("parcels", "key", "String", False), ("parcels", "goose_id", "Integer", False), ("parcels", "label", "String", True), ("geese", "tame", "bool", False), ("geese", "ring", "String", True),
]
_RETURNS = [
    ("Parcel", "number", "Integer"), ("Parcel", "fragile", "bool"), ("Parcel", "sheet", "untyped"), ("Parcel", "weight", "BigDecimal?"), ("Parcel", "arrives", "Date?"), ("Parcel", "marks", "Array[String]?"),
    ("Parcel", "key", "String"), ("Parcel", "goose_id", "Integer"), ("Parcel", "label", "String?"), ("Goose", "tame", "bool"), ("Goose", "ring", "String?"),
]
ACCESSORS = [(c, n + s, "bool" if s == "?" else t) for c, n, t in _RETURNS for s in ("", "=", "?")] + [("Parcel", "goose", "Goose"), ("Parcel", "goose=", "Goose")]
ROUTES = [
    {"method": "root"}, {"method": "resources", "names": ["users"], "calls": [{"method": "resources", "names": ["posts"], "options": {"only": ["index", "show"]}}]},
    {"method": "namespace", "names": ["admin"], "calls": [{"method": "resource", "names": ["profile"], "options": {"except": ["new", "edit"]}}]}, {"method": "get", "names": ["about-us"]},
]
ROUTE_HELPERS = [("root", 0), ("users", 0), ("new_user", 0), ("user", 1), ("edit_user", 1), ("user_posts", 1), ("user_post", 2), ("admin_profile", 0), ("about_us", 0)]
SIGNATURES = "class A < B\n  def x: () -> Integer\n  module C\n  end\nend\ninterface _Each\n  def each: () { (untyped) -> void } -> void\nend\n"
SIGNATURE_CLASSES = [("A", "class", False), ("A::C", "module", True), ("_Each", "interface", True)]
RESOLVED = [("a", "Integer"), ("b", "Integer"), ("c", "Integer?"), ("d", "untyped"), ("e", "untyped"), ("f", "Array[Integer]")]
JOIN_CASES = [(terms.NIL, terms.UNTYPED), (terms.BOT, terms.UNTYPED), (terms.BOT, terms.INTEGER), (("lit_int", 1), terms.INTEGER), (("tuple", (terms.INTEGER,)), terms.array(terms.STRING))]
JOINS = [("nil", "untyped", "untyped", "nil"), ("bot", "untyped", "untyped", "untyped"), ("bot", "Integer", "Integer", "Integer | bot"), ("1", "Integer", "Integer", "Integer"), ("[Integer]", "Array[String]", "Array[Integer | String]", "Array[Integer | String]")]


def values(names: list[str], rows: list[tuple]) -> str:
    """SQL for these rows."""

    def one(v) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    listed = ", ".join(f"({', '.join(map(one, r))})" for r in rows)
    quoted = ", ".join(f'"{n}"' for n in names)
    return f"SELECT * FROM (VALUES {listed}) v({quoted})"


def structure(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("db/structure.sql", DDL)], "file string, content string")


def accessors(spark: SparkSession) -> DataFrame:
    """class, name, ret."""
    texts = structure(spark)
    found = ddl.structure_columns(texts)
    classes = schema.model_classes(found, project=inflect.Inflections({"geese": "goose"}))
    links = schema.associations(ddl.structure_foreign_keys(texts), found, classes)
    return schema.accessors(found, classes, links).select("class", "name", rendered("ret").alias("ret"))


def trace(spark: SparkSession) -> DataFrame:
    """A cart's total, from prices of 130 goods and rates of 90 countries."""
    rows = [("Cart#total", "Float", ["Price#sum", "Tax#rate"]), ("Price#sum", "Integer", [f"Good{k}#cents" for k in range(130)]), ("Tax#rate", "Float", [f"Country{k}.vat" for k in range(90)])]
    return spark.createDataFrame(rows, "id string, type string, deps array<string>")


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("config/routes.rb", json.dumps(ROUTES))], "file string, calls string")


def signature_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a.rbs", SIGNATURES)], "file string, content string")


def call_chain(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Methods a to f of one class, each by its return, and the class's lookup path."""
    call = lambda m: ("method_return", "K", m)
    rets = {"a": terms.INTEGER, "b": call("a"), "c": ("union", (call("b"), terms.NIL)), "d": call("e"), "e": call("d"), "f": terms.array(call("b"))}
    methods = spark.createDataFrame([("K", n, False, terms.dumps(t)) for n, t in rets.items()], "class string, name string, singleton boolean, ret string")
    classes = spark.createDataFrame([("K", None)], "class string, superclass string")
    mixins = spark.createDataFrame([], "class string, module string, kind string, ord int")
    return methods, lookup.ancestors(classes, mixins).select("class", "owner", F.col("rank"))
