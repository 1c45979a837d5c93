"""More fact queries, and kernels of operators that `catalog` does not reach. Imported by `catalog`, which registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from glossa import facts
from glossa.functions import binding, columns, compat, flow, inflect
from glossa.functions import terms as T
from glossa.operators import calls, diagnostics, extensions, generators, lookup, merge, provenance, queries
from glossa.sources import ddl
from glossa.sources import signatures as sources
from glossa.streaming import workspace

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# facts: (given, wanted) with the wanted side as SQL

KEYWORDS = [("tinyint(1)", "bool"), ("tinyint", "Integer"), ("interval", "ActiveSupport::Duration"), ("int4range", "Integer"), ("numrange", "untyped"), ("daterange", "Date"), ("character varying(9)[]", "Array[String]"), ("timestamp without time zone DEFAULT now()", "ActiveSupport::TimeWithZone"), ("double precision", "Float"), ("money", "BigDecimal"), ("bytea", "String"), ("blob", "untyped"), ("jsonb NOT NULL", "untyped"), ("inet", "IPAddr"), ("time", "Time")]


@query(facts.values(["definition", "type"], KEYWORDS))
def fact_definition_types(spark, sf_dir):
    df = spark.createDataFrame([(k,) for k, _ in KEYWORDS], "definition string")
    return df.select("definition", columns.rendered(ddl.definition_type(F.col("definition"))).alias("type"))


MAYBE = ("union", (T.INTEGER, T.NIL))
PROJECTED = [("Integer?", "Integer", "nil", "Integer"), ("bool", "true", "false", "bool"), ("nil", "-", "nil", "bot"), ("String", "String", "-", "String")]


@query(facts.values(["type", "truthy", "falsy", "non_nil"], PROJECTED))
def fact_projections(spark, sf_dir):
    df = spark.createDataFrame([(T.dumps(t),) for t in (MAYBE, T.BOOL, T.NIL, T.STRING)], "t string")
    show = lambda c: F.when(c.isNull(), "-").otherwise(columns.rendered(c))
    return df.select(columns.rendered("t").alias("type"), show(columns.truthy("t")).alias("truthy"), show(columns.falsy("t")).alias("falsy"), show(columns.non_nil("t")).alias("non_nil"))


SLOTS = [(2, "1,0,0,1"), (3, "1,1,0,1"), (5, "1,1,2,1"), (1, "1,0,0,0"), (0, "0,0,0,0")]


@query(facts.values(["given", "taken"], SLOTS))
def fact_positional_slots(spark, sf_dir):
    """How many arguments each of (a, b = 1, *rest, z) takes."""
    kinds = ["required", "optional", "rest", "required"]
    return spark.createDataFrame([(n, ",".join(map(str, binding.slots(kinds, n)))) for n, _ in SLOTS], "given int, taken string")


WORLD = compat.World({"A": frozenset({"A"}), "B": frozenset({"B", "A"}), "C": frozenset({"C"}), "M": frozenset({"M"})}, frozenset({"M"}))
FITS = [("B", "A", 2), ("A", "B", 1), ("C", "A", 0), ("C", "M", 1), ("X", "A", 1), ("B | C", "A", 1), ("C", "A | C", 2), ("untyped", "A", 1), ("String", "bool", 0), ("Integer", "Numeric", 2)]


@query(facts.values(["actual", "declared", "fits"], FITS))
def fact_compatibility(spark, sf_dir):
    df = spark.createDataFrame([(a, d) for a, d, _ in FITS], "actual string, declared string")
    return df.select("actual", "declared", diagnostics.compatibility(sources.type_term("actual"), sources.type_term("declared"), WORLD).alias("fits"))


CONTEXTS = [("user.na", "method", "user", "na"), ("Foo::B", "constant", "Foo", "B"), ("x.send(:up", "send", "x", "up"), ("if lo", "identifier", "", "lo")]


@query(facts.values(["before", "kind", "receiver", "prefix"], CONTEXTS))
def fact_completion_contexts(spark, sf_dir):
    df = spark.createDataFrame([(c[0],) for c in CONTEXTS], "before string")
    return df.select("before", lookup.completion_context(F.col("before")).alias("c")).select("before", "c.*")


CHECKED = [("sig { params(a: Integer, b: T.nilable(String)).returns(T::Boolean) }", "(Integer a, String? b) -> bool"), ("sig { void }", "-> void"), ("sig { returns(T::Array[T.any(A, B)]) }", "-> Array[A | B]")]


@query(facts.values(["sig", "signature"], CHECKED))
def fact_checked_signatures(spark, sf_dir):
    df = spark.createDataFrame([(s,) for s, _ in CHECKED], "sig string")
    return df.select("sig", sources.checked_signature("sig").alias("signature"))


COMMENTS = "#: (Integer) -> String\n#: (String) -> nil\ndef a; end\n\n#: () -> void\n\ndef b; end\nx = y #: Integer"


@query(facts.values(["def_line", "bodies"], [(3, "(Integer) -> String; (String) -> nil")]))
def fact_attached_comments(spark, sf_dir):
    lines = sources.source_lines(spark.createDataFrame([("f", COMMENTS)], "file string, content string"))
    return sources.attach_to_definitions(sources.signature_comments(lines), lines).select("def_line", F.array_join("bodies", "; ").alias("bodies"))


ROUND_TRIP = ["String?", "(Integer | String)?", "Array[Integer | String]", "Hash[Symbol, untyped]", "[Integer, String]", "{ a: Integer, ?b: String }", "singleton(User)", "(^(Integer) -> String)", "bool?"]


@query(facts.values(["text", "again"], [(t, t) for t in ROUND_TRIP]))
def fact_types_round_trip(spark, sf_dir):
    df = spark.createDataFrame([(t,) for t in ROUND_TRIP], "text string")
    return df.select("text", columns.rendered(sources.type_term("text")).alias("again"))


@query(facts.values(["line", "text"], [(0, "Cart#total: Float"), (1, "├─ Price#sum: Integer"), (2, "└─ Tax#rate: Float"), (3, "... 220 more declarations in 1 more levels; search the trace file for the rest")]))
def fact_why(spark, sf_dir):
    trace = facts.trace(spark)
    none = lambda kind: F.lit(None).cast(kind)
    evidence = "array<struct<file:string,line:int,type:string,in:string>>"
    full = trace.select("id", none("string").alias("kind"), "type", none("string").alias("origin"), none("string").alias("file"), none("int").alias("line"), none("string").alias("body"), "deps", none(evidence).alias("callers"), none(evidence).alias("writes"))
    return spark.createDataFrame(list(enumerate(provenance.why(full, "Cart#total"))), "line int, text string")


DSL = "class string, method string, names array<string>, options map<string,string>, file string, line int, ord int"


@query(facts.values(["name", "ret"], [("status_on?", "bool"), ("status_on!", "bool"), ("status_on", "ActiveRecord::Relation[U]"), ("not_status_on", "ActiveRecord::Relation[U]"), ("statuses", "Hash[String, untyped]")]))
def fact_enum_methods(spark, sf_dir):
    calls_ = spark.createDataFrame([("U", "enum", ["status", "on"], {"prefix": "true"}, "f", 1, 0)], DSL)
    return generators.enum_methods(generators.enum_values(calls_)).select("name", columns.rendered("ret").alias("ret"))


@query(facts.values(["class", "name", "ret"], [("J", "open?", "bool"), ("J", "may_close?", "bool"), ("J", "close", "bool"), ("J", "close!", "bool"), ("D", "body", "ActionText::RichText?"), ("D", "body=", "ActionText::RichText?")]))
def fact_extension_methods(spark, sf_dir):
    calls_ = spark.createDataFrame([("J", "aasm.state", ["open"], "f", 1), ("J", "aasm.event", ["close"], "f", 2), ("D", "has_rich_text", ["body"], "f", 3)], "class string, method string, names array<string>, file string, line int")
    mixins = spark.createDataFrame([], "class string, module string, file string, line int")
    return extensions.extension_methods(calls_, mixins).select("class", "name", columns.rendered("ret").alias("ret"))


PROJECT = {
    "a.rb": "class A < B\n  attr_reader :n\n  def initialize(n)\n    @n = n\n  end\n  def twice\n    make(2)\n  end\n  def make(k, x: 'y')\n    k\n  end\nend\n",
    "b.rb": "class B\n  def go\n    A.new('s')\n  end\nend\n",
}
PROJECT_TEXT = ["class A < B\n  def n: () -> String\n  def initialize: (String n) -> void\n  def twice: () -> Integer\n  def make: (Integer k, ?x: String) -> Integer\nend\n", "class B\n  def go: () -> A\nend\n"]


@query(facts.values(["value"], [(t,) for t in PROJECT_TEXT]))
def fact_project_signatures(spark, sf_dir):
    """From Ruby sources to signature text: parameters from calls in other files, returns along calls, both as the calls give them."""
    from glossa.plans.analyze import Analysis

    return Analysis(spark.createDataFrame(list(PROJECT.items()), "file string, content string")).text(generic=False)


@query(facts.values(["spec", "on", "off"], [("auto,+x,-y", "x", "y"), ("+a,-a", "", "a"), ("-a,a", "a", "")]))
def fact_library_specs(spark, sf_dir):
    df = spark.createDataFrame([("auto,+x,-y",), ("+a,-a",), ("-a,a",)], "spec string")
    return df.select("spec", merge.apply_spec(F.col("spec")).alias("p")).select("spec", F.array_join("p.on", ",").alias("on"), F.array_join("p.off", ",").alias("off"))


# kernels


@query("SELECT CAST(l_orderkey AS VARCHAR) AS path, count(*) AS given FROM lineitem GROUP BY 1 HAVING count(*) > 3 OR count(*) < 2")
def kernel_d06_arity(spark, sf_dir):
    """Lines of an order as arguments of a method that takes two or three."""
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("file")).agg(F.count("*").alias("positional"))
    zero = [F.lit(0).alias(c) for c in diagnostics.POSITION[1:]]
    params = F.array(*[F.struct(F.lit(n).alias("pname"), F.lit(k).alias("kind")) for n, k in (("a", "required"), ("b", "required"), ("c", "optional"))])
    found = diagnostics.arity_mismatches(rows.select("file", *zero, F.lit("m").alias("name"), F.lit("K").alias("receiver"), params.alias("params"), "positional", F.lit(False).alias("splat")))
    return found.join(rows.withColumnRenamed("file", "path"), "path").select("path", F.col("positional").alias("given"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS path FROM (SELECT l_orderkey, l_linenumber % 2 AS arm, bool_or(l_returnflag = 'R') AS has FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING NOT bool_or(has)""")
def kernel_d08_missing_keys(spark, sf_dir):
    """Orders as reads of a key from records that their lines make: reported if no record has it."""
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("arm")).agg(F.collect_set("l_returnflag").alias("keys"))
    by = rows.groupBy(F.col("l_orderkey").cast("string").alias("file")).agg(F.collect_list("keys").alias("arms"))
    zero = [F.lit(0).alias(c) for c in diagnostics.POSITION[1:]]
    return diagnostics.missing_record_keys(by.select("file", *zero, F.lit("R").alias("key"), "arms")).select("path")


@query("""WITH s AS (SELECT l_suppkey AS c, l_returnflag AS f FROM lineitem GROUP BY 1, 2), o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS path, count(*) FILTER (WHERE NOT has) AS lacking FROM (
SELECT l_orderkey, l_suppkey, EXISTS (SELECT 1 FROM s WHERE s.c = l_suppkey AND s.f = 'R') AND l_suppkey % 3 <> 0 AS has FROM o) GROUP BY 1 HAVING bool_or(has) AND bool_or(NOT has)""")
def kernel_d09_union_members(spark, sf_dir):
    """Orders as calls on unions of their suppliers; suppliers divisible by 3 never answer."""
    rows = _read(spark, sf_dir, "lineitem")
    arm = F.struct(F.col("l_suppkey").cast("string").alias("class"), F.lit(True).alias("named"), F.lit(True).alias("complete"))
    by = rows.select("l_orderkey", "l_suppkey").distinct().groupBy(F.col("l_orderkey").cast("string").alias("file")).agg(F.collect_list(arm).alias("arms"))
    surface = rows.filter("l_returnflag = 'R' AND l_suppkey % 3 <> 0").select(F.col("l_suppkey").cast("string").alias("class"), F.lit("m").alias("name"))
    zero = [F.lit(0).alias(c) for c in diagnostics.POSITION[1:]]
    found = diagnostics.union_missing_methods(by.select("file", *zero, F.lit("m").alias("name"), F.lit(False).alias("safe"), "arms"), surface)
    return found.select("path", F.size(F.split("unresolved_method", r" \| ")).cast("long").alias("lacking"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list_filter(list(event_id % 40), lambda x: x <> user_id % 40))), ',') AS ids FROM events GROUP BY 1")
def kernel_o04_sorted_ids(spark, sf_dir):
    by = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.col("event_id") % 40).alias("ids"))
    return by.select("user_id", F.array_join(F.transform(provenance.sorted_ids(F.col("ids"), F.col("user_id") % 40), lambda x: x.cast("string")), ",").alias("ids"))


@query("""SELECT site_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN '[Integer, String]' END AS type FROM (
SELECT o_orderkey AS site_id, CASE WHEN o_orderstatus <> 'P' THEN 1 END AS a, CASE WHEN o_totalprice > 1000 THEN 1 END AS b FROM orders)""")
def kernel_j27_picked_columns(spark, sf_dir):
    """Orders as calls that pick two columns by name; one may be unknown."""
    rows = _read(spark, sf_dir, "orders")
    names = F.array(F.when(F.col("o_orderstatus") != "P", "a").otherwise("gone"), F.when(F.col("o_totalprice") > 1000, "b").otherwise("gone"))
    known = spark.createDataFrame([("K", "a", '["integer"]'), ("K", "b", '["string"]')], "class string, name string, ret string")
    found = calls.column_arguments(rows.select(F.col("o_orderkey").alias("site_id"), F.lit("K").alias("class"), names.alias("names")), known)
    return found.select("site_id", F.when(F.col("type").isNotNull(), columns.rendered("type")).alias("type"))


@query("SELECT c_custkey AS class, 'd' AS name, CASE WHEN n_regionkey = 1 THEN '[\"string\"]' ELSE '[\"untyped\"]' END AS ret FROM customer JOIN nation ON c_nationkey = n_nationkey")
def kernel_j28_delegates(spark, sf_dir):
    found = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("class"), F.lit("d").alias("name"), F.col("c_nationkey").alias("to_class"), F.lit("t").alias("to_method"))
    methods = _read(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("class"), F.lit("t").alias("name"), F.lit('["string"]').alias("ret"))
    return calls.delegate_signatures(found, methods)


@query("""SELECT DISTINCT l_suppkey AS class, p_brand AS method FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 0
UNION SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 1 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def kernel_j25_includer_bound(spark, sf_dir):
    """Parts as modules whose calls hold on every supplier that mixes them in; odd ones ask for an ancestor."""
    parts = _read(spark, sf_dir, "part")
    dsl = parts.select(F.col("p_partkey").alias("module"), F.when(F.col("p_size") % 2 == 1, "Rich").alias("requires"), F.col("p_brand").alias("method"))
    mixed = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("class"), F.col("l_partkey").alias("module"))
    paths = _read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("class"), F.lit("Rich").alias("owner"))
    return generators.includer_bound(dsl, mixed, paths).select("class", "method").distinct()


@query("""WITH h AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f FROM lineitem), o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
k AS (SELECT l_orderkey, l_suppkey, (SELECT count(*) FROM h WHERE h.s = l_suppkey AND f IN ('A', 'R')) = 2 AND l_suppkey % 2 = 0 AS ok FROM o)
SELECT l_orderkey AS site_id, CASE WHEN bool_or(ok) THEN count(*) FILTER (WHERE ok) ELSE count(*) END AS arms FROM k GROUP BY 1""")
def kernel_p16_guarded_receivers(spark, sf_dir):
    """Suppliers of an order as arms of a union, narrowed to those that answer two names."""
    rows = _read(spark, sf_dir, "lineitem")
    by = rows.groupBy(F.col("l_orderkey").alias("site_id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("arms")).withColumn("guards", F.array(F.lit("A"), F.lit("R")))
    surface = rows.filter("l_suppkey % 2 = 0").select(F.col("l_suppkey").cast("string").alias("class"), F.col("l_returnflag").alias("name"))
    return queries.guarded_receivers(by, surface).select("site_id", F.size("arms").cast("long").alias("arms"))


@query("""SELECT o_custkey AS id, n AS name, arg_min(o, CASE o WHEN 'A::B' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS owner FROM (SELECT DISTINCT o_custkey FROM orders),
(SELECT CASE p_size % 3 WHEN 0 THEN 'A::B' WHEN 1 THEN 'A' ELSE '' END AS o, p_brand AS n FROM part WHERE starts_with(p_brand, 'Brand#1')) GROUP BY 1, 2""")
def kernel_p17_constants_by_prefix(spark, sf_dir):
    """Brands as constants of three scopes: of each name the innermost."""
    asked = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("A::B").alias("scope"), F.lit("Brand#1").alias("prefix")).distinct()
    owner = F.when(F.col("p_size") % 3 == 0, "A::B").when(F.col("p_size") % 3 == 1, "A").otherwise("")
    constants = _read(spark, sf_dir, "part").select(owner.alias("owner"), F.col("p_brand").alias("name"), F.lit("t").alias("type")).distinct()
    return lookup.constant_completion(asked, constants).select("id", "name", "owner")


@query("""WITH a AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS m FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_intersect(a.m, b.m)), ',') AS must, array_to_string(list_sort(list_distinct(list_concat(a.m, b.m))), ',') AS may FROM a JOIN b USING (user_id)""")
def kernel_a14_joined_states(spark, sf_dir):
    """Event types on two ways as block states."""
    rows = _read(spark, sf_dir, "events")

    def side(odd, name):
        m = F.collect_set("event_type")
        no = F.lit(False)
        return rows.filter(F.col("event_id") % 2 == odd).groupBy("user_id").agg(m.alias("m")).select("user_id", F.struct(F.col("m").alias("must"), F.col("m").alias("may"), no.alias("always"), no.alias("never"), no.alias("dead")).alias(name))

    met = side(0, "a").join(side(1, "b"), "user_id").select("user_id", flow.join_block_states(F.col("a"), F.col("b")).alias("j"))
    return met.select("user_id", F.array_join("j.must", ",").alias("must"), F.array_join("j.may", ",").alias("may"))


@query("""SELECT a.l_suppkey AS local, least(a.n, b.n) AS min_size FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b USING (l_suppkey)""")
def kernel_a15_element_facts(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem")
    side = lambda f: rows.filter(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("local")).agg(F.count("*").alias("min_size")).withColumn("truthy", F.array(F.lit(0)))
    return flow.join_element_facts(side("R"), side("A")).select("local", "min_size")


@query("SELECT p_brand || suffix AS name, max(p_size) AS arity FROM part, (VALUES ('_path'), ('_url')) s(suffix) GROUP BY 1")
def kernel_g17_route_methods(spark, sf_dir):
    helpers = _read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").alias("arity"))
    return generators.route_methods(helpers).select("name", F.size("params").alias("arity"))


@query("SELECT l_orderkey AS site_id, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'N' OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY 1, 2")
def kernel_j03_inbound_sites(spark, sf_dir):
    """A file's own call sites (flag N) and those of others that call its methods."""
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site_id"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("class"), F.lit("m").alias("method"), "l_returnflag")
    target = _read(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("class"), F.lit("m").alias("name"))
    return queries.inbound_sites(rows.filter("l_returnflag = 'N'").drop("l_returnflag"), rows.drop("l_returnflag"), target).select("site_id", "n").distinct()


@query("SELECT c_custkey, n_name || CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE '#' END || c_mktsegment AS id, n_name || '::' || c_mktsegment AS path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def kernel_f28_declaration_ids(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", provenance.method_id(F.col("n_name"), F.col("c_mktsegment"), F.col("c_custkey") % 2 == 0).alias("id"), inflect.join_scope(F.col("n_name"), F.col("c_mktsegment")).alias("path"))


@query("SELECT p_partkey, p_size // 10 AS major, p_size % 10 AS minor FROM part")
def kernel_f29_versions(spark, sf_dir):
    text = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"), F.lit("3"))
    return _read(spark, sf_dir, "part").select("p_partkey", sources.version_parts(text).alias("v")).select("p_partkey", "v.major", "v.minor")


@query("SELECT o_orderkey AS file FROM orders WHERE o_orderstatus <> 'F'")
def kernel_t07_unchanged_files(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.lit(1).alias("mtime_ns"), F.col("o_custkey").alias("len"), F.xxhash64("o_orderkey").alias("content_hash"), "o_orderstatus")
    stamps = rows.withColumn("len", F.when(F.col("o_orderstatus") == "F", -1).otherwise(F.col("len"))).drop("o_orderstatus")
    return workspace.unchanged(rows.drop("o_orderstatus"), stamps).select("file")


@query("SELECT s_suppkey AS class, 'unknown_ancestor' AS why FROM supplier WHERE s_nationkey % 5 = 0 UNION ALL SELECT s_suppkey, 'method_missing' FROM supplier WHERE s_nationkey % 5 = 1")
def kernel_j22_incomplete_classes(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier")
    paths = s.select(F.col("s_suppkey").cast("string").alias("class"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("owner"))
    own = s.select(F.col("s_suppkey").cast("string").alias("class"), F.lit(True).alias("user_defined"))
    nations = s.filter("s_nationkey % 5 <> 0").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("class"), F.lit(True).alias("user_defined")).distinct()
    methods = nations.filter("cast(substr(class, 2) as int) % 5 = 1").select("class", F.lit("method_missing").alias("name"))
    return lookup.incomplete_classes(paths, own.union(nations), methods, []).select(F.col("class").cast("long").alias("class"), "why")


@query("SELECT p_partkey AS id, list_contains(['Brand#11', 'Brand#12'], p_brand) AS shown FROM part")
def kernel_s34_active_libraries(spark, sf_dir):
    """Brands as libraries, active if a marker gem is locked."""
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("library"))
    gems = spark.createDataFrame([("Brand#11-gem",), ("Brand#12-gem",)], "gem string")
    active = sources.active_libraries(gems, rows.select("library", F.concat("library", F.lit("-gem")).alias("gem")).distinct())
    return rows.join(active.withColumn("shown", F.lit(True)), "library", "left").select("id", F.coalesce("shown", F.lit(False)).alias("shown"))

