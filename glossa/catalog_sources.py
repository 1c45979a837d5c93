"""Kernels of sources, generators, extensions, rendering, merging and the workspace, on texts and calls made of the driver's tables, with their SQL.

Nations stand for files and classes below regions, parts for macro calls. Imported by `catalog`, which registers them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import columns, flow, inflect
from glossa.functions import terms as T
from glossa.operators import calls, coverage, extensions, flows, generators, generics, lookup, merge, provenance, queries, recursion, render, reports, schema
from glossa.plans.fixpoint import reach, shared_dir
from glossa.sources import ddl, ruby, scenarios
from glossa.sources import signatures as sources
from glossa.streaming import workspace

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _n(column: str) -> Column:
    return F.col(column).cast("string")


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


# signature files: one for each nation


def _signature_files(spark, sf_dir) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    content = _text(
        "class N", _n("n_nationkey"), " < R", _n("n_regionkey"), "\n  include M", (F.col("n_nationkey") % 3).cast("string"), "\n  attr_accessor a: Integer\n  def m: (Integer a, ?String b) -> String\n",
        "  def self.s: () -> R", _n("n_regionkey"), "?\n  alias k m\n  C: Float\nend\n",
    )
    return n.select(_text("n", _n("n_nationkey"), ".rbs").alias("file"), content.alias("content"))


@query("""SELECT 'n' || n_nationkey || '.rbs' AS file, row, replace(replace(name, '#', n_nationkey::VARCHAR), '%', (n_nationkey % 3)::VARCHAR) AS name, kind FROM nation,
(VALUES ('class', 'N#', 'class'), ('mixin', 'M%', 'include'), ('method', 'a', 'public'), ('method', 'a=', 'public'), ('method', 'm', 'public'), ('method', 's', 'public'), ('method_alias', 'k', 'm'), ('constant', 'C', 'constant')) v(row, name, kind)""")
def kernel_s10_s12_b23_declarations(spark, sf_dir):
    """What each signature file declares."""
    return sources.declarations(_signature_files(spark, sf_dir)).select("file", "row", "name", "kind")


@query("""SELECT 'n' || n_nationkey || '.rbs' AS file FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000)""")
def kernel_s19_s20_s21_class_index(spark, sf_dir):
    """Only the files that declare a needed class are loaded."""
    index = sources.classes_of_files(sources.declarations(_signature_files(spark, sf_dir)))
    needed = _read(spark, sf_dir, "supplier").filter("s_acctbal < 2000").select(_text("N", _n("s_nationkey")).alias("class"))
    return sources.files_for(index, needed)


@query("""SELECT 'N' || n_nationkey AS class, name, replace(ret, '#', n_regionkey::VARCHAR) AS text FROM nation, (VALUES
('m', 'def m: (Integer a, ?String b) -> String'), ('k', 'def k: (Integer a, ?String b) -> String'), ('s', 'def self.s: () -> R#?'), ('a', 'def a: () -> Integer'), ('a=', 'def a=: (Integer a) -> Integer')) v(name, ret)""")
def kernel_s13_b21_b24_k03_method_lines(spark, sf_dir):
    """Declared methods and those that aliases give, as text again."""
    declared = sources.declarations(_signature_files(spark, sf_dir))
    own = declared.filter("row = 'method'").select(F.col("owner").alias("class"), "name", "singleton", "overloads")
    aliases = declared.filter("row = 'method_alias'").select(F.col("owner").alias("class"), "name", "singleton", F.col("kind").alias("old"))
    rows = sources.apply_method_aliases(own, aliases)
    return rows.select("class", "name", render.method_line("name", "overloads", "singleton", F.lit(False), F.lit(True)).alias("text"))


@query("SELECT 'N' || n_nationkey AS class, CAST('R' || n_regionkey AS VARCHAR) AS superclass, 'M' || (n_nationkey % 3) AS module, 'C: Float' AS constant FROM nation")
def kernel_s11_k05_classes_and_constants(spark, sf_dir):
    declared = sources.declarations(_signature_files(spark, sf_dir))
    held = sources.constants(declared).select(F.col("owner").alias("class"), render.constant_line(F.col("name"), F.col("type"), F.col("alias_kind")).alias("constant"))
    mixed = sources.mixins(declared).select("class", "module")
    return sources.classes(declared).select("class", "superclass").join(mixed, "class").join(held, "class")


@query("SELECT p_brand AS file FROM part GROUP BY 1 HAVING bool_or(p_size = 7)")
def kernel_s22_s23_feature_files(spark, sf_dir):
    """Brands as signature files of the sizes they come in; size 7 is required."""
    features = _read(spark, sf_dir, "part").select(_n("p_size").alias("feature"), F.col("p_brand").alias("file"))
    return sources.feature_files(features, spark.createDataFrame([("7",)], "feature string"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '(' || 'Integer a, T' || p_size || '? b) -> bool' WHEN 1 THEN '-> void' WHEN 2 THEN '(Array[T' || p_size || '] a) -> Hash[Symbol, Integer]' ELSE '(singleton(T' || p_size || ') a) -> (T' || p_size || ' | String)' END AS signature FROM part""")
def kernel_s18_f20_f21_checked_signatures(spark, sf_dir):
    """Runtime-checked signatures of parts as method types."""
    t = _text("T", _n("p_size"))
    k = F.col("p_size") % 4
    sig = F.when(k == 0, _text("sig { params(a: Integer, b: T.nilable(", t, ")).returns(T::Boolean) }")).when(k == 1, F.lit("sig { void }"))
    sig = sig.when(k == 2, _text("sig { params(a: T::Array[", t, "]).returns(T::Hash[Symbol, Integer]) }")).otherwise(_text("sig { params(a: T.class_of(", t, ")).returns(T.any(", t, ", String)) }"))
    return _read(spark, sf_dir, "part").select("p_partkey", sources.checked_signature(sig).alias("signature"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Array[T' || p_size || ']' WHEN 1 THEN '(String | T' || p_size || ')?' WHEN 2 THEN '{ a: T' || p_size || ', ?b: Integer }' WHEN 3 THEN '[T' || p_size || ', nil]' ELSE '-' END AS shown FROM part""")
def kernel_s14_f22_types_of_text(spark, sf_dir):
    """Types of parts written with other spacing, parsed and rendered; what doesn't parse is null."""
    t, k = _text("T", _n("p_size")), F.col("p_size") % 5
    text = F.when(k == 0, _text("Array[ ", t, " ]")).when(k == 1, _text("( ", t, "|String )?")).when(k == 2, _text("{a: ", t, ",?b: Integer}")).when(k == 3, _text("[", t, ",nil]")).otherwise(_text("Array[", t))
    term = sources.type_term(text)
    return _read(spark, sf_dir, "part").select("p_partkey", F.when(term.isNull(), "-").otherwise(columns.rendered(F.coalesce(term, F.lit('["nil"]')))).alias("shown"))


COMMENTED = ["#: (Integer) -> String", "# @rbs x: Integer", "a = b #: String", "#: self as Foo", "#: type t = Integer", "# plain", "require 'set'"]


@query("""SELECT 'f' || (p_partkey % 50) AS file, CASE p_size % 7 WHEN 0 THEN 'method' WHEN 1 THEN 'rbs' WHEN 2 THEN 'assertion' WHEN 3 THEN 'self_bind' ELSE 'alias' END AS kind,
CASE p_size % 7 WHEN 0 THEN '(Integer) -> String' WHEN 1 THEN 'x: Integer' WHEN 2 THEN 'String' WHEN 3 THEN 'Foo' ELSE 'type t = Integer' END AS body, count(*) AS n FROM part WHERE p_size % 7 < 5 GROUP BY 1, 2, 3""")
def kernel_s15_s17_b39_b40_comments(spark, sf_dir):
    """Comments that carry types, by kind, in files whose lines the parts give."""
    lines = sources.source_lines(_commented(spark, sf_dir))
    return sources.signature_comments(lines).groupBy("file", "kind", "body").agg(F.count("*").alias("n"))


def _commented(spark, sf_dir):
    line = F.array(*map(F.lit, COMMENTED))[(F.col("p_size") % 7).cast("int")]
    rows = _read(spark, sf_dir, "part").select(_text("f", (F.col("p_partkey") % 50).cast("string")).alias("file"), F.struct("p_partkey", line.alias("line")).alias("l"))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x.line), "\n").alias("content"))


@query("""SELECT 'f' || (p_partkey % 50) AS file, CAST(row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS INTEGER) AS line, 'set' AS feature, p_size FROM part QUALIFY p_size % 7 = 6""")
def kernel_b45_required_features(spark, sf_dir):
    rows = sources.required_features(sources.source_lines(_commented(spark, sf_dir)))
    place = _read(spark, sf_dir, "part").select(_text("f", (F.col("p_partkey") % 50).cast("string")).alias("file"), "p_partkey", "p_size")
    from pyspark.sql import Window

    place = place.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("p_partkey"))).drop("p_partkey")
    return rows.join(place, ["file", "line"])


@query("""SELECT 'T' || n_nationkey AS "table", c AS "column", replace(t, '#', '') AS type, n AS nullable FROM nation, (VALUES ('id', 'Integer', false), ('name', 'String', true), ('size', 'Integer', false), ('tags', 'Array[String]', true), ('day', 'Date', false)) v(c, t, n)""")
def kernel_s24_s25_f05_ruby_schema(spark, sf_dir):
    """Nations as tables of a Ruby schema; a check constraint makes a column not null."""
    table = _text('  create_table "T', _n("n_nationkey"), '", force: :cascade do |t|\n    t.string "name"\n    t.integer "size", default: 0\n    t.string "tags", array: true\n    t.date "day"\n    t.check_constraint "(day IS NOT NULL)", name: "c"\n  end')
    rows = _read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("file"), F.struct("n_nationkey", table.alias("t")).alias("t"))
    texts = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x.t), "\n").alias("content"))
    found = ddl.ruby_schema_columns(texts)
    return found.select("table", "column", columns.rendered("type").alias("type"), "nullable")


@query("""SELECT p_partkey, p_size % 5 >= 3 AS production, p_size % 5 NOT IN (1, 2) AS every FROM part""")
def kernel_s01_s02_scanned_files(spark, sf_dir):
    """Files below tests, hidden and skipped folders are left out."""
    folder = F.array(*map(F.lit, ["test", ".git", "vendor", "lib", "app"]))[(F.col("p_size") % 5).cast("int")]
    path = _text(folder, "/", F.lower("p_brand"), "/x.rb")
    return _read(spark, sf_dir, "part").select("p_partkey", ddl.in_scope(path, True).alias("production"), ddl.in_scope(path, False).alias("every"))


@query("""WITH f AS (SELECT 0 AS k, r_regionkey AS a, 0 AS b, r_name AS path FROM region WHERE r_regionkey >= 3 UNION ALL SELECT 0, r_regionkey, n_nationkey, r_name || '/' || n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 3)
SELECT CAST(row_number() OVER (ORDER BY a, path) - 1 AS INTEGER) AS ord, path FROM f""")
def kernel_s03_input_files(spark, sf_dir):
    """Regions as arguments: the first three are folders of nations, listed in order; a repeated one counts once."""
    r = [x["r_name"] for x in _read(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    inside: dict[str, list[str]] = {}
    for x in _read(spark, sf_dir, "nation").collect():
        inside.setdefault(r[x["n_regionkey"]], []).append(f"{r[x['n_regionkey']]}/{x['n_name']}")
    return queries.input_files(spark, r + r[:1], lambda p: inside[p] if r.index(p) < 3 else None)


def _ruby_files(spark, sf_dir) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    content = _text(
        "module R", _n("n_regionkey"), "\n  class N", _n("n_nationkey"), " < Base\n    include M\n    attr_reader :a\n    def initialize(a)\n      @a = a\n    end\n    def size\n      ", _n("n_nationkey"),
        "\n    end\n    def self.made\n      new('x')\n    end\n    def to_h\n      { name: 'a', size: 1 }\n    end\n    def ===(other)\n      true\n    end\n  end\nend\n",
    )
    return n.select(_text("n", _n("n_nationkey"), ".rb").alias("file"), content.alias("content"))


@query("""SELECT 'n' || n_nationkey || '.rb' AS file, 'R' || n_regionkey || '::N' || n_nationkey AS class, name, singleton, replace(t, '#', n_nationkey::VARCHAR) AS ret FROM nation, (VALUES ('size', false, '#'), ('to_h', false, '{ name: "a", size: 1 }'), ('===', false, 'true')) v(name, singleton, t)""")
def kernel_s05_s06_s07_s08_ruby_methods(spark, sf_dir):
    """Methods of Ruby sources whose last expression is a literal."""
    found = ruby.tables(ruby.facts(_ruby_files(spark, sf_dir)))["methods"]
    return found.filter("name IN ('size', 'to_h', '===')").select("file", "class", "name", "singleton", columns.rendered("ret").alias("ret"))


@query("SELECT 'n' || n_nationkey || '.rb' AS file, 17 AS line FROM nation")
def kernel_b42_case_equality(spark, sf_dir):
    return ruby.case_equality_overrides(_ruby_files(spark, sf_dir))


@query("SELECT 'n' || n_nationkey || '.rb' AS file, 'R' || n_regionkey || '::N' || n_nationkey AS class, 'to_h' AS name, 'name,size' AS keys FROM nation")
def kernel_b43_b44_namespaces_and_hashes(spark, sf_dir):
    """Nested classes, and their methods that return a literal hash."""
    rows = ruby.facts(_ruby_files(spark, sf_dir))
    found = ruby.literal_hash_methods(rows).select("class", "name", F.array_join("keys", ",").alias("keys"))
    return ruby.namespaces(rows).join(found, "class")


@query("""SELECT class, CASE WHEN superclass IS NULL THEN lower(class) || 's' ELSE lower(superclass) || 's' END AS "table" FROM (SELECT 'N' || n_nationkey AS class, NULL AS superclass FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)""")
def kernel_s29_j18_r13_table_models(spark, sf_dir):
    """Suppliers below nations share their table."""
    n, s = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "supplier")
    models = n.select(_text("N", _n("n_nationkey")).alias("class"), _none().alias("superclass")).union(s.select(_text("S", _n("s_suppkey")), _text("N", _n("s_nationkey"))))
    return schema.table_models(models.withColumn("table_name", _none()))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'API' ELSE 'Line' END || 'Ox' AS class FROM part")
def kernel_s31_f07_project_inflections(spark, sf_dir):
    """A project's irregular plurals and acronyms hold for class names."""
    project = inflect.project_inflections(["inflect.irregular 'ox', 'oxen'", 'inflect.acronym "API"', "# inflect.irregular 'a', 'b'"])
    table = _text(F.when(F.col("p_size") % 2 == 0, "api").otherwise("line"), "_ox")
    # irregular plurals name whole tables
    whole = inflect.Inflections({"api_oxen": "api_ox", "line_oxen": "line_ox", **project.irregular}, project.acronyms)
    return _read(spark, sf_dir, "part").select("p_partkey", inflect.classify(_text(table, "en"), whole).alias("class"))


@query("SELECT n_nationkey, '3.' || n_nationkey AS version, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE n_nationkey END AS minor FROM nation")
def kernel_s32_f29_versions(spark, sf_dir):
    """A version from its own file, from the tool versions or from the Gemfile."""
    k, text = F.col("n_nationkey") % 3, _text("3.", _n("n_nationkey"))
    found = sources.versions(F.when(k == 0, _text("ruby-", text, "\n")), F.when(k == 1, _text("node 1.2\nruby ", text, "\n")), F.when(k == 2, _text("source 'x'\nruby '~> ", text, "'\n")))
    minor = sources.version_parts(found).minor
    return _read(spark, sf_dir, "nation").select("n_nationkey", found.alias("version"), F.when(k != 2, minor).alias("minor"))


@query("SELECT 'g' || p_partkey AS gem, '1.' || p_size AS version FROM part")
def kernel_s33_locked_gems(spark, sf_dir):
    """Parts as the specs of lock files; their dependencies (indented deeper) don't count."""
    spec = _text("    g", _n("p_partkey"), " (1.", _n("p_size"), ")\n      other (>= 1)")
    files = _read(spark, sf_dir, "part").groupBy("p_brand").agg(_text("GEM\n  specs:\n", F.array_join(F.collect_list(spec), "\n"), "\n\nPLATFORMS\n  ruby").alias("content"))
    return sources.locked_gems(files)


@query("SELECT CAST(user_id AS VARCHAR) AS file, event_id AS generation, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'open' ELSE 'change' END AS op FROM events")
def kernel_s39_s40_watched_changes(spark, sf_dir):
    event = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "created").otherwise("changed")
    rows = _read(spark, sf_dir, "events").select(_n("user_id").alias("file"), F.col("event_id").alias("generation"), event.alias("event"), F.lit("x").alias("content"))
    return workspace.watched_changes(rows).drop("content")


# names and columns


@query("SELECT p_partkey, lower(replace(p_brand, '#', '_')) AS path, 'R::' || replace(p_brand, '#', '') AS scoped FROM part")
def kernel_f08_f23_names(spark, sf_dir):
    """Class names as paths and inside scopes."""
    name = F.regexp_replace("p_brand", "#", "")
    spaced = F.concat(F.initcap(F.substring_index("p_brand", "#", 1)), F.substring_index("p_brand", "#", -1))
    path = F.regexp_replace(inflect.underscore(spaced), r"([a-z])(\d)", "$1_$2")
    return _read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), inflect.join_scope(F.lit("R"), name).alias("scoped"))


DIRTY_NAMES = "('c#_changed?', 'bool'), ('c#_was', 'String?'), ('c#_change', '[String?, String?]?'), ('restore_c#!', 'untyped')"


@query(f"SELECT 'N' || n_nationkey AS class, replace(n, '#', n_nationkey::VARCHAR) AS name, t AS ret FROM nation, (VALUES {DIRTY_NAMES}) v(n, t)")
def kernel_b13_g10_dirty_methods(spark, sf_dir):
    """Methods that track changes of a column, as far as they are referenced."""
    n = _read(spark, sf_dir, "nation")
    cols = n.select(_n("n_nationkey").alias("table"), _text("c", _n("n_nationkey")).alias("column"), F.lit('["string"]').alias("type"))
    classes = n.select(_n("n_nationkey").alias("table"), _text("N", _n("n_nationkey")).alias("class"))
    c = _text("c", _n("n_nationkey"))
    used = n.select(_text("N", _n("n_nationkey")).alias("class"), F.explode(F.array(_text(c, "_changed?"), _text(c, "_was"), _text(c, "_change"), _text("restore_", c, "!"), F.lit("other"))).alias("name"))
    return schema.dirty_methods(cols, classes, used).select("class", "name", columns.rendered("ret").alias("ret"))


# generators: parts as macro calls


def _calls(spark, sf_dir, method: Column | str, names: Column, options: Column | None = None) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    no = F.create_map().cast("map<string,string>")
    return p.select(_text("P", _n("p_partkey")).alias("class"), (F.lit(method) if isinstance(method, str) else method).alias("method"), names.alias("names"), (no if options is None else options).alias("options"), F.lit("f").alias("file"), F.col("p_partkey").cast("int").alias("line"), F.lit(0).alias("ord"), F.lit(False).alias("singleton"))


def _pick(*values: str) -> Column:
    """One of some values, by a part's size."""
    return F.array(*map(F.lit, values))[(F.col("p_size") % len(values)).cast("int")]


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("class", "name", "singleton", columns.rendered("ret").alias("ret"))


@query("""SELECT 'P' || p_partkey AS class, name, CASE WHEN p_size % 2 = 0 THEN 'Integer' ELSE 'untyped' END AS ret, false AS singleton FROM part, (VALUES ('a'), ('a=')) v(name)
WHERE (name = 'a' AND p_size % 3 <> 1) OR (name = 'a=' AND p_size % 3 <> 0)""")
def kernel_g01_attributes(spark, sf_dir):
    """attr_reader, attr_writer and attr_accessor, typed by instance variables of even parts."""
    ivars = _read(spark, sf_dir, "part").filter("p_size % 2 = 0").select(_text("P", _n("p_partkey")).alias("class"), F.lit("@a").alias("ivar"), F.lit('["integer"]').alias("type"))
    return _shown(generators.attributes(_calls(spark, sf_dir, _pick("attr_reader", "attr_writer", "attr_accessor"), F.array(F.lit("a"))), ivars))


@query("""SELECT 'P' || p_partkey AS class, module, CASE p_size % 3 WHEN 0 THEN 'include' WHEN 1 THEN 'extend' ELSE 'prepend' END AS kind, ord FROM part, (VALUES ('A', 1), ('B', 0)) v(module, ord)""")
def kernel_g02_mixins(spark, sf_dir):
    """Of several modules the last is applied first."""
    return generators.mixins(_calls(spark, sf_dir, _pick("include", "extend", "prepend"), F.array(F.lit("A"), F.lit("B"))))


@query("SELECT 'P' || p_partkey AS class, 'new' AS name, false AS singleton, 'Integer' AS ret FROM part WHERE p_size % 2 = 0")
def kernel_g03_aliases(spark, sf_dir):
    methods = _read(spark, sf_dir, "part").filter("p_size % 2 = 0").select(_text("P", _n("p_partkey")).alias("class"), F.lit("old").alias("name"), F.lit(False).alias("singleton"), _none().alias("param"), F.lit('["integer"]').alias("ret"))
    return _shown(generators.aliases(_calls(spark, sf_dir, "alias_method", F.array(F.lit("new"), F.lit("old"))), methods))


@query("SELECT 'P' || p_partkey AS class, 'm' || p_size AS name, p_size % 2 = 1 AS singleton, CASE WHEN p_size % 3 = 0 THEN 'String' ELSE 'untyped' END AS ret FROM part")
def kernel_g04_defined_methods(spark, sf_dir):
    options = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("ret"), F.lit('["string"]'))).otherwise(F.create_map().cast("map<string,string>"))
    return _shown(generators.defined_methods(_calls(spark, sf_dir, _pick("define_method", "define_singleton_method"), F.array(_text("m", _n("p_size"))), options)))


@query("SELECT 'P' || p_partkey AS class, name, true AS singleton, 'nil' AS ret FROM part, (VALUES ('a', 0), ('b', 1000000)) v(name, line) WHERE (p_size % 2 = 0 AND name = 'a') OR (p_size % 2 = 1 AND name = 'b')")
def kernel_g05_module_functions(spark, sf_dir):
    """Even parts name a method, odd ones open a run of all that follow."""
    p = _read(spark, sf_dir, "part")
    methods = p.select(_text("P", _n("p_partkey")).alias("class"), F.explode(F.array(F.struct(F.lit("a").alias("name"), F.lit(0).alias("line")), F.struct(F.lit("b").alias("name"), (F.col("p_partkey").cast("int") + 1).alias("line")))).alias("m"))
    methods = methods.select("class", "m.name", F.lit(False).alias("singleton"), _none().alias("param"), F.lit('["nil"]').alias("ret"), F.lit("source").alias("origin"), F.lit("f").alias("file"), "m.line")
    names = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return _shown(generators.module_functions(_calls(spark, sf_dir, "module_function", names), methods))


@query("""SELECT 'P' || p_partkey AS class, CASE WHEN p_size % 3 = 0 THEN 'to_' ELSE '' END || 'size' AS name, false AS singleton, CASE WHEN p_size % 2 = 0 THEN 'Integer?' ELSE 'Integer' END AS ret FROM part""")
def kernel_g06_g07_j28_delegated(spark, sf_dir):
    """size delegated to a reader, whose class has it; with a prefix, and nil allowed."""
    options = F.map_concat(F.create_map(F.lit("to"), F.lit("to")), F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("prefix"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>")), F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("allow_nil"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>")))
    found = generators.delegations(_calls(spark, sf_dir, "delegate", F.array(F.lit("size")), options))
    own = _read(spark, sf_dir, "part").select(_text("P", _n("p_partkey")).alias("class"), F.lit("to").alias("name"), _none().alias("param"), F.lit('["class","Box"]').alias("ret"))
    return _shown(generators.delegated(found, own.union(own.limit(1).select(F.lit("Box"), F.lit("size"), _none(), F.lit('["integer"]')))))


@query("SELECT 'P' || p_partkey AS class, name, false AS singleton, 'untyped' AS ret FROM part, (VALUES ('x'), ('x='), ('y'), ('y=')) v(name) WHERE p_size % 2 = 0 OR NOT ends_with(name, '=')")
def kernel_g08_struct_members(spark, sf_dir):
    """Members of structs can be written, those of data can't."""
    return _shown(generators.struct_members(_calls(spark, sf_dir, _pick("Struct.new", "Data.define"), F.array(F.lit("x"), F.lit("y")))))


@query("""SELECT 'P' || p_partkey AS class, replace(n, '#', CASE WHEN p_size % 2 = 0 THEN 'state_on' ELSE 'on' END) AS name, s AS singleton, replace(t, '#', p_partkey::VARCHAR) AS ret FROM part, (VALUES ('#?', false, 'bool'), ('#!', false, 'bool'), ('#', true, 'ActiveRecord::Relation[P#]'), ('not_#', true, 'ActiveRecord::Relation[P#]'), ('states', true, 'Hash[String, untyped]')) v(n, s, t)""")
def kernel_g18_f33_enums(spark, sf_dir):
    options = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("prefix"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    return _shown(generators.enum_methods(generators.enum_values(_calls(spark, sf_dir, "enum", F.array(F.lit("state"), F.lit("on")), options))))


@query("""SELECT 'P' || p_partkey AS class, name, false AS singleton, t AS ret FROM part, (VALUES (0, 'box', 'Box'), (0, 'box=', 'Box'), (0, 'build_box', 'Box'), (0, 'create_box', 'Box'), (0, 'reload_box', 'Box'),
(1, 'box', 'Box?'), (1, 'box=', 'Box?'), (1, 'build_box', 'Box'), (1, 'create_box', 'Box'), (1, 'reload_box', 'Box?'),
(2, 'lines', 'ActiveRecord::Associations::CollectionProxy[Line]'), (2, 'lines=', 'ActiveRecord::Associations::CollectionProxy[Line]'), (2, 'line_ids', 'Array[Integer]')) v(k, name, t) WHERE p_size % 3 = k""")
def kernel_g12_associations(spark, sf_dir):
    """belongs_to, has_one and has_many, with all the methods they give."""
    names = F.array(F.when(F.col("p_size") % 3 == 2, "lines").otherwise("box"))
    classes = spark.createDataFrame([("Box",), ("Line",)], "class string")
    return _shown(generators.association_methods(generators.associations(_calls(spark, sf_dir, _pick("belongs_to", "has_one", "has_many"), names), classes)))


@query("SELECT 'N' || n_nationkey AS class, name, singleton, ret FROM nation, (VALUES (0, 'perform_later', true, 'untyped'), (0, 'perform_now', true, 'untyped'), (1, 'attributes', false, 'Hash[Symbol, untyped]')) v(k, name, singleton, ret) WHERE n_nationkey % 2 = k")
def kernel_g13_framework_methods(spark, sf_dir):
    """What jobs and serializers inherit (some of it)."""
    own = _text("N", _n("n_nationkey"))
    paths = _read(spark, sf_dir, "nation").select(own.alias("class"), F.when(F.col("n_nationkey") % 2 == 0, "ActiveJob::Base").otherwise("ActiveModel::Serializer").alias("owner"))
    return _shown(generators.framework_methods(paths)).filter("name IN ('perform_later', 'perform_now') OR name = 'attributes'")


@query("SELECT 'N' || n_nationkey AS class, 'welcome' AS name, true AS singleton, 'ActionMailer::MessageDelivery' AS ret FROM nation WHERE n_nationkey % 2 = 0")
def kernel_g14_g15_mailer_actions(spark, sf_dir):
    """Public methods of mailers are sent as class methods."""
    n = _read(spark, sf_dir, "nation").withColumn("class", _text("N", _n("n_nationkey")))
    methods = n.select("class", F.explode(F.array(F.struct(F.lit("welcome").alias("name"), F.lit("public").alias("visibility")), F.struct(F.lit("inner").alias("name"), F.lit("private").alias("visibility")))).alias("m"))
    methods = methods.select("class", "m.name", F.lit(False).alias("singleton"), "m.visibility", _none().alias("param"), F.lit("f").alias("file"), F.lit(1).alias("line"))
    return _shown(generators.mailer_actions(methods, n.filter("n_nationkey % 2 = 0").select("class", F.lit("ActionMailer::Base").alias("owner"))))


@query("""SELECT 'P' || p_partkey AS class, name, false AS singleton, CASE WHEN name = 'a?' THEN 'bool' ELSE CASE p_size % 3 WHEN 0 THEN 'String?' WHEN 1 THEN 'Integer?' ELSE 'untyped' END END AS ret FROM part, (VALUES ('a'), ('a='), ('a?')) v(name)""")
def kernel_g16_typed_attributes(spark, sf_dir):
    kind = _pick("string", "integer", "odd")
    return _shown(generators.typed_attributes(_calls(spark, sf_dir, "attribute", F.array(F.lit("a"), kind)), ddl.keyword_type))


@query("""SELECT 'N' || n_nationkey AS class, name, true AS singleton, replace(t, '#', 'N' || n_nationkey) AS ret FROM nation, (VALUES ('where', 'ActiveRecord::Relation[#]'), ('first', '#?'), ('find', '#'), ('count', 'Integer'), ('ids', 'Array[String]'), ('exists?', 'bool'), ('in_order_of', 'ActiveRecord::Relation[#]'), ('find_each', 'Enumerator[#]')) v(name, t)""")
def kernel_g11_f15_f16_relation_methods(spark, sf_dir):
    """Models answer like relations (some of their methods), as far as the version has them."""
    models = _read(spark, sf_dir, "nation").select(_text("N", _n("n_nationkey")).alias("class"), F.lit('["string"]').alias("primary_key"))
    asked = ["where", "first", "find", "count", "ids", "exists?", "in_order_of", "find_each", "with_recursive"]
    return _shown(generators.relation_methods(models, (7, 1))).filter(F.col("name").isin(asked))


@query("""SELECT 'N' || n_nationkey AS class, c.name, c.ret FROM nation, (VALUES ('upcase', 'String'), ('length', 'Integer')) c(name, ret) WHERE n_nationkey % 4 = 0
UNION ALL SELECT 'N' || n_nationkey, name, ret FROM nation, (VALUES ('length', 'Integer'), ('keys', 'Array[Symbol]'), ('invert', 'Hash[Integer, Symbol]')) v(name, ret) WHERE n_nationkey % 4 = 1
UNION ALL SELECT 'N' || n_nationkey, name, ret FROM nation, (VALUES ('utc', 'Time'), ('beginning_of_day', 'ActiveSupport::TimeWithZone'), ('future?', 'bool')) v(name, ret) WHERE n_nationkey % 4 = 2
UNION ALL SELECT 'N' || n_nationkey, name, ret FROM nation, (VALUES ('permit', 'ActionController::Parameters'), ('to_h', 'Hash[String, untyped]'), ('keys', 'Array[String]')) v(name, ret) WHERE n_nationkey % 4 = 3""")
def kernel_f10_f11_f12_f13_f14_known_returns(spark, sf_dir):
    """What strings, hashes, times with zones and request parameters answer; null where nothing is known."""
    asked = ["upcase", "length", "keys", "invert", "utc", "beginning_of_day", "future?", "permit", "to_h", "nothing"]
    receivers = [T.STRING, ("hash", T.SYMBOL, T.INTEGER), T.cls("ActiveSupport::TimeWithZone"), T.cls("ActionController::Parameters")]
    receiver = F.array(*[F.lit(T.dumps(t)) for t in receivers])[(F.col("n_nationkey") % 4).cast("int")]
    rows = _read(spark, sf_dir, "nation").select(_text("N", _n("n_nationkey")).alias("class"), receiver.alias("r"), F.explode(F.array(*map(F.lit, asked))).alias("name"))
    found = rows.withColumn("t", columns.known_return("r", "name")).filter("t IS NOT NULL")
    return found.select("class", "name", columns.rendered("t").alias("ret"))


# extensions of libraries


def _extended(spark, sf_dir, method: Column, names: Column | None = None, module: Column | None = None, active: list[str] | None = None) -> DataFrame:
    made = _calls(spark, sf_dir, method, F.array(F.lit("a")) if names is None else names)
    p = _read(spark, sf_dir, "part")
    none = p.limit(0).select(_none().alias("class"), _none().alias("module"), _none().alias("file"), _none("int").alias("line"))
    mixed = none if module is None else p.select(_text("P", _n("p_partkey")).alias("class"), module.alias("module"), F.lit("f").alias("file"), F.lit(1).alias("line"))
    found = extensions.extension_methods(made, mixed, None if active is None else spark.createDataFrame([(x,) for x in active], "library string"))
    return _shown(found)


@query("""SELECT 'P' || p_partkey AS class, name, s AS singleton, replace(t, '#', p_partkey::VARCHAR) AS ret FROM part, (VALUES (0, 'a', false, 'untyped'), (1, 'a', false, 'untyped'), (1, 'a=', false, 'untyped'), (2, 'a', false, 'Array[untyped]'), (2, 'a=', false, 'Array[untyped]'),
(3, 'fetch_by_a', true, 'P#?'), (3, 'fetch_multi_by_a', true, 'Array[P#]'), (4, 'a', false, 'ActiveStorage::Attached::One'), (4, 'a=', false, 'ActiveStorage::Attached::One'), (5, 'a', false, 'untyped'), (5, 'a=', false, 'untyped'), (6, 'a', false, 'untyped'), (7, 'a', false, 'untyped')) v(k, name, s, t) WHERE p_size % 8 = k""")
def kernel_ext_paperclip_protobuf_identity_cache_active_storage_properties_graphql_grape_entity(spark, sf_dir):
    """Class-level calls of seven libraries."""
    return _extended(spark, sf_dir, _pick("has_attached_file", "optional", "repeated", "cache_index", "has_one_attached", "property", "field", "expose"))


@query("""SELECT 'P' || p_partkey AS class, name, false AS singleton, t AS ret FROM part, (VALUES (0, 'a?', 'bool'), (1, 'a', 'untyped'), (1, 'a=', 'untyped'), (2, 'a?', 'bool')) v(k, name, t) WHERE p_size % 3 = k""")
def kernel_ext_state_machines_active_resource_aasm(spark, sf_dir):
    """Calls inside blocks of three libraries."""
    return _extended(spark, sf_dir, _pick("state_machine.state", "schema.string", "aasm.state"))


@query("""SELECT 'P' || p_partkey AS class, name, s AS singleton, replace(t, '#', p_partkey::VARCHAR) AS ret FROM part, (VALUES (0, 'perform_async', true, 'String?'), (0, 'perform_bulk', true, 'Array[String?]'), (1, 'decorate', false, 'P#Decorator'), (2, 'discarded?', false, 'bool'), (2, 'kept?', false, 'bool')) v(k, name, s, t) WHERE p_size % 3 = k""")
def kernel_ext_sidekiq_draper_discard(spark, sf_dir):
    """Modules of three libraries (some of their methods); one that is not active gives nothing."""
    found = _extended(spark, sf_dir, F.lit("none"), module=_pick("Sidekiq::Job", "Draper::Decoratable", "Discard::Model"), active=["sidekiq", "draper", "discard"])
    return found.filter("name IN ('perform_async', 'perform_bulk', 'decorate', 'discarded?', 'kept?')")


@query("""SELECT 'P' || p_partkey AS class, name, t AS ret, false AS singleton FROM part, (VALUES ('image', 'Shrine::UploadedFile?'), ('image_attacher', 'Shrine::Attacher')) v(name, t) WHERE p_size % 2 = 0""")
def kernel_ext_shrine(spark, sf_dir):
    """A module that comes with an argument."""
    names = F.array(F.when(F.col("p_size") % 2 == 0, "ImageUploader::Attachment(:image)").otherwise("Plain"))
    return _extended(spark, sf_dir, F.lit("include"), names).filter("name IN ('image', 'image_attacher')")


RECEIVED = [
    ("String", "shellescape", False, "String"), ("String", "shellsplit", False, "Array[String]"), ("String", "pathmap", False, "String"), ("Anything", "ngettext", False, "String"), ("FooError", "message", False, "String"),
    ("UsersController", "valid_doorkeeper_token?", False, "bool"), ("Rack::Attack::Request", "params", False, "untyped"), ("Oj", "dump", True, "String"), ("UserSerializer", "scope", False, "untyped"),
    ("Application", "config", False, "Rails::Application::Configuration"), ("Settingslogic", "load!", True, "untyped"), ("Box", "params", False, "-"),
]


@query("SELECT p_partkey AS site_id, t AS ret FROM part, (VALUES " + ", ".join(f"({k}, '{t}')" for k, (_, _, _, t) in enumerate(RECEIVED)) + f") v(k, t) WHERE p_size % {len(RECEIVED)} = k AND t <> '-'")
def kernel_ext_shellwords_rake_gettext_exception_doorkeeper_rack_attack_oj_ams_rails_configure_settingslogic(spark, sf_dir):
    """Calls that ten libraries answer by the receiver's class or its ending."""
    pick = lambda i: F.array(*[F.lit(r[i]) for r in RECEIVED])[(F.col("p_size") % len(RECEIVED)).cast("int")]
    asked = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("site_id"), pick(0).alias("class"), pick(1).alias("name"), pick(2).alias("singleton"))
    return extensions.receiver_returns(asked).select("site_id", columns.rendered("ret").alias("ret"))


@query("""SELECT 'P' || p_partkey AS class, name, false AS singleton, 'Kredis::Types::' || CASE p_size % 2 WHEN 0 THEN 'List' ELSE 'UniqueList' END AS ret FROM part, (VALUES ('a'), ('a=')) v(name)""")
def kernel_ext_kredis(spark, sf_dir):
    return _shown(extensions.typed_lists(_calls(spark, sf_dir, _pick("kredis_list", "kredis_unique_list"), F.array(F.lit("a")))))


@query("""SELECT 'N' || n_nationkey AS class, replace(n, '#', lower(r_name)) AS name, replace(t, '#', upper(r_name[1]) || lower(r_name[2:])) AS ret FROM nation, region, (VALUES ('current_#', '#?'), ('#_signed_in?', 'bool'), ('authenticate_#!', 'untyped')) v(n, t) WHERE r_name NOT LIKE '% %'""")
def kernel_ext_devise(spark, sf_dir):
    """Helpers of controllers for every scope that logs in."""
    scopes = _read(spark, sf_dir, "region").filter("r_name NOT LIKE '% %'").select(F.lower("r_name").alias("scope"))
    found = extensions.scope_helpers(scopes, _read(spark, sf_dir, "nation").select(_text("N", _n("n_nationkey")).alias("class")))
    return found.select("class", "name", columns.rendered("ret").alias("ret")).filter("name LIKE 'current%' OR name LIKE '%signed_in?' OR name LIKE 'authenticate%'")


# calls and loading


@query("""SELECT s_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN r_regionkey % 2 = 0 THEN 'Integer' ELSE 'untyped' END ELSE 'String' END AS ret FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def kernel_r02_r03_b34_b35_resolved_returns(spark, sf_dir):
    """Suppliers call their nation, even nations their region; odd regions call themselves, which never ends."""
    s, n, r = (_read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    call = lambda k: F.concat(F.lit('["method_return","'), k, F.lit('","m"]'))
    nation, region = _text("N", _n("n_nationkey")), _text("R", _n("n_regionkey"))
    rows = s.select(F.col("s_name").alias("class"), call(_text("N", _n("s_nationkey"))).alias("ret"))
    rows = rows.union(n.select(nation, F.when(F.col("n_nationkey") % 2 == 0, call(region)).otherwise('["string"]')))
    own = _text("R", _n("r_regionkey"))
    rows = rows.union(r.select(own, F.when(F.col("r_regionkey") % 2 == 0, '["integer"]').otherwise(call(own))))
    methods = rows.select("class", F.lit("m").alias("name"), F.lit(False).alias("singleton"), "ret")
    paths = rows.select("class", F.col("class").alias("owner"), F.array(F.lit(0)).alias("rank"))
    found, _ = recursion.resolve_returns(methods, paths)
    return found.join(s.select(F.col("s_name").alias("class")), "class", "left_semi").select(F.col("class").alias("name"), columns.rendered("ret").alias("ret"))


@query("""SELECT DISTINCT 'U' || user_id AS class FROM events WHERE user_id % 2 <> 0 AND user_id % 3 <> 0""")
def kernel_b36_b37_b38_needed_classes(spark, sf_dir):
    """Classes that types name, and nothing has declared (every second) or tried (every third)."""
    rows = _read(spark, sf_dir, "events")
    user = _text("U", _n("user_id"))
    methods = rows.select(_text('["array",["class","', user, '"]]').alias("ret"))
    return calls.needed_classes(methods, rows.filter("user_id % 2 = 0").select(user.alias("class")), rows.filter("user_id % 3 = 0").select(user.alias("class")), columns.referenced_classes)


@query("""SELECT 'S' || s_suppkey AS class, 'N' || s_nationkey AS ret FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT DISTINCT 'N' || s_nationkey, 'R' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0
UNION ALL SELECT DISTINCT 'R' || n_regionkey, 'untyped' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def kernel_r04_loaded_until_closed(spark, sf_dir):
    """Suppliers name nations, which name regions: both are loaded as they are needed."""
    s, n, r = (_read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    term = lambda c: F.concat(F.lit('["class","'), c, F.lit('"]'))
    there = n.select(_text("N", _n("n_nationkey")).alias("class"), term(_text("R", _n("n_regionkey"))).alias("ret")).union(r.select(_text("R", _n("r_regionkey")), F.lit('["untyped"]')))

    def load(needed):
        some = there.join(needed, "class", "left_semi")
        return some.select("class"), some

    own = s.filter("s_acctbal > 0").select(_text("S", _n("s_suppkey")).alias("class"), term(_text("N", _n("s_nationkey"))).alias("ret"))
    _, methods = calls.load_until_closed(own, own.select("class"), load, columns.referenced_classes)
    return methods.select("class", columns.rendered("ret").alias("ret"))


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS file FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 2 = 0")
def kernel_r14_replayed_files(spark, sf_dir):
    """Files whose methods wait for a parameter that got its type late."""
    rows = _read(spark, sf_dir, "lineitem")
    wait = F.when(F.col("l_returnflag") == "R", T.dumps(T.array(("param", 0)))).otherwise(T.dumps(T.STRING))
    methods = rows.select(_n("l_orderkey").alias("file"), _n("l_suppkey").alias("class"), F.lit("m").alias("name"), F.lit(False).alias("singleton"), wait.alias("ret"))
    late = rows.filter("l_suppkey % 2 = 0").select(_n("l_suppkey").alias("class"), F.lit("m").alias("name"), F.lit(False).alias("singleton"))
    return queries.replayed_files(methods, late)


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'array' WHEN 'N' THEN 'union' ELSE 'generic' END AS kind, CAST(l_orderkey AS VARCHAR) AS file, 'S' || l_suppkey AS symbol FROM lineitem UNION SELECT 'generic', CAST(l_orderkey AS VARCHAR), 'Box' FROM lineitem WHERE l_returnflag = 'R'")
def kernel_b38_type_edges(spark, sf_dir):
    """The classes that a file's types name."""
    s = F.concat(F.lit('["class","S'), _n("l_suppkey"), F.lit('"]'))
    flag = F.col("l_returnflag")
    term = F.when(flag == "A", F.concat(F.lit('["array",'), s, F.lit("]"))).when(flag == "N", F.concat(F.lit('["union",['), s, F.lit(',["nil"]]]'))).otherwise(F.concat(F.lit('["generic","Box",['), s, F.lit("]]")))
    kind = F.when(flag == "A", "array").when(flag == "N", "union").otherwise("generic")
    return queries.type_edges(_read(spark, sf_dir, "lineitem").select(_n("l_orderkey").alias("file"), kind.alias("kind"), term.alias("type"))).distinct()


# merging


@query("""SELECT o_custkey AS class, o_orderkey AS name, o_orderstatus AS origin FROM orders WHERE NOT (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderstatus = 'F')""")
def kernel_b26_b27_dropped_externals(spark, sf_dir):
    """Before a reload, customers in debt lose what came from finished orders."""
    methods = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("class"), F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("origin"))
    return merge.drop_external(methods, _read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("class")), ["F"])


@query("SELECT user_id AS class, event_id AS name FROM events WHERE event_type = 'view'")
def kernel_b16_b17_b18_b19_file_facts(spark, sf_dir):
    """The facts of one file."""
    return merge.file_facts(_read(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.col("user_id").alias("class"), F.col("event_id").alias("name")), "view").drop("file")


@query("""SELECT o_custkey AS class, o_orderkey AS name, 'old' AS ret FROM orders WHERE NOT (o_custkey % 4 = 0 AND o_orderstatus = 'F') UNION ALL SELECT c_custkey, -1, 'new' FROM customer WHERE c_custkey % 4 = 0""")
def kernel_t15_reloaded_types(spark, sf_dir):
    """One signature file is read again: what it declared goes, what it declares now comes."""
    methods = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("class"), F.col("o_orderkey").alias("name"), F.lit("old").alias("ret"), F.col("o_orderstatus").alias("origin"))
    declared = _read(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("class"), F.lit(-1).cast("long").alias("name"), F.lit("new").alias("ret"), F.lit("F").alias("origin"))
    found, _ = queries.reload_types(methods, declared, declared.select("class"), ["F"])
    return found.drop("origin")


# rendering and reports


@query("""SELECT c.custkey AS class, 'class C' || c.custkey || ' < Base' || chr(10) || string_agg('  def o' || o_orderkey || ': () -> ' || CASE o_orderstatus WHEN 'F' THEN 'Integer' ELSE 'String' END, chr(10) ORDER BY o_orderkey) || chr(10) || 'end' AS text
FROM (SELECT DISTINCT o_custkey AS custkey FROM orders) c JOIN orders ON o_custkey = c.custkey WHERE o_orderstatus <> 'P' GROUP BY 1""")
def kernel_k01_k02_k04_class_texts(spark, sf_dir):
    """Customers as classes with their orders as methods; those from signature files are not shown."""
    rows = _read(spark, sf_dir, "orders")
    back = F.when(F.col("o_orderstatus") == "F", "Integer").otherwise("String")
    name = _text("C", _n("o_custkey"))
    methods = rows.select(name.alias("class"), _text("o", _n("o_orderkey")).alias("name"), F.lit(False).alias("singleton"), F.col("o_orderkey").alias("ord"), sources.method_type(_text("() -> ", back)).alias("overloads"), F.lit(False).alias("private"), F.lit(True).alias("explicit"), F.when(F.col("o_orderstatus") == "P", "rbs_file").otherwise("source").alias("origin"))
    classes = rows.select(name.alias("class"), F.col("o_custkey").alias("ord"), F.lit("Base").alias("superclass"), F.lit(False).alias("is_module"), F.array().cast("array<string>").alias("type_params")).distinct()
    mixins = spark.createDataFrame([], "class string, module string, kind string, ord int")
    held = spark.createDataFrame([], "owner string, name string, type string, alias_kind string, ord int")
    return render.class_texts(classes, mixins, held, methods).select(F.col("ord").alias("class"), "text")


@query("""SELECT doc_id, CASE WHEN n > 512 THEN left(t, 509) || '...' ELSE t END AS text FROM (SELECT *, length(t) AS n FROM (SELECT doc_id, '[' || array_to_string(list_transform(range(0, 1 + doc_id % 60), lambda i: 'Class' || i), ', ') || ']' AS t FROM documents))""")
def kernel_k10_hover_texts(spark, sf_dir):
    """Long types are cut."""
    parts = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 60), lambda i: F.concat(F.lit('["class","Class'), i.cast("string"), F.lit('"]')))
    term = F.concat(F.lit('["tuple",['), F.array_join(parts, ","), F.lit("]]"))
    return _read(spark, sf_dir, "documents").select("doc_id", render.hover_text(term).alias("text"))


@query("""SELECT level, count(*) AS total, 100.0 * count(*) FILTER (level = 2) / count(*) AS typed FROM (SELECT CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS level FROM events) GROUP BY 1""")
def kernel_k07_f31_coverage_report(spark, sf_dir):
    """The JSON report over events as references, by level."""
    level = F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    rows = _read(spark, sf_dir, "events").select(F.concat(F.lit("k"), level.cast("string")).alias("kind"), level.alias("level"))
    text = coverage.report(rows, rows.limit(0), 10, 9)
    by = F.from_json("value", "by_kind map<string,struct<total:long,type_coverage_percent:double>>").by_kind
    return text.select(F.explode(by)).select(F.substring("key", 2, 1).cast("int").alias("level"), F.col("value.total").alias("total"), F.col("value.type_coverage_percent").alias("typed"))


@query("""SELECT user_id::VARCHAR AS kind, event_type AS reason, count(*) AS n, string_agg(name, ',' ORDER BY name) FILTER (r <= 3) AS examples FROM (
SELECT *, 'C#m' || event_id || ' s' AS name, row_number() OVER (PARTITION BY user_id, event_type ORDER BY 'C#m' || event_id || ' s') AS r FROM events) GROUP BY 1, 2""")
def kernel_k13_hole_report(spark, sf_dir):
    holes = _read(spark, sf_dir, "events").select(_n("user_id").alias("kind"), F.col("event_type").alias("reason"), F.lit("C").alias("class"), _text("m", _n("event_id")).alias("member"), F.lit("s").alias("slot"))
    return reports.hole_report(holes).withColumn("examples", F.array_join("examples", ","))


@query("""SELECT user_id::VARCHAR AS file, '## C ' || arg_min('m' || event_id || ' ' || event_type, 'm' || event_id) || chr(10) || chr(10) || '```ruby' || chr(10) || 'x' || user_id || chr(10) || '```' || chr(10) AS value FROM events GROUP BY user_id""")
def kernel_k14_scenario_seeds(spark, sf_dir):
    rows = _read(spark, sf_dir, "events")
    holes = rows.select(_n("user_id").alias("file"), F.lit("C").alias("class"), _text("m", _n("event_id")).alias("member"), F.col("event_type").alias("reason"))
    return reports.scenario_seed(holes, rows.select(_n("user_id").alias("file"), _text("x", _n("user_id")).alias("content")).distinct())


@query("SELECT count(*) AS diagnostics, (SELECT count(*) FROM region) AS hovers, (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) AS names FROM nation")
def kernel_k12_file_report(spark, sf_dir):
    """All that an editor shows of one file, as one object."""
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    rows = reports.file_report(r.select(F.col("r_name").alias("value")), n.select("n_nationkey"), r.select("r_name"), r.select("r_regionkey"))
    v = F.from_json("value", "signatures string, diagnostics array<struct<n_nationkey:int>>, hovers array<struct<r_name:string>>")
    return rows.select(v.alias("v")).select(F.size("v.diagnostics").cast("long").alias("diagnostics"), F.size("v.hovers").cast("long").alias("hovers"), F.array_join(F.transform("v.hovers", lambda x: x.r_name), ",").alias("names"))


@query("SELECT 'U' || user_id AS id, max(event_id) AS line FROM events GROUP BY user_id")
def kernel_s37_k08_trace_files(spark, sf_dir):
    """Records written as JSON lines and read again; of records with one id the last line stays."""
    rows = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last"), F.min("event_id").alias("first"))
    none = F.array().cast("array<string>")
    record = lambda line: rows.select(_text("U", _n("user_id")).alias("id"), F.lit("method").alias("kind"), F.lit("nil").alias("type"), F.lit("source").alias("origin"), F.lit("f").alias("file"), line.cast("int").alias("line"), none.alias("deps"))
    path = f"{shared_dir(spark)}/trace-{uuid.uuid4().hex}"
    # within an id the lines stand in the order of what they record
    provenance.write_trace(record(F.col("first")).union(record(F.col("last"))).coalesce(1).sortWithinPartitions("id", "line"), path)
    return provenance.read_trace(spark, path).select("id", F.col("line").cast("long").alias("line"))


# the workspace


@query("SELECT CAST(user_id AS VARCHAR) AS file, max(event_id) FILTER (event_type = 'click') IS NOT NULL AND coalesce(max(event_id) FILTER (event_type = 'view'), -1) < max(event_id) FILTER (event_type = 'click') AS pending FROM events GROUP BY user_id")
def kernel_t06_pending_files(spark, sf_dir):
    """Clicks ask for a scan, views answer it."""
    rows = _read(spark, sf_dir, "events")
    marks = rows.select(_n("user_id").alias("file"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("asked"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("done"))
    return queries.pending(rows.select(_n("user_id").alias("file")).distinct(), marks)


@query("SELECT user_id AS doc, max(event_id) AS epoch FROM events GROUP BY 1 HAVING max(event_id) % 2 = 0")
def kernel_t12_publishable(spark, sf_dir):
    """Results of even events, as far as their epoch is still the user's last."""
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("epoch"))
    return workspace.publishable(rows.filter("epoch % 2 = 0"), rows)


@query("SELECT CAST(user_id AS VARCHAR) AS doc, max(event_id) AS version, string_agg(event_type || chr(10), '' ORDER BY event_id DESC) AS content FROM events WHERE event_type <> 'error' GROUP BY 1")
def kernel_t14_edited_documents(spark, sf_dir):
    """Every event writes a line at the top of its user's document."""
    zero = '"start_line": 0, "start_column": 0, "end_line": 0, "end_column": 0'
    edit = F.concat(F.lit("[{" + zero + ', "text": "'), "event_type", F.lit('\\n"}]'))
    rows = _read(spark, sf_dir, "events").filter("event_type <> 'error'").select(_n("user_id").alias("doc"), F.col("event_id").alias("version"), edit.alias("edits"))
    return workspace.documents(rows)


def _workspace(spark, sf_dir) -> workspace.Workspace:
    """Users as files that define what their last event says and refer to the next user's kind; two batches."""

    def extract(files: DataFrame) -> dict[str, DataFrame]:
        kind = F.substring_index("content", ":", 1)
        return {"defs": files.select("file", F.concat(F.lit("U"), "file").alias("symbol"), kind.alias("signature")), "refs": files.select("file", F.concat(F.lit("U"), F.substring_index("content", ":", -1)).alias("symbol"))}

    rows = _read(spark, sf_dir, "events").select(_n("user_id").alias("file"), F.col("event_id").alias("generation"), F.when(F.col("event_type") == "error", "delete").otherwise("change").alias("op"), F.concat_ws(":", "event_type", (F.col("user_id") + 1).cast("string")).alias("content"), "user_id")
    kept = workspace.Workspace(spark, f"{shared_dir(spark)}/workspace-{uuid.uuid4().hex}", extract)
    half = rows.agg((F.max("generation") / 2).cast("long")).first()[0]
    kept.apply(rows.filter(F.col("generation") <= half).drop("user_id"), 0, scan=True)
    kept.apply(rows.filter((F.col("generation") > half) & (F.col("user_id") % 2 == 0)).drop("user_id"), 1)
    return kept


LAST = """h AS (SELECT max(event_id) // 2 AS half FROM events), a AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events, h WHERE event_id <= half GROUP BY 1),
b AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events, h WHERE event_id > half AND user_id % 2 = 0 GROUP BY 1)"""


@query(f"WITH {LAST} SELECT CAST(user_id AS VARCHAR) AS file, coalesce(b.t, a.t) AS kind FROM a FULL JOIN b USING (user_id) WHERE coalesce(b.t, a.t) <> 'error'")
def kernel_t02_t03_t08_workspace_files(spark, sf_dir):
    """What a workspace holds after two batches of changes."""
    return _workspace(spark, sf_dir).facts["defs"].select("file", F.col("signature").alias("kind"))


@query(f"""WITH {LAST}, c AS (SELECT user_id FROM a FULL JOIN b USING (user_id) WHERE user_id IN (SELECT user_id FROM b) AND (CASE WHEN a.t = 'error' THEN NULL ELSE a.t END) IS DISTINCT FROM (CASE WHEN b.t = 'error' THEN NULL ELSE b.t END))
SELECT CAST(a.user_id AS VARCHAR) AS file FROM a WHERE a.t <> 'error' AND a.user_id + 1 IN (SELECT user_id FROM c) AND a.user_id NOT IN (SELECT user_id FROM b)""")
def kernel_t05_t09_t10_invalidated_files(spark, sf_dir):
    """Files that refer to a user whose definition the second batch has changed."""
    return _workspace(spark, sf_dir).dirty


@query("SELECT count(DISTINCT coalesce(text, '')) AS contents, count(*) AS files FROM documents")
def kernel_f30_content_hashes(spark, sf_dir):
    """Equal texts have equal hashes, different ones different hashes."""
    rows = _read(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("content"))
    return rows.select(workspace.content_hash().alias("h")).agg(F.countDistinct("h").alias("contents"), F.count("*").alias("files"))


# flows: lines of an order as what its method does, in order


def _uses(spark, sf_dir) -> DataFrame:
    use = F.when(F.col("l_returnflag") == "A", "called").when(F.col("l_returnflag") == "N", "returned").otherwise(F.when(F.col("l_linestatus") == "F", "read").otherwise("yielded"))
    rows = _read(spark, sf_dir, "lineitem")
    return rows.select(F.lit("C").alias("class"), _n("l_orderkey").alias("name"), (F.col("l_linenumber") % 2).alias("idx"), F.when(F.col("l_tax") >= 0.08, "narrowed").otherwise(use).alias("use"))


USES = """u AS (SELECT l_orderkey::VARCHAR AS name, l_linenumber % 2 AS idx, CASE WHEN l_tax >= 0.08 THEN 'narrowed' WHEN l_returnflag = 'A' THEN 'called' WHEN l_returnflag = 'N' THEN 'returned' WHEN l_linestatus = 'F' THEN 'read' ELSE 'yielded' END AS use FROM lineitem),
f AS (SELECT name, idx, CASE WHEN bool_and(use = 'called') THEN 'called' WHEN bool_and(use IN ('returned', 'yielded')) THEN 'pass_through' WHEN bool_or(use IN ('returned', 'yielded')) THEN 'constrained' END AS flow FROM u GROUP BY 1, 2 HAVING NOT bool_or(use = 'narrowed'))"""


@query(f"WITH {USES} SELECT name, idx, flow FROM f WHERE flow IS NOT NULL")
def kernel_b01_param_flows(spark, sf_dir):
    """Lines as uses of one of two parameters of their order."""
    return flows.param_flows(_uses(spark, sf_dir)).drop("class")


@query(f"""WITH {USES}, k AS (SELECT *, flow = 'called' AS proc FROM f WHERE flow IS NOT NULL AND NOT (flow = 'constrained' AND name::BIGINT % 5 = 0)),
n AS (SELECT *, count(*) OVER (PARTITION BY name, proc) AS same FROM k)
SELECT name, idx, CASE WHEN proc THEN '^(*untyped) -> R' || CASE WHEN same = 2 THEN (idx + 1)::VARCHAR ELSE '' END WHEN same = 2 THEN CASE idx WHEN 0 THEN 'IK' ELSE 'IN' END ELSE 'I' END AS shown,
CASE WHEN flow = 'constrained' THEN 'Type' || idx END AS bound FROM n""")
def kernel_b11_inferred_type_params(spark, sf_dir):
    """Parameters as type variables, named for them; every fifth order's callers say nothing."""
    uses = _uses(spark, sf_dir)
    kind = F.when(F.col("name").cast("long") % 5 == 0, "untyped").otherwise(F.concat(F.lit("Type"), "idx"))
    params = uses.select("class", "name", "idx", F.when(F.col("idx") == 0, "item_key").otherwise("item_name").alias("pname"), kind.alias("type")).distinct()
    return generics.inferred_type_params(params, flows.param_flows(uses)).select("name", "idx", "shown", "bound")


def _ways(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    return rows.select(F.lit("C").alias("class"), _n("l_orderkey").alias("name"), F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus").alias("path"), (F.col("l_returnflag") == "R").alias("invoked"), F.when(F.col("l_returnflag") == "A", _text("s", (F.col("l_suppkey") % 2).cast("string"))).alias("forward"), (F.col("l_quantity") < 5).alias("dead"), F.col("l_linestatus").alias("status"))


RUNS = """CASE WHEN bool_and(l_returnflag = 'R') THEN 'always' WHEN bool_or(l_returnflag = 'R') THEN 'maybe' ELSE 'never' END AS runs,
CASE WHEN bool_and(l_returnflag = 'A') AND min(l_suppkey % 2) = max(l_suppkey % 2) THEN 's' || min(l_suppkey % 2) END AS forward"""


@query(f"SELECT l_orderkey::VARCHAR AS name, {RUNS} FROM lineitem WHERE l_quantity >= 5 GROUP BY 1")
def kernel_b02_block_flow(spark, sf_dir):
    """Lines as ways through a method: returned ones run the block, others hand it on or drop it; small ones can't be taken."""
    return flows.block_flow(_ways(spark, sf_dir).drop("status")).drop("class")


@query(f"""SELECT o_orderkey AS site_id, {RUNS} FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 5 AND (o_orderkey % 3 = 0 OR (l_linestatus = 'O') = (o_orderkey % 3 = 1)) GROUP BY 1""")
def kernel_b03_block_flow_for_literals(spark, sf_dir):
    """Calls that pass O or F, or nothing known; lines are taken by their status only."""
    ways = _ways(spark, sf_dir)
    conditions = ways.select("class", "name", "path", F.lit(0).alias("idx"), F.col("status").alias("literal"), F.lit(True).alias("equal"))
    literal = F.when(F.col("o_orderkey") % 3 == 1, "O").when(F.col("o_orderkey") % 3 == 2, "F")
    asked = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site_id"), F.lit("C").alias("class"), _n("o_orderkey").alias("name"), F.array(literal).alias("literals"))
    return flows.block_flow_for_literals(ways.drop("status"), conditions, asked)


def _events(spark, sf_dir, kind: Column, *more: Column) -> DataFrame:
    """Events of a user as statements about one local."""
    return _read(spark, sf_dir, "events").select(F.lit("C").alias("class"), _n("user_id").alias("name"), F.lit(0).alias("path"), F.lit("x").alias("local"), F.col("event_id").alias("ord"), kind.alias("kind"), *more)


PARTED = "e AS (SELECT *, sum(CASE WHEN event_type IN ({}) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM events)"


@query(f"""WITH {PARTED.format("'error'")} SELECT r.user_id::VARCHAR AS name, r.event_id AS ord, coalesce((SELECT string_agg(DISTINCT 'k' || (w.event_id % 7), ',' ORDER BY 'k' || (w.event_id % 7)) FROM e w
WHERE w.user_id = r.user_id AND w.part = r.part AND w.event_id < r.event_id AND w.event_type IN ('click', 'signup')), '') AS keys FROM e r WHERE r.event_type = 'view'""")
def kernel_b05_b06_key_facts(spark, sf_dir):
    """Clicks write a key, signups guard one, errors break all, views read."""
    t = F.col("event_type")
    kind = F.when(t == "click", "write").when(t == "signup", "guard").when(t == "error", "break").when(t == "view", "read").otherwise("other")
    found = flows.key_facts(_events(spark, sf_dir, kind, _text("k", (F.col("event_id") % 7).cast("string")).alias("key")))
    return found.select("name", "ord", F.array_join("keys", ",").alias("keys"))


@query(f"""WITH {PARTED.format("'error'")} SELECT r.user_id::VARCHAR AS name, r.event_id AS ord, coalesce((SELECT max(CASE WHEN w.event_type = 'click' THEN w.event_id % 5 ELSE w.event_id % 5 + 1 END) FROM e w
WHERE w.user_id = r.user_id AND w.part = r.part AND w.event_id < r.event_id AND w.event_type IN ('click', 'signup')), 0) AS min_size FROM e r WHERE r.event_type = 'view'""")
def kernel_b07_element_guards(spark, sf_dir):
    """Clicks guard a size, signups an element."""
    t = F.col("event_type")
    kind = F.when(t == "click", "size").when(t == "signup", "element").when(t == "error", "break").when(t == "view", "read").otherwise("other")
    return flows.element_guards(_events(spark, sf_dir, kind, (F.col("event_id") % 5).alias("n"))).select("name", "ord", "min_size")


@query(f"""WITH {PARTED.format("'error', 'purchase'")} SELECT r.user_id::VARCHAR AS name, r.event_id AS ord, (SELECT arg_max('T' || w.event_id, w.event_id) FROM e w
WHERE w.user_id = r.user_id AND w.part = r.part AND w.event_id < r.event_id AND w.event_type = 'click' AND EXISTS (SELECT 1 FROM e n WHERE n.user_id = r.user_id AND n.part = r.part AND n.event_type = 'purchase')) AS type FROM e r WHERE r.event_type = 'view'""")
def kernel_b08_exclusive_attributes(spark, sf_dir):
    """Purchases make a fresh object, clicks write its attribute, errors let it escape, views read."""
    t = F.col("event_type")
    kind = F.when(t == "purchase", "new").when(t == "click", "write").when(t == "error", "escape").when(t == "view", "read").otherwise("other")
    return flows.exclusive_attributes(_events(spark, sf_dir, kind, F.lit("a").alias("attribute"), _text("T", _n("event_id")).alias("type"))).select("name", "ord", "type")


@query("""WITH RECURSIVE w AS (SELECT user_id, event_type FROM events WHERE event_type <> 'error' GROUP BY ALL), r AS (SELECT DISTINCT user_id AS root, user_id FROM events UNION SELECT root, user_id + 1 FROM r WHERE user_id % 5 <> 4 AND user_id + 1 IN (SELECT user_id FROM events))
SELECT 'U' || root AS class, (SELECT string_agg(DISTINCT '@' || event_type, ',' ORDER BY '@' || event_type) FROM r q JOIN w USING (user_id) WHERE q.root = r.root) AS ivars FROM r GROUP BY root""")
def kernel_b04_self_effects(spark, sf_dir):
    """Users as methods that write their events' variables and call the next user, up to every fifth."""
    rows = _read(spark, sf_dir, "events")
    users = rows.select("user_id").distinct()
    one = F.lit("U")
    own = rows.filter("event_type <> 'error'").groupBy("user_id").agg(F.collect_set(_text("@", F.col("event_type"))).alias("ivars"))
    own = users.join(own, "user_id", "left").select(one.alias("class"), _n("user_id").alias("method"), F.coalesce("ivars", F.array().cast("array<string>")).alias("ivars"), F.lit(False).alias("opaque"))
    edges = users.filter("user_id % 5 <> 4").join(users.select((F.col("user_id") - 1).alias("user_id")), "user_id")
    found = flow.self_effects(own, edges.select(one.alias("class"), _n("user_id").alias("method"), (F.col("user_id") + 1).cast("string").alias("callee")), reach)
    return found.select(_text("U", F.col("method")).alias("class"), F.nullif(F.array_join("ivars", ","), F.lit("")).alias("ivars"))


@query("""SELECT n_nationkey AS k, 'Array[N' || n_nationkey || '?]' AS first, 'Hash[Symbol, Array[N' || n_nationkey || '?]]' AS second, 'untyped' AS circle FROM nation""")
def kernel_b20_r07_b41_type_aliases(spark, sf_dir):
    """Aliases that name aliases, and a circle of them."""
    n = [r["n_nationkey"] for r in _read(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 rows: aliases of one file each
    out = []
    for k in n:
        raw = {"a": T.array(T.cls("c")), "b": ("hash", T.SYMBOL, T.cls("a")), "c": T.union(T.cls(f"N{k}"), T.NIL), "x": T.cls("y"), "y": T.cls("x")}
        found = sources.resolve_aliases(raw)
        out.append((k, T.dumps(found["a"]), T.dumps(found["b"]), T.dumps(found["x"])))
    rows = spark.createDataFrame(out, "k int, first string, second string, circle string")
    return rows.select("k", *[columns.rendered(c).alias(c) for c in ("first", "second", "circle")])


@query("SELECT 'B' || n_nationkey AS class, 'T, U' AS params, 'def put: (untyped a, untyped b) -> Array[untyped]' AS text FROM nation")
def kernel_s11_class_type_parameters(spark, sf_dir):
    """Classes with declared type parameters; where nothing binds them, their methods' types are untyped."""
    content = _text("class B", _n("n_nationkey"), "[T, U]\n  def put: (T a, U b) -> Array[T]\nend\n")
    declared = sources.declarations(_read(spark, sf_dir, "nation").select(_n("n_nationkey").alias("file"), content.alias("content")))
    line = render.method_line("name", "overloads", "singleton", F.lit(False), F.lit(True))
    methods = declared.filter("row = 'method'").select(F.col("owner").alias("class"), line.alias("text"))
    return sources.classes(declared).select("class", F.array_join("type_params", ", ").alias("params")).join(methods, "class")


@query("""SELECT 'N' || n_nationkey AS class, name, 'late' AS ret FROM nation, (VALUES ('a'), ('b')) v(name) WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'N' || n_nationkey, 'b', 'early' FROM nation WHERE n_nationkey % 2 = 1""")
def kernel_b22_pending_aliases(spark, sf_dir):
    """Aliases of b whose source is loaded later: the first pass leaves them, the second adds them."""
    n = _read(spark, sf_dir, "nation").select(_text("N", _n("n_nationkey")).alias("class"), "n_nationkey")
    no = F.lit(False).alias("singleton")
    early = n.filter("n_nationkey % 2 = 1").select("class", F.lit("b").alias("name"), no, F.lit("early").alias("ret"))
    late = n.filter("n_nationkey % 2 = 0").select("class", F.lit("a").alias("name"), no, F.lit("late").alias("ret"))
    aliases = n.select("class", F.lit("b").alias("name"), no, F.lit("a").alias("old"))
    first = sources.apply_method_aliases(early, aliases)
    return sources.apply_method_aliases(first.unionByName(late), aliases).drop("singleton")


@query("""SELECT 'N' || n_nationkey AS class, CASE n_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS fits FROM nation""")
def kernel_b53_f32_duck_types(spark, sf_dir):
    """Arguments against duck types: classes that answer all its methods, lack one, or are not known whole."""
    n = _read(spark, sf_dir, "nation").select(_text("N", _n("n_nationkey")).alias("class"), "n_nationkey")
    names = n.select("class", F.explode(F.when(F.col("n_nationkey") % 3 == 0, F.array(*map(F.lit, ["begin", "end", "exclude_end?"]))).otherwise(F.array(F.lit("begin")))).alias("name"))
    paths = n.select("class", F.col("class").alias("owner"))
    wanted = lookup.builtin_interfaces(spark).filter("interface = '_Range'")
    answers = lookup.responds_to_all(n, wanted, paths, names).select("class", F.lit(True).alias("all"))
    known = F.col("n_nationkey") % 3 != 2
    return n.join(answers, "class", "left").select("class", F.when(F.coalesce("all", F.lit(False)), 2).when(known, 0).otherwise(1).alias("fits"))


@query("""SELECT 'N' || n_nationkey AS class, name, CASE WHEN block THEN 'Array[N' || n_nationkey || ']' WHEN name = 'join' THEN 'Array[N' || n_nationkey || ']' END AS records FROM nation, (VALUES ('select', true), ('select', false), ('join', false), ('where', false)) v(name, block)""")
def kernel_f17_records_receivers(spark, sf_dir):
    """Relation calls that run on loaded records: with a block, or because relations don't have them."""
    asked = F.array(*[F.struct(F.lit(m).alias("name"), F.lit(b).alias("block")) for m, b in (("select", True), ("select", False), ("join", False), ("where", False))])
    term = _text('["generic","ActiveRecord::Relation",[["class","N', _n("n_nationkey"), '"]]]')
    rows = _read(spark, sf_dir, "nation").select(_text("N", _n("n_nationkey")).alias("class"), term.alias("t"), F.explode(asked).alias("m")).select("class", "t", "m.*")
    found = rows.withColumn("records", columns.records_receiver("t", "name", "block"))
    return found.select("class", "name", F.when(F.col("records").isNotNull(), columns.rendered(F.coalesce("records", F.lit('["nil"]')))).alias("records"))


@query("""SELECT 'n' || n_nationkey || '.md' AS file, 'Case ' || n_nationkey AS "case", step, 'def a = ' || step || chr(10) AS ruby, 'def a: () -> ' || step || chr(10) AS expected, n_nationkey % 2 = 0 AS known_issue, CASE WHEN step = 0 THEN 'lib/x.rb' ELSE '' END AS paths FROM nation, (VALUES (0), (1)) v(step)""")
def kernel_s38_s41_scenarios(spark, sf_dir):
    """Test cases in Markdown, each with two steps; the first has a project file beside the current one."""
    known = F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false")
    step = lambda k, extra="": f"### update\n\n{extra}```ruby\ndef a = {k}\n```\n\n### result\n\n```rbs\ndef a: () -> {k}\n```\n"
    content = _text("# Title\n\n## Case ", _n("n_nationkey"), '\n\n```yaml\nruby_version: "3.3"\nknown_issue: ', known, "\n```\n\n", step(0, "### file: lib/x.rb\n\n```ruby\nclass X; end\n```\n\n"), "\n", step(1))
    rows = scenarios.steps(_read(spark, sf_dir, "nation").select(_text("n", _n("n_nationkey"), ".md").alias("file"), content.alias("content")))
    return rows.filter("error IS NULL AND ruby_version = '3.3'").select("file", "case", "step", "ruby", "expected", "known_issue", F.array_join(F.transform("project", lambda p: p.path), ",").alias("paths"))


@query(f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'Integer' WHEN 'view' THEN 'true' WHEN 'error' THEN '-' WHEN 'signup' THEN '-' ELSE 'String' END AS truthy,
CASE event_type WHEN 'click' THEN 'nil' WHEN 'view' THEN 'false' WHEN 'error' THEN 'nil' WHEN 'signup' THEN 'false' ELSE '-' END AS falsy, CASE event_type WHEN 'click' THEN 'Integer' WHEN 'view' THEN 'bool' WHEN 'error' THEN 'bot' WHEN 'signup' THEN 'false' ELSE 'String' END AS non_nil FROM events""")
def kernel_p02_p03_p04_projections(spark, sf_dir):
    """What is left of a value that is known to be truthy, falsy, or not nil."""
    t = F.col("event_type")
    term = F.when(t == "click", T.dumps(T.union(T.INTEGER, T.NIL))).when(t == "view", T.dumps(T.BOOL)).when(t == "error", T.dumps(T.NIL)).when(t == "signup", T.dumps(T.FALSE)).otherwise(T.dumps(T.STRING))
    show = lambda c: F.when(c.isNull(), "-").otherwise(columns.rendered(F.coalesce(c, F.lit('["nil"]'))))
    return _read(spark, sf_dir, "events").select("event_id", show(columns.truthy(term)).alias("truthy"), show(columns.falsy(term)).alias("falsy"), show(columns.non_nil(term)).alias("non_nil"))
