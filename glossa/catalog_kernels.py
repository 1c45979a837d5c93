"""Kernels of term functions, binding, lookup, point queries and diagnostics over the driver's tables, with their SQL.

Lines of orders stand for arguments, elements and sites, their flags for types; events for observations; suppliers below nations below
regions for classes. Imported by `catalog`, which registers them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from glossa.functions import columns, flow, positions
from glossa.functions import terms as T
from glossa.operators import calls, coverage, diagnostics, lookup, provenance, queries, render
from glossa.plans.fixpoint import dealt, numbered
from glossa.sources import signatures as sources

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by(column: str, table: dict[str, tuple], otherwise: tuple | None = None) -> Column:
    """The term (JSON) of each value of a column."""
    out = None
    for value, term in table.items():
        out = F.when(F.col(column) == value, T.dumps(term)) if out is None else out.when(F.col(column) == value, T.dumps(term))
    return out if otherwise is None else out.otherwise(T.dumps(otherwise))


def _case(column: str, table: dict[str, str | int | bool]) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in table.items()) + " END"


def _lit(head: str, text: Column) -> Column:
    """A literal's term of a column."""
    quote = '"' if head != "lit_int" else ""
    return F.concat(F.lit(f'["{head}",{quote}'), text.cast("string"), F.lit(f"{quote}]"))


def _tuple(terms: Column) -> Column:
    return F.concat(F.lit('["tuple",['), F.array_join(terms, ","), F.lit("]]"))


#: One line for each number of an order, as numbers repeat.
ONE = "(SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)"


def _lines(spark, sf_dir):
    return dealt(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_suppkey")])


A, X = T.cls("A"), ("ivar", "@x")
CALL, KEY = ("method_return", "A", "m"), ("keyword_param", "k")


# projections and substitutions: events, whose types say what their values are

RECEIVERS = {"click": A, "view": T.union(A, T.NIL), "error": T.NIL, "signup": T.UNTYPED, "purchase": X}


@query(f"SELECT event_id, {_case('event_type', {'click': 'String', 'view': 'String?', 'error': 'nil', 'signup': 'String?', 'purchase': 'untyped'})} AS type FROM events")
def kernel_p05_safe_navigation(spark, sf_dir):
    """receiver&.call that gives a string."""
    rows = _read(spark, sf_dir, "events")
    return rows.select("event_id", columns.rendered(columns.safe_navigation(_by("event_type", RECEIVERS), F.lit(T.dumps(T.STRING)))).alias("type"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN l_linenumber::VARCHAR WHEN 'N' THEN '["' || l_linestatus || '", ' || l_linenumber || ']' ELSE 'Hash[:' || l_linestatus || ', ' || l_linenumber || ']' END AS exact,
CASE l_returnflag WHEN 'A' THEN 'Integer' WHEN 'N' THEN '[String, Integer]' ELSE 'Hash[Symbol, Integer]' END AS wide,
CASE l_returnflag WHEN 'A' THEN 'Integer' WHEN 'N' THEN 'Array[Integer | String]' ELSE 'untyped' END AS flat FROM lineitem""")
def kernel_p06_p01_p08_widened(spark, sf_dir):
    """Literals in tuples and hashes become their classes; tuples become arrays."""
    number, status = _lit("lit_int", F.col("l_linenumber")), F.col("l_linestatus")
    pair = _tuple(F.array(_lit("lit_str", status), number))
    hash_ = F.concat(F.lit('["hash",'), _lit("lit_sym", status), F.lit(","), number, F.lit("]"))
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_returnflag") == "A", number).when(F.col("l_returnflag") == "N", pair).otherwise(hash_).alias("t"))
    flat = F.when(F.col("l_returnflag") == "R", T.dumps(T.UNTYPED)).otherwise(columns.tuple_to_array(columns.widened("t")))
    return rows.select("l_orderkey", "l_linenumber", columns.rendered("t").alias("exact"), columns.rendered(columns.widened("t")).alias("wide"), columns.rendered(flat).alias("flat"))


def _by_place(lines, term):
    """l_orderkey, x: the terms t of an order's lines by number and part; lines that share both follow as the files hold them."""
    place = ["l_linenumber", "l_partkey", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    return lines.select("l_orderkey", F.struct(*place, term.alias("t")).alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))


@query("""SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag = 'N') = 1 THEN 'Array[' || max(CASE WHEN l_returnflag = 'N' THEN 'Integer' ELSE 'Symbol' END) || ']'
ELSE '[' || string_agg(CASE WHEN l_returnflag = 'N' THEN 'Integer' ELSE 'Symbol' END, ', ' ORDER BY l_linenumber, l_partkey) || ']' END AS type FROM lineitem GROUP BY 1""")
def kernel_p07_widened_arguments(spark, sf_dir):
    """An order's lines as a tuple: of equal parts an array."""
    part = F.when(F.col("l_returnflag") == "N", _lit("lit_int", F.col("l_linenumber"))).otherwise(_lit("lit_sym", F.col("l_returnflag")))
    rows = _by_place(_read(spark, sf_dir, "lineitem"), part)
    return rows.select("l_orderkey", columns.rendered(columns.widened_argument(_tuple(F.transform("x", lambda x: x.t)))).alias("type"))


@query("SELECT n_nationkey, '[' || n_name || ', Array[' || n_name || '], instance]' AS own, '[self, Array[self], ' || n_name || ']' AS other FROM nation")
def kernel_p09_p10_replaced_owners(spark, sf_dir):
    """self and instance stand for a nation."""
    term, owner = F.lit(T.dumps(("tuple", (("self",), T.array(("self",)), ("instance",))))), F.concat(F.lit('["class","'), "n_name", F.lit('"]'))
    rows = _read(spark, sf_dir, "nation")
    return rows.select("n_nationkey", columns.rendered(columns.replace_self(term, owner)).alias("own"), columns.rendered(columns.replace_instance(term, owner)).alias("other"))


WAITING = {"click": ("param", 0), "view": T.array(X), "error": T.union(T.STRING, CALL), "signup": T.STRING, "purchase": ("truthy", X)}


@query(f"""SELECT event_id, {_case('event_type', {'click': True, 'view': False, 'error': True, 'signup': False, 'purchase': True})} AS receiver,
{_case('event_type', {'click': True, 'view': True, 'error': True, 'signup': False, 'purchase': True})} AS anywhere,
{_case('event_type', {'click': 'untyped', 'view': 'Array[untyped]', 'error': 'untyped', 'signup': 'String', 'purchase': 'untyped'})} AS shown,
{_case('event_type', {'click': 'param(0)', 'view': 'Array[@x]', 'error': 'String | A#m', 'signup': 'String', 'purchase': 'truthy(@x)'})} AS symbolic FROM events""")
def kernel_p11_p12_p18_f27_deferred(spark, sf_dir):
    """Which types wait for a value, how a user sees them, and how provenance spells them."""
    t = _by("event_type", WAITING)
    return _read(spark, sf_dir, "events").select("event_id", columns.deferred_receiver(t).alias("receiver"), columns.is_deferred(t).alias("anywhere"), columns.rendered(columns.displayed(t)).alias("shown"), columns.symbolic(t).alias("symbolic"))


HOLES = {"click": ("tuple", (("todo",), KEY)), "view": T.array(X), "error": CALL, "signup": T.UNTYPED, "purchase": T.array(T.STRING)}
HOLE_KEYS = {"click": "missing_call_site", "view": "missing_instance_variable", "error": "missing_method", "signup": "explicit_untyped", "purchase": "-"}


@query(f"SELECT event_id, event_type <> 'purchase' AS hole, {_case('event_type', HOLE_KEYS)} AS reason FROM events")
def kernel_p15_d11_holes(spark, sf_dir):
    t = _by("event_type", HOLES)
    rows = _read(spark, sf_dir, "events").select("event_id", coverage.has_hole(t).alias("hole"), coverage.hole_reason(t, F.lit(True)).alias("reason"))
    return rows.withColumn("reason", F.when(F.col("hole"), F.col("reason")).otherwise("-"))


# joins of types: an order's lines


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'untyped' ELSE string_agg(DISTINCT ':' || l_returnflag, ' | ' ORDER BY ':' || l_returnflag) END AS kept,
CASE WHEN bool_and(l_returnflag = 'R') THEN 'untyped' ELSE string_agg(DISTINCT ':' || l_returnflag, ' | ' ORDER BY ':' || l_returnflag) FILTER (l_returnflag <> 'R') END AS dropped FROM lineitem GROUP BY 1""")
def kernel_a02_untyped_arms(spark, sf_dir):
    """The two joins differ in what an untyped arm does."""
    t = F.when(F.col("l_returnflag") == "R", T.dumps(T.UNTYPED)).otherwise(_lit("lit_sym", F.col("l_returnflag")))
    rows = _read(spark, sf_dir, "lineitem").withColumn("t", t)
    kept = columns.union_agg("t", ["l_orderkey"], rows, columns.union_type_keeping_untyped, "kept")
    both = kept.join(columns.union_agg("t", ["l_orderkey"], rows, columns.union_type, "dropped"), "l_orderkey")
    return both.select("l_orderkey", columns.rendered("kept").alias("kept"), columns.rendered("dropped").alias("dropped"))


ELEMENTS = {"A": T.array(T.INTEGER), "N": T.array(T.STRING), "R": ("tuple", (T.SYMBOL, T.INTEGER))}


@query("""WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN r AND NOT a AND NOT n THEN '[Symbol, Integer]' ELSE 'Array[' || array_to_string(list_filter([CASE WHEN a OR r THEN 'Integer' END, CASE WHEN n THEN 'String' END, CASE WHEN r THEN 'Symbol' END], lambda x: x IS NOT NULL), ' | ') || ']' END AS type FROM f""")
def kernel_a05_a10_merged_arrays(spark, sf_dir):
    """Arrays and tuples become one array; tuples of one length stay."""
    rows = _read(spark, sf_dir, "lineitem").withColumn("t", _by("l_returnflag", ELEMENTS))
    return columns.union_agg("t", ["l_orderkey"], rows).select("l_orderkey", columns.rendered("type").alias("type"))


HASHES = {"A": ("hash", T.SYMBOL, T.INTEGER), "N": ("hash", T.SYMBOL, T.union(T.INTEGER, T.STRING)), "R": ("hash", T.STRING, T.INTEGER)}


@query("""WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter([CASE WHEN r THEN 'Hash[String, Integer]' END, CASE WHEN a AND NOT n THEN 'Hash[Symbol, Integer]' END, CASE WHEN n THEN 'Hash[Symbol, Integer | String]' END], lambda x: x IS NOT NULL), ' | ') AS type FROM f""")
def kernel_a06_covered_hashes(spark, sf_dir):
    """A hash whose keys and values another one has vanishes."""
    rows = _read(spark, sf_dir, "lineitem").withColumn("t", _by("l_returnflag", HASHES))
    return columns.union_agg("t", ["l_orderkey"], rows).select("l_orderkey", columns.rendered("type").alias("type"))


@query("""SELECT l_orderkey, '[' || string_agg(DISTINCT l_linenumber::VARCHAR, ' | ' ORDER BY l_linenumber::VARCHAR) || ', ' || string_agg(DISTINCT ':' || l_returnflag, ' | ' ORDER BY ':' || l_returnflag) || ']' AS type FROM lineitem GROUP BY 1""")
def kernel_a07_merged_arguments(spark, sf_dir):
    """Tuples that calls pass merge slot by slot."""
    rows = _read(spark, sf_dir, "lineitem").withColumn("t", _tuple(F.array(_lit("lit_int", F.col("l_linenumber")), _lit("lit_sym", F.col("l_returnflag")))))
    return columns.union_agg("t", ["l_orderkey"], rows, columns.merged_arguments).select("l_orderkey", columns.rendered("type").alias("type"))


@query("""WITH f AS (SELECT user_id, list_sort(list_distinct(list(':' || event_type) FILTER (event_type NOT IN ('error', 'view')))) AS s, bool_or(event_type = 'error') AS nil FROM events GROUP BY 1)
SELECT user_id AS class, CASE WHEN len(coalesce(s, [])) = 0 THEN CASE WHEN nil THEN 'nil' ELSE 'untyped' END WHEN NOT nil THEN array_to_string(s, ' | ') WHEN len(s) = 1 THEN s[1] || '?' ELSE '(' || array_to_string(s, ' | ') || ')?' END AS type FROM f""")
def kernel_a08_appended_arguments(spark, sf_dir):
    """Users as methods called with events: errors pass nil, views something untyped, which typed arguments hide."""
    t = F.when(F.col("event_type") == "error", T.dumps(T.NIL)).when(F.col("event_type") == "view", T.dumps(T.UNTYPED)).otherwise(_lit("lit_sym", F.col("event_type")))
    bound = _read(spark, sf_dir, "events").select(F.col("user_id").alias("class"), F.lit("m").alias("name"), F.lit(False).alias("singleton"), F.lit("a").alias("pname"), t.alias("type"))
    return calls.parameter_types(bound).select("class", columns.rendered("type").alias("type"))


PROCS = {"A": ("proc", "proc", (T.INTEGER,), T.STRING, True), "N": ("proc", "proc", (T.INTEGER,), T.SYMBOL, True), "R": ("proc", "proc", (T.FLOAT,), T.STRING, True)}


@query("""WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey, '(^(' || CASE WHEN r AND (a OR n) THEN 'untyped' WHEN r THEN 'Float' ELSE 'Integer' END || ') -> ' || CASE WHEN n AND (a OR r) THEN '(String | Symbol)' WHEN n THEN 'Symbol' ELSE 'String' END || ')' AS type FROM f""")
def kernel_a11_merged_procs(spark, sf_dir):
    """Procs show as one: parameters that differ are untyped, returns are joined."""
    rows = _read(spark, sf_dir, "lineitem").withColumn("t", _by("l_returnflag", PROCS))
    return columns.union_agg("t", ["l_orderkey"], rows).select("l_orderkey", columns.rendered("type").alias("type"))


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'Array[' || array_to_string(list_concat(list_sort(list_distinct(list(CASE WHEN l_returnflag = 'N' THEN 'Integer' WHEN l_returnflag = 'R' THEN 'String' END))), list_sort(list_distinct(list(':' || l_linestatus) FILTER (l_returnflag <> 'R' AND l_returnflag <> 'N')))), ' | ') || ']'
ELSE '[' || coalesce(string_agg(CASE WHEN l_returnflag = 'N' THEN 'Integer' ELSE ':' || l_linestatus END, ', ' ORDER BY l_linenumber, l_partkey), '') || ']' END AS type FROM lineitem GROUP BY 1""")
def kernel_a12_a13_splats(spark, sf_dir):
    """[*line, *line, ...]: exact while all lines are tuples; nil gives nothing."""
    t = F.when(F.col("l_returnflag") == "N", T.dumps(("tuple", (T.INTEGER,)))).when(F.col("l_returnflag") == "R", T.dumps(T.array(T.STRING))).otherwise(_tuple(F.array(_lit("lit_sym", F.col("l_linestatus")))))
    rows = _by_place(_read(spark, sf_dir, "lineitem"), t)
    return rows.select("l_orderkey", columns.rendered(columns.splatted(F.concat(F.transform("x", lambda x: x.t), F.array(F.lit(T.dumps(T.NIL)))))).alias("type"))


WAYS = """a AS (SELECT l_orderkey AS local, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS k, bool_and(l_tax > 0.02) AS c FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
b AS (SELECT l_orderkey AS local, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS k, bool_and(l_tax > 0.02) AS c FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1)"""


@query(f"WITH {WAYS} SELECT local, array_to_string(list_sort(list_intersect(a.k, b.k)), ',') AS keys, a.c AND b.c AND a.k = b.k AS complete FROM a JOIN b USING (local)")
def kernel_a16_key_facts(spark, sf_dir):
    """Keys that a hash has on both ways."""
    rows = _read(spark, sf_dir, "lineitem")
    way = lambda df: df.groupBy(F.col("l_orderkey").alias("local")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("keys"), F.min(F.col("l_tax") > 0.02).alias("complete"))
    found = flow.join_key_facts(way(rows.filter("l_linenumber <= 3")), way(rows.filter("l_linenumber >= 2")))
    return found.select("local", F.array_join("keys", ",").alias("keys"), "complete")


@query(f"""SELECT l_orderkey AS local, l_linenumber AS attribute, CASE WHEN l_returnflag = l_linestatus THEN ':' || l_returnflag ELSE ':' || least(l_returnflag, l_linestatus) || ' | :' || greatest(l_returnflag, l_linestatus) END AS type FROM {ONE}""")
def kernel_a17_receiver_facts(spark, sf_dir):
    """Attributes known on both ways, their types joined."""
    rows = _lines(spark, sf_dir)
    way = lambda c: rows.select(F.col("l_orderkey").alias("local"), F.lit("C").alias("class"), F.col("l_linenumber").alias("attribute"), _lit("lit_sym", F.col(c)).alias("type"))
    return flow.join_receiver_facts(way("l_returnflag"), way("l_linestatus")).select("local", "attribute", columns.rendered("type").alias("type"))


LEVELS = {"click": ("tuple", (T.INTEGER, T.UNTYPED)), "view": T.cls("Unknown::Z"), "error": X, "signup": T.STRING, "purchase": CALL}


@query(f"""SELECT event_id, {_case('event_type', {'click': 1, 'view': 0, 'error': 0, 'signup': 2, 'purchase': 1})}::INTEGER AS outside, {_case('event_type', {'click': 1, 'view': 0, 'error': 1, 'signup': 2, 'purchase': 1})}::INTEGER AS inside,
CASE WHEN event_type = 'signup' THEN 2 ELSE 0 END AS called FROM events""")
def kernel_a18_a19_levels(spark, sf_dir):
    """How much is known of a value outside and inside a class, and of a call on it."""
    t, none = _by("event_type", LEVELS), F.lit(None).cast("string")
    return _read(spark, sf_dir, "events").select("event_id", coverage.type_level(t, none, none).alias("outside"), coverage.type_level(t, F.lit("C"), F.lit("m")).alias("inside"), coverage.call_level(t, F.lit(T.dumps(T.INTEGER)), none, none).alias("called"))


@query("""WITH d AS (SELECT doc_id, coalesce(lang, '-') AS lang, doc_id % 4 = 0 AS typed FROM documents WHERE doc_id % 5 <> 0)
SELECT kind, count(*) AS total, count(*) FILTER (level = 2) AS typed, count(*) FILTER (level = 0) AS unknown FROM (
SELECT 'method_return' AS kind, CASE WHEN typed THEN 2 ELSE 0 END AS level FROM d UNION ALL SELECT 'method_parameter', CASE WHEN typed THEN 0 ELSE 2 END FROM d
UNION ALL SELECT 'instance_variable', min(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END) FROM documents GROUP BY coalesce(lang, '-')) GROUP BY 1""")
def kernel_a21_declaration_sites(spark, sf_dir):
    """Documents as methods; those from signatures (every fifth) don't count."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("class"), F.col("doc_id").cast("string").alias("name"), F.lit(False).alias("singleton"))
    typed = F.col("doc_id") % 4 == 0
    origin = F.when(F.col("doc_id") % 5 == 0, "rbs_file").otherwise("source")
    methods = docs.withColumn("origin", origin).withColumn("ret", F.when(typed, T.dumps(T.STRING)))
    params = docs.withColumn("pname", F.lit("a")).withColumn("type", F.when(~typed, T.dumps(T.INTEGER)))
    ivars = docs.select("class", F.lit("@a").alias("ivar"), F.when(F.col("doc_id") % 2 == 0, T.dumps(T.STRING)).otherwise(T.dumps(T.UNTYPED)).alias("type"))
    found = coverage.counts(coverage.declaration_sites(methods, params, ivars), ["kind"])
    return found.select("kind", "total", "typed", "unknown")


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN 'missing_method' WHEN doc_id % 7 = 0 THEN 'explicit_untyped' ELSE 'unknown' END AS reason, 'method_return' AS kind, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1
UNION ALL SELECT 'missing_instance_variable', 'instance_variable', count(*) FROM documents WHERE doc_id % 11 = 0""")
def kernel_a22_o02_type_holes(spark, sf_dir):
    """Holes of declared types by reason; annotated ones are explicit."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.lit("f").alias("file"), F.lit("C").alias("class"), F.col("doc_id").cast("string").alias("name"), F.lit(False).alias("singleton"), (F.col("doc_id") % 7 == 0).alias("annotated"))
    ret = F.when(F.col("doc_id") % 2 == 1, T.dumps(T.STRING)).when(F.col("doc_id") % 3 == 0, T.dumps(CALL)).otherwise(T.dumps(T.UNTYPED))
    ivars = docs.filter("doc_id % 11 = 0").select("file", "class", F.concat(F.lit("@"), "name").alias("ivar"), F.lit(T.dumps(X)).alias("type"))
    params = spark.createDataFrame([], "class string, name string, singleton boolean, pname string, kind string, type string")
    found = coverage.type_holes(docs.withColumn("ret", ret), params, ivars)
    return found.groupBy("reason", "kind").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS start, CASE WHEN l_orderkey % 2 = 0 THEN 'Integer' WHEN l_linenumber % 2 = 1 THEN 'untyped' ELSE 'bot' END AS type FROM lineitem""")
def kernel_a29_coalesced_arguments(spark, sf_dir):
    """Two walks over each line's argument: of even orders one walk knows the type, which then stands."""
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber").alias("n")).distinct()
    walks = rows.withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1))))
    weak = F.when(F.col("n") % 2 == 1, T.dumps(T.UNTYPED)).otherwise(T.dumps(T.BOT))
    t = F.when((F.col("ord") == 1) & (F.col("l_orderkey") % 2 == 0), T.dumps(T.INTEGER)).otherwise(weak)
    none = F.lit(None).cast("string")
    args = F.array(F.struct(F.col("n").alias("start"), (F.col("n") + 1).alias("end"), none.alias("keyword"), F.lit(0).alias("idx"), t.alias("type")))
    sites = walks.select(F.col("l_orderkey").cast("string").alias("file"), F.col("n").alias("start"), (F.col("n") + 1).alias("end"), none.alias("receiver"), F.lit("m").alias("name"), none.alias("owner"), F.lit(False).alias("singleton"), "ord", F.lit(False).alias("safe"), none.alias("block"), args.alias("args"))
    found = diagnostics.coalesce_argument_sites(sites)
    return found.select("file", "start", columns.rendered(F.col("args")[0].type).alias("type"))


@query("""SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ',' ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber) AS sorted FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem) GROUP BY 1""")
def kernel_o06_canonical_order(spark, sf_dir):
    """Terms of an order's lines in the canonical order: literals of integers, then of strings, then of symbols, each by value."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    text = F.lpad(n.cast("string"), 4, "0")
    t = F.when(flag == "A", _lit("lit_int", n)).when(flag == "N", _lit("lit_str", text)).otherwise(_lit("lit_sym", text))
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", t.alias("t")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    back = {"lit_int": "A", "lit_str": "N", "lit_sym": "R"}
    sorted_ = columns.canonical_order("ts")
    shown = F.transform(sorted_, lambda x: F.concat(F.create_map(*[F.lit(v) for kv in back.items() for v in kv])[F.get_json_object(x, "$[0]")], F.get_json_object(x, "$[1]").cast("int").cast("string")))
    return rows.select("l_orderkey", F.array_join(shown, ",").alias("sorted"))


@query("""SELECT doc_id, '"' || replace(replace(replace(replace(replace(replace(t, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r'), '#{', '\\#{') || '"' AS shown FROM (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL)""")
def kernel_f24_escaped_literals(spark, sf_dir):
    """Whole texts as string literals."""
    rows = _read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", columns.rendered(F.to_json(F.array(F.lit("lit_str"), "text"))).alias("shown"))


@query("""WITH l AS (SELECT doc_id, list_extract(string_split(text, chr(10)), 1) AS first, length(text) - length(replace(text, chr(10), '')) AS breaks, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(strlen(first) AS BIGINT) AS end_of_first, CAST(strlen(text) AS BIGINT) AS end_of_last FROM l""")
def kernel_f25_utf16_offsets(spark, sf_dir):
    """The ends of the first and of the last line, given in UTF-16 units, as byte offsets."""
    rows = _read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    units = lambda c: F.length(F.encode(c, "UTF-16BE")) / 2
    parts = F.split("text", "\n")
    return rows.select("doc_id", positions.utf16_offsets("text", F.lit(0), units(parts[0]).cast("int")).alias("end_of_first"), positions.utf16_offsets("text", F.size(parts) - 1, units(F.element_at(parts, -1)).cast("int")).alias("end_of_last"))


# binding: lines of orders as arguments


def _arguments(spark, sf_dir, keyword: Column | None = None):
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = _read(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(line))
    none = F.lit(None).cast("string")
    return rows.select(F.col("l_orderkey").alias("site_id"), "pos", (none if keyword is None else keyword).alias("keyword"), _lit("lit_sym", F.col("l_returnflag")).alias("type"))


def _sites(spark, sf_dir, open_splat=None):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site_id"))
    return rows.select("site_id", F.lit("C").alias("owner"), F.lit("m").alias("method"), F.lit(False).alias("singleton"), F.lit(open_splat).cast("int").alias("open_splat"))


def _params(spark, kinds):
    return spark.createDataFrame([("C", "m", False, i, n, k, None) for i, (n, k) in enumerate(kinds)], "class string, name string, singleton boolean, idx int, pname string, kind string, default_type string")


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n, bool_or(r = 1 AND l_returnflag IS NOT NULL) AS f FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) GROUP BY 1)
SELECT o_orderkey AS site_id, CASE WHEN coalesce(n, 0) > 0 THEN 'Symbol' ELSE 'untyped' END AS a, CASE WHEN coalesce(n, 0) > 0 THEN 'Symbol' ELSE 'untyped' END AS b FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def kernel_j05_open_splats(spark, sf_dir):
    """The first argument is a splat of unknown length, so it may reach every parameter."""
    found = calls.bound_arguments(_sites(spark, sf_dir, 0), _arguments(spark, sf_dir), _params(spark, [("a", "required"), ("b", "optional")]))
    return found.groupBy("site_id").pivot("pname", ["a", "b"]).agg(F.first("type")).select("site_id", columns.rendered("a").alias("a"), columns.rendered("b").alias("b"))


@query("""WITH k AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS has1, count(DISTINCT l_linenumber) FILTER (l_linenumber > 1) AS more FROM lineitem GROUP BY 1)
SELECT o_orderkey AS site_id, CASE WHEN has1 = 1 THEN 'Symbol' ELSE 'untyped' END AS k1, CASE WHEN more > 0 THEN 'Hash[Symbol, Symbol]' ELSE '-' END AS rest FROM orders LEFT JOIN k ON l_orderkey = o_orderkey""")
def kernel_j06_keywords(spark, sf_dir):
    """Lines as keywords k1, k2, ...: one is declared, the rest goes to **rest."""
    args = _arguments(spark, sf_dir).drop("keyword").withColumn("keyword", F.lit(None).cast("string"))
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("k"), "l_linenumber").alias("keyword"), _lit("lit_sym", F.col("l_returnflag")).alias("type"))
    found = calls.bound_arguments(_sites(spark, sf_dir), args.limit(0).select(*rows.columns).unionByName(rows), _params(spark, [("k1", "keyword_required"), ("rest", "double_rest")]))
    by = found.groupBy("site_id").pivot("pname", ["k1", "rest"]).agg(F.first("type"))
    return by.select("site_id", columns.rendered("k1").alias("k1"), F.when(F.col("rest").isNull(), "-").otherwise(columns.rendered("rest")).alias("rest"))


@query("""WITH n AS (SELECT l_orderkey AS site_id, count(*) AS n FROM lineitem GROUP BY 1), o(overload, low, high) AS (VALUES (0, 1, 1), (1, 2, 3), (2, 3, 100000))
SELECT site_id, overload FROM n, o WHERE (n BETWEEN low AND high) OR (SELECT count(*) FROM o p WHERE n.n BETWEEN p.low AND p.high) <> 1""")
def kernel_j20_j21_b47_overloads(spark, sf_dir):
    """(a), (a, b, c = 1) and (a, b, c, *rest): all stay if not exactly one fits."""
    asked = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("site_id")).agg(F.count("*").cast("int").alias("positional"))
    asked = asked.select("site_id", F.lit("C").alias("class"), F.lit("m").alias("name"), "positional", F.array().cast("array<string>").alias("keywords"), F.lit(None).cast("boolean").alias("block"))
    shapes = [["required"], ["required", "required", "optional"], ["required", "required", "required", "rest"]]
    rows = [("C", "m", k, [(f"p{i}", kind, None) for i, kind in enumerate(kinds)]) for k, kinds in enumerate(shapes)]
    overloads = spark.createDataFrame(rows, "class string, name string, overload int, params array<struct<pname:string,kind:string,default_type:string>>")
    return calls.accepted_overloads(asked, overloads).select("site_id", "overload")


@query("SELECT o_orderkey AS site_id, CASE WHEN n IS NULL THEN 'untyped' ELSE '{ ' || n || ' }' END AS type FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('k' || l_linenumber || ': Symbol', ', ' ORDER BY 'k' || l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1) ON l_orderkey = o_orderkey")
def kernel_a30_keyword_records(spark, sf_dir):
    """Keywords of a method that declares none arrive as one record."""
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("k"), "l_linenumber").alias("keyword"), _lit("lit_sym", F.col("l_returnflag")).alias("type"))
    found = calls.bound_arguments(_sites(spark, sf_dir), rows, _params(spark, [("options", "required")]))
    return found.select("site_id", columns.rendered("type").alias("type"))


# names


@query("SELECT page_id, CAST(unnest(range(0, len(p) + 1)) AS BIGINT) AS cut, CASE WHEN cut = len(p) THEN 'Z' ELSE array_to_string(p[1:len(p) - cut], '::') || '::Z' END AS path FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)")
def kernel_j08_scoped_paths(spark, sf_dir):
    """What a namespace may mean inside a page's address, the innermost first."""
    parts = F.filter(F.split(F.regexp_extract("url", "://([^?#]*)", 1), "/"), lambda x: x != "")
    rows = _read(spark, sf_dir, "pages").select("page_id", F.array_join(parts, "::").alias("scope"))
    return rows.select("page_id", F.posexplode(lookup.scoped_paths(F.lit("Z"), F.col("scope"))).alias("cut", "path")).withColumn("cut", F.col("cut").cast("long"))


@query("""SELECT s_suppkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN r_name || '::' || n_name ELSE n_name END AS class FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def kernel_j09_class_names(spark, sf_dir):
    """A nation named inside its region: half of them are declared there, the others nowhere."""
    s, n, r = (_read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    names = rows.select(F.col("s_suppkey").alias("id"), F.concat_ws("::", "r_name", "s_name").alias("owner"), F.col("n_name").alias("name"))
    classes = rows.filter("n_nationkey % 2 = 0").select(F.concat_ws("::", "r_name", "n_name").alias("class")).distinct()
    return lookup.resolve_class_names(names, classes).select("id", "class")


@query("""SELECT 'U' || user_id || '#m' AS id, string_agg(DISTINCT 'U' || (user_id + 1) || '#' || event_type, ',' ORDER BY 'U' || (user_id + 1) || '#' || event_type) AS deps, count(DISTINCT event_id)::BIGINT AS callers FROM events GROUP BY user_id""")
def kernel_j11_trace_records(spark, sf_dir):
    """Users as declarations whose types refer to methods of the next user; events as their callers."""
    rows = _read(spark, sf_dir, "events")
    user = lambda k: F.concat(F.lit("U"), (F.col("user_id") + k).cast("string"))
    ref = F.concat(F.lit('["method_return","'), user(1), F.lit('","'), "event_type", F.lit('"]'))
    by = rows.groupBy("user_id").agg(F.array_sort(F.collect_set(ref)).alias("refs"))
    raw = F.when(F.size("refs") == 1, F.col("refs")[0]).otherwise(F.concat(F.lit('["union",['), F.array_join("refs", ","), F.lit("]]")))
    mine = provenance.method_id(user(0), F.lit("m"), F.lit(False))
    declared = by.select(mine.alias("id"), user(0).alias("owner"), F.lit("method").alias("kind"), F.lit("untyped").alias("type"), raw.alias("raw_type"), F.lit("source").alias("origin"), F.lit("f").alias("file"), F.lit(1).alias("line"))
    asked = rows.select(mine.alias("id"), F.lit("f").alias("file"), F.col("event_id").alias("line"), F.lit("nil").alias("type"), F.lit("x").alias("in"))
    return provenance.trace_records(declared, asked).select("id", F.array_join("deps", ",").alias("deps"), F.size("callers").cast("long").alias("callers"))


@query("""SELECT 'U' || user_id AS id, count(DISTINCT event_type)::BIGINT AS refs, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 AS ivar FROM events GROUP BY user_id""")
def kernel_r06_body_references(spark, sf_dir):
    """What a user's joined type refers to: methods, and an instance variable for errors."""
    ref = F.when(F.col("event_type") == "error", T.dumps(("ivar", "@e"))).otherwise(F.concat(F.lit('["method_return","","'), "event_type", F.lit('"]')))
    by = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(ref)).alias("refs"))
    rows = by.select(F.concat(F.lit("U"), "user_id").alias("id"), F.explode(provenance.body_references(_tuple(F.col("refs")), F.concat(F.lit("U"), "user_id"))).alias("r"))
    return rows.filter("r.owner = id").groupBy("id").agg(F.count("*").alias("refs"), F.max(F.col("r.via") == "ivar").alias("ivar"))


HIERARCHY = """h AS (SELECT s_name AS class, n_name AS up FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
below AS (SELECT up AS class, class AS sub FROM h UNION SELECT a.up, b.class FROM h a JOIN h b ON b.up = a.class)"""


def _classes(spark, sf_dir):
    s, n, r = (_read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    none = F.lit(None).cast("string")
    middle = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("class"), F.col("r_name").alias("superclass"))
    leaves = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("class"), F.col("n_name").alias("superclass"))
    return r.select(F.col("r_name").alias("class"), none.alias("superclass")).union(middle).union(leaves)


def _paths(spark, sf_dir):
    return lookup.superclass_chain(_classes(spark, sf_dir)).withColumn("rank", F.array("depth"))


@query(f"""WITH {HIERARCHY} SELECT class, CASE WHEN count(DISTINCT s_nationkey % 2) = 2 THEN 'Integer | String' WHEN max(s_nationkey % 2) = 1 THEN 'Integer' ELSE 'String' END AS ret
FROM below JOIN supplier ON s_name = sub WHERE class IN (SELECT r_name FROM region) GROUP BY 1""")
def kernel_j26_subclass_returns(spark, sf_dir):
    """Regions call a method on self that only suppliers define."""
    none = F.lit(False).alias("singleton")
    methods = _read(spark, sf_dir, "supplier").select(F.col("s_name").alias("class"), F.lit("m").alias("name"), none, F.when(F.col("s_nationkey") % 2 == 1, T.dumps(T.INTEGER)).otherwise(T.dumps(T.STRING)).alias("ret"))
    asked = _read(spark, sf_dir, "region").select(F.col("r_name").alias("class"), F.lit("m").alias("name"), none)
    return queries.subclass_returns(asked, _paths(spark, sf_dir), methods).select("class", columns.rendered("ret").alias("ret"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place, o_custkey AS value FROM orders")
def kernel_j29_o03_in_order(spark, sf_dir):
    """Results come back in the order in which files were given."""
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("value"), F.col("o_orderkey").alias("k"))
    out = queries.in_order(rows.drop("k"), rows.select("path", (-F.col("k")).alias("ord")))
    # the place of each result in what came back
    return numbered(out.select("path", "value")).select("path", "place", "value")


@query("""SELECT module, list_sort(list_distinct(list(mixed))) [1] AS first, count(DISTINCT mixed) AS n FROM (
SELECT n_name AS module, r_name AS mixed FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1""")
def kernel_r10_reachable_modules(spark, sf_dir):
    mixins = _classes(spark, sf_dir).filter("superclass IS NOT NULL").select("class", F.col("superclass").alias("module"))
    return lookup.reachable_modules(mixins).groupBy("module").agg(F.min("mixed").alias("first"), F.count("*").alias("n"))


@query("""SELECT n_name AS class, CASE WHEN n_nationkey % 3 = 0 THEN 'P' WHEN n_nationkey % 3 = 1 THEN n_name ELSE r_name END AS owner FROM nation JOIN region ON n_regionkey = r_regionkey""")
def kernel_r05_prepended_modules(spark, sf_dir):
    """A prepended module answers before the class, the class before an included module, that before the superclass."""
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    none = F.lit(None).cast("string")
    classes = rows.select(F.col("n_name").alias("class"), F.col("r_name").alias("superclass")).union(r.select("r_name", none)).union(spark.range(1).select(F.lit("P"), none))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "prepend").otherwise("include")
    mixins = rows.filter("n_nationkey % 3 < 2").select(F.col("n_name").alias("class"), F.lit("P").alias("module"), kind.alias("kind"), F.lit(0).alias("ord"))
    no = F.lit(False).alias("singleton")
    methods = rows.filter("n_nationkey % 3 < 2").select(F.col("n_name").alias("class"), F.lit("m").alias("name"), no).union(r.select("r_name", F.lit("m"), no)).union(spark.range(1).select(F.lit("P"), F.lit("m"), no))
    asked = n.select(F.col("n_name").alias("class"), F.lit("m").alias("name"), no)
    return lookup.dispatch(asked, lookup.ancestors(classes, mixins), methods).select("class", "owner")


PREFIXED = """SELECT s_suppkey AS id, k.name, k.kind FROM supplier, LATERAL (SELECT 'n' || (s_suppkey % 7) AS name, 'local' AS kind UNION ALL SELECT 'n' || (s_suppkey % 5), 'method' WHERE s_suppkey % 5 <> s_suppkey % 7
UNION ALL SELECT 'N1', 'constant' UNION ALL SELECT 'next', 'keyword' UNION ALL SELECT 'nil', 'keyword' UNION ALL SELECT 'not', 'keyword') k WHERE starts_with(k.name, 'n')"""


@query(f"""SELECT id, name, kind, CAST(row_number() OVER (PARTITION BY id ORDER BY CASE kind WHEN 'local' THEN 0 WHEN 'method' THEN 1 ELSE 2 END, name) AS INTEGER) AS rank FROM ({PREFIXED})""")
def kernel_q05_o05_identifiers(spark, sf_dir):
    """Completion after `n`: locals, methods that no local hides, keywords; constants don't fit."""
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    name = lambda k: s.select("id", F.concat(F.lit("n"), F.col("id") % k).alias("name"))
    return lookup.identifier_completion(s.select("id", F.lit("n").alias("prefix")), name(7), name(5), s.select("id", F.lit("N1").alias("name")))


# point queries: documents as sites, lengths of pages as positions

SPANS = "c AS (SELECT doc_id, n_chars AS s, n_chars + 10 + doc_id % 400 AS e FROM documents), p AS (SELECT DISTINCT CAST(length(html) AS BIGINT) AS o FROM pages)"
INNER = "i AS (SELECT o, arg_min(doc_id, (e - s) * 1000000 + doc_id) AS d FROM p JOIN c ON s <= o AND o < e GROUP BY 1)"


def _spans(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.lit("f").alias("file"), F.col("n_chars").alias("start"), (F.col("n_chars") + 10 + F.col("doc_id") % 400).alias("end"), F.col("doc_id").alias("ord"))
    term = F.when(F.col("ord") % 3 == 0, T.dumps(X)).when(F.col("ord") % 3 == 1, _lit("lit_int", F.col("ord"))).otherwise(F.concat(F.lit('["union",[["nil"],["class","D'), F.col("ord").cast("string"), F.lit('"]]]')))
    kind = F.when(F.col("ord") % 2 == 0, "method_call").otherwise("value")
    return rows.select("file", "start", "end", "ord", kind.alias("kind"), F.concat(F.lit("d"), "ord").alias("name"), term.alias("type"), F.concat(F.lit('["class","R'), F.col("ord").cast("string"), F.lit('"]')).alias("receiver"), F.concat(F.lit("S"), F.col("ord") % 50).alias("symbol"))


def _points(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select(F.lit("f").alias("file"), F.length("html").cast("long").alias("offset")).distinct()


@query(f"WITH {SPANS}, {INNER} SELECT o AS \"offset\", 'd' || d AS name, CASE d % 3 WHEN 0 THEN 'untyped' WHEN 1 THEN d::VARCHAR ELSE 'D' || d || '?' END AS text FROM i")
def kernel_q01_hover(spark, sf_dir):
    return queries.hover(_points(spark, sf_dir), _spans(spark, sf_dir)).select("offset", "name", "text")


@query(f"WITH {SPANS}, {INNER.replace('JOIN c ON', 'JOIN (SELECT * FROM c WHERE doc_id % 2 = 0) c ON')} SELECT o AS \"offset\", CASE WHEN d IS NULL THEN NULL ELSE 'R' || d END AS receiver FROM p LEFT JOIN i USING (o)")
def kernel_q02_q03_b46_receivers(spark, sf_dir):
    """The receiver of the innermost call around a position; null outside of calls."""
    found = queries.receivers(_points(spark, sf_dir), _spans(spark, sf_dir))
    return found.select("offset", F.get_json_object("receiver", "$[1]").alias("receiver"))


@query(f"""WITH {SPANS}, {INNER}, b AS (SELECT o, arg_min(doc_id, (e - s) * 1000000 + doc_id) AS d FROM p JOIN c ON s <= o - 1 AND o - 1 < e GROUP BY 1)
SELECT o AS "offset", 'S' || (coalesce(i.d, b.d) % 50) AS symbol, (coalesce(i.d, b.d) % 50)::INTEGER AS def_line FROM p LEFT JOIN i USING (o) LEFT JOIN b USING (o)""")
def kernel_q07_j31_definitions(spark, sf_dir):
    """Where the symbol at a position, or just before it, is defined."""
    defined = spark.range(50).select(F.concat(F.lit("S"), "id").alias("symbol"), F.lit("g").alias("file"), F.col("id").cast("int").alias("line"))
    return queries.definitions(_points(spark, sf_dir), _spans(spark, sf_dir), defined).select("offset", "symbol", "def_line")


@query(f"WITH {SPANS}, {INNER} SELECT o AS \"offset\", CASE WHEN d % 3 = 2 THEN 'D' || d END AS class, CASE WHEN d % 3 = 2 THEN d END AS def_line FROM i")
def kernel_q08_type_definitions(spark, sf_dir):
    """Where the class of a value is declared; nil doesn't count."""
    classes = _read(spark, sf_dir, "documents").select(F.concat(F.lit("D"), "doc_id").alias("class"), F.lit("g").alias("file"), F.col("doc_id").alias("line"))
    return queries.type_definitions(_points(spark, sf_dir), _spans(spark, sf_dir), classes).select("offset", "class", "def_line")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS src, 100 + n_nationkey AS dst FROM nation UNION SELECT 100 + s_nationkey, 1000 + s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) WHERE r <= 8),
w AS (SELECT 0 AS depth, 1 AS node UNION SELECT depth + 1, dst FROM w JOIN e ON src = node WHERE depth < 2),
k AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY depth, 'x' || lpad(node::VARCHAR, 12, '0')) AS step FROM k)
SELECT CAST(step AS INTEGER) AS step, CAST(depth AS INTEGER) AS depth, 'x' || lpad(node::VARCHAR, 12, '0') AS node FROM r WHERE step <= 32""")
def kernel_q09_k15_w07_r08_explanations(spark, sf_dir):
    """How a region came about: its nations, and the first eight suppliers of each."""
    node = lambda c: F.concat(F.lit("x"), F.lpad(c.cast("string"), 12, "0"))
    n, s = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "supplier")
    links = n.select(node(F.col("n_regionkey")).alias("src"), node(F.col("n_nationkey") + 100).alias("dst"), F.lit("return").alias("kind"), F.col("n_nationkey").cast("long").alias("ord"))
    links = links.union(s.select(node(F.col("s_nationkey") + 100), node(F.col("s_suppkey") + 1000), F.lit("return"), F.col("s_suppkey")))
    sites = links.select(F.lit("f").alias("file"), F.lit(5).alias("start"), F.lit(9).alias("end"), F.lit(1).alias("ord"), F.lit("value").alias("kind"), F.lit("a").alias("name"), F.lit(T.dumps(T.STRING)).alias("type"), F.lit(None).cast("string").alias("receiver"), node(F.lit(1)).alias("symbol")).limit(1)
    rows = queries.explanations(spark.createDataFrame([("f", 6)], "file string, offset long"), sites, links, 2)
    return rows.select(F.from_json("value", "step int, depth int, node string").alias("v")).select("v.step", "v.depth", "v.node")


@query(f"SELECT l_linenumber AS line, 'def m' || l_linenumber || ': () -> ' || CASE l_returnflag WHEN 'N' THEN 'Integer' ELSE 'String' END AS text FROM {ONE} WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)")
def kernel_q11_k11_k03_lenses(spark, sf_dir):
    """The lenses of one file of methods, their overloads parsed from signature text."""
    rows = _lines(spark, sf_dir)
    file = str(rows.agg(F.min("l_orderkey")).first()[0])
    text = F.concat(F.lit("() -> "), F.when(F.col("l_returnflag") == "N", "Integer").otherwise("String"))
    methods = rows.select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), F.concat(F.lit("m"), "l_linenumber").alias("name"), sources.method_type(text).alias("overloads"), F.lit(False).alias("singleton"), F.lit(False).alias("private"), F.lit(True).alias("explicit"), F.lit("source").alias("origin"))
    return render.code_lenses(methods, file)


# diagnostics


def _place(orderkey: str = "l_orderkey", line: str = "l_linenumber"):
    n = F.col(line)
    return [F.col(orderkey).cast("string").alias("file"), n.cast("long").alias("start"), (n + 1).cast("long").alias("end"), n.alias("line"), F.lit(0).alias("column"), n.alias("end_line"), F.lit(1).alias("end_column")]


ACTUAL = {"A": T.INTEGER, "N": T.STRING, "R": T.union(T.INTEGER, T.STRING)}
MISMATCH = "((l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O'))"


def _world(spark):
    """Integer, String and nil below Object."""
    names = ["Integer", "String", "NilClass"]
    paths = spark.createDataFrame([(n, o) for n in names for o in (n, "Object")], "class string, owner string")
    classes = spark.createDataFrame([(n, False) for n in names], "class string, is_module boolean")
    return diagnostics.world(paths, classes, spark.createDataFrame([], "class string, name string"))


def _bound(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    declared = F.when(F.col("l_linestatus") == "O", T.dumps(T.INTEGER)).otherwise(T.dumps(T.STRING))
    return rows.select(*_place(), F.lit("C").alias("arm"), (F.col("l_linenumber") % 5 != 0).alias("arms_named"), F.lit("a").alias("pname"), declared.alias("expected"), _by("l_returnflag", ACTUAL).alias("actual"), "l_orderkey")


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line, 'argument `a` expects ' || CASE l_linestatus WHEN 'O' THEN 'Integer, got String' ELSE 'String, got Integer' END AS message FROM {ONE} WHERE {MISMATCH} AND l_linenumber % 5 <> 0""")
def kernel_d02_a27_argument_mismatches(spark, sf_dir):
    """Lines whose flag can't be what their status asks for; unions may fit, calls with unnamed receivers are skipped."""
    return diagnostics.argument_mismatches(_bound(spark, sf_dir), _world(spark)).select("path", "line", "message")


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, l_linenumber % 2 AS overload, CASE WHEN {MISMATCH} THEN 1 ELSE 0 END AS bad FROM {ONE}),
s AS (SELECT l_orderkey, overload, sum(bad) AS n FROM o GROUP BY 1, 2), b AS (SELECT l_orderkey, arg_min(overload, n * 10 + overload) AS overload, min(n) AS n FROM s GROUP BY 1)
SELECT CAST(o.l_orderkey AS VARCHAR) AS path, l_linenumber AS line FROM o JOIN b ON o.l_orderkey = b.l_orderkey AND o.overload = b.overload WHERE b.n > 0 AND bad = 1""")
def kernel_d03_overload_mismatches(spark, sf_dir):
    """Odd and even lines as two overloads of an order's call: silent if either may fit, else the one with the fewest findings."""
    rows = _bound(spark, sf_dir).withColumn("site_id", F.col("l_orderkey")).withColumn("overload", F.col("line") % 2).withColumn("arity_fits", F.lit(True))
    return diagnostics.overload_mismatches(rows, _world(spark)).select("path", "line")


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line, 'return expects ' || CASE l_suppkey % 2 WHEN 0 THEN 'Integer, got String' ELSE 'String, got Integer' END AS message FROM {ONE}
WHERE (l_suppkey % 2 = 0 AND l_returnflag = 'N') OR (l_suppkey % 2 = 1 AND l_returnflag = 'A')""")
def kernel_d04_b52_return_mismatches(spark, sf_dir):
    """Lines return what their flag says from methods of their supplier; the declaration of least rank counts; an unknown arm silences."""
    rows = _lines(spark, sf_dir)
    actual = _by("l_returnflag", {"A": T.INTEGER, "N": T.STRING, "R": T.union(T.NIL, X)})
    sites = rows.select(*_place(), F.col("l_suppkey").cast("string").alias("class"), F.lit("m").alias("name"), actual.alias("actual"))
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("class"), F.lit("m").alias("name"), F.col("s_suppkey").alias("k"))
    even = F.when(F.col("k") % 2 == 0, T.dumps(T.INTEGER)).otherwise(T.dumps(T.STRING))
    odd = F.when(F.col("k") % 2 == 1, T.dumps(T.INTEGER)).otherwise(T.dumps(T.STRING))
    declared = s.select("class", "name", F.lit(0).alias("rank"), even.alias("expected")).union(s.select("class", "name", F.lit(1), odd))
    return diagnostics.return_mismatches(sites, declared, _world(spark)).select("path", "line", "message")


@query("""SELECT event_id::VARCHAR AS path, 'uninitialized constant ' || name AS message FROM (SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'Rails::' || event_type ELSE event_type END || CASE WHEN event_id % 4 = 0 THEN '::Z' ELSE '' END AS name FROM events)
WHERE event_type NOT IN ('click') AND name <> 'view' AND NOT starts_with(name, 'Rails::') AND NOT (user_id % 2 = 0 AND name NOT LIKE '%::%')""")
def kernel_d05_unresolved_constants(spark, sf_dir):
    """Events as constant reads: clicks resolve, `view` is built in, Rails is defined at run time, even users have unknown ancestors."""
    name = F.concat(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Rails::"), "event_type")).otherwise(F.col("event_type")), F.when(F.col("event_id") % 4 == 0, "::Z").otherwise(""))
    rows = _read(spark, sf_dir, "events")
    sites = rows.select(F.col("event_id").cast("string").alias("file"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit(1).alias("line"), F.lit(0).alias("column"), F.lit(1).alias("end_line"), F.lit(1).alias("end_column"), name.alias("name"), F.col("user_id").cast("string").alias("scope"), F.when(F.col("event_type") == "click", "x").alias("path"))
    none = F.lit(None).cast("string")
    opaque = rows.filter("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("class"), F.lit("unknown_ancestor").alias("why")).distinct()
    return diagnostics.unresolved_constants(sites, rows.select(none.alias("class"), none.alias("owner")).limit(0), ["Rails"], ["view"], opaque).select("path", "message")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS path, count(*) OVER (PARTITION BY l_orderkey) AS n, 'wrong number of arguments for ' || arm || '.m: given ' || given || ', expected ' || want AS message FROM (
SELECT l_orderkey, count(*) AS given FROM lineitem GROUP BY 1) JOIN (VALUES ('A', '2', 2, 2), ('B', '1..3', 1, 3)) v(arm, want, low, high) ON given < low OR given > high""")
def kernel_d06b_d07_union_arity(spark, sf_dir):
    """An order's lines as arguments of a method that two classes define: each arm is judged."""
    given = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("positional"))
    kinds = lambda ks: F.array(*[F.struct(F.lit(f"p{i}").alias("pname"), F.lit(k).alias("kind")) for i, k in enumerate(ks)])
    arms = F.array(F.struct(F.lit("A").alias("receiver"), kinds(["required"] * 2).alias("params")), F.struct(F.lit("B").alias("receiver"), kinds(["required", "optional", "optional"]).alias("params")))
    rows = given.select(F.col("l_orderkey").cast("string").alias("file"), *[F.lit(k).alias(c) for k, c in enumerate(diagnostics.POSITION[1:])], F.lit("m").alias("name"), arms.alias("arms"), "positional", F.lit(False).alias("splat"))
    found = diagnostics.union_arity_mismatches(rows)
    return found.select("path", F.count("*").over(Window.partitionBy("path")).alias("n"), "message")


@query("""SELECT event_id::VARCHAR AS path, 'undefined method `' || event_type || '` for U' || user_id AS message FROM events WHERE event_type NOT IN ('click', 'error') AND NOT (event_type = 'view' AND user_id % 2 = 0)""")
def kernel_d01_missing_methods(spark, sf_dir):
    """Events as calls; what a gate lets through is reported once, as its first walk saw it."""
    rows = _read(spark, sf_dir, "events").withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1))))
    n = F.lit(1)
    place = [F.col("event_id").cast("string").alias("file"), n.alias("start"), (n + 1).alias("end"), n.alias("line"), F.lit(0).alias("column"), n.alias("end_line"), n.alias("end_column")]
    # the second walk would let all through
    asked = rows.select(*place, "ord", F.col("event_type").alias("name"), F.concat(F.lit("U"), "user_id").alias("unresolved"), ((F.col("event_type") == "click") & (F.col("ord") == 0)).alias("method_exists"), ((F.col("event_type") == "error") & (F.col("ord") == 0)).alias("object_receiver"), ((F.col("event_type") == "view") & (F.col("user_id") % 2 == 0) & (F.col("ord") == 0)).alias("incomplete_ancestors"))
    return diagnostics.missing_methods(diagnostics.gate(asked)).select("path", "message")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F' AND l_linenumber BETWEEN 2 AND 4)""")
def kernel_p14_outside_broken(spark, sf_dir):
    """Diagnostics inside methods that don't parse are dropped."""
    found = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"))
    broken = _read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("file"), F.lit(2).alias("first_line"), F.lit(4).alias("last_line"))
    return diagnostics.outside_broken(found, broken)


@query("""SELECT CAST(row_number() OVER (ORDER BY o_custkey, l_orderkey, l_linenumber) AS BIGINT) AS place, l_orderkey::VARCHAR AS path, l_linenumber AS line, 'code' AS code FROM (SELECT DISTINCT o_custkey, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')""")
def kernel_k06_o01_d12_ordered_diagnostics(spark, sf_dir):
    """Diagnostics of two rules joined, without repetitions, in the order of files and then of positions, as JSON lines."""
    rows = _read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    one = diagnostics.diagnostic(rows.select(*_place()), "code", F.lit("m"))
    files = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.struct("o_custkey", "o_orderkey").alias("file_ord"))
    lines = diagnostics.json_lines(diagnostics.ordered(diagnostics.combined(one, one.filter("line > 2")), files))
    found = numbered(lines).select((F.col("place") + 1).alias("place"), F.from_json("value", "path string, line int, code string").alias("v"))
    return found.select("place", "v.path", "v.line", "v.code")
