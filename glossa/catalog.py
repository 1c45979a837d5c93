"""The engine's registered queries and their oracle SQL.

Two kinds, never mixed: `fact_*` run operators on small code facts whose results are known; `kernel_*` run the same operators on the
driver's tables, read as facts (files, symbols, spans, calls), and are held against SQL. A kernel shows that the operator is right as a
relational computation; only a fact query says anything about code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa import catalog_bodies, catalog_facts, catalog_kernels, catalog_sources, facts
from glossa.functions import columns, inflect, levels, terms
from glossa.operators import calls, coverage, dependencies, diagnostics, generators, lookup, merge, provenance, recursion
from glossa.plans.fixpoint import reach
from glossa.sources import ddl, signatures
from glossa.streaming import workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# dependency graph: orders as files, parts as symbols


def _refs(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("symbol"))


def _edges(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'")
    return rows.select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "mixin").otherwise("constant").alias("kind"))


def _symbols(spark, sf_dir):
    return _read(spark, sf_dir, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("symbol"))


@query("SELECT DISTINCT l_orderkey AS file FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)")
def kernel_j12_referencing_files(spark, sf_dir):
    return dependencies.referencing_files(_refs(spark, sf_dir), _symbols(spark, sf_dir))


@query("""SELECT DISTINCT l_orderkey AS file FROM lineitem l WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)
AND (l_returnflag = 'R' OR NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_returnflag <> 'N'))""")
def kernel_j13_typed_fallback(spark, sf_dir):
    return dependencies.referencing_files_by_kind(_refs(spark, sf_dir), _edges(spark, sf_dir), _symbols(spark, sf_dir), ["mixin"], True)


@query("SELECT DISTINCT l_orderkey AS file FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)")
def kernel_j14_strict_dependents(spark, sf_dir):
    return dependencies.dependent_files(_refs(spark, sf_dir), _edges(spark, sf_dir), _symbols(spark, sf_dir), ["mixin"])


@query("SELECT DISTINCT c_nationkey AS file FROM customer WHERE c_mktsegment = 'BUILDING'")
def kernel_j15_defining_files(spark, sf_dir):
    defs = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_mktsegment").alias("symbol"))
    return dependencies.defining_files(defs, spark.createDataFrame([("BUILDING",)], "symbol string"))


@query("""SELECT DISTINCT l_orderkey AS file, l_partkey AS symbol FROM lineitem
WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1)""")
def kernel_j16_external_references(spark, sf_dir):
    own = _read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("symbol"))
    return dependencies.external_references(_refs(spark, sf_dir), own)


@query("""SELECT DISTINCT l_orderkey AS file, l_partkey AS symbol FROM lineitem WHERE l_orderkey % 7 <> 0
UNION SELECT o_orderkey, -o_custkey FROM orders WHERE o_orderkey % 7 = 0""")
def kernel_u04_replace_files(spark, sf_dir):
    new = _read(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("file"), (-F.col("o_custkey")).alias("symbol"))
    return dependencies.replace_files(_refs(spark, sf_dir), new, new.select("file"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING max(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) = 1")
def kernel_a24_changed_bags(spark, sf_dir):
    """Orders whose bag of lines differs once line 2 is gone, whatever the order of rows."""
    rows = _read(spark, sf_dir, "lineitem")
    print_ = lambda df: dependencies.bag_fingerprint(df, ["l_orderkey"], ["l_linenumber", "l_partkey"])
    diff = dependencies.changed(print_(rows.repartition("l_partkey")), print_(rows.filter("l_linenumber <> 2")), ["l_orderkey"])
    return rows.join(diff, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1")
def kernel_a25_retracted_bags(spark, sf_dir):
    """Fingerprints from which line 1 is taken back equal those without it."""
    rows = _read(spark, sf_dir, "lineitem")
    print_ = lambda df: dependencies.bag_fingerprint(df, ["l_orderkey"], ["l_linenumber", "l_partkey"])
    left = dependencies.remove(print_(rows), print_(rows.filter("l_linenumber = 1")), ["l_orderkey"])
    want = print_(rows.filter("l_linenumber <> 1"))
    wrong = dependencies.changed(left, want, ["l_orderkey"])
    return left.join(wrong, "l_orderkey", "left_anti").select("l_orderkey", "n")


@query("""WITH a AS (SELECT l_suppkey s, list(l_partkey ORDER BY l_partkey, l_orderkey, l_linenumber) x FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey s, list(l_partkey ORDER BY l_partkey, l_orderkey, l_linenumber) x FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1)
SELECT DISTINCT l_orderkey AS file FROM lineitem WHERE l_suppkey IN (SELECT a.s FROM a LEFT JOIN b ON a.s = b.s WHERE a.x IS DISTINCT FROM b.x)""")
def kernel_t04_dirty_files(spark, sf_dir):
    """Files that refer to a symbol whose definition changed."""
    rows = _read(spark, sf_dir, "lineitem")
    defs = rows.select(F.lit("all").alias("file"), F.col("l_suppkey").alias("symbol"), F.concat_ws(":", "l_partkey", "l_orderkey", "l_linenumber").alias("signature"), "l_shipdate")
    refs = rows.select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("symbol"))
    return dependencies.dirty_files(defs.drop("l_shipdate"), defs.filter("l_shipdate < timestamp_ntz'1998-06-01'").drop("l_shipdate"), refs)


# merging and keeping


@query("""SELECT user_id AS class, event_type AS name, event_id AS ord, value AS ret FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) r FROM events) WHERE r = 1""")
def kernel_w01_keep_last(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("class"), F.col("event_type").alias("name"), F.lit(False).alias("singleton"), F.col("event_id").alias("ord"), F.col("value").alias("ret"))
    return merge.last_declarations(rows).drop("singleton")


@query("SELECT user_id AS site_id, event_type AS keyword, arg_max(value, event_id) AS type FROM events GROUP BY 1, 2")
def kernel_w02_last_keywords(spark, sf_dir):
    return merge.last_keywords(_read(spark, sf_dir, "events").select(F.col("user_id").alias("site_id"), F.col("event_type").alias("keyword"), F.col("event_id").alias("pos"), F.col("value").alias("type")))


@query("""WITH d AS (SELECT coalesce(lang, '-') AS class, coalesce(source, '-') AS key, doc_id, CAST(n_chars AS VARCHAR) AS value FROM documents)
SELECT class, 'method' AS declaration, key, arg_min(value, doc_id) AS value, min(doc_id) AS ord FROM d GROUP BY class, key
UNION ALL SELECT class, 'mixin', key, value, min(doc_id) FROM d WHERE doc_id % 2 = 0 GROUP BY class, key, value
UNION ALL SELECT class, 'is_module', key, arg_max(value, doc_id), max(doc_id) FROM d WHERE doc_id % 3 = 0 GROUP BY class, key""")
def kernel_w04_merge_rules(spark, sf_dir):
    """Documents as declarations of three kinds, merged by their rules."""
    rows = _read(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("-")).alias("class"), F.coalesce("source", F.lit("-")).alias("key"), F.col("n_chars").cast("string").alias("value"), F.col("doc_id").alias("ord"))
    kinds = rows.withColumn("declaration", F.lit("method")).unionByName(rows.filter("ord % 2 = 0").withColumn("declaration", F.lit("mixin"))).unionByName(rows.filter("ord % 3 = 0").withColumn("declaration", F.lit("is_module")))
    return merge.merge_declarations(kinds.withColumn("source", F.lit("rbs")).withColumn("user_defined", F.lit(False))).drop("source")


@query("""SELECT o_custkey AS class, o_orderpriority AS name, max(o_totalprice) AS ret FROM orders GROUP BY 1, 2
UNION ALL SELECT c_custkey, 'NONE', c_acctbal FROM customer""")
def kernel_b25_user_wins(spark, sf_dir):
    """External declarations only where the user has none."""
    user = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("class"), F.col("o_orderpriority").alias("name")).agg(F.max("o_totalprice").alias("ret"))
    names = user.select("class", "name", F.lit(-1.0).alias("ret"))
    external = names.unionByName(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("class"), F.lit("NONE").alias("name"), F.col("c_acctbal").alias("ret")))
    return merge.merge_preserving_user(external, user, ["class", "name"])


@query("""SELECT user_id, array_to_string(list_sort(list_filter(list_distinct(list(event_type)), lambda x: x <> 'error')), ',') AS enabled FROM
(SELECT user_id, event_type FROM events UNION ALL SELECT DISTINCT user_id, 'extra' FROM events) GROUP BY user_id""")
def kernel_u01_enabled_sets(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    return rows.select("user_id", F.array_join(merge.enabled(F.col("a"), F.array(F.lit("extra")), F.array(F.lit("error"))), ",").alias("enabled"))


# streaming state


@query("""SELECT CAST(user_id AS VARCHAR) AS file, event_id AS generation, event_type AS content FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def kernel_t01_upsert(spark, sf_dir):
    """Events applied in two micro-batches, the later half first: old changes come late and are dropped."""
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("generation"), F.when(F.col("event_type") == "error", "delete").otherwise("change").alias("op"), F.col("event_type").alias("content"))
    empty = rows.select("file", "generation", "content").limit(0)
    late, early = rows.filter("generation % 2 = 0"), rows.filter("generation % 2 = 1")
    state = workspace.upsert(empty, late)
    seen = late.groupBy("file").agg(F.max("generation").alias("seen"))
    return workspace.upsert(state, workspace.current(early, seen))


@query("""SELECT doc, epoch, at_ms FROM (SELECT user_id AS doc, max(event_id) AS epoch, arg_max(epoch_us(ts) // 1000, event_id) AS at_ms FROM events GROUP BY 1)
WHERE (SELECT max(epoch_us(ts) // 1000) FROM events) - at_ms >= 150""")
def kernel_t11_due_requests(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("epoch"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    now = rows.agg(F.max("at_ms")).first()[0]
    return workspace.due(rows, F.lit(now))


@query("SELECT event_id, user_id AS generation FROM events WHERE user_id >= 20")
def kernel_t13_current_generation(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("generation"))
    return workspace.current_generation(rows, 20)


# closures: turns of conversations, nations and regions


TURNS = """
edges AS (SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn + 1 AS dst FROM conversations c
  WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)),
walk(root, node, depth) AS (SELECT conv_id * 1000 AS root, conv_id * 1000 AS node, 0 AS depth FROM conversations
  UNION SELECT root, dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 6)"""


def _turns(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn")).distinct()
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = rows.join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("dst"))
    return rows.select((F.col("conv_id") * 1000).alias("root")).distinct(), edges


@query(f"WITH RECURSIVE {TURNS} SELECT root, node, min(depth) AS depth FROM walk GROUP BY 1, 2")
def kernel_r01_closure(spark, sf_dir):
    roots, edges = _turns(spark, sf_dir)
    return reach(roots, edges, 6)


@query(f"WITH RECURSIVE {TURNS}, near AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY 1, 2) SELECT root, depth, count(*) AS size FROM near GROUP BY 1, 2")
def kernel_w06_level_sizes(spark, sf_dir):
    roots, edges = _turns(spark, sf_dir)
    return provenance.level_sizes(reach(roots, edges, 6))


@query("""WITH sizes AS (SELECT o_custkey AS root, CAST(year(o_orderdate) - 1992 AS INTEGER) AS depth, sum(cast(o_totalprice as bigint)) // 1000 AS size FROM orders GROUP BY 1, 2),
dense AS (SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY depth) - 1 AS INTEGER) AS depth, size FROM sizes),
run AS (SELECT *, sum(size) OVER (PARTITION BY root ORDER BY depth) AS s FROM dense),
n AS (SELECT root, sum(size) AS total, max(depth) AS deepest, greatest(count(*) FILTER (WHERE s <= 200), 2) AS k FROM run GROUP BY root),
d AS (SELECT *, CASE WHEN total <= 200 THEN deepest ELSE least(k - 1, deepest) END AS shown FROM n)
SELECT d.root, CAST(shown AS INTEGER) AS shown_depth, CAST(total AS BIGINT) AS total, CAST(total - sum(size) FILTER (WHERE depth <= shown) AS BIGINT) AS hidden, CAST(deepest - shown AS INTEGER) AS hidden_levels
FROM d JOIN dense USING (root) GROUP BY d.root, shown, total, deepest""")
def kernel_w08_shown_levels(spark, sf_dir):
    """Whole levels are shown while they hold 200 at most. Prices are rounded as SQL casts them, halves to even."""
    from pyspark.sql import Window

    rows = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("root"), F.year("o_orderdate").alias("y")).agg(F.floor(F.sum(F.rint("o_totalprice").cast("long")) / 1000).cast("long").alias("size"))
    rows = rows.withColumn("depth", F.row_number().over(Window.partitionBy("root").orderBy("y")) - 1).drop("y")
    found = provenance.shown_depth(rows)
    return found.select("root", F.col("shown_depth").cast("int"), F.col("total").cast("long"), F.col("hidden").cast("long"), F.col("hidden_levels").cast("int"))


def _hierarchy(spark, sf_dir):
    """Suppliers below nations below regions as classes."""
    s, n, r = (_read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    none = F.lit(None).cast("string")
    tops = r.select(F.col("r_name").alias("class"), none.alias("superclass"))
    middle = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("class"), F.col("r_name").alias("superclass"))
    leaves = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("class"), F.col("n_name").alias("superclass"))
    return tops.union(middle).union(leaves)


CHAIN = """chain AS (
  SELECT r_name AS class, r_name AS owner, 0 AS depth FROM region
  UNION ALL SELECT n_name, n_name, 0 FROM nation UNION ALL SELECT n_name, r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, s_name, 0 FROM supplier UNION ALL SELECT s_name, n_name, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT s_name, r_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {CHAIN} SELECT class, owner, depth FROM chain")
def kernel_r11_superclass_chain(spark, sf_dir):
    return lookup.superclass_chain(_hierarchy(spark, sf_dir))


@query(f"""WITH {CHAIN},
m AS (SELECT n_name AS owner, 'a' AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_name, 'a' FROM region WHERE r_regionkey < 3 UNION ALL SELECT r_name, 'b' FROM region)
SELECT s_name AS class, names.name, (SELECT arg_min(chain.owner, depth) FROM chain JOIN m ON m.owner = chain.owner AND m.name = names.name WHERE chain.class = s_name) AS owner
FROM supplier, (VALUES ('a'), ('b'), ('c')) names(name)""")
def kernel_j02_dispatch(spark, sf_dir):
    """Calls on suppliers, answered by the nearest owner on the lookup path."""
    classes = _hierarchy(spark, sf_dir)
    paths = lookup.ancestors(classes, spark.createDataFrame([], "class string, module string, kind string, ord int"))
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    no = F.lit(False).alias("singleton")
    methods = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("class"), F.lit("a").alias("name"), no)
    methods = methods.union(r.filter("r_regionkey < 3").select("r_name", F.lit("a"), no)).union(r.select("r_name", F.lit("b"), no))
    asked = _read(spark, sf_dir, "supplier").select(F.col("s_name").alias("class"), F.explode(F.array(*map(F.lit, "abc"))).alias("name"), no)
    return lookup.dispatch(asked, paths, methods).select("class", "name", "owner")


@query(f"WITH {CHAIN} SELECT DISTINCT owner AS class FROM chain WHERE class IN (SELECT s_name FROM supplier WHERE s_acctbal < 0)")
def kernel_r09_with_ancestors(spark, sf_dir):
    classes = _hierarchy(spark, sf_dir)
    paths = lookup.superclass_chain(classes)
    names = _read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_name").alias("class"))
    return lookup.with_ancestors(names, paths)


@query(f"""WITH {CHAIN} SELECT DISTINCT c.owner AS class, 'm' AS name FROM chain c WHERE c.class <> c.owner AND c.class IN (SELECT s_name FROM supplier WHERE s_acctbal > 5000)""")
def kernel_j23_subclass_defines(spark, sf_dir):
    classes = _hierarchy(spark, sf_dir)
    methods = _read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_name").alias("class"), F.lit("m").alias("name"))
    return lookup.subclass_defines(classes.select("class", F.lit("m").alias("name")), lookup.superclass_chain(classes), methods)


# scopes and spans


URLS = "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages"


@query(f"""WITH u AS ({URLS}), p AS (SELECT page_id, string_split(regexp_replace(path, '/+$', ''), '/') AS parts FROM u),
tried AS (SELECT page_id, n, array_to_string(parts[1:n], '::') AS path FROM (SELECT page_id, parts, unnest(range(0, len(parts) + 1)) AS n FROM p)),
known AS (SELECT DISTINCT array_to_string(parts[1:2], '::') AS path FROM p WHERE page_id % 2 = 0)
SELECT p.page_id AS id, (SELECT arg_max(t.path, t.n) FROM tried t JOIN known ON known.path = t.path || '::X' OR known.path = t.path WHERE t.page_id = p.page_id AND t.n > 0 AND t.path IN (SELECT path FROM known)) AS path FROM p""")
def kernel_j07_scope_lookup(spark, sf_dir):
    """The innermost prefix of a page's address, outward, that other pages make known."""
    u = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = _read(spark, sf_dir, "pages").select("page_id", F.split(F.regexp_replace(u, "/+$", ""), "/").alias("parts"))
    known = rows.filter("page_id % 2 = 0").select(F.array_join(F.slice("parts", 1, 2), "::").alias("path")).distinct()
    # the last part is the name, what stands before it the scope; names are tried in every scope outward
    scopes = rows.select(F.col("page_id").alias("id"), F.posexplode(lookup.scopes_outward(F.array_join("parts", "::"))).alias("rank", "path")).filter("path <> ''")
    hits = scopes.join(known, "path").groupBy("id").agg(F.min_by("path", "rank").alias("path"))
    return rows.select(F.col("page_id").alias("id")).join(hits, "id", "left")


@query("""WITH c AS (SELECT doc_id, n_chars AS s, n_chars + 10 + doc_id % 400 AS e FROM documents),
p AS (SELECT DISTINCT CAST(length(html) AS BIGINT) AS o FROM pages)
SELECT o AS "offset", arg_min(doc_id, (e - s) * 1000000 + doc_id) AS ord FROM p LEFT JOIN c ON s <= o AND o < e GROUP BY 1""")
def kernel_j10_innermost_span(spark, sf_dir):
    """Lengths of pages as positions in spans that documents give: the smallest span around each, null if there is none."""
    spans = _read(spark, sf_dir, "documents").select(F.lit("f").alias("file"), F.col("n_chars").alias("start"), (F.col("n_chars") + 10 + F.col("doc_id") % 400).alias("end"), F.col("doc_id").alias("ord"))
    points = _read(spark, sf_dir, "pages").select(F.lit("f").alias("file"), F.length("html").cast("long").alias("offset")).distinct()
    return lookup.innermost(points, spans).select("offset", F.col("span.ord").alias("ord"))


@query("""SELECT l_suppkey AS class, 'all' AS interface FROM lineitem WHERE l_returnflag || l_linestatus IN (SELECT DISTINCT l_returnflag || l_linestatus FROM lineitem)
GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)""")
def kernel_j30_division(spark, sf_dir):
    """Suppliers that answer every kind of line."""
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("class"), F.concat("l_returnflag", "l_linestatus").alias("name"))
    paths = rows.select("class", F.col("class").alias("owner")).distinct()
    required = rows.select(F.lit("all").alias("interface"), "name").distinct()
    return lookup.responds_to_all(rows.select("class"), required, paths, rows)


@query("""SELECT l_partkey AS module, 'R' AS name, coalesce(bool_or(l_returnflag = 'R'), false) AS resolvable FROM (
SELECT *, dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) r FROM lineitem) WHERE r <= 32 GROUP BY 1""")
def kernel_j24_first_includers(spark, sf_dir):
    """Parts that one of their first 32 suppliers returns."""
    rows = _read(spark, sf_dir, "lineitem")
    # every supplier of a part is a host of its own
    padded = F.concat_ws(":", F.col("l_partkey"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0"))
    mixins = rows.select(F.col("l_partkey").alias("module"), padded.alias("class")).distinct()
    paths = mixins.select("class", F.col("class").alias("owner"))
    methods = rows.filter("l_returnflag = 'R'").select(padded.alias("class"), F.lit("R").alias("name")).distinct()
    none = spark.createDataFrame([], "class string, why string")
    return lookup.resolvable_via_includers(mixins.select("module", F.lit("R").alias("name")).distinct(), mixins, paths, methods, none)


# types


@query("SELECT user_id, string_agg(DISTINCT ':' || event_type, ' | ' ORDER BY ':' || event_type) AS type FROM events GROUP BY 1")
def kernel_a01_union_types(spark, sf_dir):
    """The union of a user's event types as symbols."""
    rows = _read(spark, sf_dir, "events").select("user_id", F.concat(F.lit('["lit_sym","'), "event_type", F.lit('"]')).alias("t"))
    return columns.union_agg("t", ["user_id"], rows).select("user_id", columns.rendered("type").alias("type"))


@query("""SELECT l_orderkey AS o_orderkey, CASE WHEN max(l_quantity) > 25 THEN 'Integer' ELSE string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' | ' ORDER BY l_quantity) END AS type FROM (
SELECT DISTINCT l_orderkey, l_quantity FROM lineitem) GROUP BY 1""")
def kernel_a09_subsumed_literals(spark, sf_dir):
    """Literals vanish beside their class."""
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_quantity") > 25, '["integer"]').otherwise(F.concat(F.lit('["lit_int",'), F.col("l_quantity").cast("long").cast("string"), F.lit("]"))).alias("t"))
    found = columns.union_agg("t", ["o_orderkey"], rows)
    return found.select("o_orderkey", columns.rendered("type").alias("type"))


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'String?' WHEN quality = 0 THEN 'String' ELSE 'untyped' END AS type FROM documents LEFT JOIN labels USING (doc_id)""")
def kernel_p19_nullable_accessors(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    term = F.when(F.col("quality").isNull(), '["untyped"]').otherwise('["string"]')
    return rows.select("doc_id", columns.rendered(columns.nullable_accessor(term, F.coalesce(F.col("quality") == 1, F.lit(True)))).alias("type"))


@query("""WITH x AS (SELECT coalesce(lang, '-') AS kind, CASE WHEN l.quality IS NULL THEN 0 WHEN l.quality = 0 THEN 1 ELSE 2 END AS level FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT kind, count(*) AS total, count(*) FILTER (WHERE level = 2) AS typed, count(*) FILTER (WHERE level = 1) AS untyped, count(*) FILTER (WHERE level = 0) AS unknown,
count(*) FILTER (WHERE level = 2) * 100.0 / count(*) AS type_coverage_percent, count(*) FILTER (WHERE level > 0) * 100.0 / count(*) AS tracking_coverage_percent FROM x GROUP BY 1""")
def kernel_a20_coverage_counts(spark, sf_dir):
    """Documents as sites: labelled ones are typed or untyped, the rest unknown."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    term = F.when(F.col("quality") == 0, '["untyped"]').otherwise('["class","Known"]')
    none = F.lit(None).cast("string")
    level = F.when(F.col("quality").isNull(), levels.UNKNOWN).otherwise(coverage.type_level(term, none, none))
    out = coverage.counts(rows.select(F.coalesce("lang", F.lit("-")).alias("kind"), level.alias("level")), ["kind"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("type_coverage_percent", "tracking_coverage_percent")})


@query("""WITH x AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS l FROM events)
SELECT user_id AS file, max(l) AS level FROM x GROUP BY 1""")
def kernel_w03_folded_sites(spark, sf_dir):
    """Observations of one kind keep their greatest level."""
    level = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    none = F.lit(None).cast("string")
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.col("event_id").alias("ord"), F.lit("value").alias("kind"), level.alias("level"), F.lit(False).alias("explicit"), none.alias("name"), none.alias("scope"))
    return coverage.coalesced_sites(rows).select("file", "level")


@query("""WITH l AS (SELECT l_orderkey AS site_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT site_id, CASE WHEN n >= 1 THEN ':x1' END AS a, CASE WHEN n >= 3 THEN ':x2' ELSE ':d' END AS b, CASE WHEN n >= 4 THEN string_agg(':x' || pos, ' | ' ORDER BY ':x' || pos) FILTER (pos > 2 AND pos < n) ELSE 'untyped' END AS rest, CASE WHEN n >= 2 THEN ':x' || n ELSE 'untyped' END AS z
FROM l GROUP BY site_id, n""")
def kernel_j04_positional_slots(spark, sf_dir):
    """Lines of an order as arguments of (a, b = :d, *rest, z): what each parameter takes."""
    rows = _read(spark, sf_dir, "lineitem")
    sites = rows.select(F.col("l_orderkey").alias("site_id")).distinct().select("site_id", F.concat(F.lit("C"), (F.col("site_id") % 3).cast("string")).alias("owner"), F.lit("m").alias("method"), F.lit(False).alias("singleton"), F.lit(None).cast("int").alias("open_splat"))
    args = rows.select(F.col("l_orderkey").alias("site_id"), F.row_number().over(_by_line()).alias("pos"), F.lit(None).cast("string").alias("keyword"))
    # classes, as literals of arguments are widened
    args = args.withColumn("type", F.concat(F.lit('["class",":x'), F.col("pos").cast("string"), F.lit('"]')))
    kinds = [("a", "required", None), ("b", "optional", '["class",":d"]'), ("rest", "rest", None), ("z", "required", None)]
    params = spark.createDataFrame([(f"C{c}", "m", False, i, n, k, d) for c in range(3) for i, (n, k, d) in enumerate(kinds)], "class string, name string, singleton boolean, idx int, pname string, kind string, default_type string")
    took = calls.bound_arguments(sites, args, params).groupBy("site_id").pivot("pname", ["a", "b", "rest", "z"]).agg(F.first("type"))
    return took.select("site_id", *[columns.rendered(c).alias(c) for c in ("a", "b", "rest", "z")])


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")


@query("""SELECT user_id AS class, string_agg(DISTINCT ':' || event_type, ' | ' ORDER BY ':' || event_type) AS type, count(*) AS calls FROM events GROUP BY 1""")
def kernel_j01_parameters_from_calls(spark, sf_dir):
    """Events as calls of a method with one parameter: its type over all calls of a user."""
    rows = _read(spark, sf_dir, "events")
    bound = rows.select(F.col("event_id").alias("site_id"), F.col("user_id").alias("class"), F.lit("m").alias("name"), F.lit(False).alias("singleton"), F.lit("a").alias("pname"), F.concat(F.lit('["lit_sym","'), "event_type", F.lit('"]')).alias("type"))
    found = calls.parameter_types(bound)
    n = rows.groupBy(F.col("user_id").alias("class")).agg(F.count("*").alias("calls"))
    return found.join(n, "class").select("class", columns.rendered("type").alias("type"), "calls")


# names


NAMES = "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part"


@query(f"""SELECT word, CASE WHEN regexp_matches(word, '^.?$|[^s]$|ss$') THEN word WHEN regexp_matches(word, '(movies|databases)$') THEN left(word, -1) WHEN regexp_matches(word, '^.+ies$') THEN left(word, -3) || 'y'
WHEN regexp_matches(word, '(x|ch|sh|ss|alias|status|bus|o)es$') THEN left(word, -2) ELSE left(word, -1) END AS singular,
CASE WHEN regexp_matches(word, 'y$') AND NOT regexp_matches(word, '[aeiou]y$') THEN left(word, -1) || 'ies' WHEN regexp_matches(word, '(s|sh|ch|x|z)$') THEN word || 'es' ELSE word || 's' END AS plural FROM (
SELECT word FROM ({NAMES}) UNION SELECT word || 's' FROM ({NAMES}) UNION SELECT word || 'es' FROM ({NAMES}))""")
def kernel_f06_inflections(spark, sf_dir):
    words = _read(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    words = words.union(words.select(F.concat("word", F.lit("s")))).union(words.select(F.concat("word", F.lit("es")))).distinct()
    return words.select("word", inflect.singularize(F.col("word")).alias("singular"), inflect.pluralize(F.col("word")).alias("plural"))


@query("SELECT page_id, len(list_filter(string_split(regexp_replace(url, '([0-9]+)', ':\\1', 'g'), '/'), lambda x: x LIKE ':%' OR x LIKE '*%')) AS segments, replace(replace(regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '^/+|/+$', '', 'g'), '-', '_'), '/', '_') AS name FROM pages")
def kernel_f18_route_names(spark, sf_dir):
    rows = _read(spark, sf_dir, "pages")
    return rows.select("page_id", generators.dynamic_segments(F.regexp_replace("url", "([0-9]+)", ":$1")).cast("long").alias("segments"), generators.route_name(F.regexp_extract("url", "://([^?#]*)", 1)).alias("name"))


@query("""SELECT lower(replace(p_brand, '#', '_')) AS name, max(p_size % 6)::INTEGER AS arity FROM part GROUP BY 1""")
def kernel_a26_greatest_arity(spark, sf_dir):
    """Parts as routes files that name one route each, with up to five dynamic segments; of one name the greatest arity counts."""
    name, n = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.col("p_size") % 6
    path = F.concat(F.lit("/x"), F.repeat(F.lit("/:id"), n.cast("int")))
    call = F.struct(F.lit("get").alias("method"), F.array(path).alias("names"), F.create_map(F.lit("as"), name).alias("options"), F.array().cast("array<string>").alias("calls"))
    files = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), F.to_json(F.array(call)).alias("calls"))
    return generators.route_helpers(files)


@query("SELECT conv_id * 1000 + turn AS id, lpad(conv_id::VARCHAR, 6, '0') || '#' || turn AS found FROM conversations WHERE ends_with(lpad(conv_id::VARCHAR, 6, '0') || '#' || turn, '01#2')")
def kernel_q10_find_by_suffix(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select(F.concat_ws("#", F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.col("turn").cast("string")).alias("id"))
    found = provenance.find(rows, "01#2")
    part = F.split("id", "#")
    return found.select((part[0].cast("long") * 1000 + part[1].cast("long")).alias("id"), F.col("id").alias("found"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, unnest([0, 1, 2, 3]) AS k FROM documents),
cut AS (SELECT doc_id, k, left(t, CAST(length(t) * k // 3 AS INTEGER)) AS t FROM d)
SELECT doc_id, k, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(list_extract(string_split(t, chr(10)), -1)) AS INTEGER) AS col FROM cut""")
def kernel_f26_line_columns(spark, sf_dir):
    """Line and column at the beginning, after each third and at the end of every text."""
    from glossa.functions import positions

    rows = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    offset = F.octet_length(F.substring("text", F.lit(1), F.floor(F.length("text") * F.col("k") / 3).cast("int")))
    return rows.select("doc_id", "k", positions.line_columns(F.col("text"), offset).alias("p")).select("doc_id", "k", "p.line", F.col("p.column").alias("col"))


# diagnostics


@query("""SELECT CASE WHEN event_type = 'error' THEN 'object_receiver' ELSE 'incomplete_ancestors' END AS reason, count(*) AS n FROM events
WHERE event_type = 'error' OR (event_type <> 'click' AND value > 50) GROUP BY 1""")
def kernel_a28_suppression_counts(spark, sf_dir):
    """Events through a chain of gates; what can't be known is counted."""
    rows = _read(spark, sf_dir, "events").select(F.lit(None).cast("boolean").alias("empty_span"), (F.col("event_type") == "error").alias("object_receiver"), (F.col("value") > 50).alias("incomplete_ancestors"), (F.col("event_type") == "click").alias("method_exists"))
    return diagnostics.suppression_counts(diagnostics.gate(rows))


@query("""WITH d AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line, l_returnflag AS code FROM lineitem)
SELECT path, line, code, count(*) AS n FROM d WHERE NOT (path IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F') AND line = 1)
AND NOT (path IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O') AND line = 2 AND code = 'N') GROUP BY 1, 2, 3""")
def kernel_p13_suppressed(spark, sf_dir):
    """Lines as diagnostics; orders say which of them to ignore."""
    found = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("code"))
    return diagnostics.suppress(found, _ignored(spark, sf_dir)).groupBy("path", "line", "code").agg(F.count("*").alias("n"))


def _ignored(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), "o_orderstatus")
    every = orders.filter("o_orderstatus = 'F'").select("file", F.lit(1).alias("line"), F.lit(None).cast("string").alias("code"))
    return every.union(orders.filter("o_orderstatus = 'O'").select("file", F.lit(2), F.lit("N")))


@query("""WITH s AS (SELECT o_orderkey AS f, 1 AS line, NULL AS code FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 2, 'N' FROM orders WHERE o_orderstatus = 'O')
SELECT CAST(f AS VARCHAR) AS file, line FROM s WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = f AND l_linenumber = line AND (code IS NULL OR code = l_returnflag))""")
def kernel_d10_unused_suppressions(spark, sf_dir):
    found = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("code"))
    return diagnostics.unused_suppressions(found, _ignored(spark, sf_dir)).select("file", "line")


@query("""SELECT CAST(user_id AS VARCHAR) AS reason, count(*) AS n FROM events GROUP BY 1""")
def kernel_a23_hole_counts(spark, sf_dir):
    return coverage.hole_counts(_read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("reason")), "reason")


@query("""SELECT o_custkey AS id, o_orderpriority AS name, min(o_orderkey) AS owner FROM orders GROUP BY 1, 2""")
def kernel_u05_first_candidates(spark, sf_dir):
    """Of candidates with one name the innermost stays."""
    rows = _read(spark, sf_dir, "orders")
    receivers = rows.select(F.col("o_custkey").alias("id"), F.col("o_custkey").cast("string").alias("class"), F.lit(False).alias("singleton")).distinct()
    paths = rows.select(F.col("o_custkey").cast("string").alias("class"), F.col("o_orderkey").alias("owner"), F.array(F.col("o_orderkey")).alias("rank"))
    methods = rows.select(F.col("o_orderkey").alias("class"), F.col("o_orderpriority").alias("name"), F.lit(False).alias("singleton"), F.lit("public").alias("visibility"), F.lit(0).alias("ord"), F.lit('["nil"]').alias("ret"))
    return lookup.method_completion(receivers, paths, methods).select("id", "name", "owner")


# facts


@query(facts.values(["table", "column", "type", "nullable"], facts.STRUCTURE_COLUMNS))
def fact_structure_columns(spark, sf_dir):
    """Columns of DDL text with their types."""
    rows = ddl.structure_columns(facts.structure(spark))
    return rows.select("table", "column", columns.rendered("type").alias("type"), "nullable")


@query(facts.values(["class", "name", "ret"], facts.ACCESSORS))
def fact_structure_accessors(spark, sf_dir):
    """From DDL text to the accessors of model classes: the smallest whole slice."""
    return facts.accessors(spark)


@query(facts.values(["root", "depth", "size"], [("Cart#total", 0, 1), ("Cart#total", 1, 2), ("Cart#total", 2, 220)]))
def fact_trace_levels(spark, sf_dir):
    """Level sizes of a provenance trace."""
    trace = facts.trace(spark)
    return provenance.level_sizes(provenance.levels(trace, spark.createDataFrame([("Cart#total",)], "root string"))).withColumn("size", F.col("size").cast("int"))


@query(facts.values(["name", "arity"], facts.ROUTE_HELPERS))
def fact_route_helpers(spark, sf_dir):
    return generators.route_helpers(facts.routes(spark))


@query(facts.values(["class", "kind", "is_module"], facts.SIGNATURE_CLASSES))
def fact_signature_classes(spark, sf_dir):
    rows = signatures.declarations(facts.signature_files(spark))
    return rows.filter("row = 'class'").select(F.col("name").alias("class"), "kind", (F.col("kind") != "class").alias("is_module"))


@query(facts.values(["name", "ret"], facts.RESOLVED))
def fact_resolved_returns(spark, sf_dir):
    """Returns resolved along calls to a fixpoint; a cycle stays open."""
    methods, paths = facts.call_chain(spark)
    found, _ = recursion.resolve_returns(methods, paths)
    return found.select("name", columns.rendered("ret").alias("ret"))


@query(facts.values(["a", "b", "join", "pair"], facts.JOINS))
def fact_type_joins(spark, sf_dir):
    """The two joins of types on their telling cases."""
    rows = spark.createDataFrame([(terms.dumps(a), terms.dumps(b)) for a, b in facts.JOIN_CASES], "x string, y string")
    return rows.select(columns.rendered("x").alias("a"), columns.rendered("y").alias("b"), columns.rendered(columns.union_type(F.array("x", "y"))).alias("join"), columns.rendered(columns.union_pair("x", "y")).alias("pair"))


def flagship(spark, sf_dir):
    """Calls answered along lookup paths: closure of a hierarchy, then the nearest owner of each name."""
    return kernel_j02_dispatch(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | catalog_facts.QUERIES | catalog_kernels.QUERIES | catalog_sources.QUERIES | catalog_bodies.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | catalog_facts.SQL | catalog_kernels.SQL | catalog_sources.SQL | catalog_bodies.SQL
