"""Provenance traces: which declarations a type was computed from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions.udf import arrow
from glossa.functions import terms
from glossa.plans.fixpoint import reach

RECORD = (
    "id string, kind string, type string, origin string, file string, line int, body string, deps array<string>, "
    "callers array<struct<file:string,line:int,type:string,`in`:string>>, writes array<struct<file:string,line:int,type:string,`in`:string>>"
)
#: Evidence of a declaration that is shown, and declarations of a tree. Fixed values.
SHOWN_EVIDENCE, SHOWN_DECLARATIONS = 5, 200


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON Lines trace; of records with one id the last line stays. Blank lines and records without an id are skipped."""
    text = spark.read.text(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    rows = text.filter(F.trim("value") != "").select("_at", F.from_json("value", RECORD, {"mode": "FAILFAST"}).alias("r")).filter("r.id IS NOT NULL")
    return rows.groupBy("r.id").agg(F.max_by("r", "_at").alias("r")).select("r.*")


def dependencies(trace: DataFrame) -> DataFrame:
    """src, dst, ord of declared dependencies."""
    return trace.select(F.col("id").alias("src"), F.posexplode("deps").alias("ord", "dst"))


def levels(trace: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth at which each declaration is first reached, also those that the trace lacks."""
    return reach(roots, dependencies(trace), max_depth)


def closure(trace: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, depth and record of the declarations that the trace holds."""
    return levels(trace, roots, max_depth).join(trace.withColumnRenamed("id", "node"), "node")


def level_sizes(found: DataFrame) -> DataFrame:
    """root, depth, size."""
    return found.groupBy("root", "depth").agg(F.count("*").alias("size"))


def shown_depth(sizes: DataFrame) -> DataFrame:
    """root, shown_depth, total, hidden, hidden_levels: whole levels are shown while they hold SHOWN_DECLARATIONS at most, two at least."""
    running = F.sum("size").over(Window.partitionBy("root").orderBy("depth"))
    rows = sizes.withColumn("sum", running)
    by = rows.groupBy("root").agg(F.sum("size").alias("total"), F.max("depth").alias("deepest"), F.greatest(F.sum((F.col("sum") <= SHOWN_DECLARATIONS).cast("int")), F.lit(2)).alias("n"))
    depth = F.when(F.col("total") <= SHOWN_DECLARATIONS, F.col("deepest")).otherwise(F.least(F.col("n") - 1, F.col("deepest")))
    by = by.withColumn("shown_depth", depth)
    seen = sizes.join(by.select("root", "shown_depth"), "root").filter(F.col("depth") <= F.col("shown_depth")).groupBy("root").agg(F.sum("size").alias("seen"))
    return by.join(seen, "root").select("root", "shown_depth", "total", (F.col("total") - F.col("seen")).alias("hidden"), (F.col("deepest") - F.col("shown_depth")).alias("hidden_levels"))


def find(trace: DataFrame, query: str) -> DataFrame:
    """Ids that equal the query, or else end with it."""
    hits = trace.select("id", (F.col("id") == query).alias("exact")).filter(F.col("exact") | F.col("id").endswith(query))
    whole = hits.agg(F.coalesce(F.max("exact"), F.lit(False)).alias("any"))  # one row
    return hits.crossJoin(F.broadcast(whole)).filter("exact OR NOT any").select("id")


def why(trace: DataFrame, root: str) -> list[str]:
    """The tree of declarations below root as lines of text. The declarations shown are bounded, so they are laid out on the driver."""
    spark = trace.sparkSession
    found = levels(trace, spark.createDataFrame([(root,)], "root string"))
    cut_at = shown_depth(level_sizes(found)).first()
    near = found.filter(F.col("depth") <= cut_at["shown_depth"]).select(F.col("node").alias("id"), "depth")
    records = {r["id"]: r for r in near.join(trace, "id").collect()}
    out, printed, stack = [], set(), [(root, "", "", 0)]
    while stack:
        node, head, indent, depth = stack.pop()
        record = records.get(node)
        if record is None:
            out.append(f"{head}{node}  (not in trace)")
            continue
        place = record["file"] and (f"{record['file']}:{record['line']}" if record["line"] is not None else record["file"])
        text = f"{head}{node}  [unresolved]" if record["kind"] == "unresolved" else f"{head}{node}: {record['type'] or '?'}" + (f"  [{record['origin']}]" if record["origin"] else "")
        text += f"  {place}" if place else ""
        if node in printed:
            out.append(f"{text}  (see above)")
            continue
        printed.add(node)
        out.append(text)
        if record["body"] is not None and record["body"] != (record["type"] or "?"):
            out.append(f"{indent}    body: {record['body']}")
        for label, key in (("caller", "callers"), ("write", "writes")):
            items = record[key] or []
            for item in items[:SHOWN_EVIDENCE]:
                at = item["file"] and (f"{item['file']}:{item['line']}" if item["line"] is not None else item["file"]) or "?"
                out.append(f"{indent}    {label} {at} {item['type'] or ''}" + (f" in {item['in']}" if item["in"] else ""))
            if len(items) > SHOWN_EVIDENCE:
                out.append(f"{indent}    ... {len(items) - SHOWN_EVIDENCE} more {key} in the trace")
        if depth == cut_at["shown_depth"] and cut_at["hidden"]:
            continue
        deps = list(record["deps"] or [])
        for k in reversed(range(len(deps))):
            last = k == len(deps) - 1
            stack.append((deps[k], indent + ("└─ " if last else "├─ "), indent + ("   " if last else "│  "), depth + 1))
    if cut_at["hidden"]:
        out.append(f"... {cut_at['hidden']} more declarations in {cut_at['hidden_levels']} more levels; search the trace file for the rest")
    return out


def method_id(owner: F.Column, method: F.Column, singleton: F.Column) -> F.Column:
    """A#m for methods of instances, A.m for those of the class itself."""
    return F.concat(owner, F.when(singleton, ".").otherwise("#"), method)


def ivar_id(owner: F.Column, ivar: F.Column) -> F.Column:
    return F.concat(owner, ivar)


def sorted_ids(ids: F.Column, own: F.Column) -> F.Column:
    """Distinct ids in order without a declaration's own."""
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x != own)))


@arrow("array<struct<owner:string,member:string,via:string>>")
def body_references(term: pd.Series, owner: pd.Series) -> pd.Series:
    """What a declaration's unresolved type refers to: methods, instance variables."""

    def one(text, own):
        out = []
        for t in terms.walk(terms.loads(text)):
            if t[0] == "method_return":
                out.append((t[1] or own, t[2], "method"))
            elif t[0] == "receiver_method" and t[1][0] in ("class", "singleton"):
                out.append((t[1][1], t[2], "singleton" if t[1][0] == "singleton" else "method"))
            elif t[0] == "ivar":
                out.append((own, t[1], "ivar"))
        return [{"owner": o, "member": m, "via": v} for o, m, v in dict.fromkeys(out)]

    return pd.Series([one(*x) for x in zip(term, owner)], dtype="object")


def trace_records(declarations: DataFrame, calls: DataFrame) -> DataFrame:
    """One record for each declaration. declarations: id, owner, kind, type, raw_type (JSON terms), origin, file, line.

    calls: id (of the declaration they dispatch to), file, line, type, in.
    """
    refs = F.transform(body_references("raw_type", "owner"), lambda r: F.when(r.via == "ivar", ivar_id(r.owner, r.member)).otherwise(F.concat(r.owner, F.when(r.via == "singleton", ".").otherwise("#"), r.member)))
    callers = calls.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("file", "line", "type", "in"))).alias("callers"))
    rows = declarations.withColumn("deps", sorted_ids(refs, F.col("id"))).join(callers, "id", "left")
    return rows.select("id", "kind", "type", "origin", "file", "line", "deps", "callers")


def write_trace(records: DataFrame, path: str) -> None:
    """JSON Lines by id."""
    records.orderBy("id").select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode("overwrite").text(path)


def explain(sites: DataFrame, links: DataFrame, root: str, max_depth: int = 5, max_steps: int = 32, callers: int = 16, returns: int = 8) -> DataFrame:
    """step, depth, node, kind, truncated: how a site's type came about, nearest first.

    links: src, dst, kind (call, return), ord. Of one node's links at most `callers` calls and `returns` returns are followed.
    """
    limit = F.when(F.col("kind") == "call", callers).otherwise(returns)
    by = Window.partitionBy("src", "kind")
    capped = links.withColumn("n", F.row_number().over(by.orderBy("ord"))).withColumn("all", F.count("*").over(by)).withColumn("limit", limit)
    cut_off = capped.groupBy("src").agg(F.max(F.col("all") > F.col("limit")).alias("truncated"))
    kept = capped.filter(F.col("n") <= F.col("limit"))
    spark = sites.sparkSession
    found = reach(spark.createDataFrame([(root,)], "root string"), kept, max_depth)
    place = Window.partitionBy(F.lit(1)).orderBy("depth", "node")
    ranked = found.withColumn("step", F.row_number().over(place)).withColumn("total", F.count("*").over(Window.partitionBy(F.lit(1)))).filter(F.col("step") <= max_steps)
    rows = ranked.join(cut_off, ranked.node == cut_off.src, "left").join(sites, ranked.node == sites.id, "left")
    return rows.select("step", "depth", "node", "type", (F.coalesce("truncated", F.lit(False)) | ((F.col("step") == max_steps) & (F.col("total") > max_steps))).alias("truncated"))
