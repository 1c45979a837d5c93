"""Mixing sources to target weights by entropy balancing.

Among all non-negative document rates with the wanted words per source, entropy balancing takes those nearest to one
(least relative entropy). Its convex dual has one multiplier for each source's token constraint, and the rates are
exponentially tilted: rate = min(CAP, exp(lambda_source * size / mean size)). The dual separates by source: Newton steps over each source's
histogram of sizes find its multiplier, all sources at once on the executors; a bracket catches steps that leave it, and they go on
until a step changes nothing.
Rates then become copies: within blocks of a source, from large to small documents, each document takes the whole number
of copies nearest to its rate's words plus what the earlier ones left over, so a source's words come out near its
target to within a few small documents.

Sources are ordered by code point, null last, by a distributed sort; there may be any number of them. A task holds one source's distinct
sizes, or one block of documents. A null text has size 0 and takes no words; very long texts count like others. Rows of equal id and text
are interchangeable, each is counted and mixed for itself; reruns agree. Rows without an id are spread by their texts, many rows of equal id and text by their numbers. An empty table gives
an empty table. Other columns may be carried along, whatever their names; only those named like MIXED are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, copies_apart, restored, whole

CAP = 3.0
#: Sources up to which their table is broadcast to the rows; more are joined by a shuffle.
FEW_SOURCES = 100_000
#: Documents in a block of the rounding, about.
BLOCK_DOCS = 4096
#: The multiplier of a source whose documents are all taken as often as they may be.
ALL = 1e9
#: What the mix adds to a row.
MIXED = ["size", "source_size", "target", "rate", "copies", "taken"]
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources (source, ...) with rank, from 0, by code point, null last: a range partitioning numbers its parts one after the other."""
    order = [F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8")]
    parts = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = scratch.table(parts.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "parts")
    counts = sorted(tuple(r) for r in parts.groupBy("part").count().collect())  # one row for each partition
    before = sources.sparkSession.createDataFrame([(k, sum(n for j, n in counts if j < k)) for k, _ in counts], "part int, before long")
    return parts.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def with_targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """sources (size, weight) with target: words by weight, at most cap times the size, the excess shared anew until none is above."""
    free, last = F.lit(True), -1
    total = sources.agg(F.sum("size")).first()[0] or 0
    while True:
        row = sources.agg(F.sum(F.when(~free, cap * F.col("size"))).alias("full"), F.sum(F.when(free, F.col("weight"))).alias("share"), F.count_if(free).alias("n")).first()
        left, share = float(total) - (row["full"] or 0.0), float(row["share"] or 0)
        if row["n"] in (last, 0):
            break
        # shares only grow, so what was full once stays full
        last, free = row["n"], left * F.col("weight") / share <= cap * F.col("size")
    return sources.withColumn("target", F.when(free, left * F.col("weight") / share).otherwise(cap * F.col("size")) if share else cap * F.col("size"))


def multiplier(size: np.ndarray, n: np.ndarray, target: float, cap: float = CAP) -> float:
    """The dual's solution for one source: n documents of each size."""
    total, docs = float((size * n).sum()), float(n.sum())
    if total == 0 or target >= cap * total:
        return ALL
    x = size / (max(total, 1.0) / max(docs, 1.0))
    lam, low, high = math.log(max(target / total, 1e-12)), -math.inf, math.inf
    while True:
        rate = np.minimum(cap, np.exp(np.minimum(2.0, lam * x)))
        words = n * size * rate
        miss, slope = words.sum() - target, (words * x)[rate < cap].sum()
        if abs(miss) <= max(1e-6, 1e-9 * target):
            return lam
        if miss < 0:
            low = lam
        else:
            high = lam
        step = lam - miss / slope if slope > 0 else math.inf
        if not low < step < high:
            if math.isinf(low):
                step = high - 2 * max(1.0, abs(high))
            elif math.isinf(high):
                step = low + 2 * max(1.0, abs(low))
            else:
                step = (low + high) / 2
        if step == lam or step in (low, high):
            return lam
        lam = step


def multipliers(histogram: DataFrame) -> DataFrame:
    """source, lam of every source. histogram: source, size, n, target."""

    def solved(group: pa.Table) -> pa.Table:
        size, n = (np.asarray(group[c].combine_chunks()).astype(np.float64) for c in ("size", "n"))
        order = np.argsort(size, kind="stable")
        return pa.table({"source": group["source"].slice(0, 1), "lam": pa.array([multiplier(size[order], n[order], group["target"][0].as_py())])})

    return histogram.groupBy("source").applyInArrow(solved, "source string, lam double")


def round_block(sizes: np.ndarray, rates: np.ndarray) -> list[int]:
    """Copies of documents ordered from large to small: the words left over are passed on.

    The nearest number of copies is taken, unless the smaller documents could not make up for what it leaves over.
    """
    words = rates * sizes
    least = words.sum() - np.cumsum(words)  # what the rest may give up, and what it may take on
    most = CAP * (sizes.sum() - np.cumsum(sizes)) - least
    out, left = [], 0.0
    for size, want, low, high in zip(sizes.tolist(), words.tolist(), least.tolist(), most.tolist()):
        if not size:
            out.append(1)
            continue
        want += left
        near = min(int(CAP), max(0, math.floor(want / size + 0.5)))
        if not -low <= want - near * size <= high:
            miss = lambda c: max(-low - (want - c * size), (want - c * size) - high, 0.0)  # noqa: B023, E731
            near = min(range(int(CAP) + 1), key=lambda c: (miss(c), abs(want - c * size)))
        left = want - near * size
        out.append(near)
    return out


def _rounded(docs: DataFrame, weights, id_col: str, text_col: str, source_col: str, kept: F.Column) -> DataFrame:
    """_mx_in (kept) and MIXED of every row."""
    scratch = Scratch(docs.sparkSession)
    # by id and text, and of many equal rows by their numbers, so that no block holds all that lack an id
    rows = docs.select(kept.alias("_mx_in"), word_count(text_col).alias("size"), F.col(source_col).alias("source"), F.xxhash64(id_col, text_col).alias("h"))
    rows = copies_apart(scratch.table(rows, "rows"), "h", BLOCK_DOCS // 4, scratch)
    histogram = scratch.table(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    found = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    ranked = _ranked(found, scratch).withColumn("weight", F.lit(weights(F.col("rank"))).cast("double"))
    table = scratch.table(with_targets(scratch.table(ranked.withColumn("size", F.col("source_size")), "ranked")).drop("size"), "targets")
    key = [F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("none")]
    keyed = lambda df: df.select("*", *key)
    lam = multipliers(keyed(histogram).join(keyed(table).select("k", "none", "target"), ["k", "none"]).select("source", "size", "n", "target"))
    table = keyed(table).join(keyed(lam).select("k", "none", "lam"), ["k", "none"])
    mean = F.greatest("source_size", F.lit(1)) / F.greatest("docs", F.lit(1))
    table = scratch.table(table.select("k", "none", F.col("rank").alias("sid"), "source_size", "target", "lam", mean.alias("mean"), F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks")), "sources")
    rows = keyed(rows).join(F.broadcast(table) if table.count() <= FEW_SOURCES else table, ["k", "none"])
    x = F.col("size") / F.col("mean")
    rows = rows.withColumn("rate", F.least(F.lit(CAP), F.exp(F.least(F.lit(2.0), F.col("lam") * x)))).withColumn("block", F.pmod("h", "blocks"))
    rows = rows.select("_mx_in", "size", "source_size", "target", "rate", "h", "sid", "block")
    out = rows.select("_mx_in", "size", "source_size", "target", "rate", F.lit(1).alias("copies"), F.lit(0).cast("long").alias("taken"))

    def rounded(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("h", "ascending")])
        size = np.asarray(group["size"].combine_chunks())
        copies = np.asarray(round_block(size, np.asarray(group["rate"].combine_chunks())), np.int32)
        group = group.append_column("copies", pa.array(copies)).append_column("taken", pa.array(copies * size, pa.int64()))
        return group.select(["_mx_in", *MIXED])

    return rows.groupBy("sid", "block").applyInArrow(rounded, out.schema)


def mix(docs: DataFrame, weights=lambda rank: 1 + rank % 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """docs (if keep, all columns but those named like MIXED, which are replaced; else the id as doc_id) with MIXED."""
    if not keep:
        return _rounded(docs, weights, id_col, text_col, source_col, F.col(id_col)).select(F.col("_mx_in").alias("doc_id"), *MIXED)
    kept = [c for c in docs.columns if c.lower() not in MIXED]
    return _rounded(docs, weights, id_col, text_col, source_col, whole(docs, MIXED)).select(*restored("_mx_in", kept), *MIXED)


def repeated(docs: DataFrame, weights=lambda rank: 1 + rank % 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, whole and unchanged, each as often as the mix takes it."""
    rows = _rounded(docs, weights, id_col, text_col, source_col, whole(docs)).filter("copies > 0")
    return rows.select("_mx_in", F.explode(F.sequence(F.lit(1), "copies"))).select(*restored("_mx_in", docs.columns))


def op7_entropy_balanced_mix(spark, sf_dir):
    """The mix of all documents."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


QUERIES = {"op7_entropy_balanced_mix": op7_entropy_balanced_mix}
SQL: dict[str, str] = {}
