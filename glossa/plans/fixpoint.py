"""Closures and fixpoints as bounded driver loops over DataFrames.

Each round joins only the rows that the last one found (semi-naive) and cuts its lineage on the shared checkpoint folder.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without and gets a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set")
        found = tempfile.mkdtemp(prefix="glossa-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, on the shared folder.

    A checkpoint keeps the size that was guessed before it ran: that of a small file, say, however many rows came of it. By that, tables of any size would be
    broadcast through the driver. So the guess is dropped; what proves small once it is shuffled is still broadcast.
    """
    spark = df.sparkSession
    shared_dir(spark)
    stored = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(stored.queryExecution().toRdd(), stored.schema(), False), spark)


def stored(df: DataFrame) -> DataFrame:
    """df kept by columns on the shared folder, for wide tables that many steps read a few columns of. Their small files tell little of their rows, so joins of them are sorted, as in `cut`."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


#: Rows of a table that is sent to every task.
FEW = 10_000


def few(df: DataFrame) -> DataFrame:
    """df stored, and sent to every task where it proves to have FEW rows at most: what is joined to it by keys that only few rows have stays where it is."""
    stored = cut(df)
    return F.broadcast(stored) if stored.limit(FEW + 1).count() <= FEW else stored


#: Bytes of input files of which a part holds the rows, about.
PART = 4 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many parts as its input asks for, where these are more than Spark would make: what a task sorts doesn't grow with the input then."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    total = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, df.inputFiles()))
    n = -(-total // PART)
    return df.repartition(n, *keys) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def reach(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth: the least number of steps from each root to each node (itself: 0). roots: root; edges: src, dst.

    Each round is stored once, by itself, and joined by what it found only.
    """
    edges = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    rounds = [cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())]
    while max_depth is None or len(rounds) <= max_depth:
        step = rounds[-1].join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        new = cut(step.join(_all(rounds), ["root", "node"], "left_anti").withColumn("depth", F.lit(len(rounds))))
        if new.isEmpty():
            break
        rounds.append(new)
    return _all(rounds)


def numbered(ordered: DataFrame) -> DataFrame:
    """The rows of a sorted table with place, from 0: parts are numbered one behind the other by their sizes, so no task sees more than its part."""
    at = F.col("_at")
    rows = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect())  # one row for each part
    before = rows.sparkSession.createDataFrame([(k, sum(n for j, n in sizes if j < k)) for k, _ in sizes], "_part long, _before long")
    met = rows.join(F.broadcast(before), part == F.col("_part"))
    return met.withColumn("place", F.col("_before") + at.bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def ranked_reach(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """class, owner, rank: for every class (of classes, or of the edges) its lookup path (itself first), by depth-first order of ranked edges.

    edges: src, dst, ord (the order in which src tries its neighbours). A path is the array of ords on the way, so that comparing
    arrays compares places in the lookup order; the least path of an owner counts. Only paths that are less than what their owner has are followed: what
    goes on from a greater one would be greater too, as a way back to the owner is none. It goes on until nothing new is met, and cycles end where an owner comes again.
    """
    nodes = edges.select(F.col("src").alias("n")).union(edges.select(F.col("dst").alias("n"))).union(classes.select("class")).distinct()
    start = nodes.select(F.col("n").alias("class"), F.col("n").alias("owner"), F.array().cast("array<int>").alias("path"), F.array("n").alias("trail"))
    last = cut(start)
    best = last.select("class", "owner", "path")
    while True:
        step = last.join(edges, F.col("owner") == F.col("src")).filter(~F.array_contains("trail", F.col("dst")))
        step = step.select("class", F.col("dst").alias("owner"), F.concat("path", F.array(F.col("ord").cast("int"))).alias("path"), F.concat("trail", F.array("dst")).alias("trail"))
        found = step.groupBy("class", "owner").agg(F.min("path").alias("path"), F.min_by("trail", "path").alias("trail"))
        had = best.select("class", "owner", F.col("path").alias("had"))
        last = cut(found.join(had, ["class", "owner"], "left").filter(F.col("had").isNull() | (F.col("path") < F.col("had"))).drop("had"))
        if last.isEmpty():
            return best.select("class", "owner", F.col("path").alias("rank"))
        best = cut(best.union(last.select("class", "owner", "path")).groupBy("class", "owner").agg(F.min("path").alias("path")))
