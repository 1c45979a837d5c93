"""A workspace kept up to date from a stream of file changes.

Changes: file, generation, op (open, change, close, delete), content. There is no event time: arrival and generation decide, and a change older than
what a file already has is late and dropped. State lies in Parquet tables below one folder, a log of versions, one for each micro-batch,
so a batch that is run again after a failure gives the same version and a stream that is started again goes on with what it had.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glossa.functions.positions import apply_edits
from glossa.operators.dependencies import bag_fingerprint, changed, referencing_files

CHANGES = "file string, generation long, op string, content string"
TOUCHED = StructType([StructField("file", StringType()), StructField("generation", LongType())])


def latest(changes: DataFrame) -> DataFrame:
    """Of each file the change with the greatest generation."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("generation"), F.desc("op")))
    return changes.withColumn("n", rank).filter("n = 1").drop("n")


def current(changes: DataFrame, generations: DataFrame) -> DataFrame:
    """Changes that are newer than what is known of their file (file, seen)."""
    return changes.join(generations, "file", "left").filter(F.col("seen").isNull() | (F.col("generation") > F.col("seen"))).drop("seen")


def upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state (file, generation, content) after the latest changes; deleted files go. One join, no order between files."""
    new = latest(changes)
    kept = state.join(new.select("file", F.col("generation").alias("newer")), "file", "left").filter(F.col("newer").isNull() | (F.col("newer") <= F.col("generation"))).drop("newer")
    fresh = new.filter("op <> 'delete'").join(state.select("file", F.col("generation").alias("had")), "file", "left").filter(F.col("had").isNull() | (F.col("had") < F.col("generation")))
    return kept.unionByName(fresh.select("file", "generation", "content"))


def unchanged(files: DataFrame, stamps: DataFrame) -> DataFrame:
    """Files whose stamp (mtime, len, hash) is the known one: only the stamp is refreshed."""
    return files.join(stamps, ["file", "mtime_ns", "len", "content_hash"], "left_semi")


def content_hash(content: str = "content") -> F.Column:
    return F.xxhash64(content)


class Workspace:
    """Facts of files, kept by a function that extracts them, as a log below one folder.

    extract(files: file, content) -> {"defs": DataFrame (file, symbol, signature), "refs": DataFrame (file, symbol), ...}

    A batch writes what it changes: the files it touched (also deleted ones, with their generation), and the content and facts of those that
    live. What a file has is what the last batch that touched it wrote. After COMPACT batches the log is folded into one whole version, so a
    read joins a bounded number of small tables. A version counts once its marker is written; a new Workspace over the folder goes on
    from the last one, and a batch that is applied again gives what it gave.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, root: str, extract: Callable[[DataFrame], dict[str, DataFrame]]):
        self.spark, self.root, self.extract = spark, root, extract
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        empty = spark.createDataFrame([], "file string, generation long, content string")
        self.schemas = {"files": empty.schema} | {k: d.schema for k, d in extract(empty.select("file", "content")).items()}
        self.versions, self.wholes = self._marked("_DONE"), set(self._marked("_WHOLE"))
        self.merged_key: tuple | None = None
        self._refresh()

    @property
    def version(self) -> int:
        return self.versions[-1] if self.versions else -1

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _marked(self, mark: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"v*/{mark}"))
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found or [])

    def _store(self, df: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.root}/v{version}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _log(self, name: str, schema: StructType) -> DataFrame:
        """The rows of a table in all versions since the last whole one, with their version as _v."""
        start = max([v for v in self.versions if v in self.wholes], default=-1)
        out = self.spark.createDataFrame([], schema).withColumn("_v", F.lit(-1))
        for v in self.versions:
            if v >= start:
                path = f"{self.root}/v{v}/{'whole/' if v in self.wholes else ''}{name}"
                out = out.unionByName(self.spark.read.schema(schema).parquet(path).withColumn("_v", F.lit(v)))
        return out

    def _refresh(self) -> None:
        touched = self._log("touched", TOUCHED)
        last = touched.groupBy("file").agg(F.max("_v").alias("_v"))
        now = {k: self._log(k, schema).join(last, ["file", "_v"], "left_semi").select(*schema.names) for k, schema in self.schemas.items()}
        self.files = now.pop("files")
        self.facts: dict[str, DataFrame] = now
        self.seen = touched.groupBy("file").agg(F.max("generation").alias("seen"))
        self.dirty = self.spark.read.schema("file string").parquet(f"{self.root}/v{self.version}/dirty") if self.versions else self.seen.select("file").limit(0)

    def apply(self, changes: DataFrame, batch: int | None = None, scan: bool = False) -> DataFrame:
        """One batch of changes; returns the files (file) that depend on a definition that changed, one hop away.

        scan: the first scan of a workspace, which invalidates nothing. A batch that is known already is not applied again.
        """
        number = self.version + 1 if batch is None else batch
        if number in self.versions:
            return self.spark.read.schema("file string").parquet(f"{self.root}/v{number}/dirty")
        if number < self.version:
            raise ValueError(f"batch {number} comes after {self.version}")
        new = self._store(latest(current(changes, self.seen)), "changes", number)
        touched = new.select("file")
        live = new.filter("op <> 'delete'")
        fresh = {k: self._store(d, k, number) for k, d in self.extract(live.select("file", "content")).items()}
        self._store(live.select("file", "generation", "content"), "files", number)
        before, after = self.facts["defs"].join(touched, "file", "left_semi"), fresh["defs"]
        prints = [bag_fingerprint(d, ["symbol"], ["file", "signature"]) for d in (before, after)]
        hit = referencing_files(self.facts["refs"], changed(*prints, ["symbol"])).join(touched, "file", "left_anti") if not scan else touched.limit(0)
        hit = self._store(hit, "dirty", number)
        self._store(new.select("file", "generation"), "touched", number)
        self._mark(number, "_DONE")
        self.versions.append(number)
        self.merged_key = None
        self._refresh()
        if len([v for v in self.versions if v >= max(self.wholes, default=-1)]) > self.COMPACT:
            self._fold(number)
        return hit

    def _mark(self, version: int, name: str) -> None:
        self._fs.create(self._path(f"v{version}/{name}"), True).close()

    def _fold(self, version: int) -> None:
        """All up to this version as one, beside it; older versions go once it is marked, and a crash before that leaves the log as it was."""
        seen = self.seen.withColumnRenamed("seen", "generation")
        for name, df in {"files": self.files, "touched": seen, **self.facts}.items():
            self._store(df, f"whole/{name}", version)
        self._mark(version, "_WHOLE")
        self.wholes.add(version)
        for v in [v for v in self.versions if v < version]:
            self._fs.delete(self._path(f"v{v}"), True)
            self.versions.remove(v)
        self._refresh()

    def merged(self, build: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
        """A table over all facts, built again only after a change."""
        if self.merged_key is None:
            self.merged_key = (self.version, self._store(build(self.facts), "merged", self.version))
        return self.merged_key[1]

    def without(self, file: str) -> dict[str, DataFrame]:
        """The facts of all other files."""
        return {k: d.filter(F.col("file") != file) for k, d in self.facts.items()}

    def run(self, changes: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None):
        """The streaming query: changes (a stream) are applied by micro-batch; publish gets the invalidated files of each."""

        def each(batch: DataFrame, number: int) -> None:
            found = self.apply(batch, number)
            if publish:
                publish(found, number)

        return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A stream of changes from JSON files that arrive in a folder."""
    return spark.readStream.schema(CHANGES).json(path)


def watched_changes(events: DataFrame) -> DataFrame:
    """Watcher events (file, generation, event, content) as changes."""
    op = F.when(F.col("event") == "deleted", "delete").when(F.col("event") == "created", "open").otherwise("change")
    return events.select("file", "generation", op.alias("op"), "content")


def due(requests: DataFrame, now_ms: F.Column, quiet_ms: int = 150) -> DataFrame:
    """Of each document's requests (doc, epoch, at_ms) the last one, once it has been quiet for a while; older epochs never run."""
    last = requests.groupBy("doc").agg(F.max_by(F.struct("epoch", "at_ms"), "epoch").alias("r")).select("doc", "r.epoch", "r.at_ms")
    return last.filter(now_ms - F.col("at_ms") >= quiet_ms)


def publishable(results: DataFrame, epochs: DataFrame) -> DataFrame:
    """Results (doc, epoch, ...) whose epoch is still the document's current one when they are ready."""
    return results.join(epochs.groupBy("doc").agg(F.max("epoch").alias("epoch")), ["doc", "epoch"], "left_semi")


def current_generation(results: DataFrame, generation: int) -> DataFrame:
    """Results of a scan that no later scan has replaced."""
    return results.filter(F.col("generation") >= generation)


def _folded(version: int, text: str, rows: pd.DataFrame) -> tuple[int, str]:
    """A document after edits (version, edits), in order; older versions are dropped."""
    for v, e in zip(rows["version"], rows["edits"]):
        if v > version:
            after = apply_edits(text, json.loads(e))
            version, text = int(v), text if after is None else after
    return version, text


def documents(edits: DataFrame) -> DataFrame:
    """doc, version, content kept from edits (doc, version, edits: JSON list), a stream or a table: each document's edits fold in order.

    An edit with a range outside the text is dropped whole and the text stays.
    """
    schema = "doc string, version long, content string"

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = _folded(*(state.get if state.exists else (-1, "")), pd.concat(list(batches)).sort_values("version"))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["doc", "version", "content"])

    def whole(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *_folded(-1, "", rows.sort_values("version")))], columns=["doc", "version", "content"])

    by = edits.groupBy("doc")
    return by.applyInPandasWithState(fold, schema, "version long, content string", "update", "NoTimeout") if edits.isStreaming else by.applyInPandas(whole, schema)


def running_fingerprints(changes: DataFrame) -> DataFrame:
    """key, n, h_sum, h_xor kept from a stream of signed rows (key, h: long, sign 1 or -1): a retractable bag fingerprint."""

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, mixed = state.get if state.exists else (0, "0", 0)
        total = int(total)
        for rows in batches:
            for h, sign in zip(rows["h"].astype("int64"), rows["sign"]):
                n, total, mixed = n + int(sign), (total + int(sign) * int(h)) % (1 << 64), mixed ^ int(h)
        state.update((n, str(total), mixed))
        yield pd.DataFrame([{"key": key[0], "n": n, "h_sum": str(total), "h_xor": mixed}])

    return changes.groupBy("key").applyInPandasWithState(fold, "key string, n long, h_sum string, h_xor long", "n long, h_sum string, h_xor long", "update", "NoTimeout")
