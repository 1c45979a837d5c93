"""What the training-data operators share: shared tables, text batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that an Arrow function holds in numpy arrays at a time.
CHUNK_BYTES = 2 << 20
#: Parquet settings for rows of about a megabyte.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}
#: Words in a text are runs of bytes other than these.
WHITESPACE = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else, in a local session (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="glossa-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/glossa-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
        """Write df as Parquet and read it back. large_rows: keeps row groups small, as readers hold thousands of rows of one."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        if large_rows:
            writer = writer.options(**LARGE_ROWS)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove a table that no later plan reads, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    """Partitions that a shuffle gets by configuration."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_size(text: str) -> F.Column:
    """UTF-8 bytes of a text column, null: 0."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def row_key(id_col: str, text_col: str) -> F.Column:
    """A hash of a row's id and text, null ids apart from all others; a null text counts as empty."""
    own = F.col(id_col).cast("string")
    return F.sha2(F.concat(F.coalesce(F.concat(F.length(own).cast("string"), F.lit(":"), own), F.lit("-")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)


def copies_apart(rows: DataFrame, key: str, most: int, scratch: Scratch) -> DataFrame:
    """rows, but of a key (64-bit) that more than `most` rows share each row has a key of its own: a hash of the key and of the row's number among them.

    Numbers run from part to part of a written table, so no task sees more than one part's rows of a key. Where no key is so frequent, rows as they are.
    """
    frequent = scratch.table(rows.groupBy(key).count().filter(F.col("count") > most).select(F.col(key).alias("_ca_key")), "frequent")
    if frequent.isEmpty():
        return rows
    laid = scratch.table(rows.withColumn("_ca_at", F.monotonically_increasing_id()), "laid")
    part = F.shiftright("_ca_at", 33)
    hot = laid.join(frequent, F.col(key) == F.col("_ca_key"), "left_semi").withColumn("_ca_part", part)
    counts = hot.groupBy(F.col(key).alias("_ca_key"), F.col("_ca_part").alias("_ca_of")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_ca_key").orderBy("_ca_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_ca_before", before).drop("n")
    own = F.row_number().over(Window.partitionBy(key, "_ca_part").orderBy("_ca_at"))
    hot = hot.withColumn("_ca_own", own).join(counts, (F.col(key) == F.col("_ca_key")) & (F.col("_ca_part") == F.col("_ca_of")))
    hot = hot.withColumn(key, F.xxhash64(key, F.col("_ca_before") + F.col("_ca_own")))
    cold = laid.join(frequent, F.col(key) == F.col("_ca_key"), "left_anti")
    return scratch.table(cold.select(*rows.columns).union(hot.select(*rows.columns)), "apart")


def first_rows(rooted: DataFrame) -> DataFrame:
    """_sh_row: one row key of each component, that of its least id. rooted: root, _sh_id, _sh_row."""
    least = F.min(F.struct(F.col("_sh_id").isNull().alias("none"), F.col("_sh_id"), F.col("_sh_row")))
    return rooted.groupBy("root").agg(least.alias("least")).select(F.col("least._sh_row").alias("_sh_row"))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each row key of kept (_sh_row)."""
    rows = docs.select(whole(docs).alias("_sh_in"), row_key(id_col, text_col).alias("_sh_row"))
    return rows.join(kept, "_sh_row", "left_semi").dropDuplicates(["_sh_row"]).select(*restored("_sh_in", docs.columns))


def whole(df: DataFrame, but: Iterable[str] = ()) -> F.Column:
    """All columns of a row as one struct, so that no name can clash with an operator's own. but: names to leave out, in any case."""
    out = {c.lower() for c in but}
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in out])


def restored(struct: str, names: Iterable[str]) -> list[F.Column]:
    """The columns that `whole` has put away."""
    return [F.col(struct).getField(c).alias(c) for c in names]


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8; null: empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most limit bytes of text each (one row at least)."""
    for batch in batches:
        release()
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                piece = batch.slice(start, i - start)
                yield piece, text_bytes(piece.column(piece.schema.get_field_index(text)))
                start, total = i, 0
            total += int(n)
        piece = batch.slice(start)
        yield piece, text_bytes(piece.column(piece.schema.get_field_index(text)))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows as Python values, one at a time, as each may hold megabytes."""
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in batch.columns)


def release() -> None:
    """Give Arrow memory that nothing holds any more back to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 400_000

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, vectorised."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of numpy arrays or lists."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
