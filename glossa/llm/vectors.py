"""Vectors as whole numbers: what the operators on embeddings share.

A component x is floor(256 * x), held to LARGEST either way, so that scores and squared distances fit 64 bits. Rows whose vector is null, or holds a null or
non-finite component, take no part. Vectors shorter than the longest count as if zeros followed. Every row gets a number of its own, so that rows of equal or
null id stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch

SCALE, LARGEST = 256, 1 << 27
#: Products of vectors are exact in doubles below this.
EXACT = 1 << 53


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole_numbers(rows: DataFrame, scratch: Scratch, name: str, vector_col: str, others: dict[str, Column], multiple: int = 1) -> tuple[DataFrame, int]:
    """row, the other columns, v (components as 32-bit numbers) of all usable rows, and how many components v has: the longest vector's, up to a multiple."""
    kept = rows.filter(usable(vector_col)).select(*[c.alias(n) for n, c in others.items()], F.col(vector_col).cast("array<double>").alias("x"))
    dim = kept.agg(F.max(F.size("x"))).first()[0] or 0
    dim = max(multiple, -(-dim // multiple) * multiple)
    names = [*others, "v"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "x")

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1)
            lengths = np.asarray(x.value_lengths())
            at = np.concatenate([[0], np.cumsum(lengths)])
            out = np.zeros((len(x), dim), np.int32)
            where = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
            with np.errstate(over="ignore"):
                out[np.repeat(np.arange(len(x)), lengths), where] = np.clip(np.floor(SCALE * np.asarray(x.flatten(), dtype=np.float64)), -LARGEST, LARGEST)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in out], pa.binary())], names=names)

    made = kept.mapInArrow(floor, f"{kinds}, v binary")
    return scratch.table(made.withColumn("row", F.monotonically_increasing_id()), name), dim


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of packed vectors as rows of 64-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exactly."""
    most = (np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if int(most[0]) * int(most[1]) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
