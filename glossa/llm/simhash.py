"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 4 bits exactly if some value lies within 2 bits of both. So every distinct
fingerprint emits its ball, the 2,081 values within half the radius; fingerprints that share a value are linked, and all that share one
hang on the least of them, so a group of any size gives as many links as members and no pairs are written out.
Links are deduplicated, verified by their distance, and closed to components.

Before that a filter with the same idea on halves spares fingerprints that can have no partner: of two
fingerprints within 4 bits, one 32-bit half is within 2, so one of 33 values within 1 bit of that half is shared. Fingerprints
that share none emit no ball. The filter loses no link.

Balls are made and met in numpy: a chunk of fingerprints sorts its values, links those that meet in it, and ships one
row of each value, packed into buckets by a hash of the value.

Words are lower-cased (A-Z) runs of non-blanks. A null text is empty: fingerprint zero, linked like any other. Repeated rows
and equal texts share a fingerprint. Rows with null ids take part; a component's id is its least id that is not null. A bit that is set in
exactly half the hashes is 0. Very long texts are hashed whole. An empty table gives an empty table. `near_duplicates` reads no other columns;
`keep_one` carries them along whole, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glossa.llm.common import Scratch, chunks, first_rows, keep_rows, mix, row_key
from glossa.llm.components import components

RADIUS = 4
#: Fingerprints in a chunk that emits its balls at once, and values in a bucket, about.
CHUNK, BUCKET = 256, 1 << 19
MASKS = np.array([0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)], np.uint64)


def fingerprints(texts: list[bytes], width: int = 4) -> np.ndarray:
    """SimHash of the XXH64 (seed 42) of word shingles."""
    counts, hashes = [], []
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    for t in texts:
        words = t.lower().split()
        n = len(words)
        if n > width:
            s = map(b" ".join, zip(*(words[i:] for i in range(width))))
            hashes.append(np.fromiter(map(hashed, s), np.uint64, n - width + 1))
        else:
            hashes.append(np.array([hashed(b" ".join(words))] if n else [], np.uint64))
        counts.append(len(hashes[-1]))
    size = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    flat = np.concatenate(hashes)
    ends = np.cumsum(size[some])
    starts = ends - size[some]
    for byte in range(8):
        part = ((flat >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
        bits = np.unpackbits(part[:, None], axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        more = (2 * ones > size[some][:, None]).astype(np.uint64)
        out[some] |= (more << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "_sh_fp") -> DataFrame:
    """docs with the fingerprint as a long column."""
    kept = [c for c in docs.columns if c != out]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*rows.schema.fields, StructField(out, LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text_col, 1 << 19):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints(texts).view(np.int64))], names=[*kept, out])

    return rows.mapInArrow(add, schema)


def _half(fp: F.Column, low: bool) -> F.Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)) if low else F.shiftrightunsigned(fp, 32)


def may_have_partners(fps: DataFrame) -> DataFrame:
    """The fingerprints (fp) that share a value within 1 bit of a half with another, or with several others.

    A value that two share is decided at once by their distance.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(32)])
    keyed = None
    for low in (False, True):
        half = _half(F.col("fp"), low)
        one = fps.select("fp", F.explode(F.transform(flips, lambda m: half.bitwiseXOR(m).bitwiseXOR(F.lit(0 if low else 1 << 40)))).alias("v"))
        keyed = one if keyed is None else keyed.union(one)
    met = keyed.groupBy("v").agg(F.count("*").alias("n"), F.min("fp").alias("first"), F.max("fp").alias("last"))
    near = F.bit_count(F.col("first").bitwiseXOR(F.col("last"))) <= RADIUS
    met = met.filter((F.col("n") > 2) | (F.col("n") == 2) & near).select("v")
    return keyed.join(met, "v", "left_semi").select("fp").distinct()


def _runs(values: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (value, fp) pairs: the distinct values, the least fp of each, and the links (fp, least fp) of the others."""
    order = np.argsort(values)
    values, fps = values[order], fps[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    least = np.minimum.reduceat(fps, first)
    head = np.repeat(least, np.diff(np.append(first, len(values))))
    other = fps != head
    pairs = np.unique(np.stack([fps[other], head[other]], axis=1), axis=0) if other.any() else np.empty((0, 2), np.uint64)
    return values[first], least, pairs[:, 0], pairs[:, 1]


def ball_links(fps: DataFrame, count: int) -> DataFrame:
    """a, b: links that connect all fingerprints within RADIUS bits. count: how many fingerprints there are."""
    buckets = 1 << max(0, math.ceil(math.log2(max(1, count * len(MASKS) / BUCKET))))
    schema = pa.schema([("bucket", pa.int64()), ("met", pa.bool_()), ("pack", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                fp = np.asarray(batch.slice(at, CHUNK).column(0)).view(np.uint64)
                values, least, a, b = _runs((fp[:, None] ^ MASKS).ravel(), np.repeat(fp, len(MASKS)))
                where = (mix(values) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                where, pairs = where[order], np.stack([values[order], least[order]], axis=1)
                cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                packs = [p.tobytes() for p in np.split(pairs, cuts[1:])]
                links = np.stack([a, b], axis=1).tobytes()  # those that met in the chunk pass through the bucket of its first value
                yield pa.RecordBatch.from_arrays([pa.array([*where[cuts], where[0]], pa.int64()), pa.array([False] * len(packs) + [True]), pa.array([*packs, links], pa.binary())], schema=schema)

    def meet(group: pa.Table) -> pa.Table:
        met, packs = group["met"].to_pylist(), group["pack"].to_pylist()
        pairs = np.frombuffer(b"".join(p for p, m in zip(packs, met) if not m), np.uint64).reshape(-1, 2)
        links = np.frombuffer(b"".join(p for p, m in zip(packs, met) if m), np.uint64).reshape(-1, 2)
        _, _, a, b = _runs(pairs[:, 0], pairs[:, 1])
        links = np.unique(np.concatenate([links, np.stack([a, b], axis=1)]), axis=0)
        return pa.table({"a": np.ascontiguousarray(links[:, 0]).view(np.int64), "b": np.ascontiguousarray(links[:, 1]).view(np.int64)})

    made = fps.select("fp").repartitionByRange("fp").mapInArrow(emit, "bucket long, met boolean, pack binary")
    links = made.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def rooted(fingerprinted: DataFrame, scratch: Scratch, id_col: str, fp_col: str = "_sh_fp") -> DataFrame:
    """fp, least (the least id of its rows), root: every distinct fingerprint with the least one reachable."""
    least = fingerprinted.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least"))
    least = scratch.table(least, "fps")
    near = scratch.table(may_have_partners(least.select("fp")), "near")
    roots = components(ball_links(near, near.count()), scratch)
    return least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def groups(fingerprinted: DataFrame, scratch: Scratch, id_col: str, fp_col: str = "_sh_fp") -> DataFrame:
    """fp, component_id: for every distinct fingerprint the least id of all rows reachable."""
    found = rooted(fingerprinted, scratch, id_col, fp_col)
    of = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return scratch.table(found.join(of, "root").select("fp", "component_id"), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "_sh_fp")
    rows = scratch.table(rows, "rows")
    met = rows.join(groups(rows, scratch, "doc_id"), F.col("_sh_fp") == F.col("fp"))
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with its least id (of rows that share that id, or of null ids only, any one)."""
    scratch = Scratch(docs.sparkSession)
    rows = with_fingerprints(docs.select(F.col(id_col).alias("_sh_id"), row_key(id_col, text_col).alias("_sh_row"), F.col(text_col).alias("text"))).select("_sh_id", "_sh_row", "_sh_fp")
    rows = scratch.table(rows, "rows")
    found = rows.join(rooted(rows, scratch, "_sh_id"), F.col("_sh_fp") == F.col("fp")).select("root", "_sh_id", "_sh_row")
    return keep_rows(docs, scratch.table(first_rows(found), "kept"), id_col, text_col)


def op4_simhash_ball(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_simhash_ball": op4_simhash_ball}
SQL: dict[str, str] = {}
