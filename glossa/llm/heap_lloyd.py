"""Vector codes by product quantisation, its codebooks refined by Lloyd's rounds that rescan only what may have changed.

A vector's parts are compared with the entries of their position's codebook. What a scan of a part finds is kept beside it: its entry, and its slack, the
distance to the second nearest entry (a lower bound of that to any other) less the distance to its own (an upper bound). When entries move, the slack of all
parts of an entry shrinks by at most as much as the entry itself has moved and the one that moved furthest; these drifts are summed for each entry. A part's
key is its slack plus the sum at the time of its scan, so keys never change, and a part may have another nearest entry only where its key is not above its
entry's sum of today.

Each block of rows keeps a heap of parts for each position and entry, the least key on top. A round pops from each heap the parts whose bounds are violated, and
these alone are scanned again, exactly, in whole numbers (ties go to the lower index), and put into the heap of the entry they have found. The heap is an
array in ascending order, of which what is popped is the front, so blocks are handled by numpy.

A block is a batch of rows of one partition; nothing but sums and counts of each entry leaves it (positions x entries rows from each task, combined before
the shuffle). The driver holds the codebooks. Every round is a table in the shared folder.

Rows whose vector is unusable are left out (see `vectors`); vectors are filled up with zeros to a multiple of the number of parts. A codebook starts with the rows of the
least ids; rows of equal id are taken in the order of their packed components, rows without id last. With fewer rows than entries, codebooks are as small.
Repeated rows count for themselves. Errors of equal labels (whole numbers, nulls together) are summed. An empty table gives an empty table. Columns
other than the three are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, read
from glossa.llm.vectors import matrix, products, whole_numbers

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: What rounding can take from a bound, as a share of the greatest distance at a position.
SLACK = 1e-9


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part (the lower index on ties), and the slack: how much further off the second nearest is."""
    far = (x * x).sum(axis=1)[:, None] - 2 * products(x, book) + (book * book).sum(axis=1)
    code = far.argmin(axis=1)
    at = np.arange(len(x))
    upper = np.sqrt(far[at, code].astype(np.float64))
    far[at, code] = np.iinfo(np.int64).max
    lower = np.sqrt(far.min(axis=1).astype(np.float64)) if len(book) > 1 else np.full(len(x), np.inf)
    return code, lower - upper


class Heaps:
    """The parts of a block at one position, a heap for each entry, by their keys."""

    def __init__(self, code: np.ndarray, key: np.ndarray, entries: int):
        self.order = np.lexsort((key, code))
        self.keys = key[self.order]
        self.ends = np.searchsorted(code[self.order], np.arange(entries + 1))

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """The parts whose key is at most their entry's drift."""
        popped = [self.order[a : a + np.searchsorted(self.keys[a:b], limit, side="right")] for a, b, limit in zip(self.ends, self.ends[1:], drift)]
        return np.concatenate(popped) if popped else np.empty(0, np.int64)


def assign(x: np.ndarray, book: np.ndarray, drift: np.ndarray, code: np.ndarray | None, key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Entries and keys of a block's parts at one position, and how many of them were scanned. Without code: all."""
    if code is None:
        code, slack = scan(x, book)
        return code, slack + drift[code], len(x)
    again = Heaps(code, key, len(book)).pop(drift)
    code, key = code.copy(), key.copy()
    if len(again):
        code[again], slack = scan(x[again], book)
        key[again] = slack + drift[code[again]]
    return code, key, len(again)


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much the slack of each entry's parts may have shrunk: the entry's own way and the longest of all. Arrays: position, entry, component."""
    way = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=2))
    return (way + way.max(axis=1, keepdims=True, initial=0)) * (1 + SLACK)


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows of components as rows of parts."""
    return x.reshape(len(x), parts, x.shape[1] // parts)


class Codec:
    """Codebooks of a table of vectors, and the entries of all its parts."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
        self.scratch, self.parts = Scratch(vectors.sparkSession), parts
        own = {"id": F.col(id_col).cast("long"), "label": F.col(label_col).cast("long")}
        self.rows, dim = whole_numbers(vectors, self.scratch, "rows", vector_col, own, parts)
        self.width = dim // parts
        seeds = self.rows.orderBy(F.asc_nulls_last("id"), "v", "row").limit(entries).select("v").toArrow()  # entries rows
        self.books = cut(matrix(seeds["v"], dim), parts).transpose(1, 0, 2)
        self.drift = np.zeros(self.books.shape[:2])
        self.state = self.scratch.table(self.assigned(self.rows, True), "state_0")
        for k in range(rounds):
            self.refine()
            self.state = self.scratch.table(self.assigned(self.state, False), f"state_{k + 1}")
            self.scratch.drop(f"state_{k}")

    def assigned(self, rows: DataFrame, fresh: bool) -> DataFrame:
        """The rows with code (an entry for each part), key (its key) and scanned (parts of the row that were scanned in this round)."""
        books, drift, dim, parts = self.books, self.drift, self.width * self.parts, self.parts
        # rounding of a distance is relative to it; keys are compared with this to spare
        spare = SLACK * np.sqrt(np.abs(books).max(initial=1).astype(np.float64) ** 2 * dim)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                x, n = cut(matrix(batch.column(3), dim), parts), batch.num_rows
                code = None if fresh else np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(n, parts)
                key = None if fresh else np.frombuffer(b"".join(batch.column(5).to_pylist()), np.float64).reshape(n, parts)
                codes, keys = np.empty((n, parts), np.uint8), np.empty((n, parts))
                total = 0
                for p in range(parts):
                    own = (None, None) if fresh else (code[:, p].astype(np.int64), key[:, p])
                    codes[:, p], keys[:, p], again = assign(x[:, p], books[p], drift[p] + spare, *own)
                    total += again
                scanned = np.zeros(n, np.int64)
                scanned[0] = total
                packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (codes, keys)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *packed, pa.array(scanned)], names=["row", "id", "label", "v", "code", "key", "scanned"])

        names = ["row", "id", "label", "v"] + ([] if fresh else ["code", "key"])
        return rows.select(*names).mapInArrow(step, "row long, id long, label long, v binary, code binary, key binary, scanned long")

    def refine(self) -> None:
        """Entries become the means of their parts, rounded down; those without parts stay."""
        parts, width, entries = self.parts, self.width, self.books.shape[1]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
            for batch in filter(len, batches):
                x = cut(matrix(batch.column(0), parts * width), parts)
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    np.add.at(n[p], code[:, p], 1)
                    np.add.at(total[p], code[:, p], x[:, p])
            p, e = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (p, e, n[p, e])] + [pa.array(total[p, e, i]) for i in range(width)], names=["p", "e", "n", *(f"c{i}" for i in range(width))])

        sums = self.state.select("v", "code").mapInArrow(add, "p long, e long, n long, " + ", ".join(f"c{i} long" for i in range(width)))
        new = self.books.copy()
        for p, e, n, *c in sums.groupBy("p", "e").agg(*[F.sum(k) for k in ("n", *(f"c{i}" for i in range(width)))]).collect():  # parts x entries rows
            new[p, e] = np.array(c) // n
        self.drift = self.drift + moved(self.books, new)
        self.books = new

    def digest(self) -> str:
        """SHA-256 of all components, by position, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def coded(self) -> DataFrame:
        """vec_id, code (hex), error, label_error and codebooks_sha256 of every row."""
        books, parts = self.books, self.parts

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                x = cut(matrix(batch.column(2), parts * books.shape[2]), parts)
                packed = batch.column(3).to_pylist()
                code = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, parts)
                near = np.stack([books[p][code[:, p]] for p in range(parts)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.hex() for c in packed]), pa.array(((x - near) ** 2).sum(axis=(1, 2)))], names=["vec_id", "label", "code", "error"])

        made = self.state.select("id", "label", "v", "code").mapInArrow(measure, "vec_id long, label long, code string, error long")
        of = made.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
        met = made.join(of, F.col("label").eqNullSafe(F.col("of")))
        return met.select("vec_id", "code", "error", "label_error", F.lit(self.digest()).alias("codebooks_sha256"))


def op13_heap_lloyd_codes(spark, sf_dir):
    """Codes of all vectors: 16 parts, 64 entries, two rounds."""
    return Codec(read(spark, sf_dir, "embeddings")).coded()


def _sql(rounds: int = ROUNDS) -> str:
    """Parts of four components, as the given vectors have 64."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS (
  SELECT vec_id, label, p, any_value(x) AS x, arg_min(e, d * 64 + e) AS e, min(d) AS d
  FROM (SELECT r.*, e, (x[1]-c[1])**2 + (x[2]-c[2])**2 + (x[3]-c[3])**2 + (x[4]-c[4])**2 AS d FROM r JOIN b{k} USING (p)) GROUP BY vec_id, label, p
)""")
        if k < rounds:
            steps.append(f"""
b{k + 1} AS (
  SELECT b{k}.p, b{k}.e, coalesce(m.c, b{k}.c) AS c FROM b{k} LEFT JOIN (
    SELECT p, e, [{', '.join(f'floor(sum(x[{i}]) / count(*))' for i in range(1, 5))}] AS c FROM a{k} GROUP BY p, e) m USING (p, e)
)""")
    return f"""
WITH w AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), r AS (
  SELECT vec_id, label, p, v[4 * p + 1 : 4 * p + 4] AS x FROM w, range({PARTS}) t(p)
), b0 AS (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS c FROM r QUALIFY dense_rank() OVER (ORDER BY vec_id) <= {ENTRIES}
),{','.join(steps)}, h AS (
  SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds}, range(1, 5) t(i)
), o AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h"""


QUERIES = {"op13_heap_lloyd_codes": op13_heap_lloyd_codes}
SQL = {"op13_heap_lloyd_codes": _sql()}
