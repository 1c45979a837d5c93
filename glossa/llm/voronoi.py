"""Hard-negative mining by a distributed kNN join over Voronoi cells.

Inner products become distances by one more coordinate: with M the greatest norm, a row x is (x, sqrt(M^2 - |x|^2)), an anchor a is (a, 0), and
|a - x|^2 = |a|^2 + M^2 - 2 <a, x>. All rows then have the norm M, and the higher the score the nearer the row.

1. PIVOTS rows, chosen by hash, are the pivots; each row goes to the cell of its nearest pivot. A cell's rows of one label, sorted by their distance r to
   the pivot, are cut into blocks of BLOCK rows at most, which know their least and greatest r.
2. What an anchor looks for is a window of scores [low, high], of its own label or of all others, and the first k rows in it. LANDMARKS rows (the
   pivots among them) are scored by every anchor: the k-th of them in the window raises low. So a search starts with a bound that holds.
3. Anchors of neighbouring cells form groups of PACK windows. By the triangle inequality a row at distance r of a pivot that is d from the anchor lies
   between |d - r| and d + r from it. That gives for each group and cell the interval of r that may serve any of its windows. Blocks are sent to the groups
   whose interval they meet, and to no others.
4. A group meets its blocks in parts of PART blocks, so no task holds more, however many rows share a cell, a label or a vector. Scores are exact whole
   numbers; the first k of each part, by score and then by id, are merged.

The first search finds an anchor's positives (own label, no bounds), the second the negatives of each positive, between half and 95 hundredths of
its score. Bounds of distances are widened by SLACK, more than rounding can amount to; what a score must be is compared exactly.

Rows without label or with an unusable vector take no part (see `vectors`), rows without id can be found but are no anchors and come last among ties. Repeated rows
count for themselves, each may be the other's positive, and tie by their row number. An anchor without positives, or a positive
below zero, has no negatives. An empty table gives an empty table. Columns other than the three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, read
from glossa.llm.vectors import matrix, products, whole_numbers

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: Pivots at most, rows for each of them at least, and rows that give the searches their first bounds.
PIVOTS, PER_PIVOT, LANDMARKS = 256, 2048, 1024
#: Rows of a block, windows of a group, blocks that meet a group in one task.
BLOCK, PACK, PART = 512, 512, 64
#: What bounds of distances are widened by, as a share of the greatest norm.
SLACK = 1e-5
LEAST, MOST = -(1 << 62), 1 << 62


class Space:
    """Pivots and landmarks, which every task has: at most LANDMARKS rows."""

    def __init__(self, rows: DataFrame, dim: int):
        found = rows.select("row", "label", "v", F.xxhash64("row", "v").alias("h")).orderBy("h", "row").limit(LANDMARKS).toArrow()
        self.dim = dim
        self.marks, self.labels, self.rows = matrix(found["v"], dim), np.asarray(found["label"]), np.asarray(found["row"])
        most = rows.select("v").mapInArrow(_norms(dim), "n double").agg(F.max("n"), F.count("*")).first()
        self.square, self.count = float(most[0] or 0), int(most[1] or 0)
        n = max(1, min(PIVOTS, len(self.marks), self.count // PER_PIVOT))
        self.pivots = self.chained(self.marks[:n].astype(np.float64))
        self.heights = self.height(self.pivots)
        self.slack = SLACK * np.sqrt(self.square)

    def height(self, x: np.ndarray) -> np.ndarray:
        """The coordinate that gives every row the same norm."""
        return np.sqrt(np.maximum(0, self.square - (x * x).sum(axis=1)))

    def chained(self, x: np.ndarray) -> np.ndarray:
        """Pivots in an order in which each is followed by the nearest one left, so that neighbours are numbered alike."""
        left, order = list(range(1, len(x))), [0] if len(x) else []
        while left:
            near = min(left, key=lambda k: float(((x[k] - x[order[-1]]) ** 2).sum()))
            left.remove(near)
            order.append(near)
        return x[order]

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """From rows or anchors to all pivots."""
        x = x.astype(np.float64)
        own = (x * x).sum(axis=1) if anchors else np.full(len(x), self.square)
        inner = x @ self.pivots.T + (0 if anchors else np.outer(self.height(x), self.heights))
        return np.sqrt(np.maximum(0, own[:, None] + self.square - 2 * inner))

    def reach(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a row has this score."""
        own = (x.astype(np.float64) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(0, own + self.square - 2.0 * score))


def _norms(dim: int):
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), dim).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array((x * x).sum(axis=1))], names=["n"])

    return norms


def cells(rows: DataFrame, space: Space, scratch: Scratch) -> DataFrame:
    """block, cell, label, low and high (distances to the pivot), and the block's rows, packed: row, id, known (whether there is an id), v."""
    dim = space.dim

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            d = space.distances(matrix(batch.column(3), dim), False)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["row", "id", "label", "v", "cell", "r"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            row, label, cell, r = (np.asarray(batch.column(k)) for k in (0, 2, 4, 5))
            known = np.asarray(batch.column(1).is_valid())
            ids, v = np.asarray(batch.column(1).fill_null(0)), matrix(batch.column(3), dim).astype(np.int32)
            cuts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (label[1:] != label[:-1])])).tolist()
            spans = [(a, min(a + BLOCK, e)) for b, e in zip(cuts, [*cuts[1:], len(row)]) for a in range(b, e, BLOCK)]
            out = [(int(cell[a]), int(label[a]), float(r[a:b].min()), float(r[a:b].max()), *(x[a:b].tobytes() for x in (row, ids, known, v))) for a, b in spans]
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x)) for x in out], schema=kind)

    kind = pa.schema([("cell", pa.int32()), ("label", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), *((n, pa.binary()) for n in ("rows", "ids", "known", "v"))])
    placed = rows.select("row", "id", "label", "v").mapInArrow(place, "row long, id long, label long, v binary, cell int, r double")
    order = ["cell", "label", "r", "row"]
    made = scratch.table(placed, "placed").repartitionByRange(*order).sortWithinPartitions(*order)
    made = made.mapInArrow(pack, "cell int, label long, low double, high double, rows binary, ids binary, known binary, v binary")
    return scratch.table(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _first(keys: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """The first k of each value of keys[0], by the other keys; as positions."""
    order = np.lexsort(keys[::-1])
    own = keys[0][order]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, int)
    return order[np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own)))) < k]


def search(windows: DataFrame, blocks: DataFrame, space: Space, k: int, same: bool, scratch: Scratch, name: str) -> DataFrame:
    """window, row, id, score: the first k rows of each window (window, anchor (its row), label, v, low, high), of its label or of all others."""
    dim = space.dim

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = matrix(batch.column(3), dim)
            label, low, high = (np.asarray(batch.column(c)).astype(np.int64) for c in (2, 4, 5))
            for a in range(0, len(x), PACK):
                s = slice(a, a + PACK)
                score = products(x[s], space.marks)
                fits = ((label[s, None] == space.labels) == same) & (np.asarray(batch.column(1))[s, None] != space.rows) & (score >= low[s, None]) & (score <= high[s, None])
                held = np.sort(np.where(fits, score, LEAST), axis=1)
                if held.shape[1] >= k:
                    low[s] = np.maximum(low[s], held[:, -k])
            cell = space.distances(x, True).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(low), pa.array(high), pa.array(cell)], names=["window", "anchor", "label", "v", "low", "high", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            columns = [np.asarray(batch.column(c)) for c in (0, 1, 2, 4, 5)]
            v = matrix(batch.column(3), dim).astype(np.int32)
            parts = [[c[a : a + PACK].tobytes() for c in columns] + [v[a : a + PACK].tobytes()] for a in range(0, len(v), PACK)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*parts)], names=packed)

    packed = ["windows", "anchors", "labels", "lows", "highs", "v"]
    made = windows.select("window", "anchor", "label", "v", "low", "high").mapInArrow(place, "window long, anchor long, label long, v binary, low long, high long, cell int")
    made = scratch.table(made, f"{name}_placed").repartitionByRange("cell", "anchor", "window").sortWithinPartitions("cell", "anchor", "window")
    packs = scratch.table(made.mapInArrow(pack, ", ".join(f"{c} binary" for c in packed)).withColumn("pack", F.monotonically_increasing_id()), f"{name}_packs")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label, low, high = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in (3, 4, 5))
                x = matrix(batch.column(6).slice(i, 1), dim)
                d = space.distances(x, True)
                far, near = space.reach(x, low)[:, None] + space.slack, space.reach(x, high)[:, None] - space.slack
                far = np.where(low[:, None] <= LEAST, np.inf, far)
                at, to = np.maximum(d - far, near - d), d + far
                for own in np.unique(label) if same else [0]:
                    of = label == own if same else np.ones(len(label), bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(d.shape[1], batch.column(0)[i].as_py())), pa.array(np.arange(d.shape[1], dtype=np.int32)), pa.array(np.full(d.shape[1], own)), pa.array(at[of].min(axis=0) - space.slack), pa.array(to[of].max(axis=0) + space.slack)],
                        names=["pack", "cell", "label", "at", "to"],
                    )

    served = packs.select("pack", *packed).mapInArrow(bounds, "pack long, cell int, label long, at double, to double")
    meets = (F.col("high") >= F.col("at")) & (F.col("low") <= F.col("to"))
    meta = blocks.select("block", "cell", "low", "high", F.col("label").alias("of"))
    pairs = served.join(meta.withColumnRenamed("cell", "c"), (F.col("cell") == F.col("c")) & meets & ((F.col("label") == F.col("of")) if same else F.lit(True))).select("pack", "block")
    pairs = scratch.table(pairs, f"{name}_pairs")
    parts = pairs.groupBy("pack").agg(F.ceil(F.count("*") / PART).alias("parts"))
    pairs = pairs.join(parts, "pack").select("pack", "block", F.pmod(F.xxhash64("block"), "parts").alias("part"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        window, anchor, label, low, high = (np.frombuffer(right[c][0].as_py(), np.int64) for c in packed[:5])
        x, low = matrix(right["v"], dim), low.copy()
        found = [np.empty(0, np.int64) for _ in range(5)]
        for i in range(left.num_rows):
            row, ids = (np.frombuffer(left[c][i].as_py(), np.int64) for c in ("rows", "ids"))
            none = (~np.frombuffer(left["known"][i].as_py(), np.bool_)).astype(np.int64)
            score = products(x, matrix(left["v"].slice(i, 1), dim))
            fits = (score >= low[:, None]) & (score <= high[:, None]) & ((label == left["label"][i].as_py()) == same)[:, None]
            w, c = np.nonzero(fits)
            apart = row[c] != anchor[w]
            w, c = w[apart], c[apart]
            if not len(w):
                continue
            found = [np.concatenate(p) for p in zip(found, (w, -score[w, c], none[c], ids[c], row[c]))]
            keep = _first(tuple(found), k)
            found = [f[keep] for f in found]
            full = np.bincount(found[0], minlength=len(low)) >= k
            worst = np.full(len(low), LEAST)
            np.maximum.at(worst, found[0], found[1])  # the greatest of the negated scores
            low = np.where(full, np.maximum(low, -worst), low)
        w, s, none, ids, row = found
        return pa.table({"window": window[w], "row": row, "id": pa.array(ids, mask=none.astype(bool)), "score": -s})

    sent = pairs.join(blocks.select("block", "label", "rows", "ids", "known", "v"), "block")
    asked = pairs.select(F.col("pack").alias("p"), F.col("part").alias("q")).distinct().join(packs.withColumnRenamed("pack", "p"), "p")
    met = sent.groupBy("pack", "part").cogroup(asked.groupBy("p", "q")).applyInArrow(meet, "window long, row long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    return scratch.table(met.withColumn("rank", rank).filter(F.col("rank") <= k), f"{name}_found")


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that are anchors (a condition on the columns). Labels are whole numbers."""
    scratch = Scratch(vectors.sparkSession)
    own = {"id": F.col(id_col).cast("long"), "label": F.col(label_col).cast("long"), "asks": F.coalesce(anchors, F.lit(False)) & F.col(id_col).isNotNull()}
    rows, dim = whole_numbers(vectors.filter(F.col(label_col).isNotNull()), scratch, "rows", vector_col, own)
    space = Space(rows, dim)
    blocks = cells(rows, space, scratch)
    asking = rows.filter("asks").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "label", "v")
    first = asking.select(F.col("anchor").alias("window"), "anchor", "label", "v", F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    found = search(first, blocks, space, positives, True, scratch, "positives")
    pairs = asking.join(found.select(F.col("window").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "anchor")
    pairs = scratch.table(pairs.withColumn("window", F.monotonically_increasing_id()), "asked")
    p = F.col("positive_score")
    # 50 p <= 100 n <= 95 p without products that could overflow; there is no such n where p < 0
    half, most = F.expr("positive_score - positive_score div 2"), p - F.expr("(positive_score + 19) div 20")
    second = pairs.filter("positive_score >= 0").select("window", "anchor", "label", "v", half.alias("low"), most.alias("high"))
    taken = search(second, blocks, space, negatives, False, scratch, "negatives")
    out = pairs.join(taken.select("window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "window")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_voronoi_hard_negatives(spark, sf_dir):
    """Hard negatives of every fiftieth vector; labels of every seventh are shifted by one."""
    rows = read(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.select("vec_id", "embedding", shifted.alias("label")), F.col("vec_id") % EVERY == 0)


QUERIES = {"op11_voronoi_hard_negatives": op11_voronoi_hard_negatives}
SQL = {
    "op11_voronoi_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE s.label <> p.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3""",
}
