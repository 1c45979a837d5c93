"""Resharding by minimum-cost flow: equal byte capacities, the fewest bytes moved.

Rows lie in old shards. Old shard sizes (supplies) and new capacities meet in a transport network whose edges cost one per
byte that changes its shard; successive shortest paths solve it. The network has one node for each shard, so it is solved on the driver.
Within an old shard rows are laid out in blocks, large rows first: (old shard, size class, hash), SUBS of a class at least, and as many as it
takes to hold BLOCK_ROWS rows each, about. A block's bytes are summed in Spark; the driver sees one row for each block. The flow cuts the line of
blocks into stretches, one for each receiving shard: whole blocks move, and the few blocks that a cut crosses are split
by row. The smallest rows are a second line, cut in the same proportions. Cuts miss by half a row each; what a shard has too much then goes on to
those that have too little, from its smallest rows, row by row, so that shard sizes come out equal to within a few small rows.

Nulls: a null text has size 1, a null id or old shard hashes like any other value; rows without an id are spread by their texts, many equal ones by their numbers. Rows with
equal keys are interchangeable and each gets its own slot. Very long texts are rows like others. An empty table gives an empty table. Other columns
are carried along whatever their names, as one struct until the end; those named like ADDED are replaced.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, copies_apart, restored, utf8_size, whole

#: Hash blocks of an old shard and size class at least, and rows in a block beyond that, about. A task sorts one block.
SUBS, BLOCK_ROWS = 64, 1 << 20
#: Rows of equal id, size and text that may share a block; more are numbered and spread.
COPIES = 1024
#: The share of an old shard's bytes that its smallest rows make up which go to all receivers.
RESERVE = 0.1
#: Blocks of one old shard and class at most: what the driver sees is bounded; blocks of more than 2^36 rows in one class get larger.
BLOCK_LIMIT = 1 << 16
#: Columns that a plan adds, or a caller may: those of the input by these names are replaced.
ADDED = {"size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard"}


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Bytes moved from each old to each new shard at the least total cost; successive shortest paths (Bellman-Ford)."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, left, cost; the reverse edge is the next one
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, left: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, left, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, supply[i], cost(i, j))
    for j, x in enumerate(capacity):
        edge(n + j, sink, x, 0)
    while True:
        far: list[float] = [float("inf")] * len(out)
        by = [-1] * len(out)
        far[source], queue = 0, [source]
        while queue:
            a = queue.pop(0)
            for e in out[a]:
                b, left, price = edges[e]
                if left > 0 and far[a] + price < far[b]:
                    far[b], by[b] = far[a] + price, e
                    queue.append(b)
        if by[sink] < 0:
            break
        push, b = None, sink
        while b != source:
            push = edges[by[b]][1] if push is None else min(push, edges[by[b]][1])
            b = edges[by[b] ^ 1][0]
        b = sink
        while b != source:
            edges[by[b]][1] -= push
            edges[by[b] ^ 1][1] += push
            b = edges[by[b] ^ 1][0]
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for e in out[i]:
            if n <= edges[e][0] < n + m:
                flow[i][edges[e][0] - n] = edges[e ^ 1][1]
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _literal(value, kind: str) -> F.Column:
    """A constant array or table, kept in the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class Reshard:
    """A plan for rows with an id, a text and an old shard (0 to old_shards - 1)."""

    BLOCK = ("_rs_old", "_rs_class", "_rs_sub")

    def __init__(self, rows: DataFrame, shards: int = 16, old_shard: F.Column | None = None, old_shards: int = 16, capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = True):
        """keep: carry all columns of rows, else only the id, size and text_crc32."""
        self.spark = rows.sparkSession
        self.scratch = Scratch(self.spark)
        self.shards, self.old_shards = shards, old_shards
        old = F.pmod(F.xxhash64(F.col("source")), F.lit(old_shards)) if old_shard is None else old_shard
        size = utf8_size(text_col) + 1
        carried = whole(rows) if keep else F.struct(F.col(id_col).alias("doc_id"))
        self.kept = rows.columns if keep else ["doc_id"]
        crc = F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
        rows = rows.select(
            carried.alias("_rs_in"), size.alias("size"), crc.alias("text_crc32"),
            F.coalesce(old.cast("int"), F.lit(0)).alias("_rs_old"), (F.lit(63) - F.floor(F.log2(size.cast("double"))).cast("int")).alias("_rs_class"),
            F.xxhash64(F.col(id_col), crc, size).alias("_rs_h"),
        )
        rows = copies_apart(rows if keep else self.scratch.table(rows, "rows"), "_rs_h", COPIES, self.scratch)
        classes = [{"o": r["_rs_old"], "c": r["_rs_class"], "n": min(BLOCK_LIMIT, max(SUBS, -(-r["count"] // BLOCK_ROWS)))} for r in rows.groupBy("_rs_old", "_rs_class").count().collect()]
        subs = F.coalesce(F.element_at(F.map_from_entries(F.transform(_literal(classes, "array<struct<o:int,c:int,n:int>>"), lambda x: F.struct(x.o * 64 + x.c, x.n))), F.col("_rs_old") * 64 + F.col("_rs_class")), F.lit(1))
        self.rows = rows.withColumn("_rs_sub", F.pmod(F.shiftrightunsigned("_rs_h", 7), subs).cast("int"))
        found = self.rows.groupBy(*self.BLOCK).agg(F.sum("size").alias("bytes")).collect()
        blocks = sorted((tuple(r)[:3], r["bytes"]) for r in found)
        supply = [0] * old_shards
        for (i, _, _), n in blocks:
            supply[i] += n
        # the smallest rows of each old shard, a RESERVE of its bytes at least, are a line of their own: every receiver gets some
        self.small, held = [64] * old_shards, [0] * old_shards
        for (i, c, _), n in reversed(blocks):
            if held[i] < RESERVE * supply[i] or c == self.small[i]:
                self.small[i], held[i] = c, held[i] + n
        self.lines, self.starts = [[0, 0] for _ in range(old_shards)], []
        for (i, c, s), n in blocks:
            line = int(c >= self.small[i])
            self.starts.append({"o": i, "c": c, "s": s, "line": line, "at": self.lines[i][line]})
            self.lines[i][line] += n
        self.capacities = equal_capacities(sum(supply), shards) if capacities is None else capacities
        if sum(self.capacities) < sum(supply):
            raise ValueError("the new capacities hold less than the rows")
        self.flow = min_cost_flow(supply, self.capacities, lambda i, j: int(i != j))

    @property
    def affected(self) -> list[int]:
        """Shards whose files change."""
        return sorted({k for i, row in enumerate(self.flow) for j, n in enumerate(row) if i != j and n for k in (i, j)})

    def assigned(self) -> DataFrame:
        """The rows with shard and slot."""
        kept = [c for c in self.kept if c.lower() not in ADDED]
        return self._assigned().select(*restored("_rs_in", kept), "size", "text_crc32", "shard", "slot", F.col("_rs_old").alias("old_shard"))

    def moved(self, to: str) -> DataFrame:
        """The rows, whole and unchanged but for the new shard under the name `to`."""
        return self._assigned().select(*restored("_rs_in", [c for c in self.kept if c != to]), F.col("shard").alias(to))

    def _assigned(self) -> DataFrame:
        """_rs_in, _rs_old, size, text_crc32, shard, slot."""
        cuts, targets = [], []
        for i, row in enumerate(self.flow):
            order = [j for j in [i, *(j for j in range(self.shards) if j != i)] if j < self.shards and row[j]] or [i % self.shards]
            ends = list(accumulate(row[j] for j in order))
            cuts += [[end * line // max(sum(row), 1) for end in ends[:-1]] for line in self.lines[i]]
            targets.append(order)
        starts = self.spark.range(1).select(F.explode(_literal(self.starts, "array<struct<o:int,c:int,s:int,line:int,at:bigint>>")).alias("b")).select("b.*")
        block = Window.partitionBy(*self.BLOCK).orderBy("_rs_h", "text_crc32", "size")
        before = F.sum("size").over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
        rows = self.rows.withColumn("_rs_at", before).join(F.broadcast(starts), (F.col("_rs_old") == F.col("o")) & (F.col("_rs_class") == F.col("c")) & (F.col("_rs_sub") == F.col("s")))
        middle = F.col("_rs_at") + F.col("at") + F.floor(F.col("size") / 2)
        which = F.size(F.filter(F.element_at(_literal(cuts, "array<array<bigint>>"), 2 * F.col("_rs_old") + F.col("line") + 1), lambda x: x <= middle))
        rows = rows.withColumn("_rs_to", F.element_at(F.element_at(_literal(targets, "array<array<int>>"), F.col("_rs_old") + 1), which + 1)).drop("o", "c", "s", "line", "at")
        rows = self._settled(rows)
        rank = F.row_number().over(Window.partitionBy(*self.BLOCK, "shard").orderBy("_rs_at", "_rs_h", "text_crc32", "size"))
        rows = self.scratch.table(rows.withColumn("_rs_rank", rank), "assigned")
        counted = sorted(tuple(r) for r in rows.groupBy("shard", *self.BLOCK).count().collect())
        offsets, at = [], [0] * self.shards
        for j, i, c, s, n in counted:
            offsets.append({"j": j, "o": i, "c": c, "s": s, "off": at[j]})
            at[j] += n
        return self._met(rows, offsets, "shard", "off").withColumn("slot", F.col("off") + F.col("_rs_rank") - 1)

    def _met(self, rows: DataFrame, table: list[dict], shard: str, *values: str) -> DataFrame:
        """rows with values of a table by shard (j) and block (o, c, s)."""
        kind = ",".join(["j:int", "o:int", "c:int", "s:int", *(f"{v}:bigint" for v in values)])
        told = self.spark.range(1).select(F.explode(_literal(table, f"array<struct<{kind}>>")).alias("b")).select("b.*")
        met = (F.col(shard) == F.col("j")) & (F.col("_rs_old") == F.col("o")) & (F.col("_rs_class") == F.col("c")) & (F.col("_rs_sub") == F.col("s"))
        return rows.join(F.broadcast(told), met, "left").drop("j", "o", "c", "s")

    def _settled(self, rows: DataFrame) -> DataFrame:
        """rows with shard: where they were to go (_rs_to), but what a shard has too much goes to those that have too little.

        A shard's part of a block is one stretch of the block, so a row's place in it is known from where the stretch begins.
        """
        found = rows.groupBy("_rs_to", *self.BLOCK).agg(F.sum("size").alias("bytes"), F.min("_rs_at").alias("first")).collect()
        spare = sum(self.capacities) - sum(r["bytes"] for r in found)
        total = [0] * self.shards
        for r in found:
            total[r["_rs_to"]] += r["bytes"]
        # where capacities leave room, nothing is moved on but what is above them
        over = [max(0, t - c) for t, c in zip(total, self.capacities)]
        moves, at = [], 0
        for r in sorted(found, key=lambda r: (r["_rs_to"], -r["_rs_class"], r["_rs_old"], r["_rs_sub"])):
            take = min(over[r["_rs_to"]], r["bytes"])
            if take > 0:
                moves.append({"j": r["_rs_to"], "o": r["_rs_old"], "c": r["_rs_class"], "s": r["_rs_sub"], "first": r["first"], "take": take, "pool": at})
                over[r["_rs_to"]] -= take
                at += take
        if not moves:
            return rows.withColumnRenamed("_rs_to", "shard")
        ends, into, upto = [], [], 0
        for j, (t, c) in enumerate(zip(total, self.capacities)):
            if t < c and (spare == 0 or upto < at):
                upto += c - t
                ends.append(upto)
                into.append(j)
        place = F.col("_rs_at") - F.col("first") + F.floor(F.col("size") / 2)
        where = F.least(F.size(F.filter(_literal(ends, "array<bigint>"), lambda x: x <= F.col("pool") + place)), F.lit(len(into) - 1))
        # a row that is larger than what is left of the excess stays
        on = F.coalesce(F.col("_rs_at") - F.col("first") + F.col("size") <= F.col("take"), F.lit(False))
        rows = self._met(rows, moves, "_rs_to", "first", "take", "pool")
        return rows.withColumn("shard", F.when(on, F.element_at(_literal(into, "array<int>"), where + 1)).otherwise(F.col("_rs_to"))).drop("_rs_to", "first", "take", "pool")


def rewrite_shards(spark, path: str, out: str, shards: int, old_shards: int, id_col: str = "doc_id", text_col: str = "text") -> dict[int, str]:
    """Reshard a dataset stored as path/shard=K: writes the affected shards below out and returns each shard's folder.

    Shards that the flow leaves alone keep their old files.
    """
    rows = spark.read.parquet(path)
    plan = Reshard(rows, shards, F.col("shard"), old_shards, id_col=id_col, text_col=text_col)
    affected = {*plan.affected, *range(old_shards, shards)}
    plan.moved("shard").filter(F.col("shard").isin(sorted(affected) or [-1])).repartition(len(affected) or 1, "shard").write.mode("overwrite").partitionBy("shard").parquet(out)
    return {j: f"{out if j in affected else path}/shard={j}" for j in range(shards)}


def op5_min_cost_resharding(spark, sf_dir):
    """All documents from 16 shards filled by source into 16 shards of near equal bytes."""
    plan = Reshard(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)
    return plan.assigned().select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


QUERIES = {"op5_min_cost_resharding": op5_min_cost_resharding}
SQL: dict[str, str] = {}
