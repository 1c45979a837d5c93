"""Near copies by SimHash at a Jaccard similarity of SIMILARITY of word shingles: many short fingerprints, ball hashing, exact verification.

At a similarity of 0.8 two 64-bit SimHashes of five-word shingles differ in ten bits on the average, and balls of half that radius can't be
written out. So a text has BLOCKS independent fingerprints of 32 bits, which differ in 15 % of their bits then, and two texts are
candidates if any of them differs in at most 2 bits and all together in at most MAX_DISTANCE. By calculation that holds for a pair with the
probability 0.91 at a similarity of 0.8 and 0.995 at 0.85; copies are also found by way of each other. The tests measure it.

The search is meet-in-the-middle, as for one fingerprint: two values lie within 2 bits exactly if some value lies within one bit of both.

1. Texts of the same words are one node. Nodes that share a value of a block are a cell; only distinct cells go on, whatever a third of all
   rows may share.
2. Every cell emits the 33 values within one bit, and cells that share a value meet. At most 33 cells can share one, so a meeting is
   never large.
3. Four nodes of a cell (the least, the greatest, and the same by a hash) stand for it and meet its other nodes; the least also meets that of
   the least cell around. Pairs whose sizes or whole sketches can't agree go; the text of each node is compared with that of its least
   partner, then with that of its nearest partner in every other component, and links are closed to components each time.
4. Around values where several components still meet, all members of different components are compared, so no candidate pair is left out:
   members are dealt into tiles, and a task compares two tiles (or one in itself), each pair at one value of the first block that it shares.
   What leaves a task are nodes that have a partner, then links, never pairs. It takes as many comparisons as there are such pairs, but a
   group that hangs together is not one of them.

Words are lower-cased (A-Z) runs of non-blanks. A text of fewer words than WIDTH is one shingle, a null text is empty, and empty texts
are the same. Rows with null ids take part, ties go to the least id, then to the least hash of id and text. Repeated rows count once. Very
long texts are split into segments when counting bits. An empty table gives an empty table. All columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, WordHashes, chunks, first_rows, keep_rows, mix, row_key, text_bytes
from glossa.llm.components import components

WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints of 32 bits, and the 64-bit words that hold them.
BLOCKS = 24
LANES = BLOCKS // 2
#: Differing bits of a whole sketch that a candidate may have. At SIMILARITY there are 116 on the average, with a standard deviation of 10,
#: so one such pair in 200 has more, few beside those that share no value; higher bounds let in most pairs at 0.7.
MAX_DISTANCE = 142
#: Odd factors for the words of a shingle. Fixed values.
FACTORS = np.random.default_rng(20).integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What is added to a shingle's hash for each word of the sketch. Fixed values.
LANE = np.array([(0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(LANES)], np.uint64)
#: Bytes of text that are signed at once, and shingles that are counted at once.
CHUNK, SEGMENT = 1 << 19, 255
#: Cells that emit their balls at once, and values in a bucket, about.
CELLS, BUCKET = 8192, 1 << 19
FLIPS = np.array([0] + [1 << i for i in range(32)], np.uint32)
#: Nodes of a tile and bytes of their shingles, rows of tiles in a task's group, and pairs that are compared at once, about.
TILE, TILE_BYTES, BIN, PAIRS = 4096, 8 << 20, 4096, 1 << 16
#: Marks a cell of several components, whose members are compared among themselves, among the values.
WITHIN = 1 << 62
#: A bijection of 32 bits and its inverse, to spread values over buckets.
SPREAD = 0x9E3779B1
GATHER = pow(SPREAD, -1, 1 << 32)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash of every run of width words (of all, if fewer), sorted and distinct."""
    n = min(width, len(words))
    if not n:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out += words[k : k + len(out)] * FACTORS[k]
    return np.unique(mix(out))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """LANES words of 64 SimHash bits for each set of shingles: a bit is 1 if it is set in over half the hashes."""
    out = np.zeros((len(sets), 8 * LANES), np.uint8)
    lanes, at = mix(np.concatenate([*sets, np.empty(0, np.uint64)])[:, None] + LANE), 0
    for k, n in enumerate(map(len, sets)):
        ones = np.zeros(64 * LANES, np.int32)
        for p in range(at, at + n, SEGMENT):  # counted in 8 bits first
            bits = np.unpackbits(lanes[p : min(p + SEGMENT, at + n)].view(np.uint8), axis=1, bitorder="little")
            ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
        out[k] = np.packbits(2 * ones > n, bitorder="little")
        at += n
    return out.view(np.uint64)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_sh_id, _sh_row (see row_key), words (a 128-bit hash), n (distinct shingles) and s (the sketch) of every row."""
    rows = docs.select(F.col(id_col).alias("_sh_id"), row_key(id_col, text_col).alias("_sh_row"), F.col(text_col).alias("text"))
    kind = rows.schema["_sh_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in chunks(batches, "text", CHUNK):
            split = [t.lower().split() for t in texts]
            words = pa.array([xxhash.xxh3_128_hexdigest(b" ".join(w)) for w in split], pa.string())
            sets = [shingles(hashes.array(w)) for w in split]
            n = pa.array([len(s) for s in sets], pa.int32())
            lanes = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in sketches(sets).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, n, *lanes], names=["_sh_id", "_sh_row", "words", "n", *SKETCH])

    return rows.mapInArrow(sign, f"_sh_id {kind}, _sh_row string, words string, n int, {', '.join(f'{s} long' for s in SKETCH)}")


SKETCH = [f"s{k}" for k in range(LANES)]


def cell_keys() -> Column:
    """The cells of a node: block << 32 | the block's 32 bits."""
    key = lambda k: F.shiftrightunsigned(SKETCH[k // 2], 32 * (k % 2)).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(k << 32))
    return F.array(*map(key, range(BLOCKS)))


def meetings(cells: DataFrame, count: int) -> DataFrame:
    """value, cell, least: the cells around every value that several share (33 at most), and the least of them. count: how many cells there are.

    Two cells of a block stand together at some value exactly if they are within 2 bits of each other.
    """
    bits = max(0, math.ceil(math.log2(max(1, count / BLOCKS * len(FLIPS) / BUCKET))))
    schema = pa.schema([("bucket", pa.int64()), ("pack", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip = np.arange(len(FLIPS), dtype=np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, CELLS):
                cell = np.asarray(batch.slice(at, CELLS).column(0)).view(np.uint64)
                u = ((cell.astype(np.uint32)[:, None] ^ FLIPS) * np.uint32(SPREAD)).ravel()
                # block, then the spread value: sorted so, a bucket's values stand together
                key = (np.repeat(cell >> np.uint64(32), len(FLIPS)) << np.uint64(32)) | u
                order = np.argsort(key)
                key, which = key[order], np.tile(flip, len(cell))[order]
                where = key >> np.uint64(32 - bits)
                cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])).tolist()
                packs = [_pack(key[a:b].astype(np.uint32), which[a:b]) for a, b in zip(cuts, [*cuts[1:], len(key)])]
                yield pa.RecordBatch.from_arrays([pa.array(where[cuts].view(np.int64)), pa.array(packs, pa.binary())], schema=schema)

    def meet(group: pa.Table) -> pa.Table:
        block = np.uint64(group["bucket"][0].as_py() >> bits) << np.uint64(32)
        packs = [_unpack(p) for p in group["pack"].to_pylist()]
        u, which = (np.concatenate(x) for x in zip(*packs))
        value = u * np.uint32(GATHER)
        cell = value ^ FLIPS[which]
        order = np.lexsort((cell, value))
        value, cell = value[order], cell[order]
        fresh = np.concatenate([[True], value[1:] != value[:-1]])
        shared = ~(fresh & np.concatenate([fresh[1:], [True]]))
        least = cell[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        columns = [(x[shared].astype(np.uint64) | block).view(np.int64) for x in (value, cell, least)]
        return pa.table(dict(zip(("value", "cell", "least"), columns)))

    made = cells.select("cell").repartitionByRange("cell").sortWithinPartitions("cell").mapInArrow(emit, "bucket long, pack binary")
    return made.groupBy("bucket").applyInArrow(meet, "value long, cell long, least long")


def _pack(u: np.ndarray, which: np.ndarray) -> bytes:
    """Sorted values as differences, byte by byte, so that what is small compresses, and which bit was flipped."""
    steps = np.diff(u, prepend=np.uint32(0))
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes() + which.tobytes()


def _unpack(pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(pack, np.uint8)
    n = len(data) // 5
    steps = np.ascontiguousarray(data[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32), data[4 * n :]


def agree(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) have a Jaccard similarity of SIMILARITY at least."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) agree."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        own = lambda t: shingles(hashes.array(t.lower().split()))
        for batch, ta in chunks(batches, "ta"):
            tb = text_bytes(batch.column(batch.schema.get_field_index("tb")))
            ok = pa.array([agree(own(x), own(y)) for x, y in zip(ta, tb)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    one = pairs.select("a", "b").join(_by_node(texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))), "a")
    both = one.join(_by_node(texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(judge, "a long, b long")


def _by_node(df: DataFrame) -> DataFrame:
    """A side of a join by node, to be sorted, never broadcast: each broadcast is built in the driver, and a small input would have dozens of them."""
    return df.hint("merge")


def _side(nodes: DataFrame, own: str, *more: str) -> DataFrame:
    """Columns of nodes under names that begin with own."""
    return nodes.select(*[F.col(c).alias(f"{own}_{c}") for c in ("node", "n", *SKETCH, *more)])


def _differing() -> Column:
    """Differing bits of the sketches of sides x and y."""
    return sum((F.bit_count(F.col(f"x_{s}").bitwiseXOR(F.col(f"y_{s}"))) for s in SKETCH), F.lit(0))


def _may_agree() -> Column:
    """Whether sizes and sketches of sides x and y leave a similarity of SIMILARITY possible."""
    return (F.least("x_n", "y_n") >= SIMILARITY * F.greatest("x_n", "y_n") - 1e-9) & (_differing() <= MAX_DISTANCE)


def _inside(members: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node (node, cell) with the hubs of its cells. The join makes one row a member, from which its pairs go, four at most."""
    several = cells.filter("size > 1").select("cell", F.array_distinct("hubs").alias("hubs"))
    return members.join(several, "cell").select("node", F.explode("hubs").alias("hub")).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))


def _open(met: DataFrame, held: DataFrame) -> DataFrame:
    """value, cell, root, size, n, node, main, t_main, t_rest: the components around values where several are left, and into how many tiles the
    members of the largest (main) and of all others go; main is null where one tile holds all. held: cell, root, size, n, low, high, node.

    A value marked WITHIN has the components of one cell. Others have the cells that meet another there and at no lesser value: two cells around a
    value differ from it in a bit (or none) each, and the greater of the two bits is unset in the lesser of the values where they meet.
    """
    names = ["value", "cell", "root", "size", "n", "low", "high", "node"]
    several = held.groupBy("cell").agg(F.count("*").alias("several")).filter("several > 1").select("cell")
    within = held.join(several, "cell", "left_semi").withColumn("value", F.col("cell").bitwiseOR(F.lit(WITHIN)))
    by, own = Window.partitionBy("value"), Window.partitionBy("value", "root")
    lesser = met.select("value", "cell", F.col("value").bitwiseXOR(F.col("cell")).alias("bit"))
    most = F.max(F.when(F.col("bit").bitwiseAND(F.col("value")) == 0, F.col("bit"))).over(by)
    lesser = lesser.select("value", "cell", "bit", most.alias("most"), F.min("bit").over(by).alias("least")).filter("bit <= most AND least < most")
    rows = lesser.select("value", "cell").join(held, "cell").select(*names).union(within.select(*names))
    rows = rows.withColumn("of", F.struct(F.sum("size").over(own).alias("size"), F.col("root"), F.sum("n").over(own).alias("n")))
    told = {"l": F.min("root"), "h": F.max("root"), "rows": F.count("*"), "all": F.sum("size"), "n_all": F.sum("n"), "most": F.max("of"), "low": F.max("low"), "high": F.min("high")}
    rows = rows.select("value", "cell", "root", "size", "n", "node", *[x.over(by).alias(c) for c, x in told.items()])
    rows = rows.filter((F.col("l") < F.col("h")) & ((F.col("rows") > 2) | (F.col("high") >= SIMILARITY * F.col("low") - 1e-9)))
    tiles = lambda size, n: F.ceil(F.greatest(size / TILE, n * 8 / TILE_BYTES)).cast("long")
    one = tiles(F.col("all"), F.col("n_all")) <= 1
    main, t_main = F.when(~one, F.col("most.root")), F.when(~one, tiles(F.col("most.size"), F.col("most.n")))
    t_rest = F.when(one, 1).otherwise(tiles(F.col("all") - F.col("most.size"), F.col("n_all") - F.col("most.n")))
    return rows.select("value", "cell", "root", "size", "n", "node", main.alias("main"), t_main.alias("t_main"), t_rest.cast("long").alias("t_rest"))


def _tiles(rows: DataFrame) -> DataFrame:
    """tile, value, side, node, root, n: sides 0 and 1 of a tile are compared with each other, 2 in itself. rows: value, node, root, n, main, t_main, t_rest."""
    h = F.xxhash64("node", F.lit("tile"))
    own = F.col("root") == F.col("main")
    rows = rows.withColumn("own", F.pmod(h, F.when(own, F.col("t_main")).otherwise(F.col("t_rest"))))
    tile = lambda kind, x, y: F.xxhash64("value", F.lit(kind), x, y)
    lone = rows.filter("main IS NULL").select(tile("r", "own", "own").alias("tile"), "value", F.lit(2).alias("side"), "node", "root", "n")
    steps = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    put = lambda kind, x, y, side: F.struct(tile(kind, x, y).alias("tile"), side.alias("side"))
    mains = F.transform(steps("t_rest"), lambda r: put("m", r, F.col("own"), F.lit(1)))
    against = F.transform(steps("t_main"), lambda m: put("m", F.col("own"), m, F.lit(0)))
    among = F.transform(steps("t_rest"), lambda r: put("r", F.least(r, "own"), F.greatest(r, "own"), F.when(r == F.col("own"), 2).when(r > F.col("own"), 0).otherwise(1)))
    dealt = rows.filter("main IS NOT NULL").withColumn("t", F.explode(F.when(own, mains).otherwise(F.concat(against, among))))
    return lone.union(dealt.select("t.tile", "value", "t.side", "node", "root", "n"))


def _pairs(at: dict[str, np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of candidates of different components, PAIRS compared at a time. at: tile, value, side, cell, root, n and s (BLOCKS values a row), sorted by the first four."""
    value, side, cell, s = at["value"], at["side"], at["cell"], at["s"]
    block, within = (value >> 32) & 63, value >= WITHIN
    place, rows = np.arange(len(value)), len(value)

    def ends(*columns: np.ndarray) -> np.ndarray:
        """Where the rows that agree with each in these columns end."""
        fresh = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        return np.append(fresh, rows)[np.searchsorted(fresh, place, side="right")]

    tile = at["tile"], value
    end = ends(*tile)
    of_side, of_cell = ends(*tile, side), ends(*tile, side, cell)
    first = np.select([side == 0, side == 1], [of_side, end], np.where(within, place + 1, of_cell))
    before = np.concatenate([[0], np.cumsum(end - first)])
    a = 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(before, before[a] + PAIRS, side="right")) - 1)
        i = np.repeat(place[a:b], (end - first)[a:b])
        j = np.arange(before[a], before[b]) - before[i] + first[i]
        on = (at["root"][i] != at["root"][j]) & (np.minimum(at["n"][i], at["n"][j]) >= SIMILARITY * np.maximum(at["n"][i], at["n"][j]) - 1e-9)
        # two cells meet at two values; the lesser counts
        v = value[i] & 0xFFFFFFFF
        on &= within[i] | ((cell[i] != cell[j]) & (v < cell[i] ^ cell[j] ^ v))
        i, j = i[on], j[on]
        far = np.bitwise_count(s[i] ^ s[j])
        on = (far.sum(axis=1, dtype=np.int64) <= most) & (np.argmax(far <= 2, axis=1) == block[i])
        if on.any():
            yield i[on], j[on]
        a = b


def _binned(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """tiles with their bin (small tiles share one) and with the sketches of their nodes."""
    rows, n = tiles.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = max(1, -(-rows // BIN), -(-8 * n // (2 * TILE_BYTES)))
    return tiles.withColumn("bin", F.pmod(F.xxhash64("tile"), F.lit(bins))).join(_by_node(nodes.select("node", *SKETCH)), "node")


def _laid(group: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray]]:
    """The rows of a bin as `_pairs` wants them."""
    at = {c: np.asarray(group[c].combine_chunks()) for c in ("tile", "value", "side", "root", "n")}
    at["s"] = np.stack([np.asarray(group[c].combine_chunks()) for c in SKETCH], axis=1).view(np.uint32)
    at["cell"] = at["s"][np.arange(len(at["s"])), (at["value"] >> 32) & 63].astype(np.int64)
    order = np.lexsort([at[c] for c in ("cell", "side", "value", "tile")])
    return group.take(pa.array(order)), {c: x[order] for c, x in at.items()}


def compared(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of tiles whose sketches make them candidates of another's."""
    most, kept = MAX_DISTANCE, tiles.columns

    def compare(group: pa.Table) -> pa.Table:
        group, at = _laid(group)
        taken = np.zeros(len(group), bool)
        for i, j in _pairs(at, most):
            taken[i] = taken[j] = True
        return group.select(kept).filter(pa.array(taken))

    return _binned(tiles, nodes).groupBy("bin").applyInArrow(compare, tiles.schema)


def linked(tiles: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links among the candidates of tiles, enough to connect all that link. texts: node, text."""
    most = MAX_DISTANCE

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, found in chunks(batches, "text", CHUNK):
            sets = [shingles(hashes.array(t.lower().split())).tobytes() for t in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "own"])

    def link(group: pa.Table) -> pa.Table:
        group, at = _laid(group)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["own"]]
        sizes, node = np.array([len(x) for x in sets]), np.asarray(group["node"].combine_chunks())
        names, top = np.unique(at["root"], return_inverse=True)
        heads, links = list(range(len(names))), []

        def head(r: int) -> int:
            while heads[r] != r:
                heads[r] = heads[heads[r]]
                r = heads[r]
            return r

        for i, j in _pairs(at, most):
            cuts = np.flatnonzero(np.diff(i, prepend=-1)).tolist()
            for x, y in zip(cuts, [*cuts[1:], len(i)]):
                k = int(i[x])
                mine = head(int(top[k]))
                others = np.array([o for o in j[x:y].tolist() if head(int(top[o])) != mine], np.int64)
                for o in others[_agree(sets[k], [sets[o] for o in others], sizes[others])].tolist():
                    mine, other = head(int(top[k])), head(int(top[o]))
                    if mine != other:
                        heads[other] = mine
                        links.append((int(node[k]), int(node[o])))
        return pa.table({"a": pa.array([max(p) for p in links], pa.int64()), "b": pa.array([min(p) for p in links], pa.int64())})

    rows = _binned(tiles, nodes).join(_by_node(texts.mapInArrow(own, "node long, own binary")), "node")
    return rows.groupBy("bin").applyInArrow(link, "a long, b long")


def _agree(one: np.ndarray, others: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Of which of others one set is as similar as SIMILARITY asks."""
    if not len(others):
        return np.empty(0, bool)
    all_ = np.concatenate(others)
    at = np.searchsorted(one, all_)
    same = np.zeros(len(all_) + 1, np.int64)
    if len(one):
        same[1:] = np.cumsum(one[np.minimum(at, len(one) - 1)] == all_)
    to = np.cumsum(sizes)
    both = same[to] - same[to - sizes]
    return both >= SIMILARITY * (len(one) + sizes - both) - 1e-9


def _roots(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    found = components(links, scratch)
    return nodes.select("node", "n").join(_by_node(found), "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))


def rooted(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """root, _sh_id, _sh_row: the component of every row."""
    again = Scratch(docs.sparkSession)
    rows = scratch.table(signed(docs, id_col, text_col), "rows")
    nodes = rows.groupBy("words").agg(*[F.first(c).alias(c) for c in ("n", *SKETCH)], F.min("_sh_row").alias("_sh_row"))
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", F.explode(cell_keys()).alias("cell"))
    h = F.xxhash64("node")
    hubs = F.array(F.min("node"), F.max("node"), F.min_by("node", h), F.max_by("node", h))
    cells = scratch.table(members.groupBy("cell").agg(F.min("node").alias("least"), hubs.alias("hubs"), F.count("*").alias("size")), "cells")
    met = scratch.table(meetings(cells, cells.count()), "met")

    inside = _inside(members, cells)
    star = met.filter("cell <> least").groupBy("cell").agg(F.min("least").alias("to"))
    own = cells.select("cell", F.col("least").alias("x"))
    across = star.join(_by_node(own), "cell").join(_by_node(own.select(F.col("cell").alias("to"), F.col("x").alias("y"))), "to")
    pairs = inside.union(across.select(F.greatest("x", "y"), F.least("x", "y"))).filter("a <> b").distinct()
    of_a, of_b = (_by_node(_side(nodes, k)) for k in "xy")
    near = pairs.join(of_a, F.col("a") == F.col("x_node")).join(of_b, F.col("b") == F.col("y_node")).filter(_may_agree())
    near = scratch.table(near.select("a", "b", _differing().alias("far")), "near")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    links, roots = None, nodes.select("node", F.col("node").alias("root"))
    for k, by in enumerate((["a"], ["a", "rb"])):
        # the least partner of each node, then the nearest in each of the other components
        ra, rb = (_by_node(roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))) for k in "ab")
        apart = near.join(ra, "a").join(rb, "b").filter("ra <> rb")
        best = F.min("b") if k == 0 else F.min_by("b", F.struct("far", "b"))
        first = scratch.table(apart.groupBy(*by).agg(best.alias("b")).select("a", "b"), f"first_{k}")
        found = verified(first, _texts(docs, nodes, ends(first), scratch, id_col, text_col, f"texts_{k}"))
        links = scratch.table(found if links is None else found.union(links), f"links_{k}")
        roots = scratch.table(_roots(nodes, links, Scratch(docs.sparkSession)), f"roots_{k}")

    # members of cells that met and are still apart, component by component: only values around which there are several are opened
    placed = members.join(_by_node(roots), "node")
    held = placed.groupBy("cell", "root").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("node").alias("node"))
    held = scratch.table(held, "held")
    open_ = scratch.table(_open(met, held), "open")
    more = open_.filter("size > 1").drop("node", "n").join(placed.select("node", "cell", "root", F.col("n").cast("long").alias("n")), ["cell", "root"])
    tiles = scratch.table(_tiles(open_.filter("size = 1").unionByName(more)), "tiles")
    found = scratch.table(compared(tiles, nodes), "compared")
    texts = _texts(docs, nodes, found.select("node"), scratch, id_col, text_col, "texts")
    links = again.table(linked(found, nodes, texts).union(links), "links")
    for done in ("cells", "met", "near", "held", "open", "tiles", "compared", "texts", *(f"{t}_{k}" for t in ("first", "texts", "links", "roots") for k in (0, 1))):
        scratch.drop(done)
    return rows.select("_sh_id", "_sh_row", "words").join(nodes.select("words", "node"), "words").join(_roots(nodes, links, again), "node").select("root", "_sh_id", "_sh_row")


def _texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame, scratch: Scratch, id_col: str, text_col: str, name: str) -> DataFrame:
    """node, text of the nodes asked for."""
    wanted = nodes.select("node", "_sh_row").join(_by_node(asked.distinct()), "node", "left_semi")
    rows = docs.select(row_key(id_col, text_col).alias("_sh_row"), F.col(text_col).alias("text"))
    return scratch.table(rows.join(wanted, "_sh_row").dropDuplicates(["node"]).select("node", "text"), name)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: the one with its least id (of rows that share that id, or of null ids only, any one)."""
    scratch = Scratch(docs.sparkSession)
    found = rooted(docs, scratch, id_col, text_col)
    return keep_rows(docs, scratch.table(first_rows(found), "kept"), id_col, text_col)
