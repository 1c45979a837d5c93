"""Near copies by MinHash with sequential Bayesian verification.

Documents link where the sets of their distinct three-word shingles agree: 100 * intersection >= 85 * union.

1. Equal sets are one node. A node has HASHES minima of its shingles under as many hash functions; BANDS bands of ROWS minima each are the candidate search: two
   sets are candidates where a band agrees. At the threshold a pair shares no band with the probability (1 - 0.85^6)^48 = 1.4e-10. Of each minimum 8 bits are kept beside
   it for comparison; that chance agreements count as matches (1 in 256) can only keep a pair that should go.
2. Candidates are compared by their minima, BATCH by BATCH. With m of n equal and a uniform prior, the similarity is at least s with the posterior probability
   P(Binomial(n + 1, s) <= m); a pair whose probability falls below MISS is pruned. That loses a true link with a probability of about MISS a batch.
3. Survivors are compared on their full sets, exactly, the most similar first; a pair that what is already linked connects is not compared any more.

Which pairs are compared: in each band, the nodes of a value hang on two hubs, the least and the greatest, first; links are closed to components. Where the nodes of
a value are then still in several components, those outside the largest are compared with all that are not of their own, so no candidate pair is left out. A pair is
judged in the first band it shares. Nodes come in tiles (TILE nodes and TILE_BYTES of shingles, about), so a task holds two tiles, however many
documents share a value; what leaves a task are the nodes with survivors, once for each task, never the pairs. A group of near copies of which few
hang together costs comparisons of minima in proportion to the square of those that don't; no rows.

Words are lower-cased (A-Z) runs of non-blanks. A text of fewer words than WIDTH is one shingle; null, empty and blank texts have an empty set and link
with nothing. Repeated rows and equal texts are one node. A component's id is its least id; rows without id take part, have the component's id (null if no row of it
has one) and are not kept. Very long texts are taken whole. An empty table gives an empty table. Columns other than the two are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, WordHashes, chunks, mix, read
from glossa.llm.components import components

WIDTH, PERCENT = 3, 85
BANDS, ROWS, BATCH = 48, 6, 32
HASHES = BANDS * ROWS
#: The posterior probability of a link below which a pair is pruned.
MISS = 1e-9
#: Nodes of a tile and bytes of their shingles, about.
TILE, TILE_BYTES = 1024, 8 << 20
#: Rows of tiles that a task compares at a time, about.
BIN = 4096
#: Bytes of text that are signed at once, shingles that are hashed at once.
CHUNK, SLICE = 1 << 19, 256
#: Odd factors for the words of a shingle, and for the hash functions.
_DRAWN = np.random.default_rng(12)
FACTORS = _DRAWN.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TIMES = (_DRAWN.integers(0, 1 << 31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
PLUS = _DRAWN.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
SPREAD = np.uint32(0x2C1B3C6D)


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of every run of WIDTH words (of all, if fewer), sorted and distinct."""
    n = min(WIDTH, len(words))
    if not n:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out += words[k : k + len(out)] * FACTORS[k]
    return np.unique(mix(out))


def document(text_col: str) -> Column:
    """A hash of a row's text, by which a document of each node is found again."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    return [shingles(hashes.array(t.lower().split())) for t in texts]


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of a set under each hash function."""
    x, out = (own >> np.uint64(32)).astype(np.uint32)[:, None], np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), SLICE):
        h = x[at : at + SLICE] * TIMES
        h ^= h >> np.uint32(15)
        h *= SPREAD
        h += PLUS
        np.minimum(out, h.min(axis=0), out=out)
    return out


def band_key(low: np.ndarray, band: int) -> int:
    """A hash of a band's minima, with the band in its last six bits."""
    return ((xxhash.xxh3_64_intdigest(low[ROWS * band : ROWS * (band + 1)].tobytes()) & ~63) | band) - (1 << 63)


def least_matches(n: int, miss: float = MISS) -> int:
    """The fewest equal minima of n with which a link is still as probable as miss."""
    s, below = PERCENT / 100, 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


#: After how many minima a pair is judged, and how many must be equal then.
CUTS = [(n, least_matches(n)) for n in range(BATCH, HASHES + 1, BATCH)]


def agree(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def survivors(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[x], b[y]) of 8-bit minima no batch prunes, with the number of equal ones, as an array of (position, equal)."""
    left, equal = np.arange(len(x)), np.zeros(len(x), np.int32)
    done = 0
    for n, least in CUTS:
        equal += (a[x[left], done:n] == b[y[left], done:n]).sum(axis=1, dtype=np.int32)
        on = equal >= least
        left, equal, done = left[on], equal[on], n
    return np.stack([left, equal.astype(np.int64)], axis=1)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, document (a hash of the text), words (a hash of the text's set), n (its size), low (8-bit minima, packed) and bands (a hash of each band's minima) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), document(text_col).alias("document"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in chunks(batches, "text", CHUNK):
            sets = shingle_sets(texts, hashes)
            low = [minima(s) for s in sets]
            bands = [[] if not len(s) else [band_key(m, k) for k in range(BANDS)] for s, m in zip(sets, low)]
            columns = [pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), pa.array([m.astype(np.uint8).tobytes() for m in low], pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "document", "words", "n", "low", "bands"])

    return rows.mapInArrow(sign, f"doc_id {kind}, document string, words string, n long, low binary, bands array<long>")


def pairs_of(tile: dict[str, np.ndarray]) -> np.ndarray:
    """Of one pair of tiles the surviving pairs, as (position, position, equal minima)."""
    band, side, root, n, low = int(tile["band"][0]), tile["side"], tile["root"], tile["n"], tile["low"]
    right = np.flatnonzero(side != 0)
    found = [np.empty((0, 3), np.int64)]
    for i in np.flatnonzero(side != 1).tolist():
        y = right[(root[right] != root[i]) & (100 * np.minimum(n[right], n[i]) >= PERCENT * np.maximum(n[right], n[i]))]
        if side[i] == 2:
            y = y[y > i]
        if len(y):
            on = survivors(low, low, np.full(len(y), i), y)
            left = y[on[:, 0]]
            found.append(np.stack([np.full(len(left), i), left, on[:, 1]], axis=1))
    pairs = np.concatenate(found)
    if band > 0 and len(pairs):  # judged in the first band that a pair shares
        keys = tile["bands"][:, :band]
        pairs = pairs[~(keys[pairs[:, 0]] == keys[pairs[:, 1]]).any(axis=1)]
    return pairs


def compared(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """bin, node, root, n, partners: the nodes of pairs of tiles that take part in surviving pairs; the one of a pair that comes first lists the other and the equal minima.

    tiles: tile, band, side (0 and 1 are compared with each other, 2 among themselves), node, root. Small tiles share a bin.
    """
    rows, size = tiles.join(nodes.select("node", "n"), "node").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = max(1, -(-rows // BIN), -(-8 * size // (2 * TILE_BYTES)))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("tile").combine_chunks()
        columns = {c: np.asarray(group[c].combine_chunks()) for c in ("tile", "band", "side", "node", "root", "n")}
        columns["low"] = np.frombuffer(b"".join(group["low"].to_pylist()), np.uint8).reshape(-1, HASHES)
        columns["bands"] = np.asarray(group["bands"].combine_chunks().flatten()).reshape(-1, BANDS)
        cuts = np.flatnonzero(np.diff(columns["tile"], prepend=columns["tile"][:1] - 1)).tolist()
        found = [pairs_of({c: x[a:b] for c, x in columns.items()}) + np.array([a, a, 0]) for a, b in zip(cuts, [*cuts[1:], len(columns["tile"])])]
        pairs = np.concatenate(found)
        node, takes = columns["node"], np.unique(pairs[:, :2])
        ends = np.searchsorted(pairs[:, 0], np.stack([takes, takes + 1]))
        partners = [np.stack([node[pairs[a:b, 1]], pairs[a:b, 2]], axis=1).tobytes() for a, b in ends.T]
        of = pa.array([group["bin"][0].as_py()] * len(takes), pa.int64())
        return pa.table({"bin": of, "node": node[takes], "root": columns["root"][takes], "n": columns["n"][takes], "partners": pa.array(partners, pa.binary())})

    rows = tiles.withColumn("bin", F.pmod(F.xxhash64("tile"), F.lit(bins))).join(nodes.select("node", "n", "low", "bands"), "node")
    return rows.select("bin", "tile", "band", "side", "node", "root", "n", "low", "bands").groupBy("bin").applyInArrow(compare, "bin long, node long, root long, n long, partners binary")


def verified(met: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links among the surviving pairs of `compared`, enough to connect all that link. sets: node, own (the shingles, packed)."""

    def verify(group: pa.Table) -> pa.Table:
        node = group["node"].to_pylist()
        heads = {r: r for r in group["root"].to_pylist()}
        top = dict(zip(node, group["root"].to_pylist()))
        own = {v: np.frombuffer(s.as_py(), np.uint64) for v, s in zip(node, group["own"])}
        asked = set()
        for v, packed in zip(node, group["partners"]):
            if p := packed.as_py():
                asked |= {(-equal, v, w) for w, equal in np.frombuffer(p, np.int64).reshape(-1, 2).tolist()}

        def head(r: int) -> int:
            while heads[r] != r:
                heads[r] = heads[heads[r]]
                r = heads[r]
            return r

        links = []
        for _, v, w in sorted(asked):
            x, y = head(top[v]), head(top[w])
            if x != y and agree(own[v], own[w]):
                heads[x] = y
                links.append((v, w))
        return pa.table({"a": pa.array([max(p) for p in links], pa.int64()), "b": pa.array([min(p) for p in links], pa.int64())})

    return met.join(sets, "node").select("bin", "node", "root", "partners", "own").groupBy("bin").applyInArrow(verify, "a long, b long")


def packed_sets(docs: DataFrame, nodes: DataFrame, met: DataFrame, text_col: str) -> DataFrame:
    """node, own: the shingles of the nodes in met, from one document of each."""
    asked = nodes.select("node", "document").join(met.select("node").distinct(), "node", "left_semi")
    rows = docs.select(document(text_col).alias("document"), F.col(text_col).alias("text")).join(asked, "document").groupBy("node").agg(F.first("text").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in chunks(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(texts, hashes)], pa.binary())], names=["node", "own"])

    return rows.mapInArrow(pack, "node long, own binary")


def hub_tiles(members: DataFrame) -> DataFrame:
    """Nodes against the hubs of their values, each pair once: tile, band, side, node, root. members: key, node, n, root."""
    hubs = members.groupBy("key").agg(F.array(F.min("node"), F.max("node")).alias("hubs"))
    pairs = members.join(hubs, "key").select("node", "n", F.explode(F.array_distinct("hubs")).alias("hub")).filter("node <> hub").distinct()
    parts = pairs.groupBy(F.col("hub").alias("h")).agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") * 8 / TILE_BYTES)).alias("parts"))
    pairs = pairs.join(parts, F.col("hub") == F.col("h")).select("node", "hub", F.xxhash64("hub", F.pmod(F.xxhash64("node"), "parts")).alias("tile"))
    none = F.lit(-1)
    both = pairs.select("tile", none.alias("band"), F.lit(0).alias("side"), "node").union(pairs.select("tile", none, F.lit(1), F.col("hub")).distinct())
    return both.withColumn("root", F.col("node"))


def open_tiles(members: DataFrame) -> DataFrame:
    """Tiles of the values whose nodes are in several components: members outside the largest against all others. members: key, node, n, root."""
    size = members.groupBy("key", "root").agg(F.count("*").alias("size"), F.sum("n").alias("bytes"))
    most = F.max(F.struct("size", "root", "bytes"))
    of = size.groupBy("key").agg(most.alias("main"), F.sum("size").alias("all"), F.sum("bytes").alias("n_all"), F.count("*").alias("several")).filter("several > 1")
    count = lambda size, n: F.ceil(F.greatest(size / TILE, n * 8 / TILE_BYTES)).cast("long")
    of = of.select(F.col("key").alias("k"), F.col("main.root").alias("main"), count(F.col("main.size"), F.col("main.bytes")).alias("t_main"), count(F.col("all") - F.col("main.size"), F.col("n_all") - F.col("main.bytes")).alias("t_rest"))
    rows = members.join(of, F.col("key") == F.col("k"))
    h = F.xxhash64("node", F.lit("tile"))
    own = F.col("root") == F.col("main")
    rows = rows.withColumn("own", F.pmod(h, F.when(own, F.col("t_main")).otherwise(F.col("t_rest"))))
    steps = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # sides: of the main component 1; the rest 0 against it, 2 within a tile of their own, and 0 and 1 between two tiles of the rest
    mains = F.transform(steps("t_rest"), lambda r: F.struct(F.lit("m").alias("kind"), r.alias("x"), F.col("own").alias("y"), F.lit(1).alias("side")))
    against = F.transform(steps("t_main"), lambda m: F.struct(F.lit("m").alias("kind"), F.col("own").alias("x"), m.alias("y"), F.lit(0).alias("side")))
    within = F.transform(
        steps("t_rest"),
        lambda r: F.struct(F.lit("r").alias("kind"), F.least(r, "own").alias("x"), F.greatest(r, "own").alias("y"), F.when(r == F.col("own"), 2).when(r > F.col("own"), 0).otherwise(1).alias("side")),
    )
    spread = rows.select("key", "node", "root", F.explode(F.when(own, mains).otherwise(F.concat(against, within))).alias("t"))
    return spread.select(F.xxhash64("key", "t.kind", "t.x", "t.y").alias("tile"), F.col("key").bitwiseAND(F.lit(63)).cast("int").alias("band"), "t.side", "node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(signed(docs, id_col, text_col), "rows")
    nodes = rows.filter("n > 0").groupBy("words").agg(*[F.first(c).alias(c) for c in ("n", "low", "bands")], F.min("document").alias("document"), F.min("doc_id").alias("least"))
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").count().filter("count > 1").select("key")
    shared = scratch.table(members.join(shared, "key", "left_semi").select("key", "node"), "shared")
    links, roots = None, nodes.select(F.col("node").alias("v"), F.col("node").alias("root"))
    for k, tiles in enumerate((hub_tiles, open_tiles)):
        told = nodes.select(F.col("node").alias("v"), "n").join(roots, "v")
        tiled = scratch.table(tiles(shared.join(told, F.col("node") == F.col("v")).select("key", "node", "n", "root")), f"tiles_{k}")
        met = scratch.table(compared(tiled, nodes), f"met_{k}")
        sets = scratch.table(packed_sets(docs, nodes, met, text_col), f"sets_{k}")
        found = verified(met, sets)
        links = scratch.table(found.union(links) if k else found, f"links_{k}")
        hung = scratch.table(components(links, Scratch(docs.sparkSession)), f"hung_{k}")
        roots = nodes.select("node").join(hung.withColumnRenamed("node", "v"), F.col("node") == F.col("v"), "left").select(F.col("node").alias("v"), F.coalesce("root", "node").alias("root"))
        for done in ("tiles", "met", "sets"):
            scratch.drop(f"{done}_{k}")
    named = nodes.select("node", "words", "least").join(roots, F.col("node") == F.col("v")).select("words", "least", "root")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.select("doc_id", "n", "words").join(named.join(least, "root").select("words", "component_id"), "words", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op12_bayes_minhash(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op12_bayes_minhash": op12_bayes_minhash}
SQL = {
    "op12_bayes_minhash": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), t AS (
  SELECT doc_id, n, s FROM s JOIN n USING (doc_id) QUALIFY count(*) OVER (PARTITION BY s) > 1
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b USING (s)
  WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), c(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.doc_id WHERE c.root < l.b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id, min(root) = doc_id AS kept FROM c LEFT JOIN n USING (doc_id) GROUP BY doc_id, n"""
}
