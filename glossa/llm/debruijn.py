"""Substring dedup on a De Bruijn graph of word windows.

A window of WINDOW words is an edge from its first WINDOW - 1 words to its last. An edge that occurs again is repeated; its source
is its first occurrence (least document id, then start). The graph of the repeated edges is built, compacted and used to verify what is removed:

1. pack: chunks of documents to a shared table, laid out by chunk, so that later passes move no text; with each the chunk's least k-mers.
   Every window holds its least SEED-word k-mer, and equal windows hold the same, so windows whose least k-mer is found at one place only
   are not repeated (most are not);
2. sift: in each bucket, k-mers of several chunks are sent back to their chunks;
3. edges: a chunk names its candidate windows by 96 hash bits. Of equal windows in a chunk only the first is shipped, so a passage in every
   document costs one row a chunk;
4. sources: in each bucket windows with equal names get their source; occurrences after it, and the source itself, go back to their chunks;
5. nodes: runs of neighbouring sources list the nodes they pass. Spark counts each node's incoming and outgoing edges; runs are cut
   into pieces at nodes that branch, and joins that double their reach string pieces to whole nonbranching paths;
6. spans: stretches of later occurrences are cut along the pieces, so that a passage is one and the same span wherever it is quoted;
7. verify: the words of every span are compared with the words at its source coordinates, by a 128-bit digest of the words themselves.
   A span that differs is taken apart into its windows, which are compared one by one;
8. remove: the words that verified spans cover go.

A word is thus removed only if its window was found equal at its source. Windows that have the same 96 bits by accident can only cost a
removal: the chance of any is n^2 / 2^97 for n windows, 10^-8 for 10^10.

Words are runs of non-blanks, unchanged; a null text has none. Null ids count as the greatest id. Where ids are null or repeated, rows of one id are
documents of their own, in the order of a hash of their texts; of equal rows any one is the first, the others repeat it. Texts shorter than a window
lose nothing. Very long texts are one chunk each. Ids that are no numbers count as null. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import LARGE_ROWS, Scratch, WordHashes, chunks, mix, parts, release, utf8_size

WINDOW, SEED = 20, 8
SEEDS_IN = WINDOW - SEED + 1
CHUNK_BYTES = 3 << 20
#: Bytes of text for each bucket of k-mers and of windows.
BUCKET_BYTES = 12 << 20
#: Bytes of text for each file of the table of texts.
LAID_BYTES = 64 << 20
P1, P2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def pack_rows(keys: list[int], ids: list, texts: list[bytes]) -> bytes:
    """Documents as one compressed value, by key."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    columns = np.array([[keys[i], ids[i] or 0, len(texts[i])] for i in order], np.int64).reshape(-1, 3).T
    null = np.array([ids[i] is None for i in order], np.uint8)
    head = struct.pack("<q", len(order)) + columns.tobytes() + null.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(texts[i] for i in order))


def unpack_rows(pack: bytes) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Keys, ids and texts."""
    data = zstandard.ZstdDecompressor().decompress(pack)
    n = struct.unpack_from("<q", data)[0]
    keys, ids, sizes = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n)
    null = np.frombuffer(data, np.uint8, n, 8 + 24 * n).astype(bool)
    at, out = 8 + 25 * n, []
    for size in sizes.tolist():
        out.append(data[at : at + size])
        at += size
    return keys, pa.array(ids, mask=null), out


def keyed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with key, a number of every row's own that follows the ids, null last.

    Ids that tell all rows apart are the keys. Else rows are sorted by id, then by text, then as they come; so rows of one id, or of none, are documents of
    their own, and equal ones are interchangeable.
    """
    if rows.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    order = ["none", "doc_id", "h", "came"]
    told = rows.select("doc_id", "text", F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("came"))
    ranged = told.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")


def _longer(a: np.ndarray, m: int, b: np.ndarray, n: int, p: int) -> np.ndarray:
    """Polynomial hashes of m + n words from those of m words and, m words on, of n."""
    size = max(0, len(b) - m)
    return a[:size] * np.uint64(pow(p, n, 1 << 64)) + b[m : m + size]


def _powers(h: np.ndarray, p: int, upto: int) -> dict[int, np.ndarray]:
    out, n = {1: h}, 1
    while 2 * n <= upto:
        out[2 * n] = _longer(out[n], n, out[n], n, p)
        n *= 2
    return out


def _sliding(a: np.ndarray, width: int, fold) -> np.ndarray:
    """fold (minimum or maximum) over every `width` neighbours."""
    n, now = 1, a
    while 2 * n <= width:
        now = fold(now[:-n], now[n:]) if len(now) > n else now[:0]
        n *= 2
    rest = width - n
    return fold(now[:-rest], now[rest:]) if rest and len(now) > rest else (now if not rest else now[:0])


class Windows:
    """The windows of some documents' words, in one line."""

    def __init__(self, words: list[list[bytes]], hashes: WordHashes):
        self.count = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.count) - self.count
        self.h = np.concatenate([hashes.array(w) for w in words]) if words else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(words)), self.count)
        self.place = np.arange(len(self.h)) - self.first[self.doc]

    def sift(self) -> "Windows":
        """The least k-mer of each window: least, seeds and times."""
        size = max(0, len(self.h) - WINDOW + 1)
        self.valid = (self.place + WINDOW <= self.count[self.doc])[:size]
        grams = mix(_powers(self.h, P1, SEED).get(SEED, np.empty(0, np.uint64)))
        self.least = _sliding(grams, SEEDS_IN, np.minimum)[:size]
        self.least[~self.valid] = 0
        # a k-mer is the least of a window if it is the greatest of the least ones around
        padded = np.concatenate([np.zeros(SEEDS_IN - 1, np.uint64), self.least, np.zeros(SEEDS_IN - 1, np.uint64)])
        around = _sliding(padded, SEEDS_IN, np.maximum)[: len(grams)]
        chosen = grams[: len(around)][(grams[: len(around)] == around) & (around != 0)]
        self.seeds, self.times = np.unique(chosen, return_counts=True)
        return self

    def candidates(self, recurring: np.ndarray) -> np.ndarray:
        """Starts of valid windows whose least k-mer recurs here or elsewhere (recurring: sorted)."""
        known = np.union1d(self.seeds[self.times > 1], recurring)
        if not len(known) or not len(self.least):
            return np.empty(0, np.int64)
        at = np.searchsorted(known, self.least)
        at[at == len(known)] = 0
        return np.flatnonzero((known[at] == self.least) & self.valid)

    def nodes(self) -> np.ndarray:
        """A hash of the WINDOW - 1 words at each place."""
        w = _powers(self.h, P1, 16)
        two = _longer(w[16], 16, w[2], 2, P1) if 16 in w and len(w[16]) else np.empty(0, np.uint64)
        return mix(_longer(two, 18, self.h, 1, P1) + np.uint64(WINDOW))

    def names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 hash bits of windows."""
        out = []
        for p in (P1, P2):
            w = _powers(self.h, p, 16)
            out.append(mix(_longer(w[16], 16, w[4], 4, p)[starts] + np.uint64(p >> 7)))
        return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def _arrays(*parts: np.ndarray) -> bytes:
    return struct.pack("<q", len(parts[0])) + b"".join(p.tobytes() for p in parts)


def _read(pack: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<q", pack)[0], 8, []
    for kind in kinds:
        out.append(np.frombuffer(pack, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


PACKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("pack", pa.large_binary()), ("rows", pa.large_binary())])
#: Of a window that is shipped: names, document id, start, start in the chunk, whether it comes again in the chunk.
WINDOW_KINDS = (np.uint64, np.uint32, np.int64, np.int32, np.uint32, np.uint8)
#: What is sent back to a chunk: later occurrences (start in the chunk, source document, source start), sources, and repeats within the chunk.
LATER, HEAD, BACK = 0, 1, 2
SENT_KINDS = {LATER: (np.uint32, np.int64, np.int32), HEAD: (np.uint32,), BACK: (np.uint32, np.uint32)}
#: Windows in a block, by which spans meet pieces.
BLOCK = 256
LISTED = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("source_doc", pa.int64()), ("source", pa.int64()), ("nodes", pa.list_(pa.int64()))])
#: A span: where it stands (document, place, place in the chunk), windows, source, path and place on it.
SPAN = ["doc", "place", "at", "n", "source_doc", "source", "path", "offset"]
SPAN_DDL = "doc long, place long, at long, n int, source_doc long, source long, path long, offset long"
LISTED_DDL = "kind string, chunk long, doc long, place long, at long, n int, source_doc long, source long, nodes array<long>"


def _bucketed(where: np.ndarray, arrays: tuple[np.ndarray, ...]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(where, kind="stable")
    where = where[order]
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.empty(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(where)]):
        yield int(where[a]), _arrays(*(x[order[a:b]] for x in arrays))


def _sent_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, pa.StructArray | None]]:
    """chunk, rows and what was sent to the chunk, as arrays."""
    for k in range(batch.num_rows):
        sent = batch.column(2)[k]
        yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), sent.values if sent.is_valid and len(sent.values) else None


def _sent(packs: pa.StructArray | None, kind: int) -> list[np.ndarray]:
    """The arrays of one kind that a chunk was sent."""
    pairs = zip(packs.field("kind").to_pylist(), packs.field("pack").to_pylist()) if packs is not None else ()
    found = [_read(p, *SENT_KINDS[kind]) for k, p in pairs if k == kind]
    return [np.concatenate(x).astype(np.int64) for x in zip(*found)] if found else [np.empty(0, np.int64) for _ in SENT_KINDS[kind]]


def _columns(packs: pa.StructArray | None, *names: str) -> list[np.ndarray]:
    return [np.asarray(packs.field(c)).astype(np.int64) if packs is not None else np.empty(0, np.int64) for c in names]


def _breaks(*keys: np.ndarray) -> np.ndarray:
    """Where runs begin: places at which some key is not the one before plus its step. keys: pairs of an array and its step."""
    new = np.zeros(len(keys[0][0]), bool)
    if len(new):
        new[0] = True
    for a, step in keys:
        new[1:] |= a[1:] != a[:-1] + step
    return np.flatnonzero(new)


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


class Graph:
    """The repeated edges of documents' words, their paths, and what is left of the documents.

    Within the graph a document is its key (see `keyed`).
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark)
        rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        total = rows.agg(F.sum(utf8_size("text"))).first()[0] or 0
        buckets = max(1, -(-total // BUCKET_BYTES))
        rows = keyed(rows)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch, texts in chunks(batches, "text", CHUNK_BYTES):
                chunk = uuid.uuid4().int >> 65
                seeds = Windows([t.split() for t in texts], hashes).sift().seeds
                packs = list(_bucketed((seeds % np.uint64(buckets)).astype(np.int64), (seeds,)))
                n = len(packs)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * (n + 1), pa.int64()), pa.array([None, *(b for b, _ in packs)], pa.int64()), pa.array([None, *(p for _, p in packs)], pa.large_binary()), pa.array([pack_rows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts), *[None] * n], pa.large_binary())], schema=PACKED)

        def sift(group: pa.Table) -> pa.Table:
            ids = group["chunk"].to_pylist()
            parts_ = [_read(p, np.uint64)[0] for p in group["pack"].to_pylist()]
            values = np.concatenate(parts_)
            of = np.repeat(np.arange(len(parts_)), [len(p) for p in parts_])
            order = np.argsort(values, kind="stable")
            values, of = values[order], of[order]
            same = np.zeros(len(values) + 1, bool)
            same[1:-1] = values[1:] == values[:-1]
            again = same[1:] | same[:-1]
            values, of = values[again], of[again]
            order = np.argsort(of, kind="stable")
            values, cuts = values[order], np.searchsorted(of[order], np.arange(len(parts_) + 1))
            packs = [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            some = [k for k, p in enumerate(packs) if p]
            return pa.table({"chunk": pa.array([ids[k] for k in some], pa.int64()), "kind": pa.array([0] * len(some), pa.int32()), "pack": pa.array([packs[k] for k in some], pa.binary())})

        def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                release()
                for chunk, rows_, packs in _sent_rows(batch):
                    keys, _, texts = unpack_rows(rows_)
                    w = Windows([t.split() for t in texts], hashes).sift()
                    recurring = np.unique(np.concatenate([np.frombuffer(p, np.uint64) for p in packs.field("pack").to_pylist()])) if packs is not None else np.empty(0, np.uint64)
                    starts = w.candidates(recurring)
                    if not len(starts):
                        continue
                    a, b = w.names(starts)
                    order = np.lexsort((starts, b, a))
                    a, b, starts = a[order], b[order], starts[order]
                    doc, place = keys[w.doc[starts]], w.place[starts]
                    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                    later = (doc != doc[head]) | (place != place[head])
                    again = np.zeros(len(starts), np.uint8)
                    again[head[later]] = 1
                    back = np.flatnonzero(later)
                    back = back[np.argsort(starts[back], kind="stable")]
                    ship = np.flatnonzero(~later)
                    ship = ship[np.argsort(starts[ship], kind="stable")]
                    columns = (a[ship], b[ship], doc[ship], place[ship].astype(np.int32), starts[ship].astype(np.uint32), again[ship])
                    out = [(k, None, p) for k, p in _bucketed((a[ship] % np.uint64(buckets)).astype(np.int64), columns)]
                    if len(back):
                        out.append((chunk % buckets, BACK, _arrays(starts[back].astype(np.uint32), starts[head[back]].astype(np.uint32))))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.int64()), pa.array([k for k, _, _ in out], pa.int64()), pa.array([f for _, f, _ in out], pa.int32()), pa.array([p for _, _, p in out], pa.binary())], names=["chunk", "bucket", "kind", "pack"])

        def sources(group: pa.Table) -> pa.Table:
            ids, kinds = group["chunk"].to_pylist(), group["kind"].to_pylist()
            packs = group["pack"].to_pylist()
            out = [(ids[k], kinds[k], packs[k]) for k in range(len(ids)) if kinds[k] is not None]
            open_ = [k for k in range(len(ids)) if kinds[k] is None]
            parts_ = [_read(packs[k], *WINDOW_KINDS) for k in open_]
            if parts_:
                a, b, doc, place, start, again = (np.concatenate(x) for x in zip(*parts_))
                of = np.repeat(np.arange(len(parts_)), [len(p[0]) for p in parts_])
                order = np.lexsort((place, doc, b, a))
                a, b, doc, place, start, again, of = (x[order] for x in (a, b, doc, place, start, again, of))
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                head = np.repeat(first, np.diff(np.append(first, len(a))))
                later = (doc != doc[head]) | (place != place[head])
                repeated = np.add.reduceat(later | (again > 0), first) > 0
                for kind, own in ((LATER, np.flatnonzero(later)), (HEAD, first[repeated])):
                    own = own[np.lexsort((start[own], of[own]))]
                    cuts = np.searchsorted(of[own], np.arange(len(parts_) + 1)).tolist()
                    for k, x, y in zip(open_, cuts[:-1], cuts[1:]):
                        if y > x:
                            at = own[x:y]
                            columns = (start[at], doc[head[at]], place[head[at]]) if kind == LATER else (start[at],)
                            out.append((ids[k], kind, _arrays(*columns)))
            return pa.table({"chunk": pa.array([c for c, _, _ in out], pa.int64()), "kind": pa.array([k for _, k, _ in out], pa.int32()), "pack": pa.array([p for _, _, p in out], pa.binary())})

        packed = self.scratch.table(rows.mapInArrow(pack, "chunk long, bucket long, pack binary, rows binary"), "packed", large_rows=True)
        recurring = packed.filter("bucket IS NOT NULL").select("chunk", "bucket", "pack").groupBy("bucket").applyInArrow(sift, "chunk long, kind int, pack binary")
        recurring = self.scratch.table(recurring, "recurring")
        self.texts = self._laid_out(packed.filter("bucket IS NULL").select("chunk", "rows"), max(parts(self.spark), -(-total // LAID_BYTES)))
        self.scratch.drop("packed")
        candidates = self._joined(recurring).mapInArrow(edges, "chunk long, bucket long, kind int, pack binary")
        self.sent = self.scratch.table(candidates.groupBy("bucket").applyInArrow(sources, "chunk long, kind int, pack binary"), "sent")
        self.scratch.drop("recurring")
        self.found: DataFrame | None = None

    def _laid_out(self, texts: DataFrame, files: int) -> DataFrame:
        """The chunks as a table whose files Spark knows to be divided by chunk: joins with it shuffle the other side only."""
        name = f"glossa_{uuid.uuid4().hex}"
        texts.repartition(files, "chunk").write.bucketBy(files, "chunk").options(**LARGE_ROWS).option("path", f"{self.scratch.root}/texts").saveAsTable(name)
        return self.spark.table(name)

    def _joined(self, packs: DataFrame) -> DataFrame:
        """chunk, rows and what was sent to the chunk (structs of all other columns)."""
        sent = packs.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in packs.columns if c != "chunk"])).alias("packs"))
        return self.texts.join(sent, "chunk", "left").select("chunk", "rows", "packs")

    def _listed(self) -> DataFrame:
        """LISTED: `run`, neighbouring sources with their nodes; `span`, later occurrences whose sources are neighbours too; `doc`, every document."""

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                release()
                for chunk, rows_, packs in _sent_rows(batch):
                    keys, ids, texts = unpack_rows(rows_)
                    w = Windows([t.split() for t in texts], hashes)
                    out = [{"kind": np.full(len(keys), "doc"), "doc": keys, "place": ids}]
                    start, doc, place = _sent(packs, LATER)
                    again, head = _sent(packs, BACK)
                    if len(again):
                        # a repeat within the chunk has the source of the first one in the chunk
                        by = np.argsort(start, kind="stable")
                        at = np.minimum(np.searchsorted(start[by], head), max(len(by) - 1, 0))
                        known = start[by][at] == head if len(by) else np.zeros(len(head), bool)
                        own_doc, own_place = keys[w.doc[head]], w.place[head]
                        start = np.concatenate([start, again])
                        doc = np.concatenate([doc, np.where(known, doc[by][at] if len(by) else 0, own_doc)])
                        place = np.concatenate([place, np.where(known, place[by][at] if len(by) else 0, own_place)])
                    order = np.argsort(start, kind="stable")
                    start, doc, place = start[order], doc[order], place[order]
                    at = _breaks((start, 1), (doc, 0), (place, 1), (w.doc[start], 0))
                    if len(at):
                        n = np.diff(np.append(at, len(start)))
                        out.append({"kind": np.full(len(at), "span"), "doc": keys[w.doc[start[at]]], "place": w.place[start[at]], "at": start[at], "n": n, "source_doc": doc[at], "source": place[at]})
                    heads = np.sort(_sent(packs, HEAD)[0])
                    at = _breaks((heads, 1), (w.doc[heads], 0))
                    if len(at):
                        n = np.diff(np.append(at, len(heads)))
                        node = w.nodes().view(np.int64)
                        spread = np.repeat(heads[at] - np.cumsum(n + 1) + n + 1, n + 1) + np.arange(int((n + 1).sum()))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n + 1)), pa.int32()), pa.array(node[spread]))
                        out.append({"kind": np.full(len(at), "run"), "doc": keys[w.doc[heads[at]]], "place": w.place[heads[at]], "n": n, "nodes": lists})
                    for x in out:
                        size = len(x["kind"])
                        x["chunk"] = np.full(size, chunk)
                        yield pa.RecordBatch.from_arrays([(x[f.name] if isinstance(x[f.name], pa.Array) else pa.array(x[f.name], f.type)) if f.name in x else pa.nulls(size, f.type) for f in LISTED], schema=LISTED)

        rows = self._joined(self.sent).mapInArrow(listed, LISTED_DDL)
        return self.scratch.table(rows.withColumn("run", F.monotonically_increasing_id()), "listed")

    def pieces(self, runs: DataFrame) -> DataFrame:
        """doc, place, n (windows), path, offset: the runs cut where nodes branch, and the nonbranching path of each piece with its place there.

        runs: run, doc, place, n (edges), nodes (n + 1).
        """
        passed = runs.select("run", "n", F.posexplode("nodes").alias("k", "node"))
        degrees = passed.groupBy("node").agg(
            F.sum((F.col("k") < F.col("n")).cast("long")).alias("out"), F.sum((F.col("k") > 0).cast("long")).alias("into"),
            F.max(F.when(F.col("k") == F.col("n"), F.col("run"))).alias("left"), F.max(F.when(F.col("k") == 0, F.col("run"))).alias("right"),
        )
        degrees = self.scratch.table(degrees.filter("out <> 1 OR into <> 1 OR left IS NOT NULL AND right IS NOT NULL"), "degrees")
        branching = degrees.filter("out <> 1 OR into <> 1").select("node")
        cuts = passed.filter("k > 0 AND k < n").join(branching, "node", "left_semi").groupBy("run").agg(F.array_sort(F.collect_set("k")).alias("cuts"))
        bounds = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array("n"))
        rows = runs.select("run", "doc", "place", "n").join(cuts, "run", "left").withColumn("b", bounds)
        rows = rows.select("run", "doc", "place", "n", F.explode(F.arrays_zip(F.slice("b", F.lit(1), F.size("b") - 1).alias("x"), F.slice("b", F.lit(2), F.size("b") - 1).alias("y"))).alias("c"))
        rows = rows.select("run", "doc", (F.col("place") + F.col("c.x")).alias("place"), (F.col("c.y") - F.col("c.x")).alias("n"), (F.col("c.x") == 0).alias("first"), (F.col("c.y") == F.col("n")).alias("last"))
        rows = self.scratch.table(rows.withColumn("piece", F.monotonically_increasing_id()), "pieces")
        # a run's last piece goes on in another run's first where the node between has no other edges
        links = degrees.filter("out = 1 AND into = 1 AND left <> right").select("left", "right")
        links = links.join(rows.filter("last").select(F.col("run").alias("left"), F.col("piece").alias("before"), F.col("n").alias("far").cast("long")), "left")
        links = links.join(rows.filter("first").select(F.col("run").alias("right"), "piece"), "right").select("piece", "before", "far")
        strung = self._strung(links)
        found = rows.join(strung, "piece", "left")
        return found.select("doc", "place", "n", F.coalesce("before", "piece").alias("path"), F.coalesce("far", F.lit(0)).cast("long").alias("offset"))

    def _strung(self, links: DataFrame) -> DataFrame:
        """piece, before, far: of every linked piece the first of its path and how many windows lie between. links: to the piece before.

        Each round doubles how far links reach; what still reaches on after all pieces could have been passed is a circle and stays unlinked.
        """
        now = self.scratch.table(links, "strung_0")
        for k in range(max(1, math.ceil(math.log2(now.count() + 1))) + 1):
            there = now.select(F.col("piece").alias("before"), F.col("before").alias("b"), F.col("far").alias("f"))
            now = self.scratch.table(now.select("piece", "before", "far").join(there, "before", "left").select("piece", F.coalesce("b", "before").alias("before"), (F.col("far") + F.coalesce("f", F.lit(0))).alias("far"), F.col("b").isNotNull().alias("on")), f"strung_{k + 1}")
            self.scratch.drop(f"strung_{k}")
            if now.filter("on").isEmpty():
                break
        return now.filter("NOT on").drop("on")

    @staticmethod
    def along(spans: DataFrame, pieces: DataFrame) -> DataFrame:
        """spans cut along the pieces of their sources, with path and its offset there. They meet by blocks of a document."""
        blocks = lambda a, n: F.explode(F.sequence(F.floor(a / BLOCK), F.floor((a + n - 1) / BLOCK)))
        p = pieces.select(F.col("doc").alias("source_doc"), F.col("place").alias("p"), F.col("n").alias("m"), "path", "offset", blocks(F.col("place"), F.col("n")).alias("block"))
        s = spans.select("chunk", "doc", "place", "at", "n", "source_doc", "source", blocks(F.col("source"), F.col("n")).alias("block"))
        begin, end = F.greatest("source", "p"), F.least(F.col("source") + F.col("n"), F.col("p") + F.col("m"))
        met = s.join(p, ["source_doc", "block"]).filter((begin < end) & (F.col("block") == F.floor(begin / BLOCK)))
        shift = begin - F.col("source")
        return met.select("chunk", "doc", (F.col("place") + shift).alias("place"), (F.col("at") + shift).alias("at"), (end - begin).cast("int").alias("n"), "source_doc", begin.alias("source"), "path", (F.col("offset") + begin - F.col("p")).alias("offset"))

    def _digests(self, asked: DataFrame) -> DataFrame:
        """asked with the digest of the words: of a span where it stands, of a source in every row of the chunk with that id.

        asked: chunk, own (whether it is a span, else its source), and SPAN.
        """

        def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                release()
                for chunk, rows_, packs in _sent_rows(batch):
                    if packs is None:
                        continue
                    keys, _, texts = unpack_rows(rows_)
                    split = [t.split() for t in texts]
                    count = np.fromiter(map(len, split), np.int64, len(split))
                    first = np.cumsum(count) - count
                    words = [w for ws in split for w in ws]
                    own = np.asarray(packs.field("own").to_numpy(zero_copy_only=False), bool)
                    at, n, doc, place = _columns(packs, "at", "n", "source_doc", "source")
                    mine = np.flatnonzero(own)
                    # a source's rows: those with its id, if they are long enough
                    order = np.argsort(keys, kind="stable")
                    theirs = np.flatnonzero(~own)
                    low, high = np.searchsorted(keys[order], doc[theirs], "left"), np.searchsorted(keys[order], doc[theirs], "right")
                    rows = np.repeat(theirs, high - low)
                    held = order[np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(rows))] if len(rows) else rows
                    fits = place[rows] + n[rows] + WINDOW - 1 <= count[held]
                    rows, held = rows[fits], held[fits]
                    which = np.concatenate([mine, rows])
                    begin = np.concatenate([at[mine], first[held] + place[rows]])
                    digests = [_digest(words[x:y]) for x, y in zip(begin.tolist(), (begin + n[which] + WINDOW - 1).tolist())]
                    taken = packs.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), chunk)), *(taken.field(c) for c in ("own", *SPAN)), pa.array(digests, pa.binary())], names=["chunk", "own", *SPAN, "digest"])

        return self._joined(asked).mapInArrow(digested, f"chunk long, own boolean, {SPAN_DDL}, digest binary")

    def verified(self, spans: DataFrame, docs: DataFrame, name: str) -> DataFrame:
        """spans with `equal`: whether the words at a span and at its source coordinates are the same. docs: doc, chunk."""
        nothing = [F.lit(0).cast("long").alias(c) for c in ("doc", "place", "at")]
        wanted = spans.select("source_doc", "source", "n").distinct().join(docs.withColumnRenamed("doc", "source_doc"), "source_doc")
        wanted = wanted.select("chunk", F.lit(False).alias("own"), *nothing, "n", "source_doc", "source", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("offset"))
        found = self.scratch.table(self._digests(spans.select("chunk", F.lit(True).alias("own"), *SPAN).union(wanted)), name)
        # a table of its own, so that the join reads both sides as they were shuffled and can split a span that a third of all rows quote
        there = self.scratch.table(found.filter("NOT own").select("source_doc", "source", "n", "digest").distinct().withColumn("met", F.lit(True)), f"{name}_sources")
        here = found.filter("own").join(there, ["source_doc", "source", "n", "digest"], "left")
        return here.select("chunk", *SPAN, F.col("met").isNotNull().alias("equal"))

    def spans(self) -> DataFrame:
        """chunk, doc, place, at, n, source_doc, source, path, offset of every verified span. Found once."""
        if self.found is None:
            self.found = self._spans()
        return self.found

    def _spans(self) -> DataFrame:
        listed = self.listed = self._listed()
        pieces = self.pieces(listed.filter("kind = 'run'").select("run", "doc", "place", "n", "nodes"))
        spans = self.scratch.table(self.along(listed.filter("kind = 'span'"), pieces), "spans")
        for done in ("sent", "degrees", "pieces"):
            self.scratch.drop(done)
        docs = listed.filter("kind = 'doc'").select("doc", "chunk")
        judged = self.scratch.table(self.verified(spans, docs, "digests"), "judged")
        out = judged.filter("equal").drop("equal")
        wrong = judged.filter("NOT equal")
        if not wrong.isEmpty():
            step = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
            single = wrong.withColumn("i", step).select("chunk", "doc", *[(F.col(c) + F.col("i")).alias(c) for c in ("place", "at")], F.lit(1).alias("n"), "source_doc", (F.col("source") + F.col("i")).alias("source"), "path", (F.col("offset") + F.col("i")).alias("offset"))
            out = out.union(self.verified(self.scratch.table(single, "single"), docs, "single_digests").filter("equal").drop("equal"))
        return out

    def repeats(self) -> DataFrame:
        """doc_id, start, words, source_doc, source_start, path of every verified span."""
        spans = self.spans()
        ids = self.listed.filter("kind = 'doc'").select(F.col("doc").alias("key"), F.col("place").alias("id"))
        named = spans.join(ids.withColumnsRenamed({"key": "doc", "id": "doc_id"}), "doc").join(ids.withColumnsRenamed({"key": "source_doc", "id": "source_id"}), "source_doc")
        return named.select("doc_id", F.col("place").alias("start"), (F.col("n") + WINDOW - 1).cast("long").alias("words"), F.col("source_id").alias("source_doc"), F.col("source").alias("source_start"), "path")

    def kept(self, texts: bool = False) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256, n_spans (stretches of a path) and kept_text of every document."""
        fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_spans", pa.int64())]
        schema = pa.schema(fields + [("kept_text", pa.large_string())] * texts)

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, rows_, packs in _sent_rows(batch):
                    _, ids, own = unpack_rows(rows_)
                    words = [t.split() for t in own]
                    count = np.fromiter(map(len, words), np.int64, len(words))
                    first = np.cumsum(count) - count
                    doc_of = np.repeat(np.arange(len(words)), count)
                    start, n, path, offset = _columns(packs, "at", "n", "path", "offset")
                    edge = np.zeros(int(count.sum()) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + WINDOW - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    order = np.argsort(start, kind="stable")
                    start, n, path, offset = start[order], n[order], path[order], offset[order]
                    # a span that goes on along its path from the one before is the same stretch
                    goes_on = (start[1:] == start[:-1] + n[:-1]) & (path[1:] == path[:-1]) & (offset[1:] == offset[:-1] + n[:-1]) & (doc_of[start[1:]] == doc_of[start[:-1]])
                    fresh = np.concatenate([[True], ~goes_on]) if len(start) else np.empty(0, bool)
                    stretches = np.bincount(doc_of[start[fresh]], minlength=len(words)) if len(words) else np.empty(0, np.int64)
                    left, kept = [], []
                    for k, w in enumerate(words):
                        mask = keep[first[k] : first[k] + count[k]]
                        left.append(int(mask.sum()))
                        kept.append(b" ".join(w if left[-1] == len(w) else compress(w, mask.tolist())))
                    columns = [ids, pa.array(count), pa.array(count - np.array(left, np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(stretches, pa.int64())]
                    if texts:
                        columns.append(pa.array([x.decode() for x in kept], pa.large_string()))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long" + ", kept_text string" * texts
        return self._joined(self.spans().select("chunk", "at", "n", "path", "offset")).mapInArrow(remove, kinds)


def op3_debruijn_dedup(spark, sf_dir):
    """All documents without the words of windows that start earlier elsewhere."""
    return Graph(spark.read.parquet(f"{sf_dir}/documents.parquet")).kept()


SQL = {
    "op3_debruijn_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id NULLS LAST, s) AS r FROM windows) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
positions AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words WHERE len(w) > 0),
kept AS (
  SELECT t.doc_id, string_agg(t.w[t.p], ' ' ORDER BY t.p) AS text, count(*) AS n
  FROM positions t ANTI JOIN covered c ON c.doc_id = t.doc_id AND c.p = t.p GROUP BY t.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id""",
}
QUERIES = {"op3_debruijn_dedup": lambda spark, sf_dir: op3_debruijn_dedup(spark, sf_dir).drop("n_spans")}
