"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ORDER bytes, pretrained on the training documents. A symbol's probability comes from the longest
context that the trie holds. If the symbol never followed it, an escape (estimator D: half a count from each distinct symbol) leads to the next shorter context, without the symbols already seen in the longer one (exclusion); at last all remaining bytes
are equally likely. Shorter contexts count in how many longer ones a symbol came (update exclusion). A document is its text with A-Z in lower case, then an end symbol; its score is the sum of the symbols' log10 probabilities,
that is its code length.

With contexts of ORDER bytes a symbol's probability depends on ORDER + 1 bytes only, its gram, so a few joins score a corpus:

1. gather: documents are packed into chunks on a shared table; each chunk lists its distinct grams and words with their counts in
   training documents, in hash buckets;
2. count: each bucket sums its grams and words over the chunks. The trie grows with the corpus and is never collected;
3. predict: grams meet by the two bytes before the symbol, where all their contexts of two and more bytes lie; the contexts of
   one and no byte, 65,536 counts at most, go everywhere. Each gram gets its log10 probability;
4. answer: each bucket sends its grams' probabilities and words' counts back to the chunks that listed them;
5. score: each chunk sums them by document. The words' counts make a unigram base beside the PPM score.

Null texts are empty: one end symbol, one end token. Repeated rows are counted and scored each. Rows with a null id, or one that is no
number, are training rows and come back with a null id. Very long texts are read whole, a slice at a time. Other columns are not read. Without training documents every byte is equally likely and every count zero. An empty table gives an empty table.
"""

from __future__ import annotations

import struct
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, chunks, mix, release, rows_of, utf8_size
from glossa.llm.debruijn import pack_rows, unpack_rows
from glossa.llm.labelled import remainder

ORDER = 5
#: Estimator D: each symbol gives half a count to the escape.
DISCOUNT = 0.5
#: Bytes that no UTF-8 text holds: before a text, and after it.
START, END = 0xFE, 0xFF
#: Symbols that may come: all bytes but START.
SYMBOLS = 255
#: Bytes of text in a chunk, in a slice of it that numpy holds at once, and for each bucket.
CHUNK_BYTES, SLICE_BYTES, BUCKET_BYTES = 8 << 20, 1 << 20, 12 << 20


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The grams (order + 1 bytes as a number) of all symbols, and how many each text has."""
    flat = np.frombuffer(b"".join(bytes([START]) * order + t + bytes([END]) for t in texts), np.uint8)
    n = max(len(flat) - order, 0)
    out = np.zeros(n, np.uint64)
    for k in range(order + 1):
        out <<= np.uint64(8)
        np.bitwise_or(out, flat[k : k + n], out=out)
    return out[flat[order:] != START], np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))


def _groups(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, how many rows each had, and sums of the rest. keys: sorted."""
    if not len(keys):
        return (keys, np.empty(0, np.int64), *[np.empty(0, s.dtype) for s in sums])
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at], np.diff(np.append(at, len(keys))), *[np.add.reduceat(s, at) for s in sums])


class Level:
    """Contexts of one length: grams and their counts, contexts and their totals."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.gram, self.count = gram, count
        self.context, self.distinct, self.total = _groups(gram >> np.uint64(8), count)

    def find(self, table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys are in a sorted table, and whether."""
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def count_of(self, keys: np.ndarray) -> np.ndarray:
        at, there = self.find(self.gram, keys)
        return np.where(there, self.count[at] if len(self.count) else 0, 0)


def log_probabilities(gram: np.ndarray, count: np.ndarray, one: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of each distinct gram's last byte after the others.

    gram: sorted, with all training grams that share the two bytes before the symbol; count: in training, may be 0.
    one: (256, 256) in how many contexts of two bytes a byte came after a byte, over the whole corpus.
    """
    some = count > 0
    top = Level(gram[some], count[some].astype(np.float64))
    levels = {order: top}
    for k in range(order - 1, 1, -1):
        shorter = levels[k + 1].gram & np.uint64((1 << 8 * (k + 1)) - 1)
        by = np.argsort(shorter, kind="stable")
        keys, sums = _groups(shorter[by])
        levels[k] = Level(keys, sums.astype(np.float64))
    pairs = np.flatnonzero(one.ravel()).astype(np.uint64)
    levels[1] = Level(pairs, one.ravel()[pairs.astype(np.int64)].astype(np.float64))
    zero = one.sum(axis=0)
    levels[0] = Level(np.flatnonzero(zero).astype(np.uint64), zero[zero > 0].astype(np.float64))
    out = np.zeros(len(gram))
    open_ = np.arange(len(gram))  # grams without a probability yet
    above = np.full(len(gram), -1, np.int64)  # their context in the level above, if the trie holds it
    for k in range(order, -1, -1):
        level = levels[k]
        keys = gram[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
        where, there = level.find(level.context, keys >> np.uint64(8))
        total = np.where(there, level.total[where] if len(level.total) else 0.0, 0.0)
        distinct = np.where(there, level.distinct[where] if len(level.distinct) else 0, 0).astype(np.float64)
        if k < order and len(levels[k + 1].gram):
            # what the longer context has seen is excluded
            longer = levels[k + 1]
            seen = level.count_of(longer.gram & np.uint64((1 << 8 * (k + 1)) - 1))
            _, _, excluded = _groups(longer.gram >> np.uint64(8), seen)
            from_above = above[open_]
            escaped = from_above >= 0
            total -= np.where(escaped, excluded[from_above], 0.0)
            distinct -= np.where(escaped, longer.distinct[from_above], 0)
        hit = level.count_of(keys)
        found = there & (hit > 0)
        out[open_[found]] += np.log10((hit[found] - DISCOUNT) / total[found])
        escape = there & ~found & (distinct > 0)
        out[open_[escape]] += np.log10(DISCOUNT * distinct[escape] / total[escape])
        above[open_] = np.where(there, where, -1)
        open_ = open_[~found]
    left = SYMBOLS - len(levels[0].gram)
    out[open_] -= np.log10(max(left, 1))
    return out


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(arrays[0])) + b"".join(a.tobytes() for a in arrays))


def _unzip(pack: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(pack)
    n, at, out = struct.unpack_from("<q", data)[0], 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of limited size (one text at least)."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start = i
            total = 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def _buckets_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(gram) % np.uint64(buckets)).astype(np.int64)


def _cuts(where: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, start and end of each run of equal buckets."""
    at = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.empty(0, np.int64)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(where)]):
        yield int(where[a]), a, b


def _listed(texts: list[bytes], train: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of some texts and their counts in the training ones."""
    parts = []
    for a, b in _slices(texts):
        g, size = grams(texts[a:b], order)
        coded = pa.array(g).dictionary_encode()
        own = np.asarray(coded.dictionary)
        parts.append((own, np.bincount(np.asarray(coded.indices)[np.repeat(train[a:b], size)], minlength=len(own))))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, n = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(key)
    key, _, n = _groups(key[by], n[by])
    return key, n


def _words_of(names: list[bytes], buckets: int) -> dict[int, list[bytes]]:
    """Sorted words by bucket. The empty word stands for the end of a text."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(names):
        out.setdefault(xxhash.xxh3_64_intdigest(w) % buckets, []).append(w)
    return out


class Trainer:
    """The chunks of documents with their grams and words; training: which rows the model learns from."""

    def __init__(self, docs: DataFrame, training: F.Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER):
        self.spark, self.order = docs.sparkSession, order
        self.scratch = Scratch(self.spark)
        rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.coalesce(training, F.lit(True)).alias("train"), F.col(text_col).alias("text"))
        total = rows.agg(F.sum(utf8_size("text"))).first()[0] or 0
        self.buckets = buckets = max(1, -(-total // BUCKET_BYTES))
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("bucket", pa.int64()), ("pack", pa.binary()), ("rows", pa.large_binary()), ("train", pa.binary())])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in chunks(batches, "text", CHUNK_BYTES):
                keys = batch.column(0).to_pylist()
                by = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0))
                train = np.array(batch.column(1).to_pylist(), bool)[by]
                keys, texts = [keys[i] for i in by], [texts[i].lower() for i in by]
                key, n = _listed(texts, train, order)
                where = _buckets_of(key, buckets)
                into = np.argsort(where, kind="stable")
                key, n = key[into], n[into]
                out: list[tuple] = [(None, None, None, pack_rows(list(range(len(keys))), keys, texts), train.astype(np.uint8).tobytes())]
                out += [("gram", k, _zip(np.diff(key[a:b], prepend=np.uint64(0)), n[a:b].astype(np.uint32)), None, None) for k, a, b in _cuts(where[into])]
                words: Counter[bytes] = Counter({b"": int(train.sum())})
                others: set[bytes] = set()
                for t, learn in zip(texts, train.tolist()):
                    words.update(t.split()) if learn else others.update(t.split())
                for k, own in _words_of([*words, *(others - words.keys())], buckets).items():
                    counts = np.array([words[w] for w in own], np.uint32)
                    out.append(("word", k, zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(own)) + counts.tobytes() + b" ".join(own)), None, None))
                chunk = uuid.uuid4().int >> 65
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:]))], schema=schema)
                del out, words, others
                release()

        self.chunks = self.scratch.table(rows.mapInArrow(gather, "chunk long, kind string, bucket long, pack binary, rows binary, train binary"), "chunks", large_rows=True)

    def probabilities(self) -> DataFrame:
        """bucket, key (gram), p (its log10 probability) of every gram of the corpus."""
        order, buckets = self.order, self.buckets

        def count(group: pa.Table) -> pa.Table:
            parts = [_unzip(p, np.uint64, np.uint32) for p in group["pack"].to_pylist()]
            key = np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in parts])
            n = np.concatenate([c for _, c in parts]).astype(np.int64)
            by = np.argsort(key)
            key, _, n = _groups(key[by], n[by])
            return pa.table({"key": key.view(np.int64), "n": n})

        counts = self.chunks.filter("kind = 'gram'").select("bucket", "pack").groupBy("bucket").applyInArrow(count, "key long, n long")
        counts = self.scratch.table(counts, "counts")
        one = np.zeros((256, 256))
        three = counts.filter("n > 0").select(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("k")).distinct()
        for r in three.groupBy(F.col("k").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("k")).count().collect():
            one[r["k"] >> 8, r["k"] & 255] = r["count"]

        def predict(group: pa.Table) -> pa.Table:
            key = np.asarray(group["key"].combine_chunks()).view(np.uint64)
            by = np.argsort(key)
            key, n = key[by], np.asarray(group["n"].combine_chunks())[by]
            return pa.table({"bucket": _buckets_of(key, buckets), "key": key.view(np.int64), "p": log_probabilities(key, n, one, order).astype(np.float32)})

        before = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF))
        return counts.groupBy(F.pmod(F.xxhash64(before), F.lit(min(1 << 16, 4 * buckets))).alias("met")).applyInArrow(predict, "bucket long, key long, p float")

    def answers(self) -> tuple[DataFrame, int, int]:
        """chunk, kind, bucket, pack: probabilities and counts in the order of the chunk's lists; N and V of the training tokens."""

        def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
            key = np.asarray(known["key"].combine_chunks()).view(np.uint64)
            by = np.argsort(key)
            key, p = key[by], np.asarray(known["p"].combine_chunks())[by]
            packs = []
            for pack in asked["pack"].to_pylist():
                delta, _ = _unzip(pack, np.uint64, np.uint32)
                packs.append(p[np.searchsorted(key, np.cumsum(delta, dtype=np.uint64))].tobytes())
            return pa.table({"chunk": asked["chunk"], "kind": pa.array(["gram"] * len(packs)), "bucket": asked["bucket"], "pack": pa.array(packs, pa.binary())})

        def count(group: pa.Table) -> pa.Table:
            ids, buckets, lists, total = group["chunk"].to_pylist(), group["bucket"].to_pylist(), [], Counter()
            for pack in group["pack"].to_pylist():
                data = zstandard.ZstdDecompressor().decompress(pack)
                n = struct.unpack_from("<q", data)[0]
                own = data[8 + 4 * n :].split(b" ")
                lists.append(own)
                for w, c in zip(own, np.frombuffer(data, np.uint32, n, 8).tolist()):
                    total[w] += c
            seen = [c for c in total.values() if c]
            packs = [np.array([total[w] for w in own], np.int64).tobytes() for own in lists]
            return pa.table({"chunk": pa.array([*ids, None], pa.int64()), "kind": pa.array(["word"] * len(packs) + ["total"]), "bucket": pa.array([*buckets, None], pa.int64()), "pack": pa.array([*packs, None], pa.binary()), "n": pa.array([None] * len(packs) + [sum(seen)], pa.int64()), "v": pa.array([None] * len(packs) + [len(seen)], pa.int64())})

        asked = self.chunks.select("chunk", "kind", "bucket", "pack")
        counted = asked.filter("kind = 'word'").groupBy("bucket").applyInArrow(count, "chunk long, kind string, bucket long, pack binary, n long, v long")
        counted = self.scratch.table(counted, "words")
        sums = counted.filter("kind = 'total'").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
        told = asked.filter("kind = 'gram'").groupBy("bucket").cogroup(self.probabilities().groupBy("bucket")).applyInArrow(answer, "chunk long, kind string, bucket long, pack binary")
        return told.union(counted.filter("kind = 'word'").select("chunk", "kind", "bucket", "pack")), sums["n"] or 0, sums["v"] or 0

    def score(self) -> DataFrame:
        """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every document."""
        order, buckets = self.order, self.buckets
        told, n_all, v_all = self.answers()
        sent = told.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "pack")).alias("told"))
        rows = self.chunks.filter("kind IS NULL").select("chunk", "rows", "train").join(sent, "chunk").select("rows", "train", "told")
        schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for pack, train, sent_back in rows_of(batch):
                    _, ids, texts = unpack_rows(pack)
                    train = np.frombuffer(train, np.uint8).astype(bool)
                    packs = {(t["kind"], t["bucket"]): t["pack"] for t in sent_back}
                    coded = []
                    for x, y in _slices(texts):
                        g, size = grams(texts[x:y], order)
                        c = pa.array(g).dictionary_encode()
                        coded.append((np.asarray(c.dictionary), np.asarray(c.indices), size))
                    key, place = np.unique(np.concatenate([d for d, _, _ in coded]), return_inverse=True)
                    places = np.split(place, np.cumsum([len(d) for d, _, _ in coded])[:-1])
                    where = _buckets_of(key, buckets)
                    into = np.argsort(where, kind="stable")
                    p = np.empty(len(key), np.float32)
                    for b, x, y in _cuts(where[into]):
                        p[into[x:y]] = np.frombuffer(packs["gram", b], np.float32)
                    score = np.concatenate([np.add.reduceat(p[where_].astype(np.float64)[at], np.cumsum(size) - size) for where_, (_, at, size) in zip(places, coded)])
                    names: set[bytes] = {b""}
                    for t in texts:
                        names.update(t.split())
                    counts: dict[bytes, int] = {}
                    for b, own in _words_of(list(names), buckets).items():
                        counts.update(zip(own, np.frombuffer(packs["word", b], np.int64).tolist()))
                    n_tokens, known, base = (np.empty(len(texts), kind) for kind in (np.int64, np.int64, np.float64))
                    for i, t in enumerate(texts):
                        split = [*t.split(), b""]
                        c = np.fromiter(map(counts.__getitem__, split), np.int64, len(split))
                        n_tokens[i], known[i], base[i] = len(split), np.count_nonzero(c), np.log10((c + 1) / (n_all + v_all + 1)).sum()
                    yield pa.RecordBatch.from_arrays([ids, pa.array(train), pa.array(n_tokens), pa.array(known), pa.array(np.full(len(ids), n_all)), pa.array(base), pa.array(score)], schema=schema)
                    del coded, packs, counts, names, place, places
                    release()

        return rows.mapInArrow(summed, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


#: The remainder modulo FOLDS that is held out.
FOLDS, HELD_OUT = 7, 2


def op1_ppm_scores(spark, sf_dir):
    """All documents scored by the model of the training documents."""
    model = Trainer(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder("doc_id", FOLDS) != HELD_OUT)
    return model.score().select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_ppm_scores": op1_ppm_scores}
SQL: dict[str, str] = {}
