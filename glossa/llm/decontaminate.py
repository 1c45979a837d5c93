"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some positions of a stretch of words and ignore the others, so a substituted word spoils only the seeds that look
at it. Seeds of the benchmark items are indexed; seeds at every position of every document are looked up, and each hit gives a
document, an item and a diagonal. The masks leave no stretch within the tolerance without a seed.
Around a hit the whole overlap along the diagonal is compared word by word: a document is contaminated by
an item if a stretch of MIN_WORDS words (or the whole item, if shorter) agrees in at least SIMILARITY of its words.

The benchmark is the stated query set: it goes to the executors in blocks of BLOCK_WORDS words at most, each a pass over
all documents. Words are runs of non-blanks, compared in lower case without the punctuation around them. Items shorter than SPAN
have masks of their own, which leave out as many parts of the item as words may differ; items of fewer than LEAST words never count as evidence.

Nulls: a null text has no words; a null id, or one that is no number, is returned as null. Repeated rows give repeated results; items of the
same words are one class, so copies of an item don't multiply the pairs. Ties between overlaps go to the earlier one. Very long texts are
searched whole. Empty tables: no pairs, nothing removed. Other columns are not read, or carried along whole, whatever their names. Words
are compared by 64 hash bits each; an accident would have to hit a tenth of an overlap's words.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, WordHashes, chunks, mix, restored, row_key, whole

#: Positions that count: "1". At least one fits every stretch of 12 words or more of which 0.8 are equal (the tests enumerate that). Fixed values.
MASKS = ["11101111", "11010010111", "111110011", "1111111", "1110101011", "110011111", "111101101", "1111110001"]
SPAN = 12
MIN_WORDS, SIMILARITY, LEAST = 13, 0.8, 5
#: What an equal and an unequal word add, so that SIMILARITY comes to 0.
GAINS = (1, -4)
BLOCK_WORDS = 1 << 20
PUNCTUATION = string.punctuation + "…“”„«»‘’¿¡–—"


class PlainWords(WordHashes):
    """Hashes of words in lower case without the punctuation around them."""

    def __missing__(self, word: bytes) -> int:
        plain = word.decode("utf-8", "replace").lower().strip(PUNCTUATION).encode() or word
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = WordHashes.__missing__(WordHashes(self.seed), plain)
        return h


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over a whole item of n words, one of which avoids any words that may differ."""
    differ = n * GAINS[0] // (GAINS[0] - GAINS[1])
    parts = differ + 2
    return [tuple(i for i in range(n) if i % parts not in out) for out in combinations(range(parts), differ)]


def _scaled(words: np.ndarray, weight: int) -> list[np.ndarray]:
    """The words times the factor of each picked position."""
    return [words * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF) for k in range(weight)]


def _seeds(scaled: list[np.ndarray], offsets: tuple[int, ...]) -> np.ndarray:
    """The hash of the picked words at every start that leaves room."""
    n = len(scaled[0]) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for own, o in zip(scaled, offsets):
        out += own[o : o + n]
    return mix(out)


class Index:
    """Seeds of some items, to be looked up."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        found: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        masks = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]
        for k, w in enumerate(words):
            if len(w) < LEAST:
                continue
            for offsets in masks if len(w) >= SPAN else short_masks(len(w)):
                first = offsets[0]
                s = _seeds(_scaled(w[first:], len(offsets)), tuple(o - first for o in offsets))
                s = s if len(w) >= SPAN else s[:1]
                found.setdefault(tuple(o - first for o in offsets), []).append((s, np.full(len(s), k), np.arange(first, first + len(s))))
        self.tables = {}
        for offsets, rows in found.items():
            seeds, items, starts = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(seeds, kind="stable")
            bits = max(16, min(26, int(len(seeds)).bit_length() + 5))
            seen = np.zeros(1 << bits, bool)
            seen[seeds >> np.uint64(64 - bits)] = True
            self.tables[offsets] = (seeds[order], items[order], starts[order], seen, np.uint64(64 - bits))

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Position, item and the item's position where seeds agree."""
        scaled = _scaled(words, max(map(len, self.tables), default=0))
        for offsets, (seeds, items, starts, seen, shift) in self.tables.items():
            own = _seeds(scaled, offsets)
            at = np.flatnonzero(seen[own >> shift])
            low = np.searchsorted(seeds, own[at], "left")
            high = np.searchsorted(seeds, own[at], "right")
            for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
                for k in range(a, b):
                    yield p, int(items[k]), int(starts[k])

    def overlap(self, words: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """Start in words, length and agreeing words of the overlap along a diagonal, if it is evidence."""
        own = self.words[item]
        a, b = max(0, -diagonal), min(len(own), len(words) - diagonal)
        same = words[a + diagonal : b + diagonal] == own[a:b]
        need = min(MIN_WORDS, len(own))
        if len(same) < need:
            return None
        # in integers: a stretch is evidence if its words gain 0 or more
        gains = np.concatenate([[0], np.cumsum(np.where(same, *GAINS))])
        if gains[-1] >= 0:
            return a + diagonal, len(same), int(same.sum())
        # the stretch of need words at least that gains most: for each end the best of all begins that are far enough
        begins = gains[: len(gains) - need]
        over = gains[need:] - np.minimum.accumulate(begins)
        end = int(over.argmax())
        if over[end] < 0:
            return None
        begin, end = int(begins[: end + 1].argmin()), end + need
        return a + diagonal + begin, end - begin, int(same[begin:end].sum())


def _matches(index: Index, texts: list[bytes], hashes: PlainWords) -> list[dict[int, tuple[int, int, int]]]:
    """For each text its items with the best overlap."""
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    if not index.tables:
        return out
    gap = SPAN  # words that no item has, between texts
    split = [t.lower().split() for t in texts]
    arrays, begin, at = [], [], 0
    for words in split:
        begin.append(at)
        arrays += [hashes.array(words), np.zeros(gap, np.uint64)]
        at += len(words) + gap
    flat = np.concatenate(arrays)
    tried = set()
    starts = np.array(begin)
    for p, item, q in index.hits(flat):
        k = int(np.searchsorted(starts, p, "right")) - 1
        first, n = begin[k], len(split[k])
        diagonal = p - first - q
        if p - first >= n or (k, item, diagonal) in tried:
            continue
        tried.add((k, item, diagonal))
        found = index.overlap(flat[first : first + n], item, diagonal)
        if found and (item not in out[k] or (found[2], -found[0]) > (out[k][item][2], -out[k][item][0])):
            out[k][item] = found
    return out


def item_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, class_id, n_items: items of the same words are one class, named by its least id (null if all ids are)."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+", " ")), " ")
    rows = benchmark.select(F.col(id_col).try_cast("long").alias("item_id"), F.sha2(F.array_join(words, " "), 256).alias("w"))
    by = rows.groupBy("w").agg(F.min("item_id").alias("class_id"), F.count("*").alias("n_items"))
    return rows.join(by, "w").select("item_id", "class_id", "n_items")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The classes of the benchmark with their words, in bounded blocks: (least id, number of items) of each."""
    hashes, ids, words, total = PlainWords(), [], [], 0
    items = benchmark.select(F.col(id_col).try_cast("long").alias("i"), F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+", " ").alias("t"))
    classes = items.groupBy(F.trim("t").alias("t")).agg(F.min("i").alias("i"), F.count("*").alias("n"))
    for row in classes.toLocalIterator():
        own = hashes.array(row["t"].encode().lower().split())
        if words and total + len(own) > BLOCK_WORDS:
            yield ids, words
            ids, words, total = [], [], 0
        ids.append((row["i"], row["n"]))
        words.append(own)
        total += len(own)
    if words:
        yield ids, words


PAIRS = "doc_id long, item_id long, n_items long, doc_word long, overlap_words int, equal_words int, similarity double"


def _found(rows: DataFrame, sent, key: str, kind: str) -> DataFrame:
    """key and what PAIRS has beside the document, for every row (key, text) and class of one block that share an overlap."""
    names = [key, *(c.split()[0] for c in PAIRS.split(", ")[1:])]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = Index(*sent.value), PlainWords()
        for batch, texts in chunks(batches, "text"):
            keys = batch.column(0).to_pylist()
            found = [(keys[k], *index.ids[i], s, n, e, e / n) for k, own in enumerate(_matches(index, texts, hashes)) for i, (s, n, e) in own.items()]
            if found:
                types = (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    return rows.mapInArrow(search, f"{key} {kind}, {PAIRS.split(', ', 1)[1]}")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """PAIRS: every document and class of items that share an overlap, with the best one. item_id is the class (see item_classes).

    Each block of the benchmark is a pass whose pairs are written before its broadcast is given up.
    """
    spark, out = docs.sparkSession, None
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for k, block in enumerate(_blocks(benchmark, item_col, item_text)):
        sent = spark.sparkContext.broadcast(block)
        found = scratch.table(_found(rows, sent, "doc_id", "long"), f"pairs_{k}")
        sent.destroy()
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], PAIRS) if out is None else out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, whole and unchanged, that share no overlap with any item.

    A benchmark of one block is looked up as the rows pass; of several, each block's hits are written by a hash of id and text, and the
    rows that are hit go by one join.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_col, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        sent = spark.sparkContext.broadcast(first)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, hashes = Index(*sent.value), PlainWords()
            for batch, texts in chunks(batches, text_col):
                yield batch.filter(pa.array([not own for own in _matches(index, texts, hashes)], pa.bool_()))

        return docs.mapInArrow(clean, docs.schema)
    scratch, hit = Scratch(spark), None
    rows = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    for k, block in enumerate(chain((first, second), blocks)):
        sent = spark.sparkContext.broadcast(block)
        found = scratch.table(_found(rows, sent, "row", "string").select("row").distinct(), f"hit_{k}")
        sent.destroy()
        hit = found if hit is None else hit.union(found)
    left = docs.select(whole(docs).alias("_dc_in"), row_key(id_col, text_col).alias("_dc_row")).join(hit.select(F.col("row").alias("_dc_row")), "_dc_row", "left_anti")
    return left.select(*restored("_dc_in", docs.columns))


def op8_spaced_seed_decontamination(spark, sf_dir):
    """All documents against the whole benchmark."""
    return contaminated_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_spaced_seed_decontamination": op8_spaced_seed_decontamination}
SQL: dict[str, str] = {}
