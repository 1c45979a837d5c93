"""Hard negatives and vector codes against brute force in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import heap_lloyd, voronoi
from glossa.llm.heap_lloyd import Codec
from glossa.llm.voronoi import hard_negatives

KIND = "vec_id long, embedding array<float>, label int, row string, score double, cell int"


def vectors(rng, n, dim=16, labels=3):
    """Rows with ties, a vector that a third of them share, nulls, unusable vectors, repeated rows and short vectors."""
    common = [rng.gauss(0, 1) for _ in range(dim)]
    rows = []
    for i in range(n):
        v = list(common) if i % 3 == 0 else [rng.choice([-1.0, -0.5, 0.25, 1.0]) if i % 5 == 0 else rng.gauss(0, 1) for _ in range(dim)]
        rows.append((i, v, rng.randrange(labels)))
    rows += [rows[10], rows[50], (None, rows[4][1], 1), (n, None, 1), (n + 1, rows[3][1], None), (n + 2, [float("nan")] * dim, 1), (n + 3, [float("inf")] + [0.0] * (dim - 1), 2)]
    rows += [(n + 4, [None] + [1.0] * (dim - 1), 0), (n + 5, [1.0, 2.0], 2), (n + 6, [], 1), (50 * n, rows[7][1], 0)]
    return [(*r, "x", 0.5, 7) for r in rows]


def numbers(v, dim):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dim - len(v))


def mined(rows, dim, every):
    known = [(k, i, lab, w) for k, (i, v, lab, *_) in enumerate(rows) if lab is not None and (w := numbers(v, dim)) is not None]
    out = []
    for k, i, lab, w in known:
        if i is None or i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(w, x)), j is None, j or 0, m, lj) for m, j, lj, x in known if m != k))
        for s, none, j, _, lj in [p for p in scored if p[4] == lab][:5]:
            p = -s
            hits = [(q, n2, j2) for q, n2, j2, _, l2 in scored if l2 != lab and 50 * p <= -100 * q <= 95 * p][:3]
            out += [(i, None if none else j, r + 1, None if n2 else j2, p, -q) for r, (q, n2, j2) in enumerate(hits)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many cells, blocks, groups and parts
        for name, value in {"PIVOTS": 8, "PER_PIVOT": 10, "LANDMARKS": 20, "BLOCK": 7, "PACK": 5, "PART": 2}.items():
            monkeypatch.setattr(voronoi, name, value)
    rows = vectors(random.Random(3), 240)
    found = hard_negatives(spark.createDataFrame(rows, KIND).repartition(3), F.col("vec_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(found.dtypes)["rank"] == "int"
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(mined(rows, 16, 10), key=key)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives(spark.createDataFrame([], KIND), F.col("vec_id") % 10 == 0).collect() == []
    alone = [(0, [1.0], 1, "", 0.0, 1), (1, [1.0], 2, "", 0.0, 1)]
    assert hard_negatives(spark.createDataFrame(alone, KIND), F.col("vec_id") % 10 == 0).collect() == []


def test_scores_beyond_doubles(spark):
    """Products above 2^53 are compared exactly; larger components are held."""
    rows = [(0, [3e5, 1.0], 1), (1, [3e5, 2.0], 1), (2, [2e5, 0.5], 2), (3, [2e5, 0.25], 2), (4, [1e30, 0.0], 3)]
    found = hard_negatives(spark.createDataFrame([(*r, "", 0.0, 1) for r in rows], KIND), F.col("vec_id") == 0).collect()
    dot = lambda a, b: sum(math.floor(256 * float(np.float32(x))) * math.floor(256 * float(np.float32(y))) for x, y in zip(rows[a][1], rows[b][1]))
    assert [(r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found] == [(1, 1, 2, dot(0, 1), dot(0, 2)), (1, 2, 3, dot(0, 1), dot(0, 3))]


def lloyd(rows, parts, entries, rounds):
    dim = max([len(r[1]) for r in rows if numbers(r[1], 1000)] + [parts])
    dim = -(-dim // parts) * parts
    width = dim // parts
    known = [(i, lab, w) for i, v, lab, *_ in rows if (w := numbers(v, dim)) is not None]
    seeds = sorted(known, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], np.int32).tobytes()))[:entries]
    cut = lambda w: [tuple(w[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(w)[p] for _, _, w in seeds] for p in range(parts)]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (off(x, books[p][e]), e)) for p, x in enumerate(cut(w))] for _, _, w in known]
    for _ in range(rounds):
        code = near()
        for p in range(parts):
            for e in range(len(seeds)):
                own = [cut(w)[p] for (_, _, w), c in zip(known, code) if c[p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    code = near()
    error = [sum(off(x, books[p][c[p]]) for p, x in enumerate(cut(w))) for (_, _, w), c in zip(known, code)]
    of = {}
    for (_, lab, _), e in zip(known, error):
        of[lab] = of.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e in c), e, of[lab], digest) for (i, lab, _), c, e in zip(known, code, error)]


@pytest.mark.parametrize("rounds, entries", [(0, 8), (1, 8), (6, 12), (2, 400)])
def test_codes(spark, rounds, entries):
    if entries > 255:
        entries = 64
    rows = vectors(random.Random(rounds), 150)
    made = Codec(spark.createDataFrame(rows, KIND).repartition(3), parts=4, entries=entries, rounds=rounds)
    found = sorted(map(tuple, made.coded().collect()), key=repr)
    assert found == sorted(lloyd(rows, 4, entries, rounds), key=repr)


def test_codes_of_few_and_of_nothing(spark):
    rows = [(1, [1.0] * 5, 1, "", 0.0, 1), (1, [1.0] * 5, None, "", 0.0, 1), (None, [2.0] * 5, None, "", 0.0, 1)]
    assert sorted(map(tuple, Codec(spark.createDataFrame(rows, KIND)).coded().collect()), key=repr) == sorted(lloyd(rows, 16, 64, 2), key=repr)
    assert Codec(spark.createDataFrame([], KIND)).coded().collect() == []


def test_heaps_pop_violated_parts_only():
    """After the entries have moved, parts with room to spare aren't scanned, and all codes are as a full scan finds them."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 20, (500, 4)) for c in (-3000, 0, 3000)]).astype(np.int64)
    book = np.array([[-3100] * 4, [10] * 4, [2900] * 4, [2950] * 4])
    code, key, all_ = heap_lloyd.assign(x, book, np.zeros(4), None, None)
    drift = np.zeros((1, 4))
    for _ in range(5):
        new = book + rng.integers(-15, 15, book.shape)
        drift += heap_lloyd.moved(book[None], new[None])
        book = new
        code, key, scanned = heap_lloyd.assign(x, book, drift[0], code, key)
        assert (code == heap_lloyd.scan(x, book)[0]).all()
        assert scanned < all_
    heaps = heap_lloyd.Heaps(np.array([0, 1, 0, 1]), np.array([5.0, 1.0, 2.0, 9.0]), 3)
    assert sorted(heaps.pop(np.array([2.0, 3.0, 100.0]))) == [1, 2]
