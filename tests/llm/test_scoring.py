import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import ppm


def ppm_brute(train: list[bytes], text: bytes, order: int) -> float:
    """PPM by dictionaries and one symbol at a time."""
    table: dict[int, dict[bytes, Counter]] = {k: {} for k in range(order + 1)}
    for t in train:
        data = bytes([ppm.START]) * order + t + bytes([ppm.END])
        for i in range(order, len(data)):
            table[order].setdefault(data[i - order : i], Counter())[data[i]] += 1
    for k in range(order - 1, -1, -1):  # how many longer contexts saw the symbol
        for context, seen in table[k + 1].items():
            for s in seen:
                table[k].setdefault(context[1:], Counter())[s] += 1
    data, total = bytes([ppm.START]) * order + text + bytes([ppm.END]), 0.0
    for i in range(order, len(data)):
        gone: set[int] = set()
        for k in range(order, -1, -1):
            seen = table[k].get(data[i - k : i])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in gone}
            if not left:
                continue
            n = sum(left.values())
            if data[i] in left:
                total += math.log10((left[data[i]] - ppm.DISCOUNT) / n)
                break
            total += math.log10(ppm.DISCOUNT * len(left) / n)
            gone |= set(seen)
        else:
            total -= math.log10(max(1, ppm.SYMBOLS - len(gone)))
    return total


def test_scores_match_brute_force(docs, corpus):
    got = ppm.Trainer(docs, ppm.remainder("doc_id", 7) != 2, order=3).score().collect()
    is_train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    texts = [(i, (t or "").encode().lower()) for i, t, *_ in corpus]
    train = [t for i, t in texts if is_train(i)]
    counts = Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        w = [*t.split(), b""]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[(i, is_train(i), len(w), sum(counts[x] > 0 for x in w), round(base, 4), round(ppm_brute(train, t, 3), 2))] += 1
    assert Counter((r["doc_id"], r["train"], r["n_tokens"], r["n_known"], round(r["base_score"], 4), round(r["score"], 2)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}


def test_probabilities_sum_to_one():
    train = [b"abracadabra", b"abc", b"cab"]
    g, _ = ppm.grams(train, 3)
    key, count = np.unique(g, return_counts=True)
    for context in np.unique(np.append(key >> np.uint64(8), [np.uint64(0x7A7A7A)])):
        asked = (context << np.uint64(8)) + np.arange(256, dtype=np.uint64)[np.arange(256) != ppm.START]
        every = np.union1d(key, asked)
        n = np.zeros(len(every), np.int64)
        n[np.searchsorted(every, key)] = count
        one = np.zeros((256, 256))
        for x in np.unique(key & np.uint64(0xFFFFFF)):
            one[int(x >> np.uint64(8)) & 255, int(x) & 255] += 1
        p = ppm.log_probabilities(every, n, one, 3)
        assert abs((10 ** p[np.searchsorted(every, asked)]).sum() - 1) < 1e-9


def test_nothing_to_score_or_learn(docs, nothing):
    assert ppm.Trainer(nothing, F.lit(True)).score().count() == 0
    rows = ppm.Trainer(docs.limit(4), F.lit(False)).score().collect()
    assert len(rows) == 4 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in rows)


def test_more_text_predicts_better(spark):
    import random

    rng = random.Random(2)
    make = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))
    df = spark.createDataFrame([(i, make()) for i in range(80)], "doc_id long, text string")
    rows = ppm.Trainer(df, F.col("doc_id") >= 20).score().filter("NOT train").collect()
    assert len(rows) == 20 and sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows) > -0.8


def test_every_row_comes_back_with_its_id(spark):
    rows = [(None, "b c"), (3, "a b"), (-1, None), (None, "a"), (3, "a")]
    got = ppm.Trainer(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), F.lit(True), order=2).score().collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len((t or "").split()) + 1) for i, t in rows)


@pytest.mark.parametrize("text", [b"", b"x", b"abcabc"])
def test_grams_cover_every_symbol(text):
    g, n = ppm.grams([text], 4)
    assert len(g) == len(text) + 1 == n[0] and int(g[-1]) & 255 == ppm.END
