"""MinHash near-duplicates against all pairs, on documents with hot groups, nulls, ties and long texts."""

import random

import numpy as np
import pytest

from glossa.llm import bayes_minhash
from glossa.llm.bayes_minhash import CUTS, HASHES, MISS, least_matches, minima, near_duplicates, survivors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, n double, words string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))



def brute(rows):
    """doc_id, n_shingles, component_id, kept of rows (doc_id, text)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = (t or "").translate(lower).split()
        sets.append(frozenset() if not w else frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))))
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                head[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)), d is not None and d == least[find(i)]) for i, (d, _) in enumerate(rows)]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
    return " ".join(w)


def checked(spark, rows):
    found = near_duplicates(spark.createDataFrame([(d, t, "en", "a", 1, k, 0.5, "x") for k, (d, t) in enumerate(rows)], DOCS).repartition(3))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("tile", [1024, 6])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(bayes_minhash, "TILE", tile)
    rng = random.Random(tile)
    base = [words(rng, rng.randrange(40, 200), 3000) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    # a hot group whose members are from nearly equal to too far, and chains of edits
    rows += [(1000 + i, edited(rng, base[0], rng.randrange(0, 14))) for i in range(60)]
    for k in range(1, 6):
        t = base[k]
        for i in range(8):
            t = edited(rng, t, 2)
            rows.append((2000 + 10 * k + i, t))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "é ÉÀ ß 漢字 Abc ABC"), (104, base[3].upper()), (105, "one"), (106, "ONE"), (107, "one two"), (108, "a a a a " * 40), (109, "a a a")]
    rows += [(7, base[7]), (None, base[8]), (None, None), (None, "only here " * 9), (None, "only here " * 9), (110, words(rng, 20_000, 9000))]
    rows.append((111, edited(rng, rows[-1][1], 300)))
    checked(spark, rows)


def test_a_third_shares_one_text(spark):
    rng = random.Random(2)
    rows = [(None if i % 2 else i, "the same words for all of them") for i in range(100)] + [(1000 + i, words(rng, 50)) for i in range(200)]
    checked(spark, rows)


def test_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_posterior_bounds():
    """What a batch prunes can't be a link with more than the chosen probability; a link of the least similarity passes all batches in nearly all draws."""
    for n, least in CUTS:
        s = np.linspace(0.0005, 0.9995, 1000)
        weight = s ** (least - 1) * (1 - s) ** (n - least + 1)
        assert weight[s >= 0.85].sum() / weight.sum() < MISS * 1.1
    assert least_matches(32, 0.5) > least_matches(32, 1e-9)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (2000, HASHES), dtype=np.uint8)
    same = rng.random(a.shape) < 0.85
    b = np.where(same, a, rng.integers(0, 256, a.shape, dtype=np.uint8)).astype(np.uint8)
    x = np.arange(2000)
    assert len(survivors(a, b, x, x)) == 2000
    far = np.where(rng.random(a.shape) < 0.4, a, rng.integers(0, 256, a.shape, dtype=np.uint8)).astype(np.uint8)
    assert len(survivors(a, far, x, x)) < 5


def test_minima_estimate_similarity():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        both, n = rng.integers(0, 1 << 63, 1000, dtype=np.uint64), int(1000 * share)
        a, b = np.unique(both), np.unique(np.concatenate([both[:n], rng.integers(0, 1 << 63, 1000 - n, dtype=np.uint64)]))
        want = n / (2000 - n)
        assert abs((minima(a) == minima(b)).mean() - want) < 0.1
