import fnmatch
import random
import re
import zlib

import numpy as np
import pytest

from glossa.llm import decontaminate, labelled, quality, toxicity, url_filter
from glossa.llm.common import WordHashes

# URL filter


def test_automaton_matches_globs():
    rng = random.Random(2)
    globs = ["*abc*", "a*b*c", "abc", "*", "a?c*", "", "*ab*ab*", "x" * 70 + "*", "*" + "ab" * 40 + "*"]
    machine = url_filter.ShiftAnd([g.encode() for g in globs])
    texts = ["".join(rng.choice("abcx") for _ in range(rng.randrange(12))) for _ in range(300)] + ["", "x" * 70, "x" * 75, "c" + "ab" * 40 + "c", "abab"]
    got = machine.run([t.encode() for t in texts])
    for t, row in zip(texts, got):
        assert [bool(x) for x in row] == [bool(re.fullmatch(fnmatch.translate(g), t)) for g in globs], t


def test_long_urls(spark):
    """A text is judged alike alone and with others, and a megabyte takes less than a second."""
    import time

    machine = url_filter.ShiftAnd([b"*ab" * 30 + b"*", b"*abc*", b"x" * 70 + b"*", b"*z"])
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcxz") for _ in range(rng.randrange(200))).encode() for _ in range(50)] + [b"x" * 80, b"ab" * 40]
    assert [machine._alone(t) for t in texts] == [list(map(bool, r)) for r in machine._together(texts)]
    began = time.time()
    url = "http://a.net/es/" + "p" * 1_000_000
    assert url_filter.ShiftAnd([b"*.net\xff/es/*"]).run([b".a.net\xff" + url[12:].encode(), b".a.net\xff/"])[:, 0].tolist() == [True, False]
    assert time.time() - began < 2
    rows = url_filter.judge_urls(spark.createDataFrame([(1, url), (None, "http://b.net/fr/x")], "page_id long, url string"), url_filter.RULES).collect()
    assert sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in rows) == [(0, "net/fr/", "block"), (1, "net/es/", "block")]


def judge_brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: len(f[1]), default=None)
    return host, path, best and best[1], best[0] if best else url_filter.DEFAULT


def test_urls(spark):
    urls = [
        None, "", "x", "http://", "http://com/", "http://a.com", "http://a.COM/x?y=/z", "https://WWW.Example.com/en/1#t", "http://example.com/en/", "http://m.example.com/en/a", "http://badexample.com/en/",
        "http://a.net/es/1", "http://a.net/fr", "http://a.net/fr/", "ftp://net/es/", "http://a.org/x.com/", "http://a.org?://b.com/", "http://é.com/ü", "://x.net/es/?q", "http://www.example.com/en/", "http://x.www.example.com/en/z",
    ]
    df = spark.createDataFrame([(i, u, "h", "host") for i, u in enumerate(urls)] + [(3, urls[3], "h", "host")], "page_id long, url string, html string, host string")
    rows = url_filter.judge_urls(df, url_filter.RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert tuple(r)[1:] == judge_brute(urls[r["page_id"]]), urls[r["page_id"]]
    assert url_filter.judge_urls(df.limit(0), url_filter.RULES).count() == 0


# decontamination


@pytest.fixture(scope="module")
def items():
    rng = random.Random(8)
    return [(i, " ".join(f"b{rng.randrange(3000)}" for _ in range(rng.randrange(15, 60)))) for i in range(12)] + [(50, None), (51, ""), (52, "the of"), (53, "five short words are here"), (3, "b1 b2 b3 b4 b5 b6 b7")]


def plain_words(text):
    strip = decontaminate.PUNCTUATION
    return [w.decode("utf-8", "replace").lower().strip(strip).encode() or w for w in (text or "").encode().lower().split()]


def best_overlap(words, own):
    """Over all alignments: the whole overlap if it agrees enough, else its best stretch; the most equal words, then the earliest."""
    best = None
    need = min(decontaminate.MIN_WORDS, len(own))
    for diagonal in range(-len(own), len(words)):
        a, b = max(0, -diagonal), min(len(own), len(words) - diagonal)
        same = [words[k + diagonal] == own[k] for k in range(a, b)]
        if len(same) < need:
            continue
        gain = lambda x, y: 5 * sum(same[x:y]) - 4 * (y - x)  # noqa: B023, E731
        if gain(0, len(same)) >= 0:
            found = (0, len(same))
        else:
            g, y, x = max((gain(x, y), -y, -x) for x in range(len(same)) for y in range(x + need, len(same) + 1))
            if g < 0:
                continue
            found = (-x, -y)
        got = (a + diagonal + found[0], found[1] - found[0], sum(same[found[0] : found[1]]))
        if best is None or (got[2], -got[0]) > (best[2], -best[0]):
            best = got
    return best


def pairs_brute(docs, items):
    classes = {}
    for i, t in items:
        classes.setdefault(" ".join((t or "").lower().split()), []).append(i)
    out = []
    for d, text in docs:
        words = plain_words(text)
        for t, ids in classes.items():
            own = plain_words(t)
            if len(own) >= decontaminate.LEAST and (found := best_overlap(words, own)):
                out.append((d, min((i for i in ids if i is not None), default=None), len(ids), *found, found[2] / found[1]))
    return sorted(out, key=repr)


def test_pairs_match_brute_force(spark, items, nothing):
    """The whole query against all alignments of all documents and items."""
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(300)}"
    bench = [*items, (60, items[0][1]), (61, items[0][1].upper()), (None, items[1][1]), (None, "only without any id here at all")]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(60)))) for k in range(30)] + [(None, None), (31, ""), (32, "a " * 3000)]
    for k in range(90):
        i, t = rng.choice(items)
        own = (t or "").split()
        x = rng.randrange(max(1, len(own) - 12)) if k % 3 == 0 else 0
        part = own[x : x + rng.randrange(10, 30)] if k % 3 == 0 else own
        part = [w if rng.random() > (0.25 if k % 2 else 0.1) else "zz" for w in part]
        docs.append((100 + k if k % 9 else None, " ".join([word() for _ in range(rng.randrange(20))] + ["(" + w + ")," if k % 5 == 0 else w for w in part] + [word() for _ in range(20)])))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, similarity int").repartition(3)
    table = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in decontaminate.contaminated_pairs(df, table).collect()), key=repr)
    want = pairs_brute(docs, bench)
    assert got == want and len(want) > 50
    clean = sorted((tuple(r) for r in decontaminate.without_benchmark(df, table).collect()), key=repr)
    hit = {t for d, t in docs if pairs_brute([(d, t)], bench)}
    assert clean == sorted(((d, t, "x", 1) for d, t in docs if t not in hit), key=repr) and len(clean) < len(docs) - 40
    members = sorted(map(tuple, decontaminate.item_classes(table).collect()), key=repr)
    assert (60, 0, 3) in members and (61, 0, 3) in members and len(members) == len(bench)
    assert decontaminate.contaminated_pairs(nothing, table).count() == 0 and decontaminate.contaminated_pairs(df, table.limit(0)).count() == 0
    assert decontaminate.without_benchmark(df, table.limit(0)).count() == len(docs)


def test_blocks_of_the_benchmark_give_the_same(spark, items, monkeypatch):
    bench = spark.createDataFrame(items, "item_id long, text string")
    planted = spark.createDataFrame([(i, f"pre {t} post") for i, t in items], "doc_id long, text string")
    whole = {tuple(r) for r in decontaminate.contaminated_pairs(planted, bench).collect()}
    clean = sorted((tuple(r) for r in decontaminate.without_benchmark(planted, bench).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    assert sorted((tuple(r) for r in decontaminate.without_benchmark(planted, bench).collect()), key=repr) == clean
    assert {tuple(r) for r in decontaminate.contaminated_pairs(planted, bench).collect()} == whole


def test_every_overlap_within_tolerance_is_found():
    """Spaced seeds against a comparison of every alignment."""
    rng = random.Random(6)
    hashes = decontaminate.PlainWords()
    item = [f"i{k}".encode() for k in range(40)]
    index = decontaminate.Index([1], [hashes.array(item)])
    missed = tried = 0
    for _ in range(300):
        w = [x if rng.random() > 0.15 else b"zz" for x in item]
        if sum(a == b for a, b in zip(w, item)) / 40 >= 0.8:
            tried += 1
            missed += not decontaminate._matches(index, [b"a b c " + b" ".join(w)], hashes)[0]
    assert tried > 150 and missed == 0


def test_stretches_of_long_items_are_found():
    """The overlap's best stretch against all stretches, where documents quote a part of a longer item."""
    rng = random.Random(9)
    own = np.arange(1, 41, dtype=np.uint64)
    index = decontaminate.Index([1], [own])
    found = 0
    for _ in range(3000):
        n = rng.randrange(13, 22)
        same = [rng.random() < 0.78 for _ in range(n)]
        at = rng.randrange(41 - n)
        words = np.zeros(40, np.uint64)
        words[at : at + n] = np.where(same, own[at : at + n], 0)
        equal = (words == own).tolist()
        gain = {(b, e): 5 * sum(equal[b:e]) - 4 * (e - b) for b in range(40) for e in range(b + 13, 41)}
        got = index.overlap(words, 0, 0)
        assert (got is not None) == (max(gain.values()) >= 0)
        if got:
            found += 1
            assert got[1] >= 13 and got[2] == sum(equal[got[0] : got[0] + got[1]]) and gain[got[0], got[0] + got[1]] == max(gain.values())
    assert 300 < found < 2900


def test_no_tolerated_pattern_is_without_a_seed():
    """Every choice of unequal words in stretches that hold no shorter one within the tolerance, and in whole short items."""
    from itertools import combinations

    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    assert max(m[-1] for m in masks) < decontaminate.SPAN
    for n, k in ((12, 2), (13, 2), (15, 3), (20, 4), (25, 5)):
        fits = [sum(1 << (i + s) for i in m) for m in masks for s in range(n - m[-1])]
        assert all(any(not f & sum(1 << i for i in out) for f in fits) for out in combinations(range(n), k)), n
    hashes = decontaminate.PlainWords()
    for n in range(5, 14):
        item = [f"i{i}".encode() for i in range(n)]
        index = decontaminate.Index([1], [hashes.array(item)])
        for k in range(n // 5 + 2):
            for out in combinations(range(n), k):
                text = b"a i1 b " + b" ".join(b"zz" if i in out else x for i, x in enumerate(item)) + b" c"
                found = decontaminate._matches(index, [text, b"i0"], hashes)
                assert bool(found[0]) == (k <= n // 5) and not found[1], (n, out)
                assert not found[0] or found[0][0] == (3, n, n - k)


# quality


def chain_brute(theta, move):
    import itertools

    n = len(theta)
    total, marginal = 0.0, np.zeros(n)
    for path in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(theta[i] for i in range(n) if path[i]) + sum(move[path[i], path[i + 1]] for i in range(n - 1)))
        total += w
        marginal += w * np.array(path)
    return marginal / total


def test_forward_backward():
    rng = np.random.default_rng(1)
    lines = np.array([3, 1, 5, 2])
    theta, move = rng.normal(size=11), rng.normal(size=(2, 2))
    p, at, both = quality.Chains(lines).run(theta, move, pairs=True)
    start = 0
    for n in lines:
        assert np.allclose(p[start : start + n], chain_brute(theta[start : start + n], move))
        start += n
    assert np.allclose(both.sum(axis=(1, 2)), 1) and np.allclose(both.sum(axis=1)[:, 1], p[at])


def test_line_features_do_not_depend_on_the_batch():
    texts = [b"", b"A b c.\nA b c.\n\n", "É x\tx x!!\nlast".encode(), b"one"]
    hashes = WordHashes()
    lines, size, x = quality.line_features(texts, hashes)
    assert lines.tolist() == [1, 4, 2, 1] and size.sum() == sum(len(t) + 1 for t in texts)
    alone = [quality.line_features([t], hashes)[2] for t in texts]
    assert np.allclose(x, np.concatenate(alone))


@pytest.fixture(scope="module")
def labelled_docs(spark):
    rng = random.Random(4)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "river", "runs", "slow", "and", "wide"]) for _ in range(12)).capitalize() + "." for _ in range(rng.randrange(1, 6)))
    bad = lambda: "\n".join(" ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "a|b", "###"]) for _ in range(9)) for _ in range(rng.randrange(1, 6)))
    ugly = lambda: good() + f" you are an {rng.choice(['oaf', 'blorkish', 'blorkable', 'twerp'])}"
    rows, labels = [], []
    for i in range(400):
        kind = rng.choice(["good", "good", "bad", "ugly"])
        rows.append((i, {"good": good, "bad": bad, "ugly": ugly}[kind](), "en", "s", 0.0))
        labels.append((i, int(kind != "bad"), int(kind == "ugly")))
    rows += [(900, None, "en", "s", 0.0), (901, "", "en", "s", 0.0), (902, good(), None, None, 0.0), (902, rows[0][1], "en", "s", 0.0)]
    labels += [(5000, 1, 1), (None, 0, 0), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


@pytest.mark.parametrize("what", ["quality", "toxic"])
def test_held_out_accuracy(labelled_docs, what):
    docs, labels = labelled_docs
    if what == "quality":
        rows = quality.score_quality(docs, quality.train_quality(docs, labels))
    else:
        scored = toxicity.with_toxicity(docs.select("doc_id", labelled.held_out("doc_id").alias("held_out"), "text"), toxicity.train_toxicity(docs, labels))
        rows = scored.selectExpr("doc_id", "held_out", "score", "cast(score >= 0.5 as int) predicted")
    rows = rows.collect()
    assert len(rows) == 404 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    truth = {r["doc_id"]: r[what] for r in labels.collect() if r[what] is not None}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.97


def test_held_out_labels_are_not_read(labelled_docs):
    from pyspark.sql import functions as F

    docs, labels = labelled_docs
    turned = labels.withColumn("quality", F.when(labelled.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score_quality(docs, quality.train_quality(docs, x)).orderBy("doc_id", "score").collect() for x in (labels, turned))
    assert a == b
    turned = labels.withColumn("toxic", F.when(labelled.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.with_toxicity(docs, toxicity.train_toxicity(docs, x)).orderBy("doc_id", "score").collect() for x in (labels, turned))
    assert a == b


def test_no_labels(labelled_docs, nothing):
    docs, labels = labelled_docs
    none = labels.limit(0)
    assert len({r["score"] for r in quality.score_quality(docs, quality.train_quality(docs, none)).collect()}) == 1
    assert len({r["score"] for r in toxicity.with_toxicity(docs, toxicity.train_toxicity(docs, none)).collect()}) == 1
    assert quality.score_quality(nothing, quality.train_quality(docs, labels)).count() == 0


# the toxicity grammar


def matched(text: str, oaf: float = 1.0) -> dict:
    model = toxicity.Model({"oaf$": oaf, "blor": 1.0}, np.zeros(len(toxicity.KINDS) + 1))
    sums = model.sums([text.encode()], model.machine())[0]
    return {k: v for k, v in zip(toxicity.KINDS, sums.tolist()) if v}


def test_weights_stand_on_the_arcs():
    """A match carries the weight of its insult, also where a target completes it later or another insult came between."""
    assert matched("what an oaf", 0.25) == {"insult": 0.25} and matched("you oaf", 0.25) == {"insult": 0.25, "targeted": 0.25}
    assert matched("an oaf like you", 0.25) == {"insult": 0.25, "targeted": 0.25} and matched("not an oaf", 0.25) == {"negated": 0.25}
    assert matched("he said that oaf", 0.25) == {"reported": 0.25} and matched("oaf blorkish you", 0.25) == {"insult": 1.25, "targeted": 1.0}
    assert matched("blorkish oaf you", 0.25) == {"insult": 1.25, "targeted": 0.25} and matched("destroy you oaf", 0.25) == {"threat": 1.0, "insult": 0.25, "targeted": 0.25}
    assert [toxicity.level(w) for w in (0.01, 0.125, 0.13, 0.9, 1.0)] == [0, 0, 1, 7, 7]


@pytest.mark.parametrize("text,kinds", [
    ("what an oaf.", {"insult": 1}), ("you oaf", {"insult": 1, "targeted": 1}), ("an oaf like you", {"insult": 1, "targeted": 1}), ("not an oaf", {"negated": 1}),
    ("not so. Oaf", {"insult": 1}), ("he said that oaf", {"reported": 1}), ("never said blorkish things", {"negated": 1}), ("she wrote: nothing. Said blorkish things", {"reported": 1}), ("I will destroy you", {"threat": 1}),
    ("I will not destroy you", {"negated": 1}), ("destroy the wall", {}), ("oafish", {}), ("OAF, oaf!", {"insult": 2}), ("nothing here", {}), ("", {}),
])
def test_clauses(text, kinds):
    assert matched(text) == kinds


def test_composition_is_running_one_after_the_other():
    rng = random.Random(3)
    step, writes = toxicity.grammar()
    machines = toxicity.parts()
    for _ in range(200):
        states, whole = [0] * 4, 0
        for x in (rng.randrange(toxicity.READ) for _ in range(30)):
            y, weight = x, 1.0
            for k, t in enumerate(machines):
                states[k], y, w = t.moves[states[k], y]
                weight *= w
            assert writes[whole][x] == (y, weight)
            whole = step[whole][x]
