import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from glossa.llm import debruijn, simhash, sketches
from glossa.llm.common import Scratch
from glossa.llm.components import components


def split(text) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def dedup_brute(rows):
    """Rows of one id, or of none, follow their texts' hashes; equal rows are interchangeable."""
    first, n = {}, debruijn.WINDOW
    signed = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1])))
    for k, (_, t) in enumerate(rows):
        w = split(t)
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), (k, s))
    out = Counter()
    for k, (i, t) in enumerate(rows):
        w, gone = split(t), set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (k, s):
                gone.update(range(s, s + n))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_dedup_where_a_third_has_no_id(spark):
    """Rows without id are documents of their own: work follows the rows, and long texts and repeated rows are taken whole."""
    rng = np.random.default_rng(4)
    text = lambda n, v: " ".join(f"u{rng.integers(0, v)}" for _ in range(n))
    hot, long = text(70, 5000), text(20_000, 90_000)
    rows = [(None, hot)] * 150 + [(i, text(60, 5000)) for i in range(300)] + [(7, hot), (7, hot), (301, long), (None, " ".join(long.split()[5000:15_000]))]
    graph = debruijn.Graph(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in graph.kept().collect())
    assert got == dedup_brute(rows)
    assert graph.spans().count() <= len(rows)
    assert {(r["source_doc"], r["source_start"]) for r in graph.repeats().collect()} == {(7, 0), (301, 5000)}


def test_substring_dedup_matches_brute_force(docs, corpus, nothing):
    graph = debruijn.Graph(docs)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in graph.kept().collect())
    assert got == dedup_brute([(i, t) for i, t, *_ in corpus])
    distinct = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    text = {r["doc_id"]: split(r["text"]) for r in distinct.collect()}
    spans = debruijn.Graph(distinct).repeats().collect()
    assert len(spans) > 4
    for r in spans:
        own, source = text[r["doc_id"]][r["start"] :][: r["words"]], text[r["source_doc"]][r["source_start"] :][: r["words"]]
        assert own == source and len(own) == r["words"] >= debruijn.WINDOW and (r["source_doc"], r["source_start"]) < (r["doc_id"], r["start"])
    assert len({(r["doc_id"], r["path"]) for r in spans if r["doc_id"] > 110 and r["source_doc"] == 110}) == 4
    assert debruijn.Graph(nothing).kept().count() == 0


def test_paths_of_the_graph_match_brute_force(spark, monkeypatch):
    """Pieces and the paths they are strung to, against a graph built from dictionaries."""
    monkeypatch.setattr(debruijn, "CHUNK_BYTES", 700)
    rng = np.random.default_rng(8)
    word = lambda: f"v{rng.integers(0, 5000)}"
    long = [word() for _ in range(120)]
    rows = [(i, " ".join([word() for _ in range(5)] + long[x:y] + [word() for _ in range(5)])) for i, (x, y) in enumerate([(0, 60), (40, 120), (0, 120), (20, 100), (0, 45), (70, 120), (10, 40)])]
    rows += [(20 + k, " ".join(["loop"] * n)) for k, n in enumerate((30, 25))] + [(30, " ".join(long[50:80] + long[:30])), (31, " ".join(long[50:80] + long[:30]))]
    graph = debruijn.Graph(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    pieces = graph.pieces(graph._listed().filter("kind = 'run'").select("run", "doc", "place", "n", "nodes")).collect()
    n, times, source = debruijn.WINDOW, Counter(), {}
    for i, t in rows:
        w = split(t)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            times[k] += 1
            source[k] = min(source.get(k, (i, s)), (i, s))
    edges = [k for k, c in times.items() if c > 1]
    out, into = Counter(k[:-1] for k in edges), Counter(k[1:] for k in edges)
    at = {source[k]: k for k in edges}
    covered = Counter((r["doc"], r["place"] + j) for r in pieces for j in range(r["n"]))
    assert covered == Counter(at.keys())
    through = lambda node: out[node] == 1 and into[node] == 1
    place = {}
    for r in pieces:
        for j in range(r["n"]):
            k = at[r["doc"], r["place"] + j]
            place[k] = (r["path"], r["offset"] + j)
            assert j == 0 or through(k[:-1])
    by_node = {k[:-1]: k for k in edges}
    for k in edges:
        after = by_node.get(k[1:])
        if after and through(k[1:]) and after != k:
            assert place[after] == (place[k][0], place[k][1] + 1)
    ends = Counter(p for p, _ in place.values())
    heads = [k for k in edges if not through(k[:-1]) or by_node[k[:-1]] == k]
    assert len(ends) == len({place[k][0] for k in heads})


def test_colliding_names_never_cost_a_word(docs, corpus, monkeypatch):
    """If nearly all windows share their names, the digests of the words still stop every wrong removal."""

    class Alike(debruijn.Windows):  # pickled with its code, so that workers use it
        def names(self, starts):
            a, b = super(Alike, self).names(starts)
            return a % np.uint64(2), b % np.uint32(2)

    monkeypatch.setattr(debruijn, "Windows", Alike)
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in debruijn.Graph(docs).kept().collect()}
    want = {(i, n): gone for i, n, gone, _ in dedup_brute([(i, t) for i, t, *_ in corpus])}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in want) and 0 < sum(got.values()) < sum(want.values())


def test_dedup_in_many_chunks(docs, corpus, monkeypatch):
    monkeypatch.setattr(debruijn, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(debruijn, "BUCKET_BYTES", 4000)
    texts = debruijn.Graph(docs).kept(texts=True)
    rows = texts.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == dedup_brute([(i, t) for i, t, *_ in corpus])
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)


def fingerprint_brute(text) -> int:
    w = split((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64)) if h else 0


def groups_brute(rows):
    fps = [(i, fingerprint_brute(t)) for i, t in rows]
    parent = {f: f for _, f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    every = sorted(parent)
    for a in every:
        for b in every:
            if a < b and (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in fps)


def test_simhash_matches_brute_force(docs, corpus, nothing):
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == groups_brute([(i, t) for i, t, *_ in corpus])
    assert simhash.near_duplicates(nothing).count() == 0


def test_balls_link_exactly_what_is_near(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(map(int, centres))
    for c in map(int, centres[:25]):
        for k in range(1, 12):
            bits = rng.choice(64, size=int(rng.integers(1, 7)), replace=False)
            fps.add(c ^ sum(1 << int(b) for b in bits))
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    near = simhash.may_have_partners(df)
    scratch = Scratch(spark)
    links = simhash.ball_links(near, near.count())
    roots = {r["node"]: r["root"] for r in components(links, scratch).collect()}
    got = {}
    for f in signed:
        got.setdefault(roots.get(f, f), set()).add(f)
    parent = {f: f for f in signed}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                parent[find(a)] = find(b)
    want = {}
    for f in signed:
        want.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_document_of_each_group_stays(docs, corpus):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for (_, _, c) in groups_brute([(i, t) for i, t, *_ in corpus])}
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_documents_without_an_own_id_stay(spark):
    """Components are told apart by their fingerprints, where ids are null or repeated."""
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 400, 60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, a), (None, b), (None, c), (None, d), (9, d), (5, e), (5, f), (5, e), (6, e)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, kept)) == Counter([(None, a), (None, b), (None, c), (9, d), (5, e), (5, f)])


def jaccard(a, b) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (split(a.lower()), split(b.lower())))
    return len(x & y) / len(x | y) if x | y else 1.0


def near_copies(seed: int):
    """Texts with some words edited, short and long, in groups and alone."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 3000)}"
    rows = [(900, ""), (901, None), (902, "one"), (903, "One "), (904, "one two")]
    for g in range(60):
        base = [word() for _ in range(int(rng.integers(12, 200)))]
        for k in range(int(rng.integers(1, 9))):
            own = list(base)
            for at in rng.choice(len(own), int(rng.integers(0, 1 + len(own) // 30 + (k > 0))), replace=False) if k else []:
                own[at] = word()
            rows.append((10 * g + k, " ".join(own)))
    return rows


def roots_of(ids, linked):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in linked:
        x, y = sorted((find(i), find(j)))
        parent[y] = x
    return {find(i) for i in ids}


def test_near_copies_of_the_pipeline_are_those_of_similarity(spark, tmp_path):
    """The stage against all pairs: exactly those that its rule links, and nearly all that are similar."""
    rows = near_copies(12)
    hashes = sketches.WordHashes()
    signs = sketches.sketches([sketches.shingles(hashes.array((t or "").lower().encode().split())) for _, t in rows]).view(np.uint32)
    apart = lambda m, n: np.array([int(v).bit_count() for v in signs[m] ^ signs[n]])
    alike = [(m, n) for m, (_, a) in enumerate(rows) for n, (_, b) in enumerate(rows[:m]) if jaccard(a or "", b or "") >= 0.8]
    ruled = [(m, n) for m, n in alike if apart(m, n).min() <= 2 and apart(m, n).sum() <= sketches.MAX_DISTANCE]
    pairs = lambda found: [(rows[m][0], rows[n][0]) for m, n in found]
    ids = [i for i, _ in rows]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path))
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == roots_of(ids, pairs(ruled))
    assert len(ruled) >= 0.95 * len(alike) and len(got) < len(rows) - 60


def test_recall_at_the_least_similarity(spark):
    """Pairs of texts that are just similar enough, each apart from all others: nine in ten are found at least, and no pair that isn't."""
    rng, pairs = np.random.default_rng(21), []
    while len(pairs) < 400:
        base = [f"p{len(pairs)}x{k}" for k in rng.integers(0, 4000, 150)]
        other = list(base)
        for at in rng.choice(150, int(rng.integers(3, 5)), replace=False).tolist():
            other[at] = f"q{at}"
        pairs.append((" ".join(base), " ".join(other)))
    near = [jaccard(a, b) for a, b in pairs]
    assert sum(0.8 <= s < 0.85 for s in near) > 100 and sum(s < 0.8 for s in near) > 50
    rows = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    kept = {r["doc_id"] for r in sketches.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    least = [2 * k + 1 not in kept for k, s in enumerate(near) if 0.8 <= s < 0.85]
    assert np.mean(least) >= 0.9
    assert all(2 * k + 1 in kept for k, s in enumerate(near) if s < 0.8) and all(2 * k in kept for k in range(len(near)))


def test_cells_meet_exactly_within_two_bits(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 32, 30, dtype=np.uint64)
    values = {int(b) ^ sum(1 << int(x) for x in rng.choice(32, int(rng.integers(0, 5)), replace=False)) for b in base for _ in range(20)}
    cells = [k << 32 | v for k in (0, 1, 19) for v in values]
    want = {(a, b) for a in cells for b in cells if a < b and a >> 32 == b >> 32 and (a ^ b).bit_count() <= 2}
    for bucket in (1 << 19, 1 << 9):
        sketches.BUCKET, old = bucket, sketches.BUCKET
        try:
            rows = sketches.meetings(spark.createDataFrame([(c,) for c in cells], "cell long").repartition(4), len(cells)).collect()
        finally:
            sketches.BUCKET = old
        around = {}
        for value, cell, least in map(tuple, rows):
            around.setdefault(value, []).append(cell)
            assert (value ^ cell).bit_count() <= 1 and least <= cell
        got = {(a, b) for group in around.values() for a in group for b in group if a < b}
        assert got == want and len(want) > 500 and max(map(len, around.values())) <= 33
        assert all(r["least"] == min(around[r["value"]]) for r in rows) and len(rows) == sum(len(set(g)) for g in around.values())


def test_a_cell_of_dissimilar_texts_is_compared_in_full(spark, monkeypatch):
    """If all texts share one cell, the second search finds what the least member does not link."""
    rows = near_copies(13)
    monkeypatch.setattr(sketches, "MAX_DISTANCE", 64 * sketches.LANES)
    real = sketches.signed
    one = [F.lit(0).cast("long").alias(s) for s in sketches.SKETCH]
    monkeypatch.setattr(sketches, "signed", lambda *a: real(*a).select("_sh_id", "_sh_row", "words", "n", *one))
    want = roots_of([i for i, _ in rows], [(i, j) for m, (i, a) in enumerate(rows) for j, b in rows[:m] if jaccard(a or "", b or "") >= 0.8])
    kept = sketches.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"] for r in kept.collect()} == want


def test_near_copies_under_clashing_names(spark, nothing):
    rows = [(None, "a b c d e f g", "1"), (None, "x y z u v w t", "2"), (3, "a b c d e f g", "3"), (3, "quite other words than all of those", "4")]
    names = ["_sh_row", "_sh_in", "node", "words", "n", "root", "s0", "cell", "a", "b"]
    for f in (sketches.keep_one, simhash.keep_one):
        docs = spark.createDataFrame([(i, t, *[c] * len(names)) for i, t, c in rows], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
        kept = f(docs)
        assert kept.columns == docs.columns
        assert Counter(map(tuple, kept.collect())) == Counter((i, t, *[c] * len(names)) for i, t, c in rows[1:])
        assert f(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = components(edges, Scratch(spark)).collect()
    assert len(rows) == 200 and {r["root"] for r in rows} == {0}


def test_members_meet_their_hubs_in_one_row(spark, joined_rows):
    members = spark.range(1000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("cell"))
    hubs = F.array(F.lit(0), F.lit(999), F.lit(5), F.lit(6)).cast("array<long>")
    found = sketches._inside(members, spark.range(1).select(F.col("id").alias("cell"), F.lit(1000).cast("long").alias("size"), hubs.alias("hubs")))
    got = sorted(map(tuple, found.collect()))
    assert joined_rows(found) == 1000 and got == sorted((max(n, h), min(n, h)) for n in range(1000) for h in (0, 999, 5, 6))


def test_joins_by_node_are_not_broadcast(spark, tmp_path):
    """A small input would have dozens of broadcasts, all built in the driver within seconds."""
    docs = spark.createDataFrame(near_copies(14), "doc_id long, text string")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def executions():
        bus.waitUntilEmpty()
        found = store.executionsList()
        return {x.executionId(): x for x in map(found.apply, range(found.size()))}

    before = set(executions())
    sketches.keep_one(docs).write.parquet(str(tmp_path / "kept"))
    plans = [x.physicalPlanDescription() for k, x in executions().items() if k not in before]
    made = sum(p.split("== Initial Plan ==")[0].count("- BroadcastExchange (") for p in plans)
    assert plans and made <= 30


@pytest.mark.parametrize("tile", [4096, 16])
def test_components_of_a_cell_are_compared_without_rows_of_pairs(spark, monkeypatch, tmp_path, tile):
    """All texts share one cell, in dozens of components: every pair is judged, and no join makes rows beyond those of nodes."""
    rows = near_copies(15)
    monkeypatch.setattr(sketches, "MAX_DISTANCE", 64 * sketches.LANES)
    monkeypatch.setattr(sketches, "TILE", tile)
    real, one = sketches.signed, [F.lit(0).cast("long").alias(s) for s in sketches.SKETCH]
    monkeypatch.setattr(sketches, "signed", lambda *a: real(*a).select("_sh_id", "_sh_row", "words", "n", *one))
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    before = store.executionsCount()
    sketches.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).write.parquet(str(tmp_path / "kept"))
    want = roots_of([i for i, _ in rows], [(i, j) for m, (i, a) in enumerate(rows) for j, b in rows[:m] if jaccard(a or "", b or "") >= 0.8])
    assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == want and len(want) > 50
    if tile == 4096:
        bus.waitUntilEmpty()
        made, found = [], store.executionsList()
        for k in [found.apply(k).executionId() for k in range(int(before), found.size())]:
            nodes, told = store.planGraph(k).allNodes(), store.executionMetrics(k)
            for node in map(nodes.apply, range(nodes.size())):
                if "Join" in node.name():
                    of = [m.accumulatorId() for m in map(node.metrics().apply, range(node.metrics().size())) if m.name() == "number of output rows"]
                    made += [int(told.apply(a).replace(",", "")) for a in of if told.contains(a)]
        assert made and max(made) <= 2 * sketches.BLOCKS * len(rows)
