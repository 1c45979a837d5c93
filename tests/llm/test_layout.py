import collections
import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossa.llm import mixing, resharding


def test_flow_moves_the_least():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(2, 6)
        supply = [rng.randrange(0, 50) for _ in range(n)]
        capacity = resharding.equal_capacities(sum(supply), n)
        flow = resharding.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == capacity
        assert sum(flow[i][j] for i in range(n) for j in range(n) if i != j) == sum(max(0, s - c) for s, c in zip(supply, capacity))


def test_flow_with_costs_matches_brute_force():
    cost = [[0, 2, 5], [3, 0, 1], [4, 2, 0]]
    supply, capacity = [3, 1, 0], [1, 1, 2]
    flow = resharding.min_cost_flow(supply, capacity, lambda i, j: cost[i][j])
    got = sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3))
    units = [i for i, n in enumerate(supply) for _ in range(n)]
    slots = [j for j, n in enumerate(capacity) for _ in range(n)]
    assert got == min(sum(cost[i][j] for i, j in zip(units, p)) for p in itertools.permutations(slots))


def test_shards(spark, docs, corpus, nothing):
    plan = resharding.Reshard(docs, shards=4, old_shards=3)
    rows = plan.assigned()
    assert set(docs.columns) - {"size"} < set(rows.columns)
    rows = rows.collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, size(t), crc(t)) for i, t, *_ in corpus)
    for j in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == j)
        assert slots == list(range(len(slots)))
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    largest = max(size(t) for _, t, *_ in corpus)
    assert max(total.values()) - min(total.values()) <= largest
    again = resharding.Reshard(docs.repartition(2), shards=4, old_shards=3, keep=False).assigned().collect()
    assert Counter((r["text_crc32"], r["shard"], r["slot"]) for r in rows) == Counter((r["text_crc32"], r["shard"], r["slot"]) for r in again)
    assert resharding.Reshard(nothing).assigned().count() == 0
    with pytest.raises(ValueError):
        resharding.Reshard(docs, shards=2, capacities=[1, 1])


def test_columns_named_like_the_operators_own(spark, tmp_path, docs, nothing):
    """What a caller has under the operators' inner names stays; only the columns that an operator says it adds are replaced."""
    inner = ["o", "at", "s", "j", "off", "c", "h", "mean", "lam", "sid", "src", "blocks", "block", "_copy", "_toxicity", "_rs_in", "_rs_old", "_rs_h", "_mx_in", "_stored", "bytes", "n", "target", "rate", "copies", "shard", "slot"]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("-"))).alias(c) for c in inner])
    mine = [c for c in inner if c not in mixing.MIXED]
    left = resharding.Reshard(rows, shards=4).assigned()
    assert left.count() == rows.count() and left.filter(" OR ".join(f"NOT startswith(`{c}`, '{c}:')" for c in inner if c not in resharding.ADDED)).isEmpty()
    mixed = mixing.mix(rows, keep=True)
    assert mixed.count() == rows.count() and mixed.filter(" OR ".join(f"NOT startswith(`{c}`, '{c}:')" for c in mine)).isEmpty()
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage in any of the documents here at all, and none like it either")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns and out.dtypes == rows.dtypes, name
        whole = Counter(tuple(r) for r in rows.collect())
        got = Counter(tuple(r) for r in out.collect())
        assert got and set(got) <= set(whole), name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == rows.count()
    empty = rows.limit(0)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_rows_without_ids_are_spread(spark):
    """Rows whose ids are all null don't land in one block."""
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("x"), "id").alias("text"), F.lit("s").alias("source"))
    plan = resharding.Reshard(df, keep=False)
    assert len(plan.starts) > 30
    assert len({r["shard"] for r in plan.assigned().collect()}) == 16


def test_sizes_are_settled_by_the_smallest_rows(spark, monkeypatch):
    """Sizes differ by a few small rows where there are enough of them, else by less than the largest row; a hot source is many blocks."""
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 10)
    rng = random.Random(7)
    for large, n, bound in ((4000, 6000, 130), (90000, 3000, 90000)):
        rows = [(k, "x" * (rng.randrange(500, large) if k % (n // 100) == 0 else rng.randrange(1, 60)), "hot" if k % 3 else f"s{k % 17}") for k in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        out = resharding.Reshard(df, keep=large == 4000).assigned().collect()
        total = Counter()
        for r in out:
            total[r["shard"]] += r["size"]
        assert len(total) == 16 and max(total.values()) - min(total.values()) <= bound and len(out) == n
        for j in range(16):
            slots = sorted(r["slot"] for r in out if r["shard"] == j)
            assert slots == list(range(len(slots)))


def test_near_equal_shards_of_small_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 37).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("source"))
    totals = [r["n"] for r in resharding.Reshard(df, keep=False).assigned().groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(totals) == 16 and max(totals) - min(totals) <= 3 * 38


def test_only_affected_files_are_rewritten(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") < 100, 0).when(F.col("id") < 200, 1).when(F.col("id") < 350, 2).otherwise(3).alias("shard"))
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    df.write.partitionBy("shard").parquet(old)
    where = resharding.rewrite_shards(spark, old, new, 4, 4)
    assert where[0].startswith(old) and where[1].startswith(old) and where[2].startswith(new) and where[3].startswith(new)
    rows = [spark.read.parquet(p) for p in where.values()]
    assert [r.count() for r in rows] == [100, 100, 100, 100]
    assert sorted(x["doc_id"] for r in rows for x in r.collect()) == list(range(400))


def targets_of(sizes, weights, cap=3.0):
    """By weight, at most cap times the size, the excess shared anew until none is above."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        share = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / share > cap * sizes[i]}
        for i in over or free:
            out[i] = cap * sizes[i] if over else left * weights[i] / share
        free -= over or set(free)
    return out


def test_targets(spark):
    def got(sizes, weights):
        rows = spark.createDataFrame([(k, s, float(w)) for k, (s, w) in enumerate(zip(sizes, weights))], "k int, size long, weight double")
        return [r["target"] for r in sorted(mixing.with_targets(rows).collect(), key=lambda r: r["k"])]

    t = got([100, 10, 50], [1, 2, 3])
    assert abs(sum(t) - 160) < 1e-9 and t[1] == 30 and all(x <= 3 * s + 1e-9 for x, s in zip(t, [100, 10, 50]))
    assert got([], []) == [] and got([0, 0], [1, 2]) == [0, 0]
    rng = random.Random(6)
    for _ in range(3):
        sizes, weights = [rng.choice([0, 1, 5, 40, 1000]) for _ in range(12)], [rng.randrange(1, 4) for _ in range(12)]
        assert got(sizes, weights) == targets_of(sizes, weights)


def test_many_sources(spark):
    """Sources are ranked by code point over partitions, null last, and none is too many."""
    names = [None, "", "\U0001F600", "\uFFFF", "é", "z", "Z", "a b"] + [f"s{k}" for k in range(300)]
    df = spark.createDataFrame([(k, "w " * (1 + k % 7), n) for k, n in enumerate(names)], "doc_id long, text string, source string").repartition(5)
    rows = mixing.mix(df, keep=True).collect()
    order = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    size = {r["source"]: r["size"] for r in rows}
    want = targets_of([size[s] for s in order], [1 + k % 3 for k in range(len(order))])
    assert {r["source"]: r["target"] for r in rows} == dict(zip(order, want)) and len(rows) == len(names)


def test_multipliers_end():
    """Newton steps end wherever the target lies."""
    import numpy as np

    size, n = np.array([0.0, 1.0, 7.0, 900.0]), np.array([5.0, 10.0, 3.0, 1.0])
    for target in (1e-9, 0.5, 1.0, 100.0, 931.0, 2000.0, 2792.9, 2793.0, 5000.0):
        lam = mixing.multiplier(size, n, target)
        rate = np.minimum(3, np.exp(np.minimum(2, lam * size / ((size * n).sum() / n.sum()))))
        assert target >= 2793 or abs((rate * size * n).sum() - target) <= max(1e-6, 1e-6 * target)


def test_mix(spark, docs, corpus, nothing):
    rows = mixing.mix(docs, keep=True).collect()
    count = lambda t: len((t or "").split())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, count(t)) for i, t, *_ in corpus)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = targets_of([size[s] for s in names], [1 + k % 3 for k in range(len(names))])
    for s, w in zip(names, want):
        assert target[s] == w and all(r["source_size"] == size[s] for r in rows if r["source"] == s)
        assert abs(taken[s] - w) <= max(r["size"] for r in rows if r["source"] == s) / 2 + 20
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(nothing).count() == 0


def test_rates_are_the_dual_optimum(spark):
    """Tilted rates meet the target and have less relative entropy than any other feasible rates tried."""
    import math

    rng = random.Random(1)
    df = spark.createDataFrame([(i, "w " * rng.randrange(1, 90), "s" if i % 4 else "t") for i in range(200)], "doc_id long, text string, source string")
    for s, rows in itertools.groupby(sorted(mixing.mix(df, keep=True).collect(), key=lambda r: r["source"]), key=lambda r: r["source"]):
        rows = list(rows)
        assert abs(sum(r["rate"] * r["size"] for r in rows) - rows[0]["target"]) < 1e-3
        cost = lambda rs: sum(x * math.log(x) - x + 1 for x in rs)
        best = cost([r["rate"] for r in rows])
        for _ in range(200):
            a, b = rng.sample(rows, 2)
            d = rng.uniform(-0.05, 0.05)
            x, y = a["rate"] + d, b["rate"] - d * a["size"] / b["size"]
            if 0 < x <= mixing.CAP and 0 < y <= mixing.CAP:
                assert cost([x, y]) - cost([a["rate"], b["rate"]]) > -1e-9
        assert best >= 0


def test_rounding_passes_on_what_is_left():
    import numpy as np

    sizes = np.array(sorted((random.Random(9).randrange(1, 500) for _ in range(300)), reverse=True))
    rates = np.full(300, 1.37)
    copies = mixing.round_block(sizes, rates)
    assert abs(sum(c * s for c, s in zip(copies, sizes)) - 1.37 * sizes.sum()) <= sizes[-1]


def test_a_third_without_id_and_with_one_text(spark, monkeypatch):
    """Many equal rows are numbered, so no block holds all of them; what is taken and moved stays exact."""
    monkeypatch.setattr(resharding, "COPIES", 50)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 400)
    long = " ".join(["lang"] * 20_000)
    rows = [(None, "the same text for all", "a")] * 3000 + [(i, f"text {i} " * (1 + i % 7), "ab"[i % 2]) for i in range(6000)] + [(None, None, None), (9000, long, "b"), (9000, long, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    plan = resharding.Reshard(df, keep=False)
    most = plan.rows.groupBy(*plan.BLOCK).count().agg(F.max("count")).first()[0]
    assert most < 500
    out = plan.assigned().collect()
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= len(long) + 1
    assert sorted(r["size"] for r in resharding.Reshard(df).assigned().collect()) == sorted(len(t or "") + 1 for _, t, _ in rows)
    mixed = mixing.mix(df).collect()
    assert len(mixed) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in mixed)
    for r in {(r["source_size"], r["target"]) for r in mixed}:
        assert abs(sum(x["taken"] for x in mixed if (x["source_size"], x["target"]) == r) - r[1]) <= 20_000
    key = lambda x: repr((x["doc_id"], x["size"], x["taken"]))
    assert sorted(map(key, mixed)) == sorted(map(key, mixing.mix(df.repartition(3)).collect()))
