"""Edits derive again what follows from them, and nothing else."""

import random

from glossa.functions import terms as T
from glossa.operators import incremental
from glossa.operators.recursion import resolve_returns

KIND = "class string, name string, singleton boolean, ret string"
D = T.dumps


def call(name, receiver="K"):
    return ("method_return", receiver, name)


def frame(spark, rows):
    return spark.createDataFrame([(c, n, False, D(t)) for (c, n), t in rows.items()], KIND)


def checked(spark, before, after, paths, most):
    old, new = frame(spark, before), frame(spark, after)
    resolved, _ = resolve_returns(old, paths)
    gone = {k: t for k, t in before.items() if after.get(k) != t}
    fresh = {k: t for k, t in after.items() if before.get(k) != t}
    found, hit = incremental.updated_returns(resolved, frame(spark, gone) if gone else old.limit(0), frame(spark, fresh) if fresh else new.limit(0), incremental.call_sites(old), new, paths)
    full, _ = resolve_returns(new, paths)
    shown = lambda df: sorted((r["class"], r["name"], T.render(T.loads(r["ret"]))) for r in df.collect())
    assert shown(found) == shown(full)
    assert hit.count() <= most


def test_edits_equal_full_runs(spark):
    rng = random.Random(3)
    kinds = [T.INTEGER, T.STRING, T.FLOAT]
    paths = spark.createDataFrame([("K", "K", [0]), ("L", "L", [0]), ("L", "K", [1])], "class string, owner string, rank array<int>").cache()
    arms = lambda k: [rng.choice(kinds)] + [call(f"m{rng.randrange(k)}", rng.choice("KL")) for _ in range(rng.randrange(3)) if k]
    before = {("K", f"m{k}"): T.union(*a) if len(a := arms(k)) > 1 else a[0] for k in range(60)}
    for edit in range(3):
        after = dict(before)
        spots = rng.sample(sorted(before), 3)
        after[spots[0]] = T.array(T.NIL)
        del after[spots[1]]
        after["L", spots[2][1]] = T.SYMBOL  # a method that now answers L's calls
        checked(spark, before, after, paths, 60)


def test_one_edit_touches_what_follows(spark):
    paths = spark.createDataFrame([("K", "K", [0])], "class string, owner string, rank array<int>").cache()
    before = {("K", f"m{k}"): T.INTEGER if k % 10 == 0 else call(f"m{k - 1}") for k in range(400)}
    after = before | {("K", "m125"): T.STRING}
    checked(spark, before, after, paths, 5)
    checked(spark, before, before, paths, 0)
    circle = before | {("K", "m120"): T.union(T.FLOAT, call("m129"))}
    checked(spark, before, circle, paths, 10)
    checked(spark, circle, before, paths, 10)
