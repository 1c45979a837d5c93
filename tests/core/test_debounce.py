"""Timers in keyed streaming state."""

import json
import time

from glossa.streaming import debounce


def put(folder, name, rows):
    (folder / f".{name}").write_text("\n".join(map(json.dumps, rows)))
    (folder / f".{name}").rename(folder / f"{name}.json")


def until(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.1)
    return condition()


def test_one_publication_for_edits_that_follow_each_other(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    epochs, published, inferred = {"a": 0, "b": 0, "c": 0}, [], []

    def edit(name, *docs):
        for d in docs:
            epochs[d] += 1
        put(folder, name, [{"doc": d, "epoch": epochs[d]} for d in docs])

    current = lambda: spark.createDataFrame(list(epochs.items()), "doc string, epoch long")

    def infer(due):
        rows = [tuple(r) for r in due.collect()]
        inferred.extend(rows)
        if ("c", 1) in rows:
            epochs["c"] = 2  # an edit while inference runs
        return due

    stream = spark.readStream.schema("doc string, epoch long").option("maxFilesPerTrigger", 10).json(str(folder))
    edit("1", "a", "b", "c")
    edit("2", "a")
    query = debounce.run(debounce.debounced(stream, 1500), debounce.Publisher(current, infer, lambda found: published.extend(tuple(r) for r in found.collect())), str(tmp_path / "checkpoint"))
    try:
        assert until(lambda: len(published) >= 2)
        assert sorted(published) == [("a", 2), ("b", 1)] and sorted(inferred) == [("a", 2), ("b", 1), ("c", 1)]
        edit("3", "a")
        put(folder, "4", [{"doc": "b", "epoch": 1}, {"doc": "b", "epoch": None}, {"doc": None, "epoch": None}])
        assert until(lambda: len(published) >= 3)
        time.sleep(2.5)
        assert sorted(published) == [("a", 2), ("a", 3), ("b", 1)]
    finally:
        query.stop()
    # a stream that starts again goes on with its state: what has fired does not fire again, what was armed does
    edit("5", "b")
    query = debounce.run(debounce.debounced(stream, 200), debounce.Publisher(current, lambda due: due, lambda found: published.extend(tuple(r) for r in found.collect())), str(tmp_path / "checkpoint"))
    try:
        assert until(lambda: ("b", 2) in published)
        assert sorted(published) == [("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    finally:
        query.stop()


def test_lenses_have_one_timer(spark, tmp_path):
    folder, got = tmp_path / "in", []
    folder.mkdir()
    put(folder, "1", [{"epoch": 4}, {"epoch": 9}, {"epoch": 7}])
    stream = spark.readStream.schema("epoch long").json(str(folder))
    query = debounce.run(debounce.debounced_lenses(stream), lambda batch, number: got.extend(tuple(r) for r in batch.collect()), str(tmp_path / "checkpoint"))
    try:
        assert until(lambda: got) and got == [("workspace", 9)]
    finally:
        query.stop()
