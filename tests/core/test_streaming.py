import json

import pytest
from pyspark.sql import functions as F

from glossa.functions import positions
from glossa.streaming import workspace as W

CHANGES = "file string, generation long, op string, content string"


def extract(files):
    """Facts of toy sources: `def x: sig` defines, `use x` refers."""
    lines = files.select("file", F.explode(F.split("content", "\n")).alias("line"))
    defs = lines.filter("line LIKE 'def %'").select("file", F.regexp_extract("line", r"def (\w+)", 1).alias("symbol"), F.regexp_extract("line", r": (.*)$", 1).alias("signature"))
    refs = lines.filter("line LIKE 'use %'").select("file", F.regexp_extract("line", r"use (\w+)", 1).alias("symbol"))
    return {"defs": defs, "refs": refs}


def names(df):
    return sorted(r["file"] for r in df.collect())


def test_upsert_ignores_late_changes(spark):
    empty = spark.createDataFrame([], "file string, generation long, content string")
    first = spark.createDataFrame([("a", 5, "change", "new"), ("a", 3, "open", "old"), ("b", 1, "open", "b")], CHANGES)
    state = W.upsert(empty, first)
    again = W.upsert(state, spark.createDataFrame([("a", 4, "change", "late"), ("b", 2, "delete", None), ("c", 1, "open", "c")], CHANGES))
    assert {tuple(r) for r in again.collect()} == {("a", 5, "new"), ("c", 1, "c")}


def test_workspace_batches(spark, tmp_path):
    ws = W.Workspace(spark, str(tmp_path), extract)
    dirty = ws.apply(spark.createDataFrame([("lib", 1, "open", "def x: Integer\ndef y: Nil"), ("app", 1, "open", "use x"), ("other", 1, "open", "use y")], CHANGES), scan=True)
    assert names(dirty) == []
    assert names(ws.apply(spark.createDataFrame([("lib", 2, "change", "def x: String\ndef y: Nil")], CHANGES))) == ["app"]
    assert names(ws.apply(spark.createDataFrame([("lib", 3, "change", "def y: Nil\n# moved\ndef x: String")], CHANGES))) == []
    assert names(ws.apply(spark.createDataFrame([("lib", 2, "change", "def x: Late")], CHANGES))) == []
    merged = ws.merged(lambda f: f["defs"].groupBy("symbol").agg(F.max("signature").alias("signature")))
    assert ws.merged(lambda f: 1 / 0) is merged
    assert {r["symbol"]: r["signature"] for r in merged.collect()} == {"x": "String", "y": "Nil"}
    assert names(ws.apply(spark.createDataFrame([("lib", 4, "delete", None)], CHANGES))) == ["app", "other"]
    assert ws.facts["defs"].count() == 0 and names(ws.files) == ["app", "other"]
    assert names(ws.without("app")["refs"]) == ["other"]


def test_streaming_query(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()
    ws = W.Workspace(spark, str(tmp_path / "state"), extract)

    def arrive(name, rows):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("file", "generation", "op", "content"), r))) for r in rows))
        ws.run(W.read_changes(spark, str(inbox)), str(tmp_path / "checkpoint"), lambda df, n: seen.append(names(df))).awaitTermination()

    arrive("1.json", [("lib", 1, "open", "def x: A"), ("app", 1, "open", "use x")])
    arrive("2.json", [("lib", 2, "change", "def x: B")])
    assert seen == [[], ["app"]]
    assert ws.facts["defs"].first()["signature"] == "B"


def test_workspace_goes_on_after_a_restart(spark, tmp_path):
    """A new Workspace over the folder has what the old one had; a batch without its marker never was; known batches are not applied again."""
    rows = lambda *r: spark.createDataFrame(list(r), CHANGES)
    ws = W.Workspace(spark, str(tmp_path), extract)
    ws.apply(rows(("a", 1, "open", "def x: A"), ("b", 1, "open", "use x")), 0, scan=True)
    ws.apply(rows(("gone", 5, "open", "use x"), ("gone", 6, "delete", None)), 1)
    (tmp_path / "v1" / "_DONE").unlink()
    again = W.Workspace(spark, str(tmp_path), extract)
    assert again.version == 0 and names(again.files) == ["a", "b"]
    again.apply(rows(("gone", 5, "open", "use x")), 1)
    again.apply(rows(("gone", 6, "delete", None)), 2)
    third = W.Workspace(spark, str(tmp_path), extract)
    assert third.version == 2 and names(third.files) == ["a", "b"]
    assert names(third.apply(rows(("c", 1, "open", "use x"), ("gone", 4, "change", "late"), ("a", 2, "change", "def x: B")), 3)) == ["b"]
    assert names(third.files) == ["a", "b", "c"] and third.facts["defs"].first()["signature"] == "B"
    assert names(third.apply(rows(("a", 9, "delete", None)), 3)) == ["b"] and names(third.files) == ["a", "b", "c"]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, row in (("1.json", ("a", 1, "open", "def x: A")), ("2.json", ("b", 1, "open", "use x")), ("3.json", ("c", 1, "open", "use x"))):
        (inbox / name).write_text(json.dumps(dict(zip(("file", "generation", "op", "content"), row))))
        ws = W.Workspace(spark, str(tmp_path / "state"), extract)
        ws.run(W.read_changes(spark, str(inbox)), str(tmp_path / "checkpoint")).awaitTermination()
    assert names(ws.files) == ["a", "b", "c"] and ws.facts["refs"].count() == 2


def test_a_batch_writes_what_it_changes(spark, tmp_path, monkeypatch):
    """One edit of many files writes a small version; after COMPACT batches the log is one version again."""
    monkeypatch.setattr(W.Workspace, "COMPACT", 3)
    ws = W.Workspace(spark, str(tmp_path), extract)
    ws.apply(spark.range(2000).select(F.concat(F.lit("f"), "id").alias("file"), F.lit(1).cast("long").alias("generation"), F.lit("open").alias("op"), F.concat(F.lit("def s"), "id", F.lit(": A\nuse s0")).alias("content")), scan=True)
    size = lambda v: sum(p.stat().st_size for n in ("files", "defs", "refs", "touched") for p in (tmp_path / f"v{v}" / n).rglob("*.parquet"))
    ws.apply(spark.createDataFrame([("f7", 2, "change", "def s7: B")], CHANGES))
    assert size(1) < size(0) / 5 and ws.files.count() == 2000 and ws.facts["refs"].count() == 1999
    for k in range(3, 7):
        ws.apply(spark.createDataFrame([("f7", k, "change", f"def s7: B{k}"), ("f9", k, "delete" if k == 4 else "change", "use s7")], CHANGES))
    assert len(ws.versions) <= 3 and not (tmp_path / "v0").exists()
    again = W.Workspace(spark, str(tmp_path), extract)
    for x in (ws, again):
        assert x.files.count() == 2000 and x.facts["defs"].filter("symbol = 's7'").first()["signature"] == "B6" and x.facts["refs"].filter("symbol = 's7'").count() == 1


def test_documents_fold_edits(spark, tmp_path):
    rows = [("d", 1, [{"text": "héllo\nworld"}]), ("d", 2, [{"start_line": 1, "start_column": 0, "end_line": 1, "end_column": 5, "text": "there"}]), ("d", 3, [{"start_line": 9, "start_column": 0, "end_line": 9, "end_column": 1, "text": "x"}])]
    inbox = tmp_path / "edits"
    inbox.mkdir()
    (inbox / "a.json").write_text("\n".join(json.dumps({"doc": d, "version": v, "edits": json.dumps(e)}) for d, v, e in rows))
    stream = W.documents(spark.readStream.schema("doc string, version long, edits string").json(str(inbox)))
    q = stream.writeStream.format("memory").queryName("docs").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("docs").collect()] == [("d", 3, "héllo\nthere")]


def test_running_fingerprints_retract(spark, tmp_path):
    inbox = tmp_path / "h"
    inbox.mkdir()
    (inbox / "a.json").write_text("\n".join(json.dumps({"key": "k", "h": h, "sign": s}) for h, s in [(5, 1), (7, 1), (5, -1)]))
    stream = W.running_fingerprints(spark.readStream.schema("key string, h long, sign int").json(str(inbox)))
    stream.writeStream.format("memory").queryName("prints").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert tuple(spark.table("prints").first()) == ("k", 1, "7", 7)


def test_debounce_and_epochs(spark):
    asked = spark.createDataFrame([("a", 1, 0), ("a", 2, 100), ("b", 1, 0)], "doc string, epoch long, at_ms long")
    assert {(r["doc"], r["epoch"]) for r in W.due(asked, F.lit(200)).collect()} == {("b", 1)}
    assert {(r["doc"], r["epoch"]) for r in W.due(asked, F.lit(250)).collect()} == {("a", 2), ("b", 1)}
    assert W.publishable(asked, asked).count() == 2


@pytest.mark.parametrize("line,column,want", [(0, 0, 0), (0, 2, 3), (0, 4, 7), (0, 3, None), (1, 1, 9), (2, 0, None), (1, 9, None)])
def test_utf16(line, column, want):
    assert positions.utf16_offset("aé😀\nbc", line, column) == want


def test_line_columns():
    assert positions.line_column("aé\nbc", 5) == (2, 1) and positions.line_column("", 0) == (1, 0)
    assert positions.apply_edits("abc", [{"start_line": 0, "start_column": 2, "end_line": 0, "end_column": 1, "text": ""}]) is None
