from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from glossa.llm import decontaminate, simhash


def test_entry_lists_the_queries():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark, tmp_path, docs, corpus):
    import random

    rng = random.Random(1)
    passage = " ".join(f"bench{rng.randrange(900)}" for _ in range(30))
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in corpus]
    rows += [(300 + i, f"toxic words snark{i % 3}y " + " ".join(f"w{rng.randrange(400)}" for _ in range(40)), "en", "a", 1) for i in range(60)]
    rows += [(400, f"before {passage} after", "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame(rows, schema)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(300 + i, 1, 1) for i in range(60)] + [(i, 1, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left[name] = Counter(r["doc_id"] for r in now.collect())
    assert not [i for i in left["toxicity"] if i is not None and 300 <= i < 360] and len(left["toxicity"]) >= 60
    kept = simhash.near_duplicates(spark.read.parquet(str(tmp_path / "toxicity"))).select("component_id").distinct().count()
    assert len(left["near_duplicates"]) == kept and max(left["near_duplicates"].values()) == 1
    assert 400 in left["near_duplicates"] and 400 not in left["decontamination"]
    assert set(left["near_duplicates"]) - set(left["decontamination"]) == {400}
    assert max(left["mixing"].values()) <= 3 and left["sharding"] == left["mixing"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r["doc_id"] for r in whole.collect()) == left["sharding"]
    assert decontaminate.MIN_WORDS == 13
