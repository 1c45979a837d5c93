"""Reports over an analysis: type holes, and all that an editor or a playground shows of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.coverage import hole_counts


def hole_report(holes: DataFrame, examples: int = 3) -> DataFrame:
    """kind, reason, n and the first few examples of type holes, the most frequent first."""
    name = F.concat_ws(" ", F.concat_ws("#", "class", "member"), "slot")
    by = holes.groupBy("kind", "reason").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(name)), 1, examples).alias("examples"))
    return by.orderBy(F.desc("n"), "kind", "reason")


def hole_summary(holes: DataFrame) -> DataFrame:
    """what, value, n: the counts by kind and by reason in one table."""
    kinds = hole_counts(holes, "kind").select(F.lit("kind").alias("what"), F.col("kind").alias("value"), "n")
    return kinds.unionByName(hole_counts(holes, "reason").select(F.lit("reason").alias("what"), F.col("reason").alias("value"), "n"))


def file_report(text: DataFrame, diagnostics: DataFrame, hovers: DataFrame, lenses: DataFrame) -> DataFrame:
    """value: one JSON object with the signature text, diagnostics, hovers and lenses of one file."""

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))

    whole = text.agg(F.array_join(F.collect_list("value"), "\n").alias("signatures"))
    for rows, name in ((diagnostics, "diagnostics"), (hovers, "hovers"), (lenses, "lenses")):
        whole = whole.crossJoin(F.broadcast(listed(rows, name)))  # one row each
    return whole.select(F.to_json(F.struct("signatures", "diagnostics", "hovers", "lenses")).alias("value"))


def scenario_seed(holes: DataFrame, sources: DataFrame) -> DataFrame:
    """file, value: a source with its first hole as the beginning of a test case."""
    first = holes.groupBy("file").agg(F.min_by(F.concat_ws(" ", "class", "member", "reason"), F.struct("class", "member")).alias("what"))
    return first.join(sources, "file").select("file", F.concat(F.lit("## "), "what", F.lit("\n\n```ruby\n"), "content", F.lit("\n```\n")).alias("value"))
