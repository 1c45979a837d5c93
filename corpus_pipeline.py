"""A cleaning pipeline over documents: each stage applies one operator of the llm subpackage to all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, whatever further columns there are and however they are named; the last adds
shard, slot, size, text_crc32 and old_shard, which replace columns of these names. Nulls, empty texts, repeated rows and empty tables: see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm.common import Scratch, read
from glossa.llm.decontaminate import without_benchmark
from glossa.llm.mixing import repeated
from glossa.llm.resharding import Reshard
from glossa.llm.sketches import keep_one
from glossa.llm.toxicity import train_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar doesn't find toxic."""
    return without_toxic(docs, train_toxicity(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash balls over five-word shingles, similarity 0.8), the one with its least id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return repeated(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of 16 and their slot in it, the fewest bytes moved from shards by source."""
    return Reshard(docs).assigned()


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: SQL can't express components of near copies or the mix; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
