"""Queries on small tables that hold what once told them from their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from glossa import catalog


@pytest.fixture
def against_sql(spark, tmp_path):
    def check(name, **tables):
        con = duckdb.connect()
        for table, rows in tables.items():
            rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        got = catalog.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want

    return check


def test_halves_are_rounded_to_even(spark, against_sql):
    orders = spark.createDataFrame([(1, f"{1992 + y}-01-01", p) for y, p in ((0, 2000.5), (0, 998.5), (1, 250000.5), (1, 999.5))], "o_custkey long, o_orderdate string, o_totalprice double")
    against_sql("kernel_w08_shown_levels", orders=orders.withColumn("o_orderdate", F.to_date("o_orderdate")))


@pytest.mark.parametrize("name", ["kernel_a12_a13_splats", "kernel_p07_widened_arguments"])
def test_lines_of_one_place_follow_the_file(spark, against_sql, name):
    rows = [(k, 1, 5, f, s) for k in range(4) for f, s in (("A", "F"), ("N", "O"), ("A", "O"), ("N", "F"))[: k + 1]]
    against_sql(name, lineitem=spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string"))


def test_large_part_numbers(spark, against_sql):
    against_sql("kernel_g05_module_functions", part=spark.createDataFrame([(1, 1), (2, 2), (1_000_001, 3), (1_200_000, 4)], "p_partkey long, p_size int"))


def test_signatures_with_and_without_type_parameters(spark):
    from glossa.plans.analyze import Analysis

    found = Analysis(spark.createDataFrame([("a.rb", "class A\n  def go\n    make(2)\n  end\n  def make(k)\n    k\n  end\nend\n")], "file string, content string"))
    of = lambda generic: next(line.strip() for line in found.text(generic).first()[0].splitlines() if "make" in line)
    assert of(True) == "def make: [K] (K k) -> K" and of(False) == "def make: (Integer k) -> Integer"


def test_stored_tables_are_not_taken_for_small(spark, tmp_path):
    from glossa.plans.fixpoint import cut

    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/few.parquet")
    many = cut(spark.read.parquet(f"{tmp_path}/few.parquet").select(F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("n"), "id"))
    assert many.count() == 50_000
    plan = many.alias("a").join(many.alias("b"), F.expr("a.n = b.n AND a.id = b.id"))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_texts_of_one_part_are_read_by_many_tasks(spark):
    from glossa.sources import syntax

    texts = spark.range(200).coalesce(1).select(F.concat(F.lit("f"), "id").alias("file"), F.concat(F.lit("x = "), "id").alias("content"))
    found = syntax.nodes(texts).withColumn("part", F.spark_partition_id())
    assert found.select("part").distinct().count() > 4 and found.select("file").distinct().count() == 200 and found.filter("kind = 'int'").count() == 200
