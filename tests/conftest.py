import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def joined_rows():
    """The most rows that a join made when a DataFrame was collected."""

    def most(plan):
        inner = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if plan.nodeName().endswith("QueryStage") else None
        below = [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
        made = plan.metrics().get("numOutputRows")
        return max([made.get().value() if "Join" in plan.nodeName() and made.isDefined() else 0, *map(most, below)])

    return lambda df: most(df._jdf.queryExecution().executedPlan())
