import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401  ships the page reader with the tasks
    from vakanta.session import build_session

    session = build_session(
        "local[8]",
        "tests",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Results of a column function over a list of strings."""

    def run(texts, function, kind="string"):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        from pyspark.sql import functions as F

        found = df.select("i", function(F.col("x")).alias("y")).collect()
        return [r["y"] for r in sorted(found, key=lambda r: r["i"])]

    return run
