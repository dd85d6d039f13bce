import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tokenloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def chat(spark):
    def make(*messages, conv_id=1):
        rows = [(conv_id, i, role, text) for i, (role, text) in enumerate(messages)]
        return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    return make


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column function on one text."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        names = [f"c{i}" for i in range(len(values))]
        schema = ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([values], schema)
        return df.select(fn(*[F.col(n) for n in names]).alias("x")).first()["x"]

    return run
