import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from notewell.session import build_session  # noqa: E402


# started on import, because test modules build columns at module level
WORK = tempfile.mkdtemp(prefix="spark-")
SESSION = build_session(
    "tests", "local[8]",
    **{"spark.checkpoint.dir": f"{WORK}/shared", "spark.sql.warehouse.dir": f"{WORK}/warehouse", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
)
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def one(spark):
    """Evaluate column expressions over a single text."""

    def run(text, *columns, schema="text string"):
        row = spark.createDataFrame([(text,)], schema).select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run
