import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory() as shared:
        session = (
            SparkSession.builder.master("local[4]")
            .config("spark.driver.memory", "4g")
            .config("spark.ui.enabled", "false")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.shuffle.partitions", "4")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.checkpoint.dir", f"file://{shared}")
            .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
            .getOrCreate()
        )
        yield session
        session.stop()
