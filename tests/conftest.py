import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("pagemart-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def books(spark):
    """Small literal books frame: (id, title, price, availability, rating, category, upc, day)."""
    from pyspark.sql import functions as F

    def make(rows):
        frame = spark.createDataFrame(
            rows,
            "id long, title string, price double, availability string, rating int,"
            " category string, upc string, scraped_at timestamp_ntz",
        )
        return frame.withColumn("created_at", F.col("scraped_at"))

    return make
