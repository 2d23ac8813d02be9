import os
import sys
from datetime import date, timedelta
import random

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LISTING_SCHEMA = (
    "listing_id long, entity_id long, area string, category string, listing_date date,"
    " sale_date date, amount decimal(18,2), under_contract int"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_listings(spark):
    """Listing table from tuples (id, entity, area, category, listed, sold, amount, flag)."""

    def make(rows):
        from decimal import Decimal

        typed = [
            (*r[:6], None if r[6] is None else Decimal(r[6]), r[7]) for r in rows
        ]
        return spark.createDataFrame(typed, LISTING_SCHEMA)

    return make


@pytest.fixture(scope="session")
def skewed_rows():
    """A market in which a third of all listings share one entity, one category and one day."""
    rng = random.Random(5)
    rows = []
    for i in range(1, 601):
        hot = i % 3 == 0
        listed = date(2020, 2, 29) if hot else date(2019, 1, 1) + timedelta(days=rng.randrange(900))
        sold = None if rng.random() < 0.2 else listed + timedelta(days=rng.choice([0, 0, 1, 30, 200]))
        rows.append(
            (
                i * 7,
                1 if hot else rng.randrange(2, 60),
                f"area{i % 5}",
                "common" if hot else rng.choice(["a", "b"]),
                listed,
                sold,
                None if sold is None else rng.randrange(100, 999),
                1 if rng.random() < 0.3 else None,
            )
        )
    return rows
