import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tenderloom import schemas  # noqa: E402
from tenderloom.session import get_session  # noqa: E402

NOW = datetime(2024, 6, 12, 9, 0)


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", master="local[4]", cores=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


def record(ordinal, **fields):
    row = {"ordinal": ordinal, "opportunity_id": str(ordinal), "source_id": "test_src", "source_name": "Test Source",
           "title": "Roof Replacement at Fire Station 12", "url": f"https://example.gov/bids/{ordinal}",
           "county": "broward", "agency": "Broward County", "status": "open", "categories": [], "requirements": [],
           "documents": [], "keywords": [], "commodity_codes": []}
    row.update(fields)
    return row


def opportunities(spark, rows):
    from pyspark.sql import types as T
    schema = T.StructType.fromDDL(schemas.OPPORTUNITY)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


SOON, PAST = NOW + timedelta(days=5), NOW - timedelta(days=5)
