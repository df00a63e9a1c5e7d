import os
import sys
import tempfile
from datetime import date
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from labledger.session import get_session

    ck = tempfile.mkdtemp(prefix="labledger-test-", dir="/tmp")
    s = get_session("local[4]", 8, extra={"spark.checkpoint.dir": ck, "spark.driver.memory": "4g"})
    yield s
    s.stop()


def _val(field, v):
    from pyspark.sql import types as T

    if v is None:
        return None
    if isinstance(field.dataType, T.DecimalType):
        return Decimal(str(v))
    if isinstance(field.dataType, T.DateType) and isinstance(v, str):
        return date.fromisoformat(v)
    if isinstance(field.dataType, T.DoubleType):
        return float(v)
    return v


@pytest.fixture(scope="session")
def orders_df(spark):
    """Build a typed order table from a list of dicts (missing columns null)."""
    from labledger.schema import ORDER

    def make(rows):
        data = []
        for i, r in enumerate(rows):
            r = dict(r)
            r.setdefault("req_id", f"R{i:04d}")
            data.append(tuple(_val(f, r.get(f.name)) for f in ORDER.fields))
        return spark.createDataFrame(data, ORDER)

    return make
