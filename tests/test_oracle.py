"""Every registered query with oracle SQL agrees with DuckDB (sf0.001)."""

import pytest

from conftest import SMALL
import harness


def _keys():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return harness.duck(SMALL)


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, duck, key):
    import __spark_entry__ as E
    r = harness.compare(spark, duck, SMALL, key, E.queries()[key], E.oracle_sql()[key])
    assert r["ok"], r
    assert "types" not in r, r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["grant", "total_spent", "orders"]
    assert len(rows) >= 1


def test_rows_only_queries_run(spark):
    import __spark_entry__ as E
    for key in sorted(set(E.queries()) - set(E.oracle_sql())):
        if key.startswith("stream_"):
            continue
        assert E.queries()[key](spark, SMALL).count() >= 0, key
