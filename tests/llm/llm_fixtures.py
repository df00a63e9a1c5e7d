"""Fixtures of these tests; imported by each, as a second conftest module would hide that of the folder above."""

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """A DataFrame of the given schema from rows."""
    def build(schema, rows, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return build


def result(df, key, *columns):
    """Rows as a dict by key."""
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="session")
def by():
    return result
