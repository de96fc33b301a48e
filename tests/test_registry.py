"""Every query without file round trips against its SQL twin, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from docloom import registry  # noqa: E402
from docloom.registry import files  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"read_element_docs", "read_item_docs", "read_markdown_docs", "read_ordered_lines", "stream_ingest_docs"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert registry.queries().keys() == registry.oracles().keys()
    assert SLOW <= files.QUERIES.keys()


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in SLOW])
def test_query_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, SF_DIR).toPandas()
    expected = con.sql(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert check.normal(got) == check.normal(expected)
