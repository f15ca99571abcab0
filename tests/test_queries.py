"""Every query of the library's own operators against its SQL, over the smallest data set."""

import compare
import pytest

import __spark_entry__ as entry_point
from assetflow.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return compare.database(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, database, name):
    names, rows = compare.rows_of_spark(entry_point.queries()[name](spark, SF_DIR))
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert rows
    else:
        assert (names, rows) == compare.rows_of_sql(database, sql)


def test_entry(spark):
    report = entry_point.entry(spark).collect()
    assert [r.file_type for r in report] == ["json", "mp4", "txt", "wav", "xlsx"]


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
