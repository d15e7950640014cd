"""Every query that has SQL gives what the SQL gives."""

import pytest
from oracle import connection, rows, sql_rows
from stationweave.plans import archive, problems

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = problems.QUERIES | archive.QUERIES, problems.ORACLE | archive.ORACLE


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", ORACLE)
def test_same_as_sql(spark, con, name):
    found = QUERIES[name](spark, FOLDER)
    assert rows(found.toArrow()) == sql_rows(con, ORACLE[name])


def test_every_archive_query_has_sql_or_is_a_sample():
    assert set(archive.QUERIES) - set(archive.ORACLE) == {"sampled_files", "station_sample"}


def test_samples_are_the_same_again(spark):
    a, b = (archive.sampled_files(spark, FOLDER) for _ in range(2))
    assert rows(a.toArrow()) == rows(b.toArrow())
    assert 1 <= max(r["count"] for r in a.groupBy("schema_group").count().collect()) <= 3
