"""Every registered query with SQL against that SQL, and the others for rows."""

import pytest

import oracle
from ferrule.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.differences(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 40
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_display_text_of_long_ages_equals_its_sql(spark, tmp_path):
    connection = oracle.duckdb.connect()
    connection.execute(f"COPY (SELECT unnest([0, 59, 3600, 86399, 86400, 128000])::BIGINT AS page_id, 'http://host/a/long/path/of/a/page.html' AS url) TO '{tmp_path}/pages.parquet' (FORMAT PARQUET)")
    assert oracle.differences(queries.QUERIES["display_text"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), queries.ORACLES["display_text"]) is None
