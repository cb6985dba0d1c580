"""Every registered query against its SQL twin, on the smallest data set."""

import pytest
from oracle_check import connect, spark_rows, sql_rows

import __spark_entry__ as contract
from vocabmill.plans import oracle, queries as registered

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = registered.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    schema, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_schema, expected = sql_rows(db, ORACLE[name])
    assert schema == expected_schema
    assert rows == expected


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[-1] == "rank"
    ranks = [r["rank"] for r in df.collect()]
    assert ranks == list(range(1, 101))


@pytest.mark.parametrize("name", ["t3_top_ordered", "t4_all_ordered", "j1_word_list", "j2_word_lists_all"])
def test_order_of_sorted_lists(spark, db, name):
    found = [r.ngram for r in QUERIES[name](spark, SF_DIR).collect()]
    order = "" if "all" in name else " ORDER BY rank"
    expected = [row[0] for row in db.sql(f"SELECT ngram FROM ({ORACLE[name]}){order}").fetchall()]
    assert found == expected
