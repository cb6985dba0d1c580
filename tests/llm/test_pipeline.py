import pytest
from llm.llm_helpers import documents, texts
from oracle_check import connect, spark_rows, sql_rows

import __spark_entry__ as contract
import corpus_pipeline
from vocabmill.llm import oracle, queries

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = documents(spark)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "").cache()
        assert after.columns == docs.columns, name
        assert after.dtypes == docs.dtypes
        docs = after
        counts.append(docs.count())
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    assert len(rows) == docs.count()
    own = texts()
    assert all((i, t) in rows for i, t, _ in own[:60] if i not in (3, 7))
    assert {i for i, _ in rows} & {80, 81, 82, 83, 92, 75, 76} == set()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in last} == {i for i, _ in rows}


def test_copies_without_ids_and_with_one_id(spark, tmp_path):
    """Copies go whatever their ids are; rows that share an id are told apart by their texts."""
    own = texts()
    near = own[5][1].rsplit(" ", 1)[0] + " other."
    rows = [(None, own[5][1], "en"), (None, near, "en"), (5, own[5][1], "en"), (6, own[6][1], "de"), (6, own[8][1], "de"), (6, own[6][1] + " end.", "de")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    groups = [{own[5][1], near}, {own[6][1], own[6][1] + " end."}, {own[8][1]}]
    assert len(left) == 3
    assert all(sum(r.text in group for r in left) == 1 for group in groups)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables(spark, name, stage):
    assert stage(spark, documents(spark, []), "").collect() == []


def test_all_queries_are_registered():
    names = contract.queries()
    assert "pipeline" in names
    for number in range(1, 14):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1
    assert set(oracle.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_queries_against_sql(spark, name):
    schema, rows = spark_rows(queries.queries()[name](spark, SF_DIR))
    expected_schema, expected = sql_rows(connect(SF_DIR), oracle.oracle_sql()[name])
    assert schema == expected_schema
    assert rows == expected


def test_pipeline_on_tables(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert rows and max(fill.values()) <= queries.TOKEN_LIMIT
    assert len(fill) <= -(-sum(fill.values()) // queries.TOKEN_LIMIT) + 2
