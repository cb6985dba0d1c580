"""What tasks hold at once, and that it changes no result."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm.llm_helpers import documents, texts
from pyspark.sql import functions as F

import corpus_pipeline
from vocabmill.llm import language_id, quality_rules

MB = 1 << 20


@pytest.fixture
def task(monkeypatch):
    """Instead of running a function in tasks, give the rows that are sent to them and the function."""
    calls = []

    def note(df, function, schema):
        calls.append((df, function))
        return df

    monkeypatch.setattr(language_id, "map_batches", note)
    return calls


def used(function, batch):
    """Result rows of ``function`` and the most memory it had meanwhile, in MB."""
    list(function([batch.slice(0, 1)]))  # tables that a worker makes once
    tracemalloc.start()
    rows = sum(part.num_rows for part in function([batch]))
    most = tracemalloc.get_traced_memory()[1] / MB
    tracemalloc.stop()
    return rows, most


def model() -> language_id.Model:
    table = np.random.default_rng(1).normal(size=(1 << 15, 4)).astype(np.float32)
    return language_id.Model(["de", "en", "es", "fr"], table, None, np.zeros(4, np.float32), 1.0, 0.0, 15)


def test_counts_of_buckets_are_not_kept_for_all_rows(spark, task):
    docs = documents(spark)
    language_id.bags(docs, 15, "text", "doc_id")
    many = pa.record_batch([pa.array(range(1000)), pa.array([f"text of number {k} " * 20 for k in range(1000)])], ["doc_id", "text"])
    rows, most = used(task[0][1], many)
    assert rows == 1000
    assert most < 60  # as many as buckets for each row were 250


def test_prediction_works_in_small_blocks(spark, task):
    language_id.predict(documents(spark), model())
    many = pa.record_batch([pa.array(range(1000)), pa.array(["some words of a text " * 100] * 1000)], ["key", "text"])
    rows, most = used(task[0][1], many)
    assert rows == 1000
    assert most < 60


def test_texts_are_sent_once(spark, task):
    docs = documents(spark)
    rows = docs.select(F.struct("*").alias("row"))
    language_id.predict(rows, model(), key="row", text="row.text")
    assert task[0][0].columns == ["key"]
    language_id.predict(docs, model())
    assert task[1][0].columns == ["key", "text_sent"]


def test_texts_in_the_key_give_the_same(spark):
    """Rows with nulls, a null key and columns whose names differ in case."""
    docs = documents(spark).withColumnRenamed("text", "TEXT").withColumn("place", F.monotonically_increasing_id()).cache()
    beside = docs.select(F.col("place").alias("key_"), "text")
    rows = docs.select(F.struct("*").alias("row")).union(docs.limit(1).select(F.expr("if(true, null, struct(*))").alias("row")))
    found = quality_rules.references(docs, quality_rules.Limits())
    empty = [r.place for r in docs.where("text is null").collect()]
    pairs = [
        (quality_rules.judged(beside, found, key="key_"), quality_rules.judged(rows, found, key="row", text="row.text")),
        (language_id.predict(beside, model(), key="key_"), language_id.predict(rows, model(), key="row", text="row.text")),
    ]
    for apart, inside in pairs:
        names = apart.columns[1:]
        expected = {r.key_: tuple(r[n] for n in names) for r in apart.collect()}
        own = {r["row"] and r["row"].place: tuple(r[n] for n in names) for r in inside.collect()}
        nothing = own.pop(None)
        assert own == expected
        assert empty and {expected[p] for p in empty} == {nothing}


@pytest.mark.parametrize("size", [500, 1 << 20])
def test_blocks_change_no_counts(spark, monkeypatch, task, size):
    own = pa.record_batch([pa.array(range(len(texts()))), pa.array([t for _, t, _ in texts()], pa.string())], ["doc_id", "text"])
    language_id.bags(documents(spark), 15, "text", "doc_id")
    whole = pa.Table.from_batches(task[0][1]([own])).to_pylist()
    monkeypatch.setattr(language_id, "PIECE_CHARS", size)
    assert pa.Table.from_batches(task[0][1]([own])).to_pylist() == whole
    assert [r["doc_id"] for r in whole] == list(range(own.num_rows))


def test_stages_keep_rows_as_they_are(spark):
    docs = documents(spark).cache()
    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns, name
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
