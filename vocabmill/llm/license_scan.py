"""License scan by diagonal voting.

All pairs of neighbouring words of a text (k-grams with k = 2) are joined by
hash, and by the words themselves, with the pairs of the templates' words. A hit
at word ``i`` of the text and ``j`` of the template votes for the diagonal
``i - j``: a whole copy of a template has all its votes on one. The votes of a
diagonal are a bit for each pair of the template, in as many numbers of ``BITS`` bits
as the longest template needs; so they merge before the shuffle and repeated rows
change nothing.

Phrases: a place is a diagonal with all votes, which verifies every word.
Longer templates bring labels of their own: a diagonal is merged with those up
to ``GAP`` behind it (words that are inserted or left out shift the diagonal), and
the span is accepted if the merged votes cover ``COVERAGE`` of the template.

Templates are sentences or whole texts given by the caller, of any length from two
words on. Spark knows their exact size, and broadcasts them only if they are small.

Null and empty texts have no words, places and labels, and score 0. A template
that a text has several times is found each time. Rows are told apart by id and
text; equal rows have equal results. Texts of one word cannot match, as phrases
have two words at least. Very long texts are rows of pairs like others. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocabmill.llm.host_reputation import LOWER, UPPER

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and the labels of their licences.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Usual notices and the labels that they bring besides.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}
GAP = 2
COVERAGE = 0.75
#: Pairs of a template that are bits of one number.
BITS = 62


def words_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(folded, SEPARATORS), "")


def _template_rows(spark, phrases: Mapping[str, str], notices: Mapping[str, str]) -> tuple[DataFrame, int]:
    """A row for each pair of words of the templates, and how many numbers hold the bits of the longest."""
    columns: dict[str, list] = {name: [] for name in ("template", "label", "base", "pairs", "at", "t0", "t1")}
    for number, (text, label, base) in enumerate([*((t, x, True) for t, x in phrases.items()), *((t, x, False) for t, x in notices.items())]):
        words = [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]
        if len(words) < 2:
            raise ValueError(f"a template has two words or more: {text}")
        for at, (one, other) in enumerate(zip(words, words[1:], strict=False)):
            for name, value in zip(columns, (number, label, base, len(words) - 1, at, one, other), strict=True):
                columns[name].append(value)
    schema = "template int, label string, base boolean, pairs int, at int, t0 string, t1 string"
    # As an Arrow table it is a local relation, of a size that Spark knows.
    rows = spark.createDataFrame(pa.table(columns), schema) if columns["at"] else spark.createDataFrame([], schema)
    return rows, max(columns["at"], default=0) // BITS + 1


def _key(key: str, text: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))))


def diagonals(docs: DataFrame, templates: DataFrame, numbers: int, key: str, text: str) -> DataFrame:
    """``row, template, label, base, pairs, diagonal`` and its votes, in ``numbers`` columns."""
    words = docs.select(_key(key, text).alias("row"), words_of(F.col(text)).alias("words"))
    pairs = words.select("row", F.posexplode(F.arrays_zip(F.col("words").alias("w0"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("w1"))).alias("at_word", "pair"))
    pairs = pairs.select("row", "at_word", "pair.*").where("w1 is not null").withColumn("gram", F.xxhash64("w0", "w1"))
    hits = pairs.join(templates.withColumn("gram", F.xxhash64("t0", "t1")), "gram").where("w0 = t0 and w1 = t1")
    bit = F.expr(f"shiftleft(1L, at % {BITS})")
    votes = [F.bit_or(F.when(F.expr(f"at div {BITS}") == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"votes_{k}") for k in range(numbers)]
    return hits.groupBy("row", "template", "label", "base", "pairs", (F.col("at_word") - F.col("at")).alias("diagonal")).agg(*votes)


def _counted(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, map(F.bit_count, columns))


def spans(found: DataFrame) -> DataFrame:
    """``row, label, base, first_word, coverage`` of verified spans."""
    votes = [F.col(name) for name in found.columns if name.startswith("votes_")]
    exact = found.where(F.col("base") & (_counted(votes) == F.col("pairs")))
    exact = exact.select("row", "label", "base", F.col("diagonal").alias("first_word"), F.lit(1.0).alias("coverage"))
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    merged = _counted([F.bit_or(column).over(own.rangeBetween(0, GAP)) for column in votes])
    near = found.where(~F.col("base")).withColumn("merged", merged)
    coverage = F.col("merged") / F.col("pairs")
    near = near.where(coverage >= COVERAGE)
    # The diagonals of one copy count once, by the first.
    near = near.withColumn("before", F.lag("diagonal").over(own))
    near = near.where(F.col("before").isNull() | (F.col("diagonal") - F.col("before") > GAP))
    return exact.unionByName(near.select("row", "label", F.lit(False).alias("base"), F.col("diagonal").alias("first_word"), coverage.alias("coverage")))


def _labels(rows: Column) -> Column:
    return F.coalesce(F.array_join(F.array_sort(F.collect_set(rows)), ","), F.lit(""))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row."""
    templates, numbers = _template_rows(docs.sparkSession, phrases, notices)
    place = F.when(F.col("base"), F.col("first_word"))
    found = spans(diagonals(docs, templates, numbers, key, text)).groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(place).cast("long").alias("first_word"),
        F.max(place).cast("long").alias("last_word"),
        _labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        _labels(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = docs.select(F.col(key).alias("key"), _key(key, text).alias("row"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    return rows.join(found, "row", "left").select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def spans_of(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The verified spans themselves, with the id: ``key, label, base, first_word, coverage``; equal rows once."""
    found = spans(diagonals(docs, *_template_rows(docs.sparkSession, phrases, notices), key, text))
    names = docs.select(F.col(key).alias("key"), _key(key, text).alias("row")).distinct()
    return found.join(names, "row").select(F.col("key").alias(key), "label", "base", "first_word", "coverage")


