"""Column layouts shared by every operator.

Only the listed columns are fixed. Operators that take ``keys`` carry extra
grouping columns, such as ``lang`` or ``file``, next to them.
"""

from pyspark.sql import types as T


def _longs(*names):
    return [T.StructField(name, T.LongType()) for name in names]


#: One yearly count of one spelling: the input of the engine.
ENTRY = T.StructType(
    [T.StructField("ngram", T.StringType())] + _longs("year", "match_count", "volume_count")
)

#: All accepted years of one spelling.
CASING = T.StructType(
    [T.StructField("ngram", T.StringType())]
    + _longs("first_year", "last_year", "match_count", "volume_count")
)

_TOP_STATS = T.StructType(_longs("first_year", "last_year", "match_count", "volume_count"))

#: All spellings that differ only in case. ``min_volume_count`` is a lower
#: bound, because one book may hold several spellings.
CLASS = T.StructType(
    [T.StructField("fold_key", T.StringType()), T.StructField("top_casing", T.StringType())]
    + _longs("first_year", "last_year", "match_count", "min_volume_count")
    + [T.StructField("top_stats", _TOP_STATS), T.StructField("n_casings", T.LongType())]
)

LANGUAGE = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("short_name", T.StringType(), False),
        T.StructField("word_prefixes", T.ArrayType(T.StringType(), False), False),
        T.StructField("should_strip_capitalized", T.BooleanType(), False),
    ]
)
