"""The total order on statistics.

More matches are better, then more books, then seen later, then first seen
earlier. Equal statistics are settled by the smaller word in byte order.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_first(matches="match_count", books="min_volume_count", word="top_casing") -> list[Column]:
    """Sort columns that put the best row first."""
    return [
        F.col(matches).desc(),
        F.col(books).desc(),
        F.col("last_year").desc(),
        F.col("first_year").asc(),
        F.col(word).asc(),
    ]


def rank_value(stats: str = "", books="volume_count", word: str | None = None) -> Column:
    """The same order as one comparable value: the smaller, the better.

    ``stats`` names a struct column that holds the statistics.
    """

    def field(name):
        return F.col(f"{stats}.{name}" if stats else name)

    parts = [
        (-field("match_count")).alias("matches"),
        (-field(books)).alias("books"),
        (-field("last_year")).alias("last"),
        field("first_year").alias("first"),
    ]
    if word:
        parts.append(F.col(word).alias("word"))
    return F.struct(*parts)
