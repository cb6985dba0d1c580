"""Connected components by alternating large-star and small-star.

Both steps link the neighbours of a node to the least one: the large star those
that are greater than the node, the small star the others and the node itself.
The neighbours of a node are never gathered: the least is a minimum that is
merged before the shuffle, and is joined back to the links, where Spark can
split a node with very many of them. Every round is written to the shared
folder; the end is seen by a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabmill.llm.shared import stored


def _starred(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``least``, the least v of each u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(stored(least, "least"), "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = _starred(both).where(F.col("v") > F.col("u"))
    return rows.select(F.col("v").alias("u"), F.least("least", "u").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rows = _starred(down)
    own = rows.select("u", F.col("least").alias("v"))
    others = rows.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return own.union(others).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head()
    return row.n, row.x or 0


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``(u, v)`` that isn't the least of its component.

    Links to oneself, repeated and reversed links do no harm; without links the result is empty.
    """
    links = stored(links.where("u <> v").distinct(), "links")
    state = _state(links)
    while state[0]:
        links = stored(_small_star(stored(_large_star(links), "large-star")), "small-star")
        state, before = _state(links), state
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
