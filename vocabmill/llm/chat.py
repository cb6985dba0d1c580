"""Chat formatting: cumulative snapshots are collapsed, the maximal conversations rendered.

Logs often hold a conversation once for every turn it had at the time. One that
is a prefix of a longer one, turn by turn (role and text), is dropped; of equal
ones that with the least id stays.

Each turn has a rolling hash of its conversation up to there: exclusive ors of
the hashes of position, role and text, twice with other seeds, as a window that
only reads on. Long conversations are cut into ranges of ``PART`` turn numbers,
whose sums are added up in a second, small window; so no task has to go through
one conversation. The hashes of the whole conversations are anti-joined with
those of all proper prefixes, which are made distinct before they are shuffled.

The rest is rendered by part: a row holds up to one range of turns, so a row
is bounded however long a conversation is. Parts follow one another.

Turns are ordered by turn, role, text, nulls first; their numbers need not be
without gaps. Null roles and texts are rendered as empty, but are not equal to
empty ones. Repeated rows are turns of their own. Rows without a conversation id
are one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocabmill.llm.shared import stored

#: Turn numbers in a part.
PART = 256


def _turn_hash(seed: int) -> Column:
    values = [F.col("position"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return F.xxhash64(F.lit(seed), *values)


def rolling(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text) with ``part``, ``position`` and the hashes ``a, b`` up to each turn."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    cut = turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 62))))
    local = cut.withColumn("position", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    sizes = cut.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = (
        local.join(offsets.withColumnRenamed("conv", "c").withColumnRenamed("part", "p"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
        .withColumn("position", F.col("position") + F.col("before"))
        .drop("c", "p", "before")
    )
    placed = stored(placed.withColumn("ha", _turn_hash(1)).withColumn("hb", _turn_hash(2)), "turns")
    sums = placed.groupBy("conv", "part").agg(F.bit_xor("ha").alias("ha"), F.bit_xor("hb").alias("hb"))
    earlier = sums.select(
        F.col("conv").alias("c"), F.col("part").alias("p"), *(F.coalesce(F.bit_xor(h).over(before), F.lit(0)).alias(f"{h}_before") for h in ("ha", "hb"))
    )
    so_far = Window.partitionBy("conv", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumn("a", F.bit_xor("ha").over(so_far)).withColumn("b", F.bit_xor("hb").over(so_far))
    return within.join(earlier, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select(
        "conv", "turn", "role", "text", "part", "position", F.col("a").bitwiseXOR(F.col("ha_before")).alias("a"), F.col("b").bitwiseXOR(F.col("hb_before")).alias("b")
    )


def maximal(rows: DataFrame) -> DataFrame:
    """``conv, n_turns, n_copies``: conversations that no other one continues; the least id of equal ones."""
    sizes = rows.groupBy("conv").agg(F.max("position").alias("n_turns"))
    known = rows.select("conv", "position", "a", "b").join(
        sizes.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))
    )
    proper = known.where(F.col("position") < F.col("n_turns")).select("a", "b", "position").distinct()
    whole = known.where(F.col("position") == F.col("n_turns")).select("conv", "a", "b", "n_turns")
    one = whole.groupBy("a", "b", "n_turns").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    left = one.join(proper.withColumnRenamed("position", "n_turns"), ["a", "b", "n_turns"], "left_anti")
    return left.select("conv", "n_turns", "n_copies")


def rendered(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """``conv, part, n_turns, n_copies, text``: parts are numbered from 0 by their order."""
    chosen = rows.join(kept.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = chosen.groupBy("conv", "part", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("position", turn.alias("turn")))).alias("turns"))
    number = (F.row_number().over(Window.partitionBy("conv").orderBy("part")) - 1).cast("long")
    return parts.select("conv", number.alias("part"), "n_turns", "n_copies", F.array_join("turns.turn", "").alias("text"))


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rendered maximal conversations of a table of turns."""
    named = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = stored(rolling(named), "rolling")
    return rendered(rows, stored(maximal(rows), "maximal")).withColumnRenamed("conv", conv)
