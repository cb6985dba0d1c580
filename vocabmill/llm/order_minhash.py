"""Document fingerprints by Order MinHash, with Spark's own functions only.

A text is the sequence of its words (what stands between the ASCII characters
0x20 and 0x09 to 0x0D). Its k-mers are the runs of ``K`` words, each numbered
among its equals by occurrence; a text with fewer words is one k-mer. A hash of
a numbered k-mer says which of ``SLOTS`` slots it belongs to and ranks it there.
Of each slot the ``2`` minimal ones are selected and put into the order in which
they stand in the text; a hash of that tuple is the slot's part of the
fingerprint. As tuples keep the order of the text, moved passages change the
fingerprint as well as changed words do: it is sensitive to the edit distance.
One hash over all k-mers, split into slots, selects for all slots in one pass.

With ``fill``, as the query has it, a slot with fewer than two k-mers goes on into
the following slots, after the last into the first: it has the two k-mers that come
next from its start on the circle of hashes. For each slot these are the two minima
of the whole text under a hash of its own (the distance from the slot's start), as
Order MinHash asks for; slots of short texts only depend on each other. Then all
slots of a text with a word are filled. Without ``fill`` such slots have one k-mer,
which has no order, or none.

With ``split``, as the query has it, letters of the scripts that are written without
blanks between words are words by themselves, and so are the characters of a word
of more than ``LONG_WORD`` characters. Otherwise a text without blanks is one k-mer.

The likeness of two fingerprints is the number of slots with the same hash over
the greater number of filled slots. Equal texts have equal fingerprints, empty
texts the empty one; two empty fingerprints have likeness 1.

Null texts are empty. Hashes have 39 bits where occurrences are counted, and
positions count modulo 2^24 words. Steps are kept apart by generators of one
row each, so that each is evaluated once.

``next document``: the one with the next smaller id, after the last the first.
Rows with equal ids follow by a hash of their text; equal rows count as one and
have the same next document. Rows without an id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocabmill.llm.shared import stored

K = 3
SLOTS = 64
POSITION_BITS = 24
#: Bits of a slot's hash in the fingerprint.
HASH_BITS = 18
#: Characters of a word; a longer one is split into characters.
LONG_WORD = 64
UNSPACED = "".join(f"\\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))


def _step(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` and a column that later expressions can't pull into themselves."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _index(size: Column) -> Column:
    """0 to size - 1."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def _words(text: Column, split: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    if split:
        # The first test reads most texts only once, and copies none.
        text = F.when(text.rlike(f"[{UNSPACED}]"), F.regexp_replace(text, f"([{UNSPACED}])", " $1 ")).otherwise(text)
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def with_slots(df: DataFrame, text: str, out: str, fill: bool = False, split: bool = False) -> DataFrame:
    """``df`` with the filled slots of ``text``: an array of ``slot << HASH_BITS | hash``, by slot."""
    low = (1 << POSITION_BITS) - 1
    old = df.columns

    def at(array: str, i: Column) -> Column:
        return F.get(F.col(array), i)

    words = _words(F.col(text), split)
    if split:
        df = _step(df, "w_", words)
        parts = F.flatten(F.transform("w_", lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
        # No word has more characters than bytes.
        words = F.when(F.exists("w_", lambda w: F.octet_length(w) > LONG_WORD), parts).otherwise(F.col("w_"))
    df = _step(df, "h_", F.transform(words, lambda w: F.xxhash64(w)))
    size = F.size("h_")
    runs = F.when(size == 0, 0).otherwise(F.greatest(size - (K - 1), F.lit(1)))

    def kmer(i: Column) -> Column:
        value = F.xxhash64(*(at("h_", i + k) for k in range(K)))
        return F.shiftleft(value, POSITION_BITS).bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(low)))

    df = _step(df, "k_", F.sort_array(F.transform(_index(runs), kmer)))

    def rank(name: str, i: Column, bits: int) -> Column:
        return F.shiftright(at(name, i), bits)

    def firsts(name: str, bits: int) -> Column:
        return F.filter(_index(F.size(name)), lambda i: (i == 0) | (rank(name, i, bits) != rank(name, i - 1, bits)))

    df = _step(df, "f_", firsts("k_", POSITION_BITS))

    def numbered(start: Column, j: Column) -> Column:
        end = F.coalesce(at("f_", j + 1), F.size("k_"))

        def one(i: Column) -> Column:
            value = F.xxhash64(rank("k_", i, POSITION_BITS), i - start)
            return F.shiftleft(value, POSITION_BITS).bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(at("k_", i).bitwiseAND(F.lit(low)))

        return F.transform(F.sequence(start, end - 1), one)

    df = _step(df, "s_", F.sort_array(F.flatten(F.transform("f_", numbered))))
    slot_bits = 63 - (SLOTS - 1).bit_length()
    df = _step(df, "b_", firsts("s_", slot_bits))

    def place(i: Column) -> Column:
        return F.shiftright(at("s_", i), slot_bits)

    def hashed(i: Column) -> Column:
        first, second = at("s_", i), at("s_", i + 1)
        if fill:
            second = F.when(F.size("s_") > 1, F.coalesce(second, at("s_", F.lit(0))))
            both = second.isNotNull()
        else:
            both = second.isNotNull() & (F.shiftright(first, slot_bits) == F.shiftright(second, slot_bits))
        a, b = F.shiftright(first, POSITION_BITS), F.shiftright(second, POSITION_BITS)
        ordered = first.bitwiseAND(F.lit(low)) <= second.bitwiseAND(F.lit(low))
        value = F.when(~both, F.xxhash64(a)).when(ordered, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        return value.bitwiseAND(F.lit((1 << HASH_BITS) - 1))

    def slot(number: Column, value: Column) -> Column:
        return F.shiftleft(number, HASH_BITS).bitwiseOR(value).cast("int")

    if not fill:
        return _step(df, out, F.transform("b_", lambda i: slot(place(i), hashed(i)))).select(*old, out)
    # One more at the end: the first k-mers again, for the slots after the last one that has any.
    df = _step(df, "v_", F.transform("b_", hashed))
    df = _step(df, "p_", F.concat(F.transform("b_", place), F.array(F.lit(SLOTS - 1).cast("long"))))

    def reached(value: Column, i: Column) -> Column:
        """All slots after the one before, up to this one."""
        start = F.coalesce(at("p_", i - 1), F.lit(-1)) + 1
        return F.when(start <= at("p_", i), F.transform(F.sequence(start, at("p_", i)), lambda number: slot(number, value))).otherwise(F.array().cast("array<int>"))

    filled = F.flatten(F.transform(F.concat("v_", F.slice("v_", 1, 1)), reached))
    return _step(df, out, filled).select(*old, out)


def fingerprint(slots: Column) -> Column:
    """Six hexadecimal digits for each filled slot, in order."""
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(most, F.lit(1)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", fill: bool = False, split: bool = False) -> DataFrame:
    """``key, fingerprint`` of every row."""
    rows = with_slots(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "slots", fill, split)
    return rows.select(F.col("key").alias(key), fingerprint(F.col("slots")).alias("fingerprint"))


def _neighbours(ids: DataFrame) -> DataFrame:
    """``row, next_row`` of distinct rows ``(id, row)``: by descending id, the last followed by the first.

    Ranges of the order are sorted by themselves; one row of each range tells
    the range before how to go on.
    """
    order = [F.col("id").desc_nulls_last(), F.col("row").asc()]
    ranged = stored(ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    following = ranged.withColumn("next_row", F.lead("row").over(Window.partitionBy("range").orderBy(*order)))
    firsts = ranged.select("range", "id", "row").withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    firsts = stored(firsts.where("place = 1").select("range", "row"), "range-heads")
    # As many rows as there are ranges.
    after = F.lead("row").over(Window.orderBy("range"))
    lowest = F.first("row").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = firsts.select("range", F.coalesce(after, lowest).alias("head"))
    return following.join(F.broadcast(follow), "range").select("row", F.coalesce("next_row", "head").alias("next_row"))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", fill: bool = False, split: bool = False) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last third replaced by as much of the start of the next document.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit("|"), F.col("text"))))
    sized = rows.select("id", "row", F.length("text").alias("n")).distinct()
    pairs = stored(_neighbours(sized.select("id", "row")).join(sized.select("row", "n"), "row"), "neighbours")
    # One shuffle of the texts serves both joins: both read all of these columns.
    marked = with_slots(rows, "text", "slots", fill, split).select("id", "row", "text", "slots").repartition("row")
    other = marked.select(F.col("row").alias("next_row"), F.col("id").alias("next_id"), F.col("text").alias("next_text"), F.col("slots").alias("next_slots"))
    third = F.floor(F.col("n") / 3).cast("int")
    nexts = pairs.join(other, "next_row").select("row", "next_id", F.expr("substring(next_text, 1, cast(floor(n / 3) as int))").alias("start"), "next_slots")
    nexts = nexts.dropDuplicates(["row"])
    both = marked.join(nexts, "row").withColumn("n", F.length("text"))
    both = both.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), (F.col("n") - third).cast("int")), F.col("start")))
    both = with_slots(both, "edited", "edited_slots", fill, split)
    return both.select(
        F.col("id").alias(key),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("slots")).alias("fingerprint"),
        fingerprint(F.col("edited_slots")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
        F.col("next_id").alias("next_doc_id"),
    )
