"""Near duplicates by MinHash: universal hash minima, banding, verification, components.

1. Each task turns its texts into sets of word shingles and takes ``bands * rows``
   minima of universal hashes of each set.
2. Documents with equal sets are one class; what follows works on classes, so a
   text with millions of copies counts once.
3. Classes that agree in all minima of a band share a bucket. In each bucket the
   least and the greatest class are paired with all others: as many pairs as
   members, however large the bucket.
4. Pairs whose signatures agree too rarely for the threshold are left out (by
   five standard deviations); for the others, both full sets are compared.
5. The links give components. Classes that are no end of a bucket that still holds
   several components were not compared with each other. They are joined by a
   prefix filter on their full sets: shingles are put in one order, rare ones first;
   two sets of ``a`` and ``b`` shingles that are alike enough have ``o`` in common,
   so they share one of the first ``a - o + 1`` of one and ``b - o + 1`` of the other.
   Large groups of texts that are alike, but not enough, differ by rare shingles
   and hardly meet. Pairs that meet in different components are compared. So no
   link is lost that the banding found: a pair left uncompared is connected by
   links already, or too different.

A pair at the threshold shares a bucket with probability ``1 - (1 - t^rows)^bands``:
0.999995 with the values below.

A text with fewer words than a shingle is one shingle. Null texts and texts without
words have an empty set and are linked with nothing. Very long texts are worked on
one by one, their words in pieces. Rows without an id get a null component and
are kept. Repeated rows belong to one class. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vocabmill.llm.components import components
from vocabmill.llm.hashed_words import hash_words, mixed, row_slices, windows
from vocabmill.llm.shared import map_batches, row_blocks, stored, string_bytes


@dataclass(frozen=True)
class Params:
    width: int = 5  # words in a shingle
    numerator: int = 75  # linked if denominator * intersection >= numerator * union
    denominator: int = 100
    bands: int = 32
    rows: int = 4
    seed: int = 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words, counts, _ = hash_words(data, offsets, fold=True)
    found, runs = windows(words, counts, width)
    short = {}
    for row in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        first = int(counts[:row].sum())
        x = np.array([counts[row]], np.uint64)
        for word in words[first : first + counts[row]]:
            x = mixed(x) + word
        short[row] = mixed(x)
    return [short[row] if row in short else np.unique(found[a:b]) for row, (a, b) in enumerate(row_slices(runs))]


def hash_family(params: Params) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(params.seed)
    count = params.bands * params.rows
    return (draw.integers(0, 1 << 63, count, np.uint64) << np.uint64(1)) | np.uint64(1), draw.integers(0, 1 << 63, count, np.uint64)


def signatures(sets: list[np.ndarray], params: Params) -> np.ndarray:
    """The minima of each non-empty set, a row each."""
    flat = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    factors, terms = hash_family(params)
    result = np.empty((len(factors), len(sets)), np.uint32)
    for k, (a, b) in enumerate(zip(factors, terms, strict=True)):
        result[k] = np.minimum.reduceat(((flat * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return result.T


def band_keys(minima: np.ndarray, params: Params) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = minima.reshape(len(minima), params.bands, params.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, params.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for k in range(params.rows):
        keys = mixed(keys) + parts[:, :, k]
    return mixed(keys).view(np.int64)


def sketches(docs: DataFrame, params: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, digest`` of the set, ``signature`` and ``keys`` of the bands (null for empty sets)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for start, stop in row_blocks(offsets):
                sets = shingle_sets(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], params.width)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(sizes)
                digest = [None] * len(sets)
                signature, keys = [None] * len(sets), [None] * len(sets)
                if len(full):
                    minima = signatures([sets[i] for i in full], params)
                    bands = band_keys(minima, params)
                    for k, i in enumerate(full.tolist()):
                        digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        signature[i], keys[i] = minima[k].view(np.int32), bands[k]
                yield pa.record_batch(
                    [batch.column(0).slice(start, stop - start), pa.array(sizes), pa.array(digest, pa.binary()), pa.array(signature, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "n_shingles", "digest", "signature", "keys"],
                )

    schema = "id long, n_shingles long, digest binary, signature array<int>, keys array<long>"
    return map_batches(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), run, schema)


def _likely(pairs: DataFrame, classes: DataFrame, params: Params) -> DataFrame:
    """Pairs whose signatures agree often enough, by five standard deviations."""
    share, count = params.numerator / params.denominator, params.bands * params.rows
    least = max(1, math.floor(count * share - 5 * math.sqrt(count * share * (1 - share))))
    signed = classes.select("id", "signature")
    agree = F.aggregate(F.zip_with("su", "sv", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    likely = (
        pairs.join(signed.select(F.col("id").alias("u"), F.col("signature").alias("su")), "u")
        .join(signed.select(F.col("id").alias("v"), F.col("signature").alias("sv")), "v")
        .where(agree >= least)
        .select("u", "v")
    )
    return stored(likely, "likely-pairs")


def compared(pairs: DataFrame, classes: DataFrame, texts: DataFrame, params: Params, screened: bool) -> DataFrame:
    """``u, v, linked`` of the pairs (that pass a test of their signatures, if ``screened``), by their full sets."""
    if screened:
        pairs = _likely(pairs, classes, params)
    both = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u").join(
        texts.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [string_bytes(batch.column(k)) for k in (2, 3)]
            good = np.zeros(batch.num_rows, bool)
            longer = sides[0][1] + sides[1][1]
            for start, stop in row_blocks(longer):
                sets = [shingle_sets(d[o[start] : o[stop]], o[start : stop + 1] - o[start], params.width) for d, o in sides]
                for row, (a, b) in enumerate(zip(*sets, strict=True)):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    union = len(a) + len(b) - common
                    good[start + row] = union and params.denominator * common >= params.numerator * union
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(good)], ["u", "v", "linked"])

    found = map_batches(both.select("u", "v", "tu", "tv"), run, "u long, v long, linked boolean")
    # An id that stands for several texts counts with the best of them.
    return found.groupBy("u", "v").agg(F.max("linked").alias("linked"))


def shingle_rows(ids: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """``id, set, n, shingle``: the shingles of the texts of ``ids``; ``set`` tells several texts of an id apart, ``n`` is its size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for start, stop in row_blocks(offsets):
                sets = shingle_sets(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], params.width)
                sizes = np.array([len(x) for x in sets])
                names = np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in sets])
                columns = (batch.column(0).slice(start, stop - start).to_numpy(), names, sizes)
                columns = [np.repeat(x, sizes) for x in columns] + [np.concatenate(sets).view(np.int64)]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], ["id", "set", "n", "shingle"])

    return map_batches(texts.join(ids, "id", "left_semi").select("id", "text"), run, "id long, set long, n long, shingle long")


def prefix_pairs(named: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """``u, v``: pairs of the classes ``named (id, component)`` in different components that may be alike enough.

    ``o = ceil(s / (1 + s) * (a + b))`` for a similarity of s. The smaller set is at
    least ``s`` times the larger one.
    """
    high, low = params.numerator, params.denominator
    rows = stored(shingle_rows(named.select("id"), texts, params), "mixed-shingles")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("sets"))
    # Rows that repeat an id and its text repeat the set: its shingles keep their places.
    place = F.dense_rank().over(Window.partitionBy("id", "set").orderBy("sets", "shingle")) - 1
    ordered = rows.join(counts, "shingle").withColumn("place", place)
    # The longest prefix is that against a set as much smaller as can be. What no other set has links with nothing:
    # a set with so many shingles of its own that they fill its prefix drops out.
    ordered = ordered.where((low * F.col("place") <= (low - high) * F.col("n")) & (F.col("sets") > 1))
    prefixes = stored(ordered.join(named, "id").select("id", "component", "n", "shingle", "place"), "prefixes")
    smaller = prefixes.where((low + high) * F.col("place") <= (low - high) * F.col("n"))
    larger = prefixes.select("shingle", *(F.col(c).alias(f"{c}_") for c in ("id", "component", "n", "place")))
    overlap = F.ceil(high * (F.col("n") + F.col("n_")) / F.lit(low + high).cast("double") - 1e-9)
    near = (F.col("n") < F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("id") < F.col("id_")))
    near = near & (low * F.col("n") >= high * F.col("n_")) & (F.col("component") != F.col("component_"))
    met = smaller.join(larger, "shingle").where(near & (F.col("place") <= F.col("n") - overlap) & (F.col("place_") <= F.col("n_") - overlap))
    return met.select(F.least("id", "id_").alias("u"), F.greatest("id", "id_").alias("v")).distinct()


def near_duplicates(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row; ``component_id`` is the least id of its component."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col(key).isNotNull())
    rows = stored(sketches(docs, params, key, text), "sketches")
    found = rows.where("n_shingles > 0 and id is not null")
    classes = stored(
        found.groupBy("digest")
        .agg(F.min(F.struct("id", "n_shingles", "signature", "keys")).alias("first"))
        .select("digest", "first.*"),
        "classes",
    )
    buckets = classes.select("id", "n_shingles", F.explode("keys").alias("bucket"))
    ends = stored(
        buckets.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"), "bucket-ends"
    )
    members = stored(buckets.join(ends, "bucket"), "bucket-members")
    stars = (
        members.where("id > low").select(F.col("low").alias("u"), F.col("id").alias("v"))
        .union(members.where("id < high and id > low").select(F.col("id").alias("u"), F.col("high").alias("v")))
        .distinct()
    )
    # The texts of classes that share a bucket are written once; no other text moves again.
    texts = stored(texts.join(members.select("id").distinct(), "id", "left_semi"), "bucket-texts")
    tested = stored(compared(stars, classes, texts, params, True), "compared")
    links = tested.where("linked").select("u", "v")
    first = components(links)
    # What is left: classes that are not an end of their bucket, in buckets with several components.
    inner = members.where("id > low and id < high").select("bucket", "id")
    named = inner.join(first, inner.id == first.node, "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    named = stored(named, "bucket-components")
    several = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("bucket")
    left = named.join(several, "bucket", "left_semi").select("id", "component").distinct()
    crossed = prefix_pairs(stored(left, "mixed-classes"), texts, params)
    more = compared(crossed.join(stars, ["u", "v"], "left_anti"), classes, texts, params, False)
    more = stored(more.where("linked").select("u", "v"), "more-links")
    named = stored(components(links.union(more)), "components")
    named = classes.select("digest", "id").join(named, F.col("id") == F.col("node"), "left")
    named = named.select("digest", F.coalesce("component", "id").alias("component_id"))
    # Copies may be very many: the sides are joined by class, which Spark can split.
    result = rows.select("id", "n_shingles", "digest").join(named, "digest", "left")
    result = result.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return result.select(
        F.col("id").alias(key), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
