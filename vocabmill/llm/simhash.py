"""Near duplicates by SimHash: every pair of fingerprints is compared, in tiles.

1. A text's words (split at the ASCII blanks, A-Z lower-cased) give shingles of four,
   repeats included. A bit of the fingerprint is 1 if it is set in over half of
   the shingles' XXH64 values. A text with fewer words is one shingle; without
   words the fingerprint is zero.
2. Equal fingerprints are one class, so a text with millions of copies counts once.
3. Classes are dealt into cells by the population counts of both halves of the
   fingerprint, 33 x 33 at most; a cell with many classes is cut into tiles by
   hash. Two fingerprints that differ in ``radius`` bits have counts that differ by
   ``radius`` at most in total, so only tiles of cells that are that near meet.
4. A pair of tiles is one row: all fingerprints of one against those of the other,
   by numpy's exclusive-or and bit counts. Within it, blocks whose quarters'
   population counts differ by more than the radius in total are skipped as well.
   Of the links found, a pair of tiles returns a spanning forest: at most as many
   links as it has classes, however many there are.
5. The links give components, by large-star and small-star.

Null texts count as empty. Empty texts have the fingerprint zero and are linked
like all others. Very long texts are hashed piece by piece. Rows without an id get
a fingerprint, but take no part in links and have a null component. Repeated rows
are one class; rows that share an id but not the text are classes of their own.
An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabmill.llm.components import components
from vocabmill.llm.shared import BLOCK_CHARS, map_batches, stored

_BLANK = re.compile(rb"[ \t-\r]")
#: Elements of a matrix of differences that is worked on at once.
_MATRIX = 1 << 20


@dataclass(frozen=True)
class Params:
    width: int = 4  # words in a shingle
    radius: int = 4  # fingerprints link if so many bits differ, or fewer
    seed: int = 42
    tile: int = 1 << 16  # classes in a tile, about; changes no result


def word_blocks(text: bytes, most: int = BLOCK_CHARS) -> Iterator[list[bytes]]:
    """The words of a text, in blocks of some ``most`` bytes; no word is cut."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + most) if at + most < len(text) else None
        end = blank.end() if blank else len(text)
        yield text[at:end].split()
        at = end


def shingle_hashes(text: bytes, params: Params) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, in blocks."""
    words: list[bytes] = []
    found = False
    for block in word_blocks(text):
        words += block
        if len(words) >= params.width:
            found = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts.tolist(), ends[params.width - 1 :].tolist(), strict=False)
            yield np.array([xxhash.xxh64_intdigest(joined[a:b], params.seed) for a, b in spans], np.uint64)
            words = words[len(words) - params.width + 1 :]
    if words and not found:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), params.seed)], np.uint64)


def fingerprint(text: str | None, params: Params = Params()) -> int:
    """64 bits; ``bytes.lower`` and ``bytes.split`` know ASCII only, as is asked for."""
    set_bits, count = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes((text or "").encode().lower(), params):
        for start in range(0, len(hashes), 1 << 14):
            part = hashes[start : start + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        count += len(hashes)
    return sum(1 << int(k) for k in np.flatnonzero(2 * set_bits > count)) if count else 0


def fingerprints(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fingerprint`` (its 64 bits as a signed number) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), params) for x in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["id", "fingerprint"])

    return map_batches(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), run, "id long, fingerprint long")


def join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Make the links ``(u, v)`` connect in ``label``, where every node names the least of its group."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while len(u) and not np.array_equal(up := label[label], label):
            label[:] = up


def _quarters(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Groups of the fingerprints ``left`` then ``right`` by links between both (or within ``left``): each names its least."""
    within = right is None
    right = left if within else right
    label = np.arange(len(left) if within else len(left) + len(right))
    blocks, block = np.unique(_quarters(left), axis=0, return_inverse=True)
    others, other = np.unique(_quarters(right), axis=0, return_inverse=True)
    rows = np.argsort(block, kind="stable")
    ends = np.cumsum(np.bincount(block, minlength=len(blocks)))
    for k, counts in enumerate(blocks):
        near = np.flatnonzero((np.abs(others - counts).sum(axis=1) <= radius)[other])
        own = rows[ends[k - 1] if k else 0 : ends[k]]
        step = max(1, _MATRIX // max(len(near), 1))
        for start in range(0, len(own) if len(near) else 0, step):
            part = own[start : start + step]
            differ = np.bitwise_count(left[part][:, None] ^ right[near][None, :])
            i, j = np.nonzero(differ <= radius)
            u, v = part[i], near[j]
            if within:
                u, v = u[u < v], v[u < v]
            join_labels(label, u, v if within else v + len(left))
    return label


def tile_pairs(classes: DataFrame, params: Params) -> DataFrame:
    """``a, b, same, left, right``: the tiles that have to be compared, with their classes."""
    low = F.bit_count(F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned("fingerprint", 32))
    dealt = classes.withColumns({"low": low.cast("int"), "high": high.cast("int")})
    cells = dealt.groupBy("low", "high").agg(F.ceil(F.count("*") / params.tile).cast("int").alias("tiles"))
    cells = stored(cells, "simhash-cells")
    salted = dealt.join(cells, ["low", "high"]).withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
    name = F.struct("low", "high", "tile")
    tiles = stored(
        salted.groupBy(name.alias("a")).agg(F.collect_list(F.struct("fingerprint", "id")).alias("left")), "simhash-tiles"
    )
    reach = range(-params.radius, params.radius + 1)
    steps = [(x, y) for x, y in product(reach, reach) if abs(x) + abs(y) <= params.radius and (x, y) >= (0, 0)]
    steps = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps)))
    others = cells.select(*(F.col(c).alias(f"{c}_") for c in cells.columns))
    met = cells.select("*", steps.alias("step"))
    met = met.join(others, (F.col("low_") == F.col("low") + F.col("step.x")) & (F.col("high_") == F.col("high") + F.col("step.y")))
    met = met.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumn("tile_", F.explode(F.sequence(F.lit(0), F.col("tiles_") - 1)))
    met = met.select(name.alias("a"), F.struct(F.col("low_").alias("low"), F.col("high_").alias("high"), F.col("tile_").alias("tile")).alias("b"))
    met = met.where("a <= b")
    # The work grows with the product of two tiles, not with their bytes: partitions are not merged by size.
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lefts = met.join(tiles, "a").repartition(partitions, "b")
    return lefts.join(tiles.select(F.col("a").alias("b"), F.col("left").alias("right")), "b")


def links(classes: DataFrame, params: Params = Params()) -> DataFrame:
    """``u, v``: links that connect whatever the pairs of ``classes (id, fingerprint)`` within the radius connect.

    Nodes are ``struct(id, fingerprint)``, so the least of a component has its least id.
    """
    node = "struct<id: bigint, fingerprint: bigint>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(k).slice(row, 1).flatten() for k in (1, 2)]
                prints, ids = ([x.field(name).to_numpy() for x in sides] for name in ("fingerprint", "id"))
                bits = [x.view(np.uint64) for x in prints]
                same = batch.column(0)[row].as_py()
                label = forest(bits[0], None if same else bits[1], params.radius)
                prints, ids = (x[0] if same else np.concatenate(x) for x in (prints, ids))
                child = np.flatnonzero(label != np.arange(len(label)))
                yield pa.record_batch(
                    [pa.StructArray.from_arrays([pa.array(ids[k]), pa.array(prints[k])], ["id", "fingerprint"]) for k in (child, label[child])], ["u", "v"]
                )

    pairs = tile_pairs(classes, params).select((F.col("a") == F.col("b")).alias("same"), "left", "right")
    return map_batches(pairs, run, f"u {node}, v {node}")


def simhash_duplicates(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` (16 hex digits) and ``component_id`` of every row: the least id of its component."""
    rows = stored(fingerprints(docs, params, key, text), "simhash-fingerprints")
    classes = stored(rows.where("id is not null").groupBy("fingerprint").agg(F.min("id").alias("id")).select("id", "fingerprint"), "simhash-classes")
    found = components(links(classes, params)).select(F.col("node.fingerprint").alias("fingerprint"), F.col("component.id").alias("component"))
    named = classes.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    # Copies may be very many: joined by class with a stored table, a shuffle on either side, which Spark can split.
    named = stored(named, "simhash-components")
    return rows.join(named, "fingerprint", "left").select(
        F.col("id").alias(key),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
