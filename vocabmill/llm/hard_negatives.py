"""Hard negatives: for an anchor and each of its positives, the best rows of other labels within a window of scores.

A score is the inner product of components ``floor(256 * x)``, an integer.
Everything is exact; angles only decide what need not be scored:

1. Some anchors that point in different directions are the references. Every row is stored
   with its norm and its angles to them.
2. Anchors and rows are dealt into the cells of a grid, so many anchors and so many
   rows each. A cell is one group: the stated queries against all rows, in blocks.
3. In a cell, the angles of an anchor and a row to a reference bound the angle between
   them: it is at least their difference, and at most their sum (or the rest to a full
   circle). Cosines of the bounds times both norms, widened beyond any rounding,
   bound the score; first for tiles of rows that point the same way, then for rows.
   Only where these bounds meet a window of scores that may still enter
   a result are integers multiplied. A window's lower end rises with the worst row kept.
4. Each cell returns its best rows of each window, which are merged by anchor. This is
   done once for the positives and once for the negatives, whose windows
   follow from the positives' scores.

Rows with a null id, label or vector, or a component that is null or not finite (also
after scaling) take no part. An id is no positive or negative of itself; rows that
repeat an id, label and vector count once. Vectors meet vectors of their own
length only; empty ones score 0. Scores beyond 64 bits count as the nearest 64-bit number.
Ties go to the smaller id. An empty table, or one without anchors, gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vocabmill.llm.shared import map_batches, ship_package, stored

_PREPARED = "id long, label long, vector array<double>, norm double, angles array<float>"
_TILE = 1024
#: Angles are stored in single precision; this covers its rounding and that of the arc cosine near 0.
_ANGLE_SLACK = 1e-5
_MOST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Params:
    every: int = 100  # rows whose id this divides are anchors
    positives: int = 5
    negatives: int = 10
    low: int = 30  # a negative's score in hundredths of the positive's
    high: int = 90
    references: int = 8
    sample: int = 1024  # anchors among which the references are chosen; changes no result
    anchors: int = 1 << 14  # in a cell, about; changes no result
    rows: int = 1 << 15  # in a cell, about; changes no result


def scaled(vector: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.floor(256.0 * vector)


def angles_to(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles in radians; a zero vector has right angles to all, which is as good as any as its norm is 0."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    units = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    return np.arccos(np.clip(units @ references.T, -1.0, 1.0))


def choose_references(vectors: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors far from each other, one by one the one whose nearest choice is farthest."""
    norms = np.linalg.norm(vectors, axis=1)
    units = vectors[(norms > 0) & np.isfinite(norms)] / norms[(norms > 0) & np.isfinite(norms), None]
    chosen: list[int] = []
    nearest = np.full(len(units), -2.0)
    while len(units) and len(chosen) < count:
        k = int(np.argmin(nearest)) if chosen else 0
        if chosen and nearest[k] > 1 - 1e-9:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, units @ units[k])
    return units[chosen]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (null: not a number), start and length of each row of a list column."""
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values, offsets[:-1], np.diff(offsets)


def prepared(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """``id, label, vector`` with scaled components, ``norm`` and ``angles`` to the references of its length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts, sizes = _lists(batch.column(2))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                vectors = scaled(values[starts[own][:, None] + np.arange(size)[None, :]])
                good = np.isfinite(vectors).all(axis=1)
                own, vectors = own[good], vectors[good]
                found = references.get(int(size), np.zeros((0, size)))
                angles = angles_to(vectors, found).astype(np.float32)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (vectors, angles)]
                with np.errstate(over="ignore"):
                    norms = np.linalg.norm(vectors, axis=1)
                own = pa.array(own)
                yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), lists[0], pa.array(norms), lists[1]], ["id", "label", "vector", "norm", "angles"])

    return map_batches(rows, run, _PREPARED)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``b``, whose values are whole numbers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -_MOST, _MOST).astype(np.int64)


def score_bounds(angles_a: np.ndarray, norms_a: np.ndarray, low: np.ndarray, high: np.ndarray, norms: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each ``a`` with each other row (or tile) whose angles lie in ``low..high`` and norms in ``norms``."""
    shape = len(angles_a), len(low)
    least, most = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32)
    for k in range(angles_a.shape[1]):
        a = angles_a[:, k, None]
        np.maximum(least, a - high[None, :, k], out=least)
        np.maximum(least, low[None, :, k] - a, out=least)
        np.minimum(most, a + high[None, :, k], out=most)
        np.minimum(most, 2 * np.float32(np.pi) - a - low[None, :, k], out=most)
    upper = np.cos(np.maximum(least.astype(np.float64) - _ANGLE_SLACK, 0.0))
    lower = np.cos(np.minimum(most.astype(np.float64) + _ANGLE_SLACK, np.pi))
    small, great = (norms_a[:, None] * x[None, :] for x in norms)
    with np.errstate(invalid="ignore"):
        slack = 1.0 + 1e-9 * great
        top = np.where(upper > 0, great, small) * upper + slack
        bottom = np.where(lower > 0, small, great) * lower - slack
    # Norms beyond all numbers bound nothing; scores end where 64 bits do.
    bottom, top = np.where(np.isnan(bottom), -np.inf, bottom), np.where(np.isnan(top), np.inf, top)
    return np.clip(bottom, -float(_MOST), float(_MOST)), np.clip(top, -float(_MOST), float(_MOST))


class Best:
    """The first ``size`` rows of each query, by score and id."""

    def __init__(self, queries: int, size: int):
        self.size = size
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: No lower score can enter.
        self.floor = np.full(queries, -_MOST, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        new = np.ones(len(query), bool)
        new[1:] = (np.diff(query) != 0) | (np.diff(score) != 0) | (np.diff(ids) != 0)
        query, score, ids = query[new], score[new], ids[new]
        first = np.flatnonzero(np.concatenate(([True], np.diff(query) != 0)))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        self.query, self.score, self.id = (x[place < self.size] for x in (query, score, ids))
        full = place == self.size - 1
        self.floor[query[full]] = score[full]


@dataclass
class Side:
    """Rows of one length, as arrays."""

    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    norm: np.ndarray
    angles: np.ndarray

    def take(self, rows: np.ndarray) -> Side:
        return Side(self.id[rows], self.label[rows], self.vector[rows], self.norm[rows], self.angles[rows])


def sides(table: pa.Table) -> dict[int, tuple[np.ndarray, Side]]:
    """Rows by the length of their vectors, with their numbers in the table."""
    table = table.combine_chunks()
    vector, angles = (table.column(c).combine_chunks() for c in ("vector", "angles"))
    vector, angles = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (vector, angles))
    values, starts, sizes = _lists(vector)
    angle, angle_starts, angle_sizes = _lists(angles)
    result = {}
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        wide = int(angle_sizes[own[0]])
        result[int(size)] = own, Side(
            *(table.column(c).to_numpy()[own] for c in ("id", "label")),
            values[starts[own][:, None] + np.arange(size)[None, :]],
            table.column("norm").to_numpy()[own],
            angle[angle_starts[own][:, None] + np.arange(wide)[None, :]].astype(np.float32),
        )
    return result


def search(anchors: Side, rows: Side, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, size: int) -> Best:
    """The best rows for queries ``anchor`` (rows of ``anchors``) with scores in ``low..high`` and the same label, or another."""
    best = Best(len(anchor), size)
    if rows.angles.shape[1]:  # rows that point the same way are neighbours
        nearest = rows.angles.argmin(axis=1)
        rows = rows.take(np.lexsort((rows.angles.min(axis=1), nearest)))
    for start in range(0, len(rows.id), _TILE):
        part = rows.take(np.arange(start, min(start + _TILE, len(rows.id))))
        # The scores that may still enter a result of an anchor.
        wanted = np.maximum(low, best.floor)
        open_ = np.flatnonzero(wanted <= high)
        least, most = np.full(len(anchors.id), np.inf), np.full(len(anchors.id), -np.inf)
        np.minimum.at(least, anchor[open_], wanted[open_].astype(np.float64))
        np.maximum.at(most, anchor[open_], high[open_].astype(np.float64))
        bottom, top = score_bounds(
            anchors.angles, anchors.norm, part.angles.min(axis=0)[None], part.angles.max(axis=0)[None], (part.norm.min()[None], part.norm.max()[None])
        )
        live = np.flatnonzero((top[:, 0] >= least) & (bottom[:, 0] <= most))
        for at in range(0, len(live), _TILE):
            some = live[at : at + _TILE]
            bottom, top = score_bounds(anchors.angles[some], anchors.norm[some], part.angles, part.angles, (part.norm, part.norm))
            meets = (top >= least[some, None]) & (bottom <= most[some, None])
            meets &= ((anchors.label[some, None] == part.label[None]) == same) & (anchors.id[some, None] != part.id[None])
            cols, lines = np.flatnonzero(meets.any(axis=0)), np.flatnonzero(meets.any(axis=1))
            if not len(cols):
                continue
            scores = exact_scores(anchors.vector[some[lines]], part.vector[cols])
            meets = meets[np.ix_(lines, cols)]
            line = np.full(len(anchors.id), -1)
            line[some[lines]] = np.arange(len(lines))
            asked = open_[line[anchor[open_]] >= 0]
            for first in range(0, len(asked), _TILE):
                query = asked[first : first + _TILE]
                own = line[anchor[query]]
                good = meets[own] & (scores[own] >= wanted[query, None]) & (scores[own] <= high[query, None])
                q, c = np.nonzero(good)
                best.add(query[q], scores[own[q], c], part.id[cols[c]])
    return best


def _searched(anchors: pa.Table, rows: pa.Table, low: list[list[int]], high: list[list[int]], same: bool, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, Best]]:
    """Results of a cell: table row of the anchor and number of the window for each query, and its best rows."""
    others = sides(rows)
    for length, (own, side) in sides(anchors).items():
        if length not in others:
            continue
        sizes = [len(low[k]) for k in own]
        anchor = np.repeat(np.arange(len(own)), sizes)
        number = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, np.int64)]).astype(np.int64)
        ends = (np.array([x for k in own for x in ends[k]], np.int64) for ends in (low, high))
        yield own[anchor], number, search(side, others[length][1], anchor, *ends, same, size)


def _cells(rows: DataFrame, anchors: DataFrame, params: Params):
    """Both sides, grouped by cell; ``rows`` and ``anchors`` are stored tables."""
    spark = rows.sparkSession
    across = -(-anchors.count() // params.anchors) or 1
    # Small tables are spread over all cores.
    down = max(-(-rows.count() // params.rows), spark.sparkContext.defaultParallelism)
    dealt = rows.withColumn("down", F.pmod(F.monotonically_increasing_id(), F.lit(down)).cast("int"))
    dealt = dealt.withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    asked = anchors.withColumn("across", F.pmod("anchor", F.lit(across)).cast("int"))
    asked = asked.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    return dealt.groupBy("across", "down"), asked.groupBy("across", "down")


def _first(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The first rows of each key by score and id; a row that was found twice counts once."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= size).dropDuplicates([*keys, "rank"])


def positives(rows: DataFrame, anchors: DataFrame, params: Params) -> DataFrame:
    """``anchor, rank, id, score``: the first rows with an anchor's label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            names = right.column("anchor").to_numpy()
            low, high = [[-_MOST]] * right.num_rows, [[_MOST]] * right.num_rows
            for own, _, best in _searched(right, left, low, high, True, params.positives):
                parts.append((names[own[best.query]], best.id, best.score))
        return _table(parts, ["anchor", "id", "score"])

    sides_ = _cells(rows, anchors, params)
    ship_package(rows.sparkSession)
    found = sides_[0].cogroup(sides_[1]).applyInArrow(run, "anchor long, id long, score long")
    return _first(found, ["anchor"], params.positives)


def negatives(rows: DataFrame, anchors: DataFrame, params: Params) -> DataFrame:
    """``anchor, positive, rank, id, score``: for each of the ``scores`` of an anchor, by number, the first rows of other labels."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            names, scores = right.column("anchor").to_numpy(), right.column("scores").to_pylist()
            low = [[-(-params.low * x // 100) for x in row] for row in scores]
            high = [[params.high * x // 100 for x in row] for row in scores]
            for own, number, best in _searched(right, left, low, high, False, params.negatives):
                parts.append((names[own[best.query]], number[best.query], best.id, best.score))
        return _table(parts, ["anchor", "positive", "id", "score"])

    sides_ = _cells(rows, anchors, params)
    ship_package(rows.sparkSession)
    found = sides_[0].cogroup(sides_[1]).applyInArrow(run, "anchor long, positive long, id long, score long")
    return _first(found, ["anchor", "positive"], params.negatives)


def _table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64) for _ in names]
    return pa.table([pa.array(x.astype(np.int64)) for x in columns], names)


def _references(anchors: DataFrame, params: Params) -> dict[int, np.ndarray]:
    """Reference directions by length of vector, from a bounded sample of anchors."""
    share = -(-anchors.count() // params.sample) or 1
    sample = anchors.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("vector").limit(params.sample)
    by_length: dict[int, list] = {}
    for row in sample.toLocalIterator():
        by_length.setdefault(len(row.vector), []).append(row.vector)
    return {size: choose_references(scaled(np.array(x, float).reshape(len(x), size)), params.references) for size, x in by_length.items()}


def mine(rows: DataFrame, params: Params = Params(), key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    anchors = rows.where(F.col("id") % params.every == 0)
    sound = anchors.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = stored(prepared(rows, _references(sound, params)), "negatives-rows")
    anchors = rows.where(F.col("id") % params.every == 0).dropDuplicates(["id", "label", "vector"])
    anchors = stored(anchors.withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    near = stored(positives(rows, anchors, params), "negatives-positives")
    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("x"))
    asked = stored(anchors.join(listed.select("anchor", F.col("x.score").alias("scores")), "anchor"), "negatives-windows")
    found = negatives(rows, asked, params)
    near = near.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor", (F.col("rank") - 1).cast("long").alias("positive"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return found.join(near, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
