"""Packing of token pieces into sequences of fixed length, by local search between underfull bins.

1. Each document is its ids and an end id; longer ones are cut into pieces of
   the full length. The pieces (numbers only, no ids) are written once.
2. Full pieces are sequences of their own. The others are dealt by hash into
   blocks of about ``BLOCK_PIECES`` pieces, as many as the count asks for. In a
   block, best fit (longest piece first) makes bins; then local search exchanges
   one piece for one, two for one, or moves a piece between underfull bins,
   whenever that raises the sum of squared fills, and drops bins that fall empty.
   A bin that gains goes on as the one to fill, so gains add up until it is full
   and the other one is empty.
3. Bins that stay underfull leave their block. Blocks of such pieces are packed
   again, in fewer blocks, until one block is left; so only the last block may
   have bins that could not be filled. Each round works on what the last could
   not fill, which is a small part of it.

A block is a bounded number of pieces, whatever the table's size. Null and empty
texts are a piece with the end id alone. Repeated rows are packed each; an id
may be null or occur several times. Empty tables give empty results.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabmill.llm.bpe import SentCodec
from vocabmill.llm.shared import map_batches, ship_package, stored

#: Pieces in a block, on average.
BLOCK_PIECES = 50_000
#: A bin is full enough if less than this share of it is free.
FULL_ENOUGH = 1 / 128
#: Pieces of a bin up to which its offers are kept in a table; bins with more are always looked at.
FEW = 4


def pieces(docs: DataFrame, codec: SentCodec, length: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of every piece; the column of the id is called ``key``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, start, size, crc = [], [], [], [], []
            held, at = np.zeros(0, "<u4"), 0

            def put(row, ids, at):
                owner.append(row)
                number.append(at // length)
                start.append(at)
                size.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))

            for row, ids, last in codec.get().encode(batch.column(1).to_pylist()):
                held = np.concatenate((held, ids, np.array([end_id] * last, "<u4"))).astype("<u4")
                whole = len(held) // length * length
                for k in range(0, whole, length):
                    put(row, held[k : k + length], at + k)
                held, at = held[whole:], at + whole
                if last:
                    if len(held):
                        put(row, held, at)
                    held, at = held[:0], 0
            columns = [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            yield pa.record_batch(columns, ["key", "piece", "start", "length", "ids_crc32"])

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long"
    return map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the fullest bin that it fits in."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    open_spaces: list[int] = []  # sorted free spaces that some bin has
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        at = bisect.bisect_left(open_spaces, size)
        if at == len(open_spaces):
            number, space = len(bins), capacity
            bins.append([])
        else:
            space = open_spaces[at]
            number = free[space].pop()
            if not free[space]:
                open_spaces.pop(at)
        bins[number].append(i)
        rest = space - size
        if rest:
            if not free[rest]:
                bisect.insort(open_spaces, rest)
            free[rest].append(number)
    return bins


def _best_exchange(gaining: list[int], losing: list[int], sizes: list[int], free: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The exchange that fills ``gaining`` most: how much, what it gets, what it gives."""
    best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
    offered = sorted((sizes[i], i) for i in losing)
    values = [v for v, _ in offered]

    def take(limit, given, lost):
        nonlocal best
        at = bisect.bisect_right(values, limit) - 1
        if at >= 0 and values[at] - lost > best[0]:
            best = (values[at] - lost, (offered[at][1],), given)

    take(free, (), 0)  # a move
    for i in gaining:  # one for one
        take(free + sizes[i], (i,), sizes[i])
    low, high = 0, len(offered) - 1  # two of the other bin, as a move or for one of its own
    for given, lost in [((), 0), *(((i,), sizes[i]) for i in gaining)]:
        low, high = 0, len(offered) - 1
        while low < high:
            both = values[low] + values[high]
            if both > free + lost:
                high -= 1
            else:
                if both - lost > best[0]:
                    best = (both - lost, (offered[low][1], offered[high][1]), given)
                low += 1
    pairs = sorted(gaining, key=sizes.__getitem__)
    for k, i in enumerate(pairs):  # one of the other bin for two of its own
        for j in pairs[k + 1 :]:
            take(free + sizes[i] + sizes[j], (i, j), sizes[i] + sizes[j])
    return best


def _offers(bins: list[list[int]], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """What each bin can give: its pieces and sums of two, a row each; and which bins have too many to list."""
    table, many = np.zeros((len(bins), FEW * (FEW + 1) // 2), np.int64), np.zeros(len(bins), bool)
    for n in range(len(bins)):
        _offer(table, many, n, [sizes[i] for i in bins[n]])
    return table, many


def _offer(table: np.ndarray, many: np.ndarray, n: int, values: list[int]) -> None:
    many[n] = len(values) > FEW
    both = [] if many[n] else values + [a + b for k, a in enumerate(values) for b in values[k + 1 :]]
    table[n, : len(both)] = both
    table[n, len(both) :] = 0


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills of underfull bins until no exchange does; empty bins go.

    A bin is compared with every other underfull bin that offers something of a size that would fit.
    """
    bins = list(bins)
    fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
    slack = int(capacity * FULL_ENOUGH)
    todo = sorted((n for n in range(len(bins)) if capacity - fill[n] > slack), key=lambda n: (-fill[n], n))
    done = [bins[n] for n in range(len(bins)) if capacity - fill[n] <= slack]
    table, many = _offers(bins, sizes)
    waiting = np.zeros(len(bins), bool)
    waiting[todo] = True
    while todo:
        target = todo.pop(0)
        waiting[target] = False
        gained = True
        while gained and fill[target] < capacity:
            gained = False
            own, free = [sizes[i] for i in bins[target]], capacity - fill[target]
            # A bin of many pieces has many ways to fill up, and is not held up for long.
            fits = many | (len(own) > 2 * FEW)
            for lost in {0, *own, *(a + b for k, a in enumerate(own) for b in own[k + 1 :])} if len(own) <= 2 * FEW else ():
                fits |= ((table > lost) & (table <= lost + free)).any(axis=1)
            partners = np.flatnonzero(fits & waiting)
            # The emptiest bins first: to take from them raises the squares most.
            for other in partners[np.lexsort((-partners, fill[partners]))].tolist():
                gain, got, given = _best_exchange(bins[target], bins[other], sizes, int(capacity - fill[target]))
                # The squares rise by 2 * gain * (fill of target - fill of other + gain).
                if gain > 0 and fill[target] + gain > fill[other]:
                    bins[target] = [i for i in bins[target] if i not in given] + list(got)
                    bins[other] = [i for i in bins[other] if i not in got] + list(given)
                    fill[target] += gain
                    fill[other] -= gain
                    _offer(table, many, other, [sizes[i] for i in bins[other]])
                    gained = True
                    if not fill[other]:
                        todo.remove(other)
                        waiting[other] = False
                    if fill[target] == capacity:
                        break
            if gained:
                todo.sort(key=lambda n: (-fill[n], n))
        done.append(bins[target])
    return done


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def _packed(rows: DataFrame, blocks: int, capacity: int, final: bool, first_bin: int) -> DataFrame:
    """Columns of ``rows`` and ``bin``, ``offset``; both null for what another round has to pack."""
    columns = [name for name in rows.columns if name not in ("bin", "offset")]
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.select(*columns).dtypes) + ", bin long, offset long"
    ship_package(rows.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        table = table.select(columns).sort_by([(name, "ascending") for name in ("length", "ids_crc32", "start", "row")])
        sizes = table.column("length").to_pylist()
        bin_of, offset = [None] * len(sizes), [None] * len(sizes)
        number = first_bin + block
        for members in pack_block(sizes, capacity):
            if not final and capacity - sum(sizes[i] for i in members) > capacity * FULL_ENOUGH:
                continue
            at = 0
            for i in members:
                bin_of[i], offset[i] = number, at
                at += sizes[i]
            number += blocks
        return table.append_column("bin", pa.array(bin_of, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    block = F.pmod(F.xxhash64("row", F.lit(blocks)), F.lit(blocks)).cast("long")
    dealt = rows.select(*columns).withColumn("block", F.lit(0).cast("long") if blocks == 1 else block)
    return dealt.groupBy("block").applyInArrow(run, schema)


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """``parts`` of ``pieces`` with ``sequence_id`` and ``offset``. Numbers of sequences have gaps."""
    parts = stored(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    small = parts.where(F.col("length") < capacity)
    whole = parts.where(F.col("length") >= capacity)
    # Whole sequences take the negative numbers.
    results = [whole.withColumn("bin", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))]
    first, count, final = 0, small.count(), False
    while count:
        blocks = -(-count // BLOCK_PIECES)
        final = final or blocks == 1
        tried = stored(_packed(small, blocks, capacity, final, first), "packed")
        results.append(tried.where("bin is not null"))
        first += (count + 1) * blocks  # no block has more bins than there are pieces
        small = tried.where("bin is null")
        left = 0 if final else small.count()
        # Pieces that hardly any bin can be filled with are packed as they are.
        final, count = left > count // 2, left
    whole = results[0]
    for result in results[1:]:
        whole = whole.unionByName(result)
    return whole.drop("row").withColumnRenamed("bin", "sequence_id")
