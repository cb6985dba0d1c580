"""Spelling variants: words that one inserted, deleted or replaced letter makes equal.

Words are counted in the tasks before they are shuffled. Then pivotal grams:

1. The bigrams of all words are put in one order, rare ones first. A word's prefix
   are its three first bigrams in that order, with all that tie with the third.
2. Of its prefix, a word takes two disjoint bigrams as pivots, by dynamic
   programming those with the least total of words that have them. One edit
   destroys one of two disjoint bigrams at most. So if two words are near, the one
   whose third bigram comes earlier (or either, if they tie) has a pivot
   that the other has too, and has in its prefix, as all its bigrams
   up to the third are in the prefix.
3. Position limits: an edit falls into one third of a word, by the length of the
   shorter one; the other two thirds stay as they are, and a bigram there stays at
   its place. So the index key is a pivot, its place, and the two other thirds.
   If both pivots touch the edited third, each is a key without a place.
   Words meet by these keys, not by a bigram alone: lists stay short however many
   words share a bigram.
4. Pairs that meet are verified by their edit distance.

Null texts have no words; a null id counts as an empty one. Texts are worked on in
pieces that end between words. A word's n counts all its places, repeated rows
included. Ties between forms go to the smaller word in code-point order. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabmill.llm.shared import BLOCK_CHARS, map_batches, stored

LETTERS = "A-Za-zÀ-ÿ"
_RUN = re.compile(f"[{LETTERS}]+")
_GAP = re.compile(f"[^{LETTERS}]")
#: Different words that a task counts before it passes them on.
_HELD = 1 << 18


@dataclass(frozen=True)
class Params:
    every: int = 31  # a run loses a letter if this divides its checksum
    shortest: int = 7
    least: int = 2  # occurrences of a word
    times: int = 10  # a form has so many times the word's occurrences


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + BLOCK_CHARS) if at + BLOCK_CHARS < len(text) else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def words_of(doc_id: int | None, text: str | None, params: Params = Params()) -> Counter:
    """The words of a text, with their number; ``bytes.lower`` knows A-Z only."""
    found: Counter = Counter()
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for piece in _pieces(text or ""):
        for run, n in Counter(_RUN.findall(piece.encode().lower().decode())).items():
            check = zlib.crc32(run.encode(), start)
            if check % params.every == 0:
                place = check % len(run)
                run = run[:place] + run[place + 1 :]
            if len(run) >= params.shortest:
                found[run] += n
    return found


def word_counts(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of the words that occur often enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(doc_id, x.as_py(), params).items():
                    held[word] += n
                if len(held) > _HELD:
                    yield flushed()
                    held.clear()
        yield flushed()

    found = map_batches(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.least)


def grams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Place of each bigram in the order, and number of its occurrences. There are 90 x 90 bigrams at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                found.update(grams(word))
        yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["gram", "n"])

    counts = map_batches(words.select("word"), run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    ordered = sorted((row.n, row.gram) for row in counts.toLocalIterator())
    return {gram: (place, n) for place, (n, gram) in enumerate(ordered)}


def prefix(word: str, order: dict[str, tuple[int, int]], size: int = 3) -> list[int]:
    """Starts of the ``size`` first bigrams of a word in the order, and of those that tie with the last, by start."""
    places = [order[x][0] for x in grams(word)]
    last = sorted(places)[size - 1]
    return [i for i, place in enumerate(places) if place <= last]


def pivots(word: str, order: dict[str, tuple[int, int]], count: int = 2) -> list[int]:
    """Starts of ``count`` disjoint bigrams of the prefix with the least total of occurrences.

    ``best[k]`` is the cheapest choice of k bigrams that end before the one looked at.
    """
    starts = prefix(word, order)
    best: list[tuple[int, list[int]]] = [(0, [])] + [(1 << 62, [])] * count
    waiting: list[tuple[int, list[tuple[int, list[int]]]]] = []  # choices that end later
    for start in starts:
        while waiting and waiting[0][0] <= start:
            best = [min(pair) for pair in zip(best, waiting.pop(0)[1], strict=True)]
        cost = order[word[start : start + 2]][1]
        more = [(1 << 62, [])] + [(total + cost, [*chosen, start]) for total, chosen in best[:-1]]
        waiting.append((start + 2, more))
    return min([best[count], *(more[count] for _, more in waiting)])[1]


def regions(length: int, shortest: int) -> Iterator[tuple[int, int, int, int]]:
    """``(third, shorter, start, end)``: the thirds of a word that an edit may fall into.

    ``shorter`` is the length of the shorter word of a pair; in a word that is
    longer by one, the edited third is longer by one too.
    """
    for shorter in (length, length - 1):
        if shorter >= shortest:
            cut = shorter // 3
            for third, (start, end) in enumerate(((0, cut), (cut, shorter - cut), (shorter - cut, shorter))):
                yield third, shorter, start, end + length - shorter


def _key(third: int, shorter: int, rest: str, mark: str) -> int:
    return xxhash.xxh64_intdigest(f"{third}{shorter} {rest} {mark}".encode())


def _mark(word: str, gram: int, start: int, end: int) -> str:
    """A bigram outside the edited third by its place in the rest, one that touches it by itself."""
    if gram + 2 <= start:
        return str(gram)
    return str(gram - end + start) if gram >= end else word[gram : gram + 2]


def index_keys(word: str, order: dict, shortest: int) -> set[int]:
    """Keys under which others find a word: all bigrams of its prefix."""
    starts = prefix(word, order)
    return {
        _key(third, shorter, word[:start] + word[end:], _mark(word, gram, start, end))
        for third, shorter, start, end in regions(len(word), shortest)
        for gram in starts
    }


def probe_keys(word: str, order: dict, shortest: int) -> set[int]:
    """Keys that a word looks up: a pivot outside the edited third, as that survives, or else both."""
    chosen = sorted(pivots(word, order), key=lambda i: order[word[i : i + 2]])
    found = set()
    for third, shorter, start, end in regions(len(word), shortest):
        safe = [i for i in chosen if i + 2 <= start or i >= end][:1]
        for gram in safe or chosen:
            found.add(_key(third, shorter, word[:start] + word[end:], _mark(word, gram, start, end)))
    return found


def _keyed(words: DataFrame, keys_of, order: dict, shortest: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                keys = [keys_of(word, order, shortest) for word in part.column(0).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
                flat = np.fromiter((k for x in keys for k in x), np.uint64, len(rows))
                yield pa.record_batch([pa.array(flat.view(np.int64)), part.column(0).take(rows), part.column(1).take(rows)], ["key", "word", "n"])

    return map_batches(words.select("word", "n"), run, "key long, word string, n long")


def near_words(words: DataFrame, params: Params = Params()) -> DataFrame:
    """``word, n, near, near_n``: every near pair of ``words (word, n)``, in both directions, once."""
    order = gram_order(words)
    probes = _keyed(words, probe_keys, order, params.shortest)
    index = _keyed(words, index_keys, order, params.shortest).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = probes.join(index, "key").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    ways = (("word", "n", "near", "near_n"), ("near", "near_n", "word", "n"))
    ways = [F.struct(*(F.col(a).alias(b) for a, b in zip(way, ways[0], strict=True))) for way in ways]
    both = met.select(F.explode(F.array(*ways)).alias("x")).select("x.*")
    return both.groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """``word, root``: where the ``forms (word, form)`` lead in ``hops`` steps at most, by doubling the steps."""
    links = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(hops - 1, 0).bit_length()):
        links = stored(links, "spelling-roots")
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return links


def variants(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = stored(word_counts(docs, params, key, text), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_words(words, params).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(near, "word", "left")
    leads = -F.col("best.n") >= F.lit(params.times) * F.col("n")
    found = stored(
        found.select(
            "word",
            F.when(leads, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(leads, -F.col("best.n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    # Each step multiplies the occurrences, so a chain is short.
    most = words.agg(F.max("n")).head()[0] or 1
    hops = math.ceil(math.log(most, params.times)) + 1
    led = roots(found.where("form is not null"), hops)
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
