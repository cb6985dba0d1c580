"""Quality rules: base counts of a text, and how far its histograms are from its language's.

The method compares two histograms of a text with those of each language, by the
Jensen-Shannon distance (0 for equal, 1 for disjoint histograms):

- of its characters, in ``CLASSES`` classes;
- of its words, over the common words of the language and one place for all others.

The language references are the summed histograms of all labelled documents;
common words are each language's most frequent ones (a documented number). Spark
sums both, partly in the tasks, for every language there is; what reaches the driver
and the tasks is those numbers for each language.

A text is taken for the language it is nearest to by both histograms together (the
least sum of the squares), so its own label isn't used. It is rejected if that
language is farther than ``Limits.characters`` by characters, or ``Limits.words``
by words. As most words are not common ones, a text without any common word is not
farther than that from many languages. So a text with fewer common words than its
language is also rejected by the distance of the two sums, of common and of other
words: its limit is the share ``Limits.common`` of the distance at which a text
without any common word is. Short texts are far from any language by chance, so all
limits are raised by ``allowance / sqrt(n)`` for n characters or words, and texts of
fewer than ``min_chars`` word characters or ``min_words`` words are not judged by
the respective histogram at all.

Null and empty texts have no words and fail the base rules. Without any labelled
text, as in an empty table, there are no references and only the base rules judge.
Very long texts are worked on one by one. Equally frequent words are taken in byte
order, equally near languages in the order of their names. Repeated rows are judged
each. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vocabmill.llm.hashed_words import hash_words, row_slices, windows
from vocabmill.llm.shared import map_batches, row_blocks, stored, string_bytes, text_source

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Classes: lower and upper letters of ASCII, digits, blanks, line ends, full stops and commas,
#: other marks, symbols, and by UTF-8 lead byte: other Latin letters, other scripts, the rest.
LOWER, UPPER, DIGIT, BLANK, LINE, STOP, MARK, SYMBOL, LATIN, SCRIPT, WIDE, CONTROL = range(12)
CLASSES = 12
WINDOW = 5
#: Distinct words that a task counts before it hands them on.
TASK_WORDS = 200_000


@dataclass(frozen=True)
class Limits:
    min_words: int = 40
    min_chars: int = 200
    characters: float = 0.25
    words: float = 0.45
    common: float = 0.5  # of the distance of a text without common words
    allowance: float = 1.0  # over the square root of the number of characters or words
    common_words: int = 100


def _class_table() -> np.ndarray:
    """Class of each byte; 255 for the later bytes of a character."""
    table = np.full(256, MARK, np.uint8)
    table[:32] = CONTROL
    table[127] = CONTROL
    table[97:123], table[65:91], table[48:58] = LOWER, UPPER, DIGIT
    table[[0x20, 0x09]] = BLANK
    table[[0x0A, 0x0B, 0x0C, 0x0D]] = LINE
    table[list(b".,")] = STOP
    table[list(SYMBOLS)] = SYMBOL
    table[0x80:0xC0] = 255
    table[0xC0:0xCA], table[0xCA:0xE0], table[0xE0:0xF0], table[0xF0:] = LATIN, SCRIPT, SCRIPT, WIDE
    return table


_TABLE = _class_table()


def class_histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class, a row for each text."""
    kinds = _TABLE[data].astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    lead = kinds != 255
    flat = np.bincount(rows[lead] * CLASSES + kinds[lead], minlength=(len(offsets) - 1) * CLASSES)
    return flat.reshape(-1, CLASSES)


def repeated_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that stand in a window of five that the text has twice or more."""
    found, runs = windows(words, counts, WINDOW)
    result = np.zeros(len(counts), np.int64)
    firsts = np.cumsum(counts) - counts
    for row, (a, b) in enumerate(row_slices(runs)):
        if b - a < 2:
            continue
        own = found[a:b]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            continue
        twice = np.zeros(b - a, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edges = np.zeros(int(counts[row]) + 1, np.int64)
        edges[np.flatnonzero(twice)] += 1
        edges[np.flatnonzero(twice) + WINDOW] -= 1
        result[row] = int((np.cumsum(edges)[:-1] > 0).sum())
    return result


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def references(docs: DataFrame, limits: Limits, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """For each language: its classes' shares, its common words, their shares with that of all others at the end."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        words: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            everything, bounds = string_bytes(batch.column(0))
            langs = batch.column(1).to_pylist()
            for start, stop in row_blocks(bounds):
                data, offsets = everything[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start]
                histograms = class_histograms(data, offsets)
                whole = data.tobytes()
                for row, name in enumerate(langs[start:stop]):
                    classes[name] = classes.get(name, 0) + histograms[row]
                    for word in whole[offsets[row] : offsets[row + 1]].lower().split():
                        words[name, word] = words.get((name, word), 0) + 1
                if len(words) > TASK_WORDS:
                    yield record(words, {})
                    words.clear()
        yield record(words, classes)

    def record(words, classes):
        rows = [(name, word, -1, n) for (name, word), n in words.items()]
        rows += [(name, None, k, int(n)) for name, own in classes.items() for k, n in enumerate(own)]
        names, own, kinds, counts = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.record_batch([pa.array(names, pa.string()), pa.array(own, pa.binary()), pa.array(kinds, pa.int32()), pa.array(counts, pa.int64())], ["lang", "word", "class", "n"])

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    counted = map_batches(labelled, sums, "lang string, word binary, class int, n long")
    counted = counted.groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    counted = stored(counted, "language-counts")
    words = counted.where("word is not null")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = words.withColumn("place", place).where(F.col("place") <= limits.common_words)
    common: dict[str, list] = {}
    for r in top.orderBy("lang", "place").toLocalIterator():
        common.setdefault(r.lang, []).append((bytes(r.word), r.n))
    sizes = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).toLocalIterator()}
    shares: dict[str, np.ndarray] = {}
    for r in counted.where("word is null").toLocalIterator():
        shares.setdefault(r.lang, np.zeros(CLASSES))[r["class"]] = r.n
    found = {}
    for name, own in sorted(common.items()):
        if shares[name].sum():
            counts = np.array([n for _, n in own], float)
            rest = max(sizes[name] - counts.sum(), 0.0)
            found[name] = (shares[name] / shares[name].sum(), [word for word, _ in own], np.append(counts, rest) / sizes[name])
    return found


def distance(shares: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row to a reference."""
    middle = (shares + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(shares > 0, shares * np.log2(shares / middle), 0).sum(1)
        other = np.where(reference > 0, reference * np.log2(reference / middle), 0).sum(1)
    return np.sqrt(np.clip((own + other) / 2, 0, 1))


def lack_of_common(others: np.ndarray, reference: float) -> tuple[np.ndarray, float]:
    """Distance of the sums of common and of other words to a reference, and that of a text without common words.

    ``others`` are the texts' shares of other words; the distance is 0 where a text has no more of them than the reference.
    """
    both = np.array([1 - reference, reference])
    most = distance(np.array([[0.0, 1.0]]), both)[0]
    return np.where(others > reference, distance(np.stack((1 - others, others), 1), both), 0), float(most)


class Judge:
    """Counts and distances of many texts at once."""

    def __init__(self, found: dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]):
        self.references = []
        for classes, words, shares in found.values():
            data = np.frombuffer(b" ".join(words), np.uint8)
            hashes, _, _ = hash_words(data, np.array([0, len(data)]))
            order = np.argsort(hashes)
            self.references.append((classes, hashes[order], np.append(shares[:-1][order], shares[-1])))

    def distances(self, histograms: np.ndarray, folded: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distances of each text to its nearest language: by characters, by words, by lack of common words, and the most that last can be."""
        rows = len(counts)
        if not self.references:
            return (np.zeros(rows),) * 4
        nearest = np.full(rows, np.inf)
        by_chars, by_words, lack, most = np.ones(rows), np.ones(rows), np.zeros(rows), np.zeros(rows)
        shares = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
        owner = np.repeat(np.arange(rows), counts)
        for classes, hashes, reference in self.references:
            chars = distance(shares, classes)
            place = np.minimum(np.searchsorted(hashes, folded), len(hashes) - 1)
            place = np.where(hashes[place] == folded, place, len(hashes))
            width = len(hashes) + 1
            own = np.bincount(owner * width + place, minlength=rows * width).reshape(rows, width)
            own = own / np.maximum(own.sum(1, keepdims=True), 1)
            words = distance(own, reference)
            near = chars**2 + words**2 < nearest
            nearest[near] = (chars**2 + words**2)[near]
            by_chars[near], by_words[near] = chars[near], words[near]
            lack[near], most[near] = lack_of_common(own[near, -1], reference[-1])
        return by_chars, by_words, lack, most


def judged(docs: DataFrame, found: dict, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, distances and verdict of every row, called by ``key``; ``text`` may be a field of it, as in ``key.text``."""
    kind = docs.schema[key].dataType.simpleString()
    sent, text_in = text_source(docs, key, text)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(found)
        for batch in batches:
            everything, bounds = string_bytes(text_in(batch))
            for start, stop in row_blocks(bounds):
                data, offsets = everything[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start]
                words, counts, _ = hash_words(data, offsets)
                folded, _, _ = hash_words(data, offsets, fold=True)
                histograms = class_histograms(data, offsets)
                whole = data.tobytes()
                blanks = histograms[:, BLANK] + histograms[:, LINE]
                chars = histograms.sum(1) - blanks
                lines = np.array([duplicate_lines(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
                repeats = repeated_words(words, counts)
                by_chars, by_words, lack, most = judge.distances(histograms, folded, counts)
                failed = (counts < 10) | (100 * repeats > 20 * counts)
                slack = [limits.allowance / np.sqrt(np.maximum(n, 1)) for n in (chars, counts)]
                far = (chars >= limits.min_chars) & (by_chars > limits.characters + slack[0])
                far |= (counts >= limits.min_words) & ((by_words > limits.words + slack[1]) | (lack > limits.common * most + slack[1]))
                columns = [counts, chars, histograms[:, SYMBOL], lines, repeats]
                yield pa.record_batch(
                    [batch.column(0).slice(start, stop - start), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed), pa.array(by_chars), pa.array(by_words), pa.array(~failed & ~far)],
                    ["key", *names, "base_failed", "char_distance", "word_distance", "kept"],
                )

    schema = f"key {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, char_distance double, word_distance double, kept boolean"
    return map_batches(docs.select(F.col(key).alias("key"), *sent), run, schema).withColumnRenamed("key", key)
