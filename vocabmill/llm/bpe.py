"""BPE encoding and decoding with a lexicon of the corpus' frequent words.

1. Spark counts the words of all documents. Each task merges its counts before
   the shuffle.
2. The most frequent words (a documented bound) are encoded once and compiled
   into a minimal acyclic transducer whose outputs number the words in order;
   the number leads to the word's ids.
3. The transducer, the ids and the vocabulary are one file that Spark copies to
   each executor. All Python workers of an executor map the same file.
4. Each task takes the distinct strings between white space of a block, finds
   their words, walks the transducer with all words at once and merges those that
   it doesn't know exactly, by the vocabulary.

Decoding joins the ids' tokens by blanks, as the tokenizer's file asks for.

Null and empty texts have no ids and an empty decoded text. Repeated rows are
encoded each. Other columns pass through; a column that has the name of a new
one is refused by Spark only when both are selected: pass ``columns`` to keep
those that are wanted.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vocabmill.llm import lexicon, pretokens
from vocabmill.llm.shared import fetched, map_arrays, map_batches, pack_arrays, send_file, stored, text_blocks
from vocabmill.llm.vocabulary import Vocabulary

#: Most words in the lexicon.
MAX_WORDS = 100_000
#: Distinct units that a task counts before it hands their words on.
TASK_UNITS = 400_000
#: Distinct units that a worker without a lexicon remembers.
CACHED_UNITS = 300_000
#: Characters that are encoded at once.
ENCODED_CHARS = 1 << 21
#: Python's split() takes these for white space, the tokenizer doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_WHITE_SPACE = re.compile("[" + "".join(map(chr, pretokens.WHITE_SPACE)) + "]+")


def words_of(block: list[tuple[int, str, bool]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prepared text, its code points, where words start and end, and the first word of each piece."""
    pieces = [pretokens.prepare(text) for _, text, _ in block]
    text = "\n".join(pieces) + "\n"
    codes, starts, ends = pretokens.word_bounds(text)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    firsts = np.searchsorted(starts, np.cumsum(lengths) - lengths)
    return text, codes, starts, ends, firsts


def strings(text: str, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [text[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def units_of(text: str) -> list[str]:
    """What stands between white space in a prepared text. No word goes beyond it."""
    if any(c in text for c in SEPARATORS):
        return [u for u in _WHITE_SPACE.split(text) if u]
    return text.split()


def _numbering() -> defaultdict[str, int]:
    """Numbers each new key in order."""
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def _gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``flat`` that ``index`` names, in a row, and where each begins (and the end)."""
    lengths = offsets[index + 1] - offsets[index]
    before = np.concatenate(([0], np.cumsum(lengths)))
    source = np.repeat(offsets[index] - before[:-1], lengths) + np.arange(before[-1])
    return flat[source], before


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: how often each word of the tokenizer occurs in all documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: Counter[str] = Counter()

        def flush():
            counts: Counter[str] = Counter()
            at, names, numbers = 0, list(units), list(units.values())
            while at < len(names):
                own = names[at : at + TASK_UNITS // 4]
                block = "\n".join(own) + "\n"
                _, starts, ends = pretokens.word_bounds(block)
                lengths = np.fromiter(map(len, own), np.int64, len(own)) + 1
                owner = np.searchsorted(np.cumsum(lengths), starts, "right")
                for word, n in zip(strings(block, starts, ends), np.array(numbers[at : at + len(own)])[owner].tolist(), strict=True):
                    counts[word] += n
                at += len(own)
            for mark in pretokens.SPECIAL_MARKS.values():
                counts.pop(mark, None)
            units.clear()
            return pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for block in text_blocks(batch.column(0).to_pylist()):
                for _, text, _ in block:
                    units.update(units_of(pretokens.prepare(text)))
                if len(units) > TASK_UNITS:
                    yield flush()
        if units:
            yield flush()

    return map_batches(docs.select(text), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text: str = "text", max_words: int = MAX_WORDS) -> list[str]:
    """The most frequent words, ties in order of the words. The bound is what reaches the driver.

    A histogram of the order, of exact numbers and then first letters where words are
    rare, shows how far down the most frequent words go. So the task that takes them
    reads few others, however many tasks there are before it.
    """
    counted = stored(word_counts(docs, text), "word-counts")
    n = F.col("n")
    number = F.when(n < 1024, n).otherwise(F.greatest(F.floor(F.log2("n") * 64) + 1024, F.lit(1024)))
    place = F.struct((-number).alias("number"), F.when(n < 64, F.substring("word", 1, 3)).alias("start"))
    sizes = counted.groupBy(place.alias("place")).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    reached = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_words)
    last = reached.agg(F.max("place").alias("place")).head().place
    if last is None:
        return []
    bound = F.struct(F.lit(last.number).cast("long").alias("number"), F.lit(last.start).cast("string").alias("start"))
    top = counted.where(place <= bound).orderBy(F.desc("n"), "word").limit(max_words)
    return [row.word for row in top.select("word").toLocalIterator()]


class Codec:
    """Encodes and decodes. ``arrays`` holds a lexicon; without one, a bounded memory of words takes its place."""

    def __init__(self, vocabulary: Vocabulary, arrays: dict[str, np.ndarray] | None = None):
        self.vocabulary = vocabulary
        if arrays is None:
            self.lexicon, self.seen = None, _numbering()
            self.flat, self.offsets = np.zeros(1 << 16, np.int32), np.zeros(CACHED_UNITS + 1, np.int64)
        else:
            self.lexicon = lexicon.Lexicon(arrays)
            self.flat, self.offsets = arrays["flat"], arrays["offsets"]

    @staticmethod
    def compile(vocabulary: Vocabulary, words: list[str]) -> dict[str, np.ndarray]:
        words = sorted(words)
        ids, lengths = vocabulary.merge(words)
        arrays = lexicon.build(words, range(len(words)))
        return arrays | {"flat": ids, "offsets": np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)}

    def _ids_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each unit has."""
        text = "\n".join(units) + "\n"
        codes, starts, ends = pretokens.word_bounds(text)
        lengths = np.fromiter(map(len, units), np.int64, len(units)) + 1
        firsts = np.searchsorted(starts, np.cumsum(lengths) - lengths)
        if self.lexicon is None:
            index = np.full(len(starts), -1)
            flat, offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        else:
            index = self.lexicon.walk(codes, starts, ends)
            flat, offsets = self.flat, self.offsets
        unknown = np.flatnonzero(index < 0)
        own = strings(text, starts[unknown], ends[unknown])
        distinct = {word: k for k, word in enumerate(dict.fromkeys(own))}
        ids, counts = self.vocabulary.merge(list(distinct))
        index[unknown] = np.fromiter(map(distinct.__getitem__, own), np.int64, len(own)) + len(offsets) - 1
        flat, offsets = np.concatenate((flat, ids)), np.concatenate((offsets, offsets[-1] + np.cumsum(counts)))
        ids, before = _gather(flat, offsets, index)
        return ids, np.diff(before[np.append(firsts, len(index))])

    def encode_block(self, block: list[tuple[int, str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and the first id of each piece (and the end).

        What stands between white space is encoded once for a block.
        """
        pieces = [units_of(pretokens.prepare(text)) for _, text, _ in block]
        units = list(chain.from_iterable(pieces))
        if self.lexicon is None:
            index = self._remembered(units)
            flat, offsets = self.flat, self.offsets
        else:
            known = _numbering()
            index = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
            flat, counts = self._ids_of(list(known))
            offsets = np.concatenate(([0], np.cumsum(counts)))
        ids, before = _gather(flat, offsets, index)
        firsts = np.cumsum([0, *map(len, pieces)])
        return ids.astype("<u4"), before[firsts]

    def _remembered(self, units: list[str]) -> np.ndarray:
        """Numbers of the units in a memory, which starts anew when it is full."""
        if len(self.seen) > CACHED_UNITS:
            self.seen = _numbering()
        known = len(self.seen)
        index = np.fromiter(map(self.seen.__getitem__, units), np.int64, len(units))
        if fresh := len(self.seen) - known:
            ids, counts = self._ids_of(list(islice(reversed(self.seen), fresh))[::-1])
            used = int(self.offsets[known])
            while used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while known + fresh >= len(self.offsets):
                self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
            self.flat[used : used + len(ids)] = ids
            self.offsets[known + 1 : known + 1 + fresh] = used + np.cumsum(counts)
        return index

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, bool]]:
        """``(row, ids, last)`` for each piece of each text, in order."""
        for block in text_blocks(texts, ENCODED_CHARS):
            ids, firsts = self.encode_block(block)
            for k, (row, _, last) in enumerate(block):
                yield row, ids[firsts[k] : firsts[k + 1]], last

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


class SentCodec:
    """A codec that workers set up when they first need it: from the vocabulary and the lexicon's file."""

    _ready: dict[tuple, Codec] = {}

    def __init__(self, vocabulary_path: str, file: str | None):
        self.key = (vocabulary_path, file)

    def get(self) -> Codec:
        if self.key not in self._ready:
            path, file = self.key
            self._ready.clear()
            self._ready[self.key] = Codec(Vocabulary(path), map_arrays(fetched(file)) if file else None)
        return self._ready[self.key]


def codec_for(docs: DataFrame, vocabulary_path: str, text: str = "text", max_words: int = MAX_WORDS) -> SentCodec:
    """Count the words of ``docs``, compile the lexicon, send it to the executors.

    ``vocabulary_path`` is a file that all nodes have, as part of a library.
    """
    words = frequent_words(docs, text, max_words)
    arrays = Codec.compile(Vocabulary(vocabulary_path), words)
    return SentCodec(vocabulary_path, send_file(docs.sparkSession, "lexicon", pack_arrays(arrays)))


def encode(docs: DataFrame, codec: SentCodec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids array<int>`` and ``n_tokens`` of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[] for _ in range(batch.num_rows)]
            for row, ids, _ in codec.get().encode(batch.column(1).to_pylist()):
                lists[row].append(ids)
            own = [np.concatenate(x).astype(np.int32) for x in lists]
            yield pa.record_batch(
                [batch.column(0), pa.array(own, pa.list_(pa.int32())), pa.array([len(x) for x in own], pa.int64())], ["key", "ids", "n_tokens"]
            )

    return map_batches(docs.select(F.col(key).alias("key"), text), run, f"key {kind}, ids array<int>, n_tokens long").withColumnRenamed("key", key)


def decode(df: DataFrame, codec: SentCodec, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the ``decoded`` text of an array of ids; null ids give an empty text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec.get().decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["key", "decoded"])

    return map_batches(df.select(F.col(key).alias("key"), ids), run, f"key {kind}, decoded string").withColumnRenamed("key", key)


def round_trip_digests(docs: DataFrame, codec: SentCodec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text and keeps ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    One pass, so that neither ids nor decoded texts leave the task.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ids_sha, text_sha = [], [], []
            hashes = None
            for _, ids, last in codec.get().encode(batch.column(1).to_pylist()):
                if hashes is None:
                    hashes, count = (hashlib.sha256(), hashlib.sha256()), 0
                hashes[0].update(ids.tobytes())
                decoded = codec.get().decode(ids)
                hashes[1].update((" " + decoded if count and len(ids) else decoded).encode())
                count += len(ids)
                if last:
                    tokens.append(count)
                    ids_sha.append(hashes[0].hexdigest())
                    text_sha.append(hashes[1].hexdigest())
                    hashes = None
            yield pa.record_batch([batch.column(0), pa.array(tokens, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(F.col(key).alias("key"), text), run, schema).withColumnRenamed("key", key)
