"""Token counts by finite-state transducers that count on their transitions.

A cascade of two deterministic transducers reads a text:

1. over character classes, with seven states: marks where words start. Texts
   are cut into chunks; the chunks' state maps are composed by a parallel prefix
   scan (``pretokens``), so all chunks of a block run at once.
2. over characters: its transitions carry how many tokens are emitted, moved as
   far to the front as all continuations allow. It is compiled from the corpus'
   frequent words, counted by Spark, and minimised (``lexicon``). The sum along
   a word's path is its number of tokens. Words outside it are merged exactly.

The counts of a text are a difference of prefix sums over the words of its block.

Null and empty texts have 0 bytes and 0 tokens. A text of any length is read in
pieces that end at white space. Repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabmill.llm import lexicon
from vocabmill.llm.bpe import MAX_WORDS, frequent_words, strings, words_of
from vocabmill.llm.shared import fetched, map_arrays, map_batches, pack_arrays, send_file, text_blocks
from vocabmill.llm.vocabulary import Vocabulary


class Counter:
    """``compile`` makes the arrays of the second transducer."""

    def __init__(self, vocabulary: Vocabulary, arrays: dict[str, np.ndarray]):
        self.vocabulary, self.transducer = vocabulary, lexicon.Lexicon(arrays)

    @staticmethod
    def compile(vocabulary: Vocabulary, words: list[str]) -> dict[str, np.ndarray]:
        _, lengths = vocabulary.merge(words)
        return lexicon.build(words, lengths.tolist())

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        result = np.zeros(len(texts), np.int64)
        for block in text_blocks(texts):
            text, codes, starts, ends, firsts = words_of(block)
            tokens = self.transducer.walk(codes, starts, ends)
            unknown = np.flatnonzero(tokens < 0)
            own = strings(text, starts[unknown], ends[unknown])
            distinct = dict.fromkeys(own)
            _, lengths = self.vocabulary.merge(list(distinct))
            counts = dict(zip(distinct, lengths.tolist(), strict=True))
            tokens[unknown] = np.fromiter(map(counts.__getitem__, own), np.int64, len(own))
            before = np.concatenate(([0], np.cumsum(tokens)))
            sums = np.diff(before[np.append(firsts, len(tokens))])
            np.add.at(result, [row for row, _, _ in block], sums)
        return result


class SentCounter:
    _ready: dict[tuple, Counter] = {}

    def __init__(self, vocabulary_path: str, file: str):
        self.key = (vocabulary_path, file)

    def get(self) -> Counter:
        if self.key not in self._ready:
            self._ready.clear()
            self._ready[self.key] = Counter(Vocabulary(self.key[0]), map_arrays(fetched(self.key[1])))
        return self._ready[self.key]


def counter_for(docs: DataFrame, vocabulary_path: str, text: str = "text", max_words: int = MAX_WORDS) -> SentCounter:
    """Count the words of ``docs``, compile the transducer, send it to the executors."""
    arrays = Counter.compile(Vocabulary(vocabulary_path), frequent_words(docs, text, max_words))
    return SentCounter(vocabulary_path, send_file(docs.sparkSession, "counts", pack_arrays(arrays)))


def token_counts(docs: DataFrame, counter: SentCounter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = counter.get().count(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), size.alias("n_bytes"))
    return map_batches(rows, run, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)
