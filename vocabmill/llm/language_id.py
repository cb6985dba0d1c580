"""Language of a text: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

Subwords are the runs of two and three characters of the lower-cased text in
which everything but letters is a blank; each is hashed into ``buckets``. A text
is the average of its subwords' embeddings, and a linear softmax over it gives
the languages' probabilities. Both layers are trained together by stochastic
gradient descent in numpy, on a bounded sample: up to ``per_language`` of the
labelled rows of every language, fewer if all of them would be more than
``sampled`` (one of each at least), those with the least hash of their id and text. Rows that repeat both count once, so neither
rows without an id nor repeated ones outweigh others. The sample's texts become
counts of buckets in the tasks; the driver never sees texts.

A part of the sample is kept from training to calibrate: it gives a temperature,
which makes the score a probability, and the score below which a prediction is
rejected, such that ``keep`` of the correct predictions are accepted, while no
score above ``MAX_THRESHOLD`` is ever asked for.

Whole texts are predicted; as the model is linear, the embeddings of up to ``width``
languages are multiplied by the softmax's weights beforehand, and each subword is
one look-up; with more languages the weights are applied to the average.

A text that is null or has no letter is ``und`` with score 0 and rejected; marks that
combine with letters form subwords, but are no letters. Texts are worked on in blocks
of ``PIECE_CHARS`` characters, longer ones in pieces. Without labelled rows, as in an empty table, every text is ``und``. Of
equally likely languages the first by name is taken. Repeated rows are
predicted each. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocabmill.llm.shared import map_batches, stored, text_blocks, text_source

UNKNOWN = "und"
MAX_THRESHOLD = 0.6
#: Characters that are worked on at once in a task; each takes some 250 bytes meanwhile.
PIECE_CHARS = 1 << 17


@dataclass(frozen=True)
class Params:
    per_language: int = 1500
    sampled: int = 300_000  # rows of all languages
    bits: int = 15  # 2 ** bits buckets
    width: int = 16  # numbers in an embedding
    epochs: int = 4
    visits: int = 24_000  # so many rows are visited at least, by more epochs over a small sample
    batch: int = 32
    rate: float = 20.0
    calibrated_share: int = 5  # one of so many is kept from training
    keep: float = 0.998
    seed: int = 7


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # of each bucket, what it adds to the languages' logits, or its embedding
    weights: np.ndarray | None  # of the softmax, for embeddings
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int


@functools.cache
def _letters() -> np.ndarray:
    """Lower case of each letter, a blank for all else."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] in "LM":
            lower = chr(code).lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([unicodedata.category(chr(code))[0] == "L" for code in range(0x110000)])


def subwords(block: list[tuple[int, str, bool]], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords of a block, how many each piece has, and how many letters it has."""
    text = " ".join(piece for _, piece, _ in block) + " "
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[raw].astype(np.uint64)
    lengths = np.fromiter((len(piece) + 1 for _, piece, _ in block), np.int64, len(block))
    owner = np.repeat(np.arange(len(block)), lengths)
    letters = np.bincount(owner[_is_letter()[raw]], minlength=len(block))
    blank = codes == 32
    # Runs of blanks count as one.
    keep = ~(blank & np.concatenate(([True], blank[:-1])))
    codes, owner, blank = codes[keep], owner[keep], blank[keep]
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(len(block), np.int64), letters
    before = np.concatenate((np.array([32], np.uint64), codes[:-1]))
    first = np.concatenate((np.array([32, 32], np.uint64), codes[:-2]))[: len(codes)]
    shift = np.uint64(64 - bits)
    two = ((before * np.uint64(0x9E3779B97F4A7C15) + codes * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)) >> shift
    three = before * np.uint64(0x165667B19E3779F9) + codes * np.uint64(0xC2B2AE3D27D4EB4F) + first * np.uint64(0x27D4EB2F165667C5)
    three = (three * np.uint64(0xD6E8FEB86659FD93)) >> shift
    # A subword may start with a blank or end with one, but not go beyond a word's end.
    good_three = ~(np.concatenate(([True], blank[:-1])))
    buckets = np.concatenate((two, three[good_three])).astype(np.int64)
    owners = np.concatenate((owner, owner[good_three]))
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(block)), letters


def values(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, each when it is asked for."""
    return (value.as_py() for value in column)


def bags(docs: DataFrame, bits: int, text: str, *columns: str) -> DataFrame:
    """``columns`` and the counts of buckets of each text, as ``buckets`` and ``counts``."""
    schema = ", ".join(f"{n} {t}" for n, t in docs.select(*columns).dtypes) + ", buckets array<int>, counts array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, before = 0, 0
            for block in text_blocks(values(batch.column(len(columns))), PIECE_CHARS):
                found, sizes, _ = subwords(block, bits)
                used, sums = [], []
                at = 0
                for (_, _, last), size in zip(block, sizes.tolist(), strict=True):
                    # Only the counts of a text that goes on in the next block are kept for all buckets.
                    before = before + np.bincount(found[at : at + size], minlength=1 << bits)
                    at += size
                    if last:
                        used.append(np.flatnonzero(before).astype(np.int32))
                        sums.append(before[used[-1]].astype(np.int32))
                        before = 0
                own = [batch.column(k).slice(done, len(used)) for k in range(len(columns))]
                yield pa.record_batch([*own, pa.array(used, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int32()))], [*columns, "buckets", "counts"])
                done += len(used)

    return map_batches(docs.select(*columns, F.col(text)), run, schema)


#: Rows that the exact limit is taken from, as a multiple of it: counts of distinct rows are estimates.
MARGIN = 1.5


def sample(docs: DataFrame, params: Params, key: str, lang: str, text: str = "text") -> DataFrame:
    """Up to ``per_language`` distinct rows of each language, by the least hashes of their ids and texts."""
    span = 1 << 62
    numbered = docs.withColumn("order_", F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.col(text)), 2))
    labelled = numbered.where(F.col(lang).isNotNull())
    counts = stored(labelled.groupBy(lang).agg(F.approx_count_distinct("order_").alias("distinct")), "language-rows")
    own = max(1, min(params.per_language, params.sampled // max(counts.count(), 1)))
    some = MARGIN * own + 20
    rough = F.least(F.lit(span), F.floor(F.lit(span * some) / F.greatest("distinct", F.lit(1))).cast("long"))
    # Hashes are even, so a language has about so many of them here.
    least = labelled.join(counts.select(lang, rough.alias("most_")), lang).where("order_ <= most_").select(lang, "order_").distinct()
    ranked = least.withColumn("place", F.row_number().over(Window.partitionBy(lang).orderBy("order_")))
    exact = ranked.where(F.col("place") <= own).groupBy(lang).agg(F.max("order_").alias("most_"))
    chosen = labelled.join(stored(exact, "language-limits"), lang).where("order_ <= most_").drop("most_")
    return chosen.dropDuplicates([lang, "order_"])


def train(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the rows with a text and a language; None if there are none."""
    usable = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null")
    chosen = sample(usable, params, "key", "lang")
    rows = bags(chosen, params.bits, "text", "order_", "lang").where(F.size("buckets") > 0)
    # Bounded: so many rows of each language, of at most 2 ** bits pairs each.
    found = sorted(rows.toLocalIterator(), key=lambda r: (r.order_, r.lang, r.buckets[:3]))
    if not found:
        return None
    languages = sorted({r.lang for r in found})
    number = {name: k for k, name in enumerate(languages)}
    examples = [(np.array(r.buckets), np.array(r.counts, np.float32) / sum(r.counts), number[r.lang]) for r in found]
    return fit(examples, languages, params)


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], params: Params) -> Model:
    draw = np.random.default_rng(params.seed)
    held = [e for k, e in enumerate(examples) if k % params.calibrated_share == 0]
    used = [e for k, e in enumerate(examples) if k % params.calibrated_share] or examples
    size, width, many = 1 << params.bits, params.width, len(languages)
    embedding = draw.uniform(-1 / width, 1 / width, (size, width)).astype(np.float32)
    weights, bias = np.zeros((width, many), np.float32), np.zeros(many, np.float32)
    # Languages with fewer rows weigh more, so that none is neglected.
    seen = np.bincount([y for _, _, y in used], minlength=many).clip(1)
    weigh = (seen.mean() / seen).clip(0.2, 5)
    epochs = max(params.epochs, -(-params.visits // len(used)))
    steps = epochs * len(used)
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(used))
        for at in range(0, len(order), params.batch):
            rate = params.rate * (1 - step / steps) / params.batch
            own = [used[k] for k in order[at : at + params.batch]]
            hidden = np.stack([shares @ embedding[buckets] for buckets, shares, _ in own])
            logits = hidden @ weights + bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            wrong = chance
            wrong[np.arange(len(own)), [y for _, _, y in own]] -= 1
            wrong *= weigh[[y for _, _, y in own]][:, None]
            back = wrong @ weights.T
            weights -= rate * (hidden.T @ wrong)
            bias -= 0.05 * rate * wrong.sum(0)
            for (buckets, shares, _), gradient in zip(own, back, strict=True):
                embedding[buckets] -= rate * shares[:, None] * gradient
            step += len(own)
    table, over = ((embedding @ weights).astype(np.float32), None) if many <= width else (embedding, weights)
    logits = np.array([shares @ table[buckets] for buckets, shares, _ in held or used])
    logits = (logits if over is None else logits @ over) + bias
    truth = np.array([y for _, _, y in held or used])
    temperature = min(np.geomspace(0.02, 50, 100), key=lambda t: _loss(logits / t, truth))
    score = _softmax(logits / temperature)
    right = np.sort(score.max(1)[score.argmax(1) == truth])
    threshold = min(float(right[int((1 - params.keep) * len(right))]), MAX_THRESHOLD) if len(right) else 0.0
    return Model(languages, table, over, bias, float(temperature), threshold, params.bits)


def _softmax(logits: np.ndarray) -> np.ndarray:
    chance = np.exp(logits - logits.max(1, keepdims=True))
    return chance / chance.sum(1, keepdims=True)


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    """Cross entropy to targets that allow for one unseen error, so that no score is certain."""
    many = logits.shape[1]
    chance = np.log(np.clip(_softmax(logits), 1e-300, 1))
    error = 1 / (len(truth) + 2)
    target = np.full(logits.shape, error / max(many - 1, 1))
    target[np.arange(len(truth)), truth] = 1 - error
    return float(-(target * chance).sum(1).mean())


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", columns: tuple[str | Column, ...] = ()) -> DataFrame:
    """``key, lang_pred, score, accepted`` of every row, and ``columns`` that pass through.

    ``text`` may be a field of ``key``, as in ``key.text``.
    """
    chosen = docs.select(F.col(key).alias("key"), *columns)
    names = chosen.columns
    sent, text_in = text_source(docs, key, text)
    schema = ", ".join(f"{n} {t}" for n, t in chosen.dtypes) + ", lang_pred string, score double, accepted boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            sums = np.zeros((size, model.table.shape[1] if model else 1))
            counts, letters = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for block in text_blocks(values(text_in(batch)), PIECE_CHARS) if model else ():
                found, sizes, own = subwords(block, model.bits)
                rows = [row for row, _, _ in block]
                full = np.flatnonzero(sizes)
                if len(full):
                    starts = (np.cumsum(sizes) - sizes)[full]
                    # Sums of a text are the same however it is cut into blocks only up to rounding.
                    np.add.at(sums, np.array(rows)[full], np.add.reduceat(model.table[found], starts, axis=0, dtype=np.float64))
                np.add.at(counts, rows, sizes)
                np.add.at(letters, rows, own)
            known = letters > 0
            best, score = [UNKNOWN] * size, np.zeros(size)
            if model and known.any():
                means = sums / np.maximum(counts, 1)[:, None]
                logits = (means if model.weights is None else means @ model.weights) + model.bias
                chance = _softmax(logits / model.temperature)
                best = [model.languages[k] if ok else UNKNOWN for k, ok in zip(chance.argmax(1).tolist(), known, strict=True)]
                score = np.where(known, chance.max(1), 0.0)
            accepted = known & (score >= (model.threshold if model else 0))
            yield pa.record_batch(
                [*(batch.column(k) for k in range(len(names))), pa.array(best, pa.string()), pa.array(score), pa.array(accepted)], [*names, "lang_pred", "score", "accepted"]
            )

    return map_batches(docs.select(F.col(key).alias("key"), *columns, *sent), run, schema).withColumnRenamed("key", key)
