"""What several operators need: Arrow batches in small blocks, the shared folder, files for tasks."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that are worked on at once in a task. Bounds its memory, changes no result.
BLOCK_CHARS = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of this application on the default file system,
    which on a cluster must not be that of a single machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    default = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if default.startswith("file:") and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"/tmp/checkpoints/{context.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: computed once, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def send_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Put ``data`` into the shared folder, for Spark to copy to every executor. Returns the file's name.

    Executors that start later fetch it too. ``fetched`` finds the copy in a task.
    """
    file = f"{name}-{uuid.uuid4().hex}"
    spark.sparkContext.addFile(_write_bytes(spark, f"{shared_path(spark, name)}/{file}", data))
    return file


def _write_bytes(spark: SparkSession, to: str, data: bytes) -> str:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(to)
    system = path.getFileSystem(conf)
    out = system.create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return system.makeQualified(path).toString()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package's modules to the Python workers of all executors, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as file:
        for path in sorted(top.rglob("*.py")):
            file.write(path, path.relative_to(top.parent))
    name = f"vocabmill-{uuid.uuid4().hex}.zip"
    context.addPyFile(_write_bytes(spark, f"{shared_path(spark, 'package')}/{name}", packed.getvalue()))
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def text_source(docs: DataFrame, key: str, text: str) -> tuple[list[Column], Callable[[pa.RecordBatch], pa.Array]]:
    """What to send to tasks as the last columns besides ``key``, the first one, and how they find the texts of a batch.

    A text that is a field of ``key``, named ``key.text``, goes there with it and not a second time.
    """
    kind = docs.schema[key].dataType
    top, _, field = text.partition(".")
    if isinstance(kind, StructType) and top == key and field:
        place = kind.names.index(field) if field in kind.names else [name.lower() for name in kind.names].index(field.lower())
        return [], lambda batch: batch.column(0).flatten()[place]
    return [F.col(text).alias("text_sent")], lambda batch: batch.column(batch.num_columns - 1)


def fetched(file: str) -> str:
    return SparkFiles.get(file)


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file that ``map_arrays`` can map into memory."""
    parts, header, at = [], [], 0
    for name, array in arrays.items():
        raw = np.ascontiguousarray(array).tobytes()
        header.append(f"{name} {array.dtype.str} {at} {array.size}")
        raw += b"\0" * (-len(raw) % 64)
        parts.append(raw)
        at += len(raw)
    head = "\n".join(header).encode()
    head += b" " * (-(len(head) + 16) % 64)
    return len(head).to_bytes(16, "little") + head + b"".join(parts)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    size = int.from_bytes(open(path, "rb").read(16), "little")
    with open(path, "rb") as file:
        head = file.read(16 + size)[16:].decode()
    start = 16 + size
    whole = np.memmap(path, np.uint8, "r")
    result = {}
    for line in head.split("\n"):
        name, kind, at, count = line.split()
        width = np.dtype(kind).itemsize
        result[name] = whole[start + int(at) : start + int(at) + int(count) * width].view(kind)
    return result


def text_blocks(texts: Iterable[str | None], most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str, bool]]]:
    """Blocks of ``(row, piece, last)`` of up to ``most`` characters; null is empty.

    A longer text is cut after white space, so that no word is cut; ``last``
    marks its last piece. A text without white space stays whole.
    """
    block: list[tuple[int, str, bool]] = []
    filled = 0
    for row, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            end = len(text) if len(text) - at <= most else _cut(text, at, at + most)
            if filled and filled + end - at > most:
                yield block
                block, filled = [], 0
            block.append((row, text[at:end] if at or end < len(text) else text, end == len(text)))
            filled += end - at
            at = end
            if at == len(text):
                break
    if block:
        yield block


def _cut(text: str, start: int, end: int) -> int:
    """After the last blank or line end before ``end``, or else after the first one behind it."""
    cut = max(text.rfind(" ", start, end), text.rfind("\n", start, end))
    if cut < 0:
        later = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
        cut = min(later) if later else len(text) - 1
    return cut + 1


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``most`` bytes; a longer row is a range of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column is called so."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
