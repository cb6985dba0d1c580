"""Keeping a word list up to date while data files arrive, change and go.

A stream over the input folder names the files that arrive. Each batch of files
is turned into case classes per file and stored as a part of the state; files are
never split over batches. The state is the merge of ``scope='file'`` over the
files that are present now: the same as a batch run over them, in any order of
arrival.

- **A manifest says what counts.** It lists the file versions (path, length, time of
  change) of the state and the part that holds each one. Every run compares it with
  the folder: versions that it doesn't know are folded in, those that are gone
  don't count any more, so a replaced file replaces its classes. Rows of a part
  whose file is not listed for that part are never read. Two contents of one path
  with equal length and time of change cannot be told apart.
- **A compacted base that files can be taken out of.** Files are dealt into groups by
  hash. The base holds a row per class and leading spelling for each group, next to the
  parts. When a file of a group is replaced or removed, that group's base no longer
  counts and the group is read from its parts until it is compacted again.
- **Snapshots.** A new manifest is written as a whole beside the old one, and readers
  take the last complete one. What it no longer names is removed a generation later, so
  a frame that was made before a run still counts right after it.

A run that fails leaves the last manifest as it is; parts that it had finished are
taken up by the next one. A batch that runs again overwrites its own part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vocabmill.config import Config
from vocabmill.operators.merge import file_classes, merge_candidates, merge_classes
from vocabmill.operators.rollup import file_keys
from vocabmill.operators.topk import pick_top
from vocabmill.schema import CLASS
from vocabmill.session import list_names, materialize, remove_path
from vocabmill.sources.entries import decode_lines

_SETTINGS = "strip_capitalized boolean, min_year long, min_matches long, min_books long"
_BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
#: A version of a file; ``file`` is its path as the rows of its lines know it.
_VERSION = "path string, file string, length long, modified timestamp"
_MANIFEST = f"{_VERSION}, part string, _file_1 long, _file_2 long, group int, base string"
_KEYS = ["path", "length", "modified"]
_FILE = ["_file_1", "_file_2"]

#: Beyond any age of a file. Spark would skip files a week older than the newest.
MAX_FILE_AGE = "36500d"

#: So many parts are left next to the base before they are compacted.
COMPACT_AFTER = 20

#: Files in a batch, unless the caller says otherwise; their names pass the driver.
FILES_PER_BATCH = 1000

#: Groups of files that are compacted, and taken apart, together.
GROUPS = 16


def _path(state_dir: str, *names: str) -> str:
    return "/".join([state_dir.rstrip("/"), *names])


def _settings(config: Config) -> tuple:
    return (config.strip_capitalized, config.min_year, config.min_matches, config.min_books)


def _check_settings(spark: SparkSession, state_dir: str, config: Config) -> bool:
    """Whether there is a state; it must have been built with the same settings."""
    if "_SUCCESS" not in list_names(spark, _path(state_dir, "settings")):
        if any(list_names(spark, _path(state_dir, part)) for part in ("classes", "manifest", "progress")):
            raise ValueError(f"{state_dir} holds a state, but not the settings it was built with")
        return False
    stored = spark.read.schema(_SETTINGS).json(_path(state_dir, "settings")).first()
    if tuple(stored) != _settings(config):
        raise ValueError(f"{state_dir} was built with other settings: {stored}")
    return True


# File versions


def _versions(files: DataFrame) -> DataFrame:
    """Rows of Spark's binary file source as versions; their contents are never read."""
    return files.select("path", F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def present_files(spark: SparkSession, input_dir: str) -> DataFrame:
    """The versions of all files below ``input_dir``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(input_dir)
    return _versions(found).distinct()


def _literal(path: str) -> str:
    """A path that Spark's readers don't take for a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def fold_files(spark: SparkSession, versions: list[Row], part: str, state_dir: str, config: Config) -> None:
    """Store the case classes of each of the files as ``part`` of the state."""
    paths = [_literal(row.path) for row in versions]
    lines = spark.read.option("recursiveFileLookup", "true").text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    entries = decode_lines(lines, ["file"], allow_empty=not config.strip_capitalized)
    classes = file_classes(entries, config, keep_files=True).withColumn("group", _group())
    classes.hint("rebalance", "group").write.mode("overwrite").partitionBy("group").parquet(_path(state_dir, "classes", f"part={part}"))
    # The versions come last: with them, the part is complete.
    rows = spark.createDataFrame([tuple(row) for row in versions], _VERSION).coalesce(1)
    rows.write.mode("overwrite").parquet(_path(state_dir, "files", f"part={part}"))


def _group():
    return F.pmod("_file_1", F.lit(GROUPS)).cast("int")


# Manifests


def _complete(spark: SparkSession, folder: str) -> list[str]:
    return [name for name in list_names(spark, folder) if "_SUCCESS" in list_names(spark, f"{folder}/{name}")]


def _generations(spark: SparkSession, state_dir: str) -> list[int]:
    return sorted(int(name) for name in _complete(spark, _path(state_dir, "manifest")))


def _manifest(spark: SparkSession, state_dir: str, generation: int | None = None) -> DataFrame:
    """What counts, by the last complete manifest; nothing before the first."""
    if generation is None:
        generation = max(_generations(spark, state_dir), default=-1)
    if generation < 0:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(_path(state_dir, "manifest", str(generation)))


def _folded(spark: SparkSession, state_dir: str) -> DataFrame:
    """The versions that complete parts hold, whether they count or not."""
    root = _path(state_dir, "files")
    paths = [f"{root}/{name}" for name in _complete(spark, root)]
    if not paths:
        return spark.createDataFrame([], f"{_VERSION}, part string")
    rows = spark.read.schema(f"{_VERSION}, part string").option("basePath", root).parquet(*paths)
    return rows.select("path", "file", "length", "modified", "part")


def _next_manifest(spark: SparkSession, state_dir: str, present: DataFrame) -> DataFrame:
    """The versions that are present, each with one part that holds it, and with the base of its group if that still counts."""
    before = _manifest(spark, state_dir)
    folded = _folded(spark, state_dir).withColumns(file_keys()).withColumn("group", _group())
    known = before.unionByName(folded.withColumn("base", F.lit(None).cast("string"))).join(present.select(*_KEYS), _KEYS, "left_semi")
    # A version that several parts hold stays where the base has it, or else goes to the last part.
    held = F.struct(F.col("base").isNotNull().alias("based"), "part", "file", *_FILE, "group", "base")
    live = known.groupBy(*_KEYS).agg(F.max(held).alias("x")).select(*_KEYS, "x.*").drop("based")
    gone = before.where("base is not null").join(live.where("base is not null").select(*_KEYS), _KEYS, "left_anti")
    broken = gone.select("group").distinct().withColumn("broken", F.lit(True))
    live = live.join(broken, "group", "left").withColumn("base", F.when(F.col("broken").isNull(), F.col("base")))
    names = [field.split()[0] for field in _MANIFEST.split(", ")]
    return live.select(*names)


def _names(rows: DataFrame, column: str) -> list:
    """The different values of a column that names parts or groups: as many as there were batches, at most."""
    return sorted(row[0] for row in rows.select(column).distinct().collect())


def _read_state(spark: SparkSession, state_dir: str, manifest: DataFrame) -> DataFrame:
    """Case classes, with their ``group``, of what counts: bases, and the parts of files that are in none."""
    empty = spark.createDataFrame([], CLASS).withColumn("group", F.lit(0))
    columns = [*CLASS.names, "group"]
    based, loose = manifest.where("base is not null"), manifest.where("base is null")
    found = [empty]
    for rows, kind, name in ((based, "base", "base"), (loose, "classes", "part")):
        root = _path(state_dir, kind)
        parts = _names(rows, name)
        if parts:
            # A part without any class has no files at all.
            schema = ", ".join(f"{n} {t}" for n, t in empty.dtypes if n != "group")
            keys = "" if kind == "base" else ", _file_1 long, _file_2 long"
            table = spark.read.schema(f"{schema}{keys}, part string, group int").option("basePath", root)
            table = table.parquet(*(f"{root}/part={x}" for x in parts)).where(F.col("group").isin(_names(rows, "group")))
            on = ["part", "group", *(_FILE if kind == "classes" else [])]
            counts = rows.select(F.col(name).alias("part"), *on[1:]).distinct()
            found.append(table.join(counts, on, "left_semi"))
    result = found[0].select(*columns)
    for rows in found[1:]:
        result = result.unionByName(rows.select(*columns))
    return result


def _compacted(spark: SparkSession, state_dir: str, manifest: DataFrame, generation: int) -> DataFrame:
    """Merge the groups that have files outside their base into new bases; the manifest that names these."""
    name = str(generation)
    groups = manifest.where("base is null").select("group").distinct()
    renewed = manifest.join(groups, "group", "left_semi")
    merged = merge_candidates(_read_state(spark, state_dir, renewed), ["group"])
    merged = merged.select(*CLASS.names, "group").hint("rebalance", "group")
    merged.write.mode("overwrite").partitionBy("group").parquet(_path(state_dir, "base", f"part={name}"))
    others = manifest.join(groups, "group", "left_anti")
    return others.unionByName(renewed.withColumn("base", F.lit(name)).select(*manifest.columns))


def _remove_unnamed(spark: SparkSession, state_dir: str, generations: list[int]) -> None:
    """Remove what neither of the last two manifests names."""
    kept = generations[-2:]
    named = [_manifest(spark, state_dir, n) for n in kept]
    parts = {x for rows in named for x in _names(rows, "part")}
    bases = {x for rows in named for x in _names(rows.where("base is not null"), "base")}
    for folder, keep in (("classes", parts), ("files", parts), ("base", bases)):
        for name in list_names(spark, _path(state_dir, folder)):
            if name.removeprefix("part=") not in keep:
                remove_path(spark, _path(state_dir, folder, name))
    for n in generations[:-2]:
        remove_path(spark, _path(state_dir, "manifest", str(n)))


# Runs


def run_incremental(
    spark: SparkSession,
    input_dir: str,
    state_dir: str,
    config: Config,
    max_files_per_batch: int | None = None,
    compact_after: int = COMPACT_AFTER,
) -> DataFrame:
    """Bring the state up to the files that are in ``input_dir`` now, return the classes.

    ``state_dir`` must be on storage shared by the cluster. The filters and cutoffs
    of ``config`` stay the same over the life of a state. Files that more than
    ``compact_after`` parts hold outside the base are merged into it.
    """
    if not _check_settings(spark, state_dir, config):
        spark.createDataFrame([_settings(config)], _SETTINGS).write.mode("overwrite").json(_path(state_dir, "settings"))
    at_once = max_files_per_batch or FILES_PER_BATCH
    reader = spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("recursiveFileLookup", "true")
    arrivals = _versions(reader.option("maxFileAge", MAX_FILE_AGE).option("maxFilesPerTrigger", at_once).load(input_dir))

    def fold_batch(batch: DataFrame, batch_id: int) -> None:
        fold_files(batch.sparkSession, batch.distinct().collect(), f"arrived-{batch_id}", state_dir, config)

    query = (
        arrivals.writeStream.foreachBatch(fold_batch)
        .option("checkpointLocation", _path(state_dir, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    _settle(spark, input_dir, state_dir, config, at_once, compact_after)
    return current_classes(spark, state_dir)


def _chunks(rows: Iterator[Row], size: int) -> Iterator[list[Row]]:
    while chunk := list(islice(rows, size)):
        yield chunk


def _settle(spark: SparkSession, input_dir: str, state_dir: str, config: Config, at_once: int, compact_after: int) -> None:
    """Fold in what the stream doesn't tell, and write a new manifest if anything has changed."""
    generations = _generations(spark, state_dir)
    generation = max(generations, default=-1) + 1
    present = materialize(present_files(spark, input_dir), "present-files")
    # A path that has been seen is no arrival, however it has changed.
    unknown = present.join(_folded(spark, state_dir), _KEYS, "left_anti").select(*present.columns)
    for number, chunk in enumerate(_chunks(unknown.toLocalIterator(), at_once)):
        fold_files(spark, chunk, f"changed-{generation}-{number}", state_dir, config)
    manifest = materialize(_next_manifest(spark, state_dir, present), "manifest")
    loose = _names(manifest.where("base is null"), "part")
    if len(loose) > compact_after:
        manifest = _compacted(spark, state_dir, manifest, generation)
    elif manifest.exceptAll(_manifest(spark, state_dir)).isEmpty() and _manifest(spark, state_dir).count() == manifest.count():
        return
    manifest.coalesce(1).write.mode("overwrite").parquet(_path(state_dir, "manifest", str(generation)))
    _remove_unnamed(spark, state_dir, [*generations, generation])


def current_classes(spark: SparkSession, state_dir: str) -> DataFrame:
    """Case classes over all files of the last complete manifest."""
    return merge_classes(_read_state(spark, state_dir, _manifest(spark, state_dir)).drop("group"))


def current_words(
    spark: SparkSession, state_dir: str, config: Config, with_stats: bool = False
) -> DataFrame:
    """The word list over all files of the state, for the settings of the state."""
    if not _check_settings(spark, state_dir, config):
        raise ValueError(f"{state_dir} holds no state")
    return pick_top(
        current_classes(spark, state_dir),
        config.max_outputs,
        config.sort_by_popularity,
        with_stats=with_stats,
    )
