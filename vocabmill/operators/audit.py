"""Counting what breaks a rule while a job runs, instead of stopping at it or scanning once more.

The checks of ``quality`` and ``filters`` list offending rows and are jobs of their own.
Here a word list is made in one scan, and metrics on the way count by rule. Lines that
are no entry are left out, as are entries that break a rule of entries; what remains
is the list that the job would make without them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vocabmill.config import Config
from vocabmill.functions.ranking import rank_value
from vocabmill.functions.sums import checked_sum
from vocabmill.operators.casing import case_classes, with_fold_key
from vocabmill.operators.filters import reject_reason
from vocabmill.operators.rollup import file_keys, has_support, year_span, years_seen
from vocabmill.operators.topk import pick_top
from vocabmill.schema import ENTRY
from vocabmill.sources.entries import decode_problem, split_lines

#: Why a line is no entry, and why an entry is not accepted.
LINE_CAUSES = ("encoding", "field_count", "not_a_number", "year", "match_count", "volume_count")
REJECT_CAUSES = ("too_old", "capitalized", "not_a_word")


class Audit:
    """The counts of a job, which are there once the job has run.

    ======================  =====================================================
    ``decode:<cause>``      lines that are no entry (V1)
    ``books``               accepted entries with more books than matches (V2)
    ``repeated_years``      words, spans of 64 years and files with a repeat (V3)
    ``empty``               entries without a word, where that matters (V4)
    ``class``               classes that are worse than their best spelling (V7)
    ``rejected:<cause>``    words by the cause of their earliest rejected entry (F6)
    ``unsupported``         words that pass the filters but miss a cutoff (F7)
    ======================  =====================================================
    """

    def __init__(self):
        self._observed: list[Observation] = []

    def watch(self, df: DataFrame, **rules: Column) -> DataFrame:
        """``df``, of whose rows those that ``rules`` hold for are counted as they pass."""
        metrics = [F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
        self._observed.append(Observation())
        return df.observe(self._observed[-1], *metrics)

    @property
    def counts(self) -> dict[str, int]:
        """Waits for the job, if it is still running, and must not be asked before it was started."""
        return {name.replace("__", ":"): n for observed in self._observed for name, n in observed.get.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.counts.items()), "rule string, n long")


def sound_entries(lines: DataFrame, config: Config, audit: Audit, keys: Sequence[str] = ()) -> DataFrame:
    """The entries among ``lines`` (column ``value``), with the ``cause`` that rejects them, if any."""
    split = split_lines(lines.where(F.col("value") != "")).withColumn("_problem", decode_problem())
    split = audit.watch(split, **{f"decode__{c}": F.col("_problem") == c for c in LINE_CAUSES})
    fields = [F.get("_fields", F.lit(0)).alias("ngram"), *(F.col(f"_{n}").alias(n) for n in ENTRY.names[1:])]
    entries = split.where("_problem is null").select(*keys, *fields).withColumn("cause", reject_reason(config))
    more_books = F.col("cause").isNull() & (F.col("match_count") < F.col("volume_count"))
    empty = F.lit(config.strip_capitalized) & (F.col("ngram") == "")
    return audit.watch(entries, books=more_books, empty=empty).where(~more_books & ~empty)


def audited_casings(entries: DataFrame, config: Config, audit: Audit, keys: Sequence[str] = ()) -> DataFrame:
    """Supported spellings of ``sound_entries``; rejected entries go along in the same shuffles to be counted by word."""
    if "file" in entries.columns:
        entries = entries.withColumns(file_keys()).drop("file")
    files = [name for name in ("_file_1", "_file_2") if name in entries.columns]
    accepted = F.col("cause").isNull()

    def of_accepted(name):
        return F.when(accepted, F.col(name))

    rows = entries.withColumns({
        "_first": of_accepted("year"), "_matches": F.coalesce(of_accepted("match_count"), F.lit(0)),
        "_books": F.coalesce(of_accepted("volume_count"), F.lit(0)), "_rejected": F.when(~accepted, F.col("year")),
        # Rejected years share a span, as nothing is counted in it.
        "_span": F.when(accepted, year_span()), "_kept": accepted.cast("bigint"),
    })
    spans = rows.groupBy(*keys, *files, "ngram", "_span").agg(
        F.min("_first").alias("first_year"),
        F.max("_first").alias("last_year"),
        checked_sum("_matches").alias("match_count"),
        checked_sum("_books").alias("volume_count"),
        F.min("_rejected").alias("_rejected"),
        years_seen().alias("_years"),
        F.sum("_kept").alias("_entries"),
    )
    repeated = F.col("_span").isNotNull() & (F.col("_entries") > F.bit_count("_years"))
    words = audit.watch(spans, repeated_years=repeated).groupBy(*keys, "ngram").agg(
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
        checked_sum("match_count").alias("match_count"),
        checked_sum("volume_count").alias("volume_count"),
        F.min("_rejected").alias("year"),
    )
    cause = reject_reason(config)
    any_accepted = F.col("first_year").isNotNull()
    supported = has_support(config.min_matches, config.min_books)
    rules = {f"rejected__{c}": F.col("year").isNotNull() & (cause == c) for c in REJECT_CAUSES}
    words = audit.watch(words, **rules, unsupported=any_accepted & ~supported)
    return with_fold_key(words.where(any_accepted & supported).drop("year"))


def audited_classes(casings: DataFrame, audit: Audit, keys: Sequence[str] = ()) -> DataFrame:
    """Case classes, of which those that break the rule of classes are counted."""
    worse = rank_value(books="min_volume_count") > rank_value("top_stats")
    return audit.watch(case_classes(casings, keys), **{"class": worse})


def audited_word_list(lines: DataFrame, config: Config, audit: Audit, with_stats: bool = False) -> DataFrame:
    """The word list of text ``lines`` (``value``, and ``file`` if files are to be told apart), in one scan.

    Entries that repeat a year are counted and stay in the list.
    """
    keys = [name for name in lines.columns if name == "file"]
    casings = audited_casings(sound_entries(lines, config, audit, keys), config, audit)
    classes = audited_classes(casings, audit)
    return pick_top(classes, config.max_outputs, config.sort_by_popularity, with_stats=with_stats)
