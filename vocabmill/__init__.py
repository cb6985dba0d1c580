"""Ranked vocabularies from very large tables of yearly word counts."""

from vocabmill.config import Config
from vocabmill.operators.audit import Audit, audited_word_list
from vocabmill.operators.casing import (
    case_classes,
    casing_count,
    class_totals,
    top_casing,
    with_fold_key,
)
from vocabmill.operators.filters import (
    accept,
    filter_capitalized,
    filter_capitalized_by_language,
    filter_languages,
    filter_non_words,
    filter_year,
    reject_cause,
    rejection_audit,
    support_audit,
)
from vocabmill.operators.merge import merge_files
from vocabmill.operators.quality import (
    DataQualityError,
    check_books,
    check_class,
    check_decode,
    check_empty,
    check_years,
    repeated_years,
)
from vocabmill.operators.rollup import support, yearly_rollup
from vocabmill.operators.topk import pick_top
from vocabmill.plans.word_list import (
    all_word_lists,
    language_word_list,
    read_language,
    word_list,
    word_lists,
)
from vocabmill.sources.catalog import dataset_paths, language_config, languages
from vocabmill.sources.columnar import read_columnar, write_columnar
from vocabmill.sources.documents import entries_from_documents, read_documents
from vocabmill.sources.entries import read_entries, write_entries_text
from vocabmill.sources.words import read_words, write_words
from vocabmill.streaming.incremental import current_words, run_incremental

__all__ = [
    "Audit",
    "Config",
    "DataQualityError",
    "accept",
    "all_word_lists",
    "audited_word_list",
    "case_classes",
    "casing_count",
    "check_books",
    "check_class",
    "check_decode",
    "check_empty",
    "check_years",
    "class_totals",
    "current_words",
    "dataset_paths",
    "entries_from_documents",
    "filter_capitalized",
    "filter_capitalized_by_language",
    "filter_languages",
    "filter_non_words",
    "filter_year",
    "language_config",
    "language_word_list",
    "languages",
    "merge_files",
    "pick_top",
    "read_columnar",
    "read_documents",
    "read_entries",
    "read_language",
    "reject_cause",
    "rejection_audit",
    "repeated_years",
    "run_incremental",
    "support",
    "support_audit",
    "top_casing",
    "with_fold_key",
    "word_list",
    "word_lists",
    "write_columnar",
    "write_entries_text",
    "read_words",
    "write_words",
    "yearly_rollup",
]
