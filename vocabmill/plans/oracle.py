"""Plain SQL with the same results as the registered queries, for another engine."""

from __future__ import annotations

from vocabmill.plans.queries import (
    BREAKS,
    LANGUAGE_CODES,
    PATH_BASE,
    TOP,
    TOP_LARGE,
    TOP_PER_LANGUAGE,
    TOP_PER_LANGUAGE_LARGE,
)
from vocabmill.sources.catalog import FILE_NAME_FORMAT, LANGUAGES, LATIN_WORD_PREFIXES

CAPITALIZED = r"regexp_matches(ngram, '^\p{Lu}')"
NOT_A_WORD = "(contains(ngram, '_') OR contains(ngram, '.'))"
FOLD = "replace(lower(ngram), 'ß', 'ss')"
PREFIX = "CASE WHEN regexp_matches(ngram, '^[A-Za-z]') THEN lower(ngram[1]) ELSE 'other' END"
BEST = "match_count DESC, {books} DESC, last_year DESC, first_year, {word}"
BEST_CASING = BEST.format(books="volume_count", word="ngram")
BEST_CLASS = BEST.format(books="min_volume_count", word="top_casing")

_codes = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in LANGUAGE_CODES.items())
_KEYS = {
    "lang": f"CASE lang {_codes} END",
    "file": "source",
    "source": "source",
    "decade": "(1950 + doc_id % 60) // 10 * 10",
}
CATALOG = "(VALUES " + ", ".join(f"('{n}', '{s}', {f})" for n, s, f in LANGUAGES) + ")"
CATALOG += " AS catalog(name, short_name, should_strip_capitalized)"
PREFIXES = "(VALUES " + ", ".join(f"('{p}')" for p in LATIN_WORD_PREFIXES) + ") AS p(prefix)"


def _list(keys) -> str:
    return "".join(f"{key}, " for key in keys)


def entries(*keys: str, empty: bool = False) -> str:
    source = "".join(f"{_KEYS[key]} AS {key}, " for key in keys)
    where = "" if empty else "WHERE ngram <> ''"
    return rf"""
        SELECT {_list(keys)}ngram, year,
               count(*) AS match_count, count(DISTINCT doc_id) AS volume_count
        FROM (SELECT doc_id, {source}1950 + doc_id % 60 AS year,
                     unnest(regexp_split_to_array(text, '[ \n\t\r]+')) AS ngram
              FROM documents)
        {where}
        GROUP BY {_list(keys)}ngram, year"""


def accepted(*keys: str, strip: bool) -> str:
    capitals = f"AND NOT {CAPITALIZED}" if strip else ""
    return f"""
        SELECT * FROM ({entries(*keys)})
        WHERE year >= 1962 {capitals} AND NOT {NOT_A_WORD}"""


def rollup(source: str, *keys: str, having: str = "") -> str:
    return f"""
        SELECT {_list(keys)}ngram, min(year) AS first_year, max(year) AS last_year,
               sum(match_count)::BIGINT AS match_count,
               sum(volume_count)::BIGINT AS volume_count
        FROM ({source}) GROUP BY {_list(keys)}ngram {having}"""


def supported(source: str, *keys: str, matches: int = 20, books: int = 3) -> str:
    having = f"HAVING sum(match_count) >= {matches} AND sum(volume_count) >= {books}"
    return f"SELECT *, {FOLD} AS fold_key FROM ({rollup(source, *keys, having=having)})"


def classes(casings: str, *keys: str) -> str:
    """Case classes, flat, out of spellings."""
    by = f"{_list(keys)}fold_key"
    return f"""
        SELECT {by}, min(first_year) AS first_year, max(last_year) AS last_year,
               sum(match_count)::BIGINT AS match_count,
               max(volume_count) AS min_volume_count, count(*) AS n_casings,
               max(ngram) FILTER (best) AS top_casing,
               max(first_year) FILTER (best) AS top_first_year,
               max(last_year) FILTER (best) AS top_last_year,
               max(match_count) FILTER (best) AS top_match_count,
               max(volume_count) FILTER (best) AS top_volume_count
        FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {BEST_CASING}) = 1 AS best
              FROM ({casings}))
        GROUP BY {by}"""


def merged_files(file_keys: tuple[str, ...], source: str = "") -> str:
    """Cutoffs and classes per file, then totals per class and the best leading spelling."""
    source = source or accepted(*file_keys, strip=False)
    casings = supported(source, *file_keys, matches=5, books=2)
    return f"""
        WITH partial AS ({classes(casings, *file_keys)}),
        totals AS (
            SELECT fold_key, min(first_year) AS first_year, max(last_year) AS last_year,
                   sum(match_count)::BIGINT AS match_count,
                   max(min_volume_count) AS min_volume_count,
                   sum(n_casings)::BIGINT AS n_casings
            FROM partial GROUP BY fold_key),
        leaders AS (
            SELECT fold_key, top_casing AS ngram, min(top_first_year) AS first_year,
                   max(top_last_year) AS last_year,
                   sum(top_match_count)::BIGINT AS match_count,
                   max(top_volume_count) AS volume_count
            FROM partial GROUP BY fold_key, top_casing),
        best AS (
            SELECT fold_key, ngram AS top_casing, first_year AS top_first_year,
                   last_year AS top_last_year, match_count AS top_match_count,
                   volume_count AS top_volume_count
            FROM leaders
            QUALIFY row_number() OVER (PARTITION BY fold_key ORDER BY {BEST_CASING}) = 1)
        SELECT * FROM totals JOIN best USING (fold_key)"""


STATS = "first_year, last_year, match_count, min_volume_count"
MERGED = classes(supported(accepted(strip=False)))
STRIPPED = classes(supported(accepted(strip=True)))
EVERYTHING = classes(supported(accepted(strip=False), matches=1, books=1))


def top(source: str, columns: str, limit: int) -> str:
    return f"""
        SELECT {columns} FROM (
            SELECT *, row_number() OVER (ORDER BY {BEST_CLASS}) AS rank FROM ({source}))
        WHERE rank <= {limit}"""


def by_language(matches: int, books: int) -> str:
    df = f"""
        SELECT e.* FROM ({accepted("lang", strip=False)}) e
        JOIN {CATALOG} ON e.lang = short_name
        WHERE NOT (should_strip_capitalized AND {CAPITALIZED})"""
    return classes(supported(df, "lang", matches=matches, books=books), "lang")


def top_by_language(source: str, columns: str, limit: int) -> str:
    return f"""
        SELECT {columns} FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {BEST_CLASS}) AS rank
            FROM ({source}))
        WHERE rank <= {limit}"""


CAUSE = f"""
    CASE WHEN year < 1962 THEN 'too_old' WHEN {CAPITALIZED} THEN 'capitalized'
         WHEN {NOT_A_WORD} THEN 'not_a_word' END"""
REJECTED = f"SELECT * FROM (SELECT *, {CAUSE} AS cause FROM ({entries()})) WHERE cause IS NOT NULL"
LANGUAGE_ENTRIES = f"SELECT *, {PREFIX} AS prefix FROM ({entries('lang')})"


#: The entries that broken lines leave, and what else is in them, by ``kind``.
BROKEN = f"SELECT *, (year + match_count) % 11 AS kind FROM ({entries()})"
BROKEN_ENTRIES = f"""
    SELECT CASE WHEN kind = 8 THEN '' ELSE ngram END AS ngram, year,
           CASE WHEN kind = 7 THEN volume_count ELSE match_count END AS match_count,
           CASE WHEN kind = 7 THEN match_count ELSE volume_count END AS volume_count, kind
    FROM ({BROKEN}) WHERE kind NOT BETWEEN 1 AND 6"""
BROKEN_CAUSES = f"SELECT *, {CAUSE} AS cause FROM ({BROKEN_ENTRIES})"
#: Entries that pass all rules, those that are there twice as two rows.
BROKEN_ACCEPTED = f"""
    SELECT ngram, year, match_count, volume_count FROM (
        SELECT *, unnest(range(CASE WHEN kind = 9 THEN 2 ELSE 1 END)) AS copy FROM ({BROKEN_CAUSES}))
    WHERE cause IS NULL AND match_count >= volume_count AND ngram <> ''"""


def _audited() -> str:
    lines = " UNION ALL ".join(
        f"SELECT 'decode:{cause}' AS rule, count(*) AS n FROM ({BROKEN}) WHERE kind = {k}" for k, cause in enumerate(BREAKS) if cause
    )
    words = " UNION ALL ".join(
        f"SELECT 'rejected:{cause}', count(*) FROM earliest WHERE cause = '{cause}'" for cause in ("too_old", "capitalized", "not_a_word")
    )
    casings = rollup(BROKEN_ACCEPTED)
    return f"""
        WITH e AS ({BROKEN_CAUSES}),
        earliest AS (SELECT ngram, arg_min(cause, year) AS cause FROM e WHERE cause IS NOT NULL AND ngram <> '' GROUP BY ngram)
        {lines}
        UNION ALL SELECT 'books', count(*) FROM e WHERE cause IS NULL AND match_count < volume_count
        UNION ALL SELECT 'empty', count(*) FROM e WHERE ngram = ''
        UNION ALL SELECT 'repeated_years', count(DISTINCT (ngram, year - year % 64))
            FROM (SELECT ngram, year FROM ({BROKEN_ACCEPTED}) GROUP BY ALL HAVING count(*) > 1)
        UNION ALL {words}
        UNION ALL SELECT 'unsupported', count(*) FROM ({casings}) WHERE match_count < 20 OR volume_count < 3
        UNION ALL SELECT 'class', 0"""


def oracle_sql() -> dict[str, str]:
    path = "'" + f"{PATH_BASE}/{FILE_NAME_FORMAT}" % ("' || short_name || '", "' || prefix || '") + "'"
    return {
        "s1_language_catalog": f"""
            SELECT name, short_name, '{" ".join(LATIN_WORD_PREFIXES)}' AS word_prefixes,
                   should_strip_capitalized, count(ngram) AS n_entries,
                   coalesce(sum(match_count), 0)::BIGINT AS match_count
            FROM {CATALOG} LEFT JOIN ({entries("lang")}) e ON e.lang = short_name
            GROUP BY ALL""",
        "s3_dataset_paths": f"""
            SELECT short_name, p.prefix, {path.replace("|| prefix ||", "|| p.prefix ||")} AS path,
                   count(ngram) AS n_entries,
                   coalesce(sum(match_count), 0)::BIGINT AS match_count
            FROM {CATALOG} CROSS JOIN {PREFIXES}
            LEFT JOIN ({LANGUAGE_ENTRIES}) e ON e.lang = short_name AND e.prefix = p.prefix
            GROUP BY ALL""",
        "s5_text_scan": entries(),
        "s6_multi_file_scan": LANGUAGE_ENTRIES,
        "s7_prefix_pruning": f"""
            SELECT * FROM (SELECT *, {PREFIX} AS prefix FROM ({entries()}))
            WHERE prefix IN ('a', 'q', 'other')""",
        "s7_columnar_pruning": f"""
            SELECT * FROM ({LANGUAGE_ENTRIES})
            WHERE lang IN ('eng', 'ger') AND prefix IN ('a', 'q', 'other')""",
        "f1_recency": f"SELECT * FROM ({entries()}) WHERE year >= 1962",
        "f2_capitalised": f"SELECT * FROM ({entries()}) WHERE NOT {CAPITALIZED}",
        "f3_not_a_word": f"SELECT * FROM ({entries()}) WHERE NOT {NOT_A_WORD}",
        "f4_accept": accepted(strip=True),
        "f5_reject_cause": REJECTED,
        "f6_rejection_audit": f"""
            SELECT ngram, min(year) AS year, arg_min(cause, year) AS cause
            FROM ({REJECTED}) GROUP BY ngram""",
        "f7_threshold_audit": rollup(
            accepted(strip=True),
            having="HAVING sum(match_count) < 20 OR sum(volume_count) < 3",
        ),
        "p1_strip_by_language": f"""
            SELECT e.* FROM ({entries("lang")}) e JOIN {CATALOG} ON e.lang = short_name
            WHERE NOT (should_strip_capitalized AND {CAPITALIZED})""",
        "p3_kept_with_stats": f"SELECT top_casing AS ngram, {STATS} FROM ({MERGED})",
        "v1_decode": "SELECT '' AS value, '' AS cause WHERE false",
        "v1_decode_zero_books": f"""
            SELECT concat_ws(chr(9), ngram, year, match_count, 0) AS value,
                   'volume_count' AS cause
            FROM ({entries()}) WHERE volume_count = 1""",
        "v2_books_le_matches": f"""
            SELECT * FROM ({accepted(strip=True)}) WHERE match_count < volume_count""",
        "v2_books_le_matches_swapped": f"""
            SELECT ngram, year, volume_count AS match_count, match_count AS volume_count
            FROM ({accepted(strip=True)}) WHERE volume_count < match_count""",
        "v3_one_entry_per_year": f"""
            SELECT lang, ngram, year, count(*) AS n_entries FROM ({accepted("lang", strip=True)})
            GROUP BY ALL HAVING count(*) > 1""",
        "v3_one_entry_per_year_mixed": f"""
            SELECT ngram, year, count(*) AS n_entries FROM ({accepted("lang", strip=True)})
            GROUP BY ALL HAVING count(*) > 1""",
        "v3_repeated_years_mixed": f"""
            SELECT ngram, year - year % 64 AS from_year, count(*) AS n_entries,
                   count(DISTINCT year) AS n_years
            FROM ({accepted("lang", strip=True)})
            GROUP BY ngram, from_year HAVING count(*) > count(DISTINCT year)""",
        "v3_repeated_years_in_files": f"""
            SELECT source AS file, ngram, year - year % 64 AS from_year, sum(n)::BIGINT AS n_entries,
                   count(DISTINCT year) AS n_years
            FROM (SELECT source, ngram, year + 100 * (match_count % 3) AS year,
                         CASE WHEN (year + match_count) % 7 = 0 THEN 2 ELSE 1 END AS n
                  FROM ({entries("source")}))
            WHERE year >= 1962 AND NOT {CAPITALIZED} AND NOT {NOT_A_WORD}
            GROUP BY source, ngram, from_year HAVING sum(n) > count(DISTINCT year)""",
        "v4_empty_ngram": f"SELECT * FROM ({entries(empty=True)}) WHERE ngram = ''",
        "v4_empty_ngram_lower_case": f"""
            SELECT '' AS ngram, year, match_count, volume_count FROM ({entries()})
            WHERE NOT regexp_matches(ngram, '[a-z]')""",
        "v7_class_invariant_short_total": f"""
            SELECT * FROM (SELECT * REPLACE (match_count - 1 AS match_count) FROM ({MERGED}))
            WHERE (match_count, min_volume_count, last_year, -first_year)
                < (top_match_count, top_volume_count, top_last_year, -top_first_year)""",
        "v7_class_invariant": f"""
            SELECT * FROM ({MERGED})
            WHERE (match_count, min_volume_count, last_year, -first_year)
                < (top_match_count, top_volume_count, top_last_year, -top_first_year)""",
        "a1_yearly_rollup": rollup(entries()),
        "a2_support": f"""
            SELECT * FROM ({rollup(entries())}) WHERE match_count >= 20 AND volume_count >= 3""",
        "a3_fold_key": f"SELECT *, {FOLD} AS fold_key FROM ({rollup(entries())})",
        "a4_class_totals": f"SELECT fold_key, {STATS} FROM ({MERGED})",
        "a5_top_casing": f"""
            SELECT fold_key, top_casing, top_first_year, top_last_year, top_match_count,
                   top_volume_count
            FROM ({MERGED})""",
        "a6_casing_count": f"SELECT fold_key, n_casings FROM ({MERGED})",
        "a7_merge_dataset": MERGED,
        "a7_merge_files": merged_files(("file",)),
        "t1_all_unordered": f"SELECT top_casing AS ngram FROM ({MERGED})",
        "t2_top_unordered": top(MERGED, "top_casing AS ngram", TOP),
        "t2_top_unordered_large": top(EVERYTHING, f"top_casing AS ngram, {STATS}", TOP_LARGE),
        "t3_top_ordered": top(MERGED, "rank, top_casing AS ngram", TOP),
        "t3_top_ordered_large": top(EVERYTHING, "rank, top_casing AS ngram", TOP_LARGE),
        "t4_all_ordered": f"""
            SELECT top_casing AS ngram, {STATS}, row_number() OVER (ORDER BY {BEST_CLASS}) AS rank
            FROM ({MERGED}) ORDER BY {BEST_CLASS}""",
        "v1_decode_broken": f"""
            SELECT ngram, year AS in_year, match_count,
                   ({BREAKS!r})[(year + match_count) % {len(BREAKS)} + 1] AS cause
            FROM ({entries()}) WHERE (year + match_count) % {len(BREAKS)} > 0""",
        "j1_language_word_list": f"""
            SELECT * FROM ({top_by_language(
                by_language(20, 3), f"lang, rank, top_casing AS ngram, {STATS}", TOP)})
            WHERE lang IN ('fre', 'ger')""",
        "j1_file_scope": f"""
            SELECT top_casing AS ngram, {STATS} FROM ({merged_files(("prefix",), f"""
                SELECT *, {PREFIX} AS prefix FROM ({accepted("lang", strip=True)})
                WHERE lang = 'eng'""")})""",
        "j2_all_word_lists": top_by_language(
            by_language(20, 3), f"lang, rank, top_casing AS ngram, {STATS}", TOP_PER_LANGUAGE
        ),
        "j2_columnar_word_lists": top_by_language(
            by_language(20, 3), f"lang, rank, top_casing AS ngram, {STATS}", TOP_PER_LANGUAGE
        ),
        "s8_word_sink": top_by_language(
            by_language(20, 3), "lang, rank AS position, top_casing AS ngram", TOP_PER_LANGUAGE
        ),
        "v_audited_word_list": _audited(),
        "j1_audited_word_list": top(
            classes(supported(BROKEN_ACCEPTED)), f"rank, top_casing AS ngram, {STATS}", TOP
        ),
        "s7_bucketed_copy": f"""
            SELECT * FROM ({LANGUAGE_ENTRIES})
            WHERE lang IN ('eng', 'ger') AND prefix IN ('a', 'q', 'other')""",
        "j2_bucketed_word_lists": top_by_language(
            by_language(20, 3), f"lang, rank, top_casing AS ngram, {STATS}", TOP_PER_LANGUAGE
        ),
        "s8_long_list": f"""
            SELECT top_casing AS ngram, row_number() OVER (ORDER BY {BEST_CLASS}) AS position
            FROM ({EVERYTHING})""",
        "t3_top_ordered_by_ranges": top(EVERYTHING, f"rank, top_casing AS ngram, {STATS}", TOP_LARGE),
        "j1_overlapping_files": top(STRIPPED, f"rank, top_casing AS ngram, {STATS}", TOP),
        "j1_word_list": top(STRIPPED, f"rank, top_casing AS ngram, {STATS}", TOP),
        "j1_word_list_merged": top(MERGED, f"rank, top_casing AS ngram, {STATS}", TOP),
        "j2_word_lists": top_by_language(
            by_language(20, 3), f"lang, rank, top_casing AS ngram, {STATS}", TOP_PER_LANGUAGE
        ),
        "j2_word_lists_all": f"""
            SELECT lang, top_casing AS ngram, {STATS} FROM ({by_language(20, 3)})
            ORDER BY lang, {BEST_CLASS}""",
        "j2_word_lists_large": top_by_language(
            by_language(1, 1), "lang, rank, top_casing AS ngram", TOP_PER_LANGUAGE_LARGE
        ),
        "j3_incremental": merged_files(("source", "decade")),
        "j3_replaced_files": merged_files(
            ("source", "decade"),
            f"SELECT * FROM ({accepted('source', 'decade', strip=False)}) WHERE decade <> 1980",
        ),
    }
