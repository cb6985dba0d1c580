"""Small inputs, and a plain model of the whole job to compare with."""

from __future__ import annotations

import random
import unicodedata

from vocabmill import Config
from vocabmill.schema import ENTRY

STRIP = Config(min_matches=1, min_books=1)
KEEP = Config(strip_capitalized=False, min_matches=1, min_books=1)


def entries(spark, rows, keys=""):
    """Entries from tuples ``(ngram, year, match_count, volume_count, *keys)``."""
    schema = ", ".join(
        ["ngram string", "year long", "match_count long", "volume_count long"]
        + [f"{key} string" for key in keys.split()]
    )
    return spark.createDataFrame(rows, schema)


def column(df, name="ngram"):
    return [row[name] for row in df.collect()]


def random_entries(seed, files=1):
    """Random entries with many case variants and ties: (ngram, year, matches, books, file)."""
    rng = random.Random(seed)
    stems = ["a", "ab", "abc", "straße", "STRASSE", "été", "x.y", "t_NOUN", "ς", "σ", "ı", "i"]
    rows = {}
    for _ in range(rng.randrange(20, 120)):
        word = "".join(rng.choice((c.lower(), c.upper(), c)) for c in rng.choice(stems))
        year, books = rng.randrange(1955, 1975), rng.randrange(1, 4)
        file = f"f{rng.randrange(files)}"
        rows[word, year, file] = (word, year, books + rng.randrange(4), books, file)
    return list(rows.values())


def better(stats):
    """Sort key of statistics: the smaller, the better."""
    first, last, matches, books = stats
    return (-matches, -books, -last, first)


def merge(a, b):
    return (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], max(a[3], b[3]))


def model_casings(rows, config):
    casings = {}
    for word, year, matches, books, *_ in rows:
        upper = unicodedata.category(word[0]) == "Lu"
        if year < config.min_year or (config.strip_capitalized and upper):
            continue
        if "_" in word or "." in word:
            continue
        first, last, m, b = casings.get(word, (year, year, 0, 0))
        casings[word] = (min(first, year), max(last, year), m + matches, b + books)
    return {
        word: stats
        for word, stats in casings.items()
        if stats[2] >= config.min_matches and stats[3] >= config.min_books
    }


def model_classes(casings):
    """{fold key: (top casing, totals, top stats)}"""
    classes = {}
    for word, stats in casings.items():
        classes.setdefault(word.casefold(), []).append((word, stats))
    result = {}
    for key, members in classes.items():
        total = members[0][1]
        for _, stats in members[1:]:
            total = merge(total, stats)
        top, top_stats = min(members, key=lambda m: (better(m[1]), m[0].encode()))
        result[key] = (top, total, top_stats)
    return result


def model_words(classes, limit=None):
    order = sorted(classes.values(), key=lambda c: (better(c[1]), c[0].encode()))
    return [(top, *total) for top, total, _ in order][:limit]


def model_file_merge(rows, config):
    """Classes per file, then totals and the best among the casings leading a file."""
    totals, leaders = {}, {}
    for file in {row[4] for row in rows}:
        own = model_classes(model_casings([r for r in rows if r[4] == file], config))
        for key, (top, total, top_stats) in own.items():
            totals[key] = merge(totals[key], total) if key in totals else total
            known = leaders.setdefault(key, {})
            known[top] = merge(known[top], top_stats) if top in known else top_stats
    return {
        key: (min(leaders[key], key=lambda w: (better(leaders[key][w]), w.encode())), total)
        for key, total in totals.items()
    }


assert ENTRY.names == ["ngram", "year", "match_count", "volume_count"]
