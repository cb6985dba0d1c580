"""Small tables with all kinds of odd rows, and plain versions to compare with."""

from __future__ import annotations

import random
import re

LANGS = {
    "en": "the of and to in is that it was for on are as with they be at this have from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, `row` string, id string, n int, kept string, score string, component_id string"


def prose(rng: random.Random, lang: str, words: int) -> str:
    stems = LANGS[lang]
    out = []
    for _ in range(words):
        word = rng.choice(stems) if rng.random() < 0.5 else "".join(rng.choice(stems)[:4] for _ in range(rng.randrange(1, 4)))
        out.append(word.capitalize() if rng.random() < 0.1 else word)
    return " ".join(out) + "."


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, lang): prose, copies, near copies, nulls, blanks, short, long and odd texts."""
    rng = random.Random(5)
    rows: list[tuple[int | None, str | None, str | None]] = []
    for i in range(60):
        lang = rng.choice(list(LANGS))
        rows.append((i, prose(rng, lang, rng.randrange(30, 200)), lang))
    base = rows[3][1].split()
    for i in range(60, 75):  # near copies
        own = list(base)
        for _ in range(rng.randrange(1, 6)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(1000)}"
        rows.append((i, " ".join(own), "en"))
    rows += [(i, rows[7][1], rows[7][2]) for i in range(75, 80)]  # copies
    rows += [(80, None, "en"), (81, "", "en"), (82, " \t\n", None), (83, "one", None), (84, "One", "en"), (85, "a b c", "en"), (86, "A b\tC", "en")]
    rows += [(87, "12 34 !!! ###", None), (88, "日本語 テキスト　한국어 Σας İx é", None), (89, "x" * 5000, None), (90, "don't 'll <|endoftext|> we're\x1cxx", "en")]
    rows += [(91, " ".join(rng.choice(LANGS["en"]) for _ in range(60_000)), "en"), (92, "the cat " * 30, "en"), (93, "line one here\nline one here\n\n \nother", "en")]
    rows += [(92, "the cat " * 30, "en"), (7, rows[7][1], rows[7][2]), (None, rows[5][1], "en"), (None, None, None)]  # repeated rows, rows without an id
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, lang, "s", len(t or ""), "k", "r", "x", 1, "no", "high", "c") for i, t, lang in rows], SCHEMA
    ).repartition(3)


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))
