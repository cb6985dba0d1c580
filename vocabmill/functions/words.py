"""Column expressions on single words. All run on the JVM side."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that mark part-of-speech tags and abbreviations.
NON_WORD_CHARACTERS = ("_", ".")

DOTLESS_I = "\u0131"
# A noncharacter: legal in memory, never assigned to text.
PLACEHOLDER = "\ufdd0"


def fold(word: Column) -> Column:
    """Case-insensitive form of a word: full, locale-free Unicode case folding.

    Lower case alone keeps ``ß`` apart from ``ss`` and ``ς`` from ``σ``, so the
    word goes to upper case and back. Dotless ı is taken out on the way because
    its upper case is I. The replacements also keep the optimizer from reducing
    the nested case conversions to a single lower().
    """
    shielded = F.translate(F.lower(word), DOTLESS_I, PLACEHOLDER)
    folded = F.lower(F.translate(F.upper(shielded), PLACEHOLDER, DOTLESS_I))
    is_ascii = F.octet_length(word) == F.char_length(word)
    return F.when(is_ascii, F.lower(word)).otherwise(folded)


def starts_uppercase(word: Column) -> Column:
    """Whether the first character has the Unicode Uppercase property.

    In byte order the words that start with A-Z are one range, so this part is
    a plain comparison: no regular expression for ASCII words, and row groups
    of a table sorted by word can be skipped.
    """
    ascii_upper = (word >= "A") & (word < "[")
    other_upper = (word >= "\u0080") & word.rlike(r"^\p{IsUppercase}")
    return ascii_upper | other_upper


def not_a_word(word: Column) -> Column:
    """Whether the token carries a tag or is an abbreviation."""
    condition = F.lit(False)
    for character in NON_WORD_CHARACTERS:
        condition = condition | word.contains(character)
    return condition


def word_prefix(word: Column) -> Column:
    """The data file prefix a word belongs to: its first letter, or ``other``."""
    first = F.lower(F.substring(word, 1, 1))
    return F.when(first.between("a", "z") & (F.octet_length(first) == 1), first).otherwise("other")
