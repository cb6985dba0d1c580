"""Parameters of a word list run."""

from __future__ import annotations

from dataclasses import dataclass

# The data set edition and the default cutoffs.
PUBLICATION_YEAR = 2012
DEFAULT_MIN_YEAR = PUBLICATION_YEAR - 50
DEFAULT_MIN_MATCHES = 6000
DEFAULT_MIN_BOOKS = 10


@dataclass(frozen=True)
class Config:
    """What to keep and how much of it to return.

    The cutoffs apply to the total of one spelling over the accepted years,
    before spellings that differ in case are merged. A cutoff of 0 is off.
    """

    strip_capitalized: bool = True
    min_year: int = DEFAULT_MIN_YEAR
    min_matches: int = DEFAULT_MIN_MATCHES
    min_books: int = DEFAULT_MIN_BOOKS
    max_outputs: int | None = None
    sort_by_popularity: bool = False

    def __post_init__(self):
        if self.min_year > PUBLICATION_YEAR:
            raise ValueError(
                f"min_year {self.min_year} excludes every book: "
                f"the data set was published in {PUBLICATION_YEAR}"
            )
        if self.min_matches < 0 or self.min_books < 0:
            raise ValueError("min_matches and min_books must not be negative")
        if self.max_outputs is not None and self.max_outputs < 1:
            raise ValueError("max_outputs must be at least 1, or None for no limit")
