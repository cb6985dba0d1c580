"""Sums that fail when they overflow, whatever the session's settings say."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked_sum(name: str) -> Column:
    """The sum of a column that is never NULL."""
    return F.coalesce(F.try_sum(name), F.raise_error(F.lit(f"the sum of {name} exceeds 64 bits")))
