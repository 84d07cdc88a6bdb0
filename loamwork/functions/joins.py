"""Joins that broadcast one side only after its rows have been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers each, so some tens of MB at most.
MOST_ROWS = 1_000_000


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = MOST_ROWS) -> DataFrame:
    """Join with `small` (narrow, staged) broadcast if it has at most `most` rows; a shuffled join otherwise."""
    few = small.limit(most + 1).count() <= most
    return big.join(F.broadcast(small) if few else small, on, how)
