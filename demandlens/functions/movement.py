"""How a chart entry moved against the period before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def movement_kind(position: Column, previous: Column, seen_before: Column) -> Column:
    """new, re_entry, unchanged, up or down; ``previous`` is NULL when absent."""
    return (
        F.when(previous.isNull() & seen_before, "re_entry")
        .when(previous.isNull(), "new")
        .when(previous == position, "unchanged")
        .when(previous > position, "up")
        .otherwise("down")
    )


def movement_positions(position: Column, previous: Column) -> Column:
    """Positions gained, or lost when negative; NULL for entries that were absent."""
    return previous - position
