"""Inclusive intervals as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Shared positions; zero or less without any."""
    return F.least(a_stop, b_stop) - F.greatest(a_start, b_start) + 1


def span(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Positions from the first to the last of either."""
    return F.greatest(a_stop, b_stop) - F.least(a_start, b_start) + 1


def ratio(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Overlap as a part of the span."""
    return overlap(a_start, a_stop, b_start, b_stop) / span(a_start, a_stop, b_start, b_stop)
