"""Band labels for ages, ratings, delivery times and delays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inclusive upper bounds and labels; the last label has no upper bound.
AGE_BANDS = ((17, "under 18"), (24, "18-24"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64"), (None, "65+"))
RATING_BANDS = (
    ("2.4", "poor (up to 2.4)"),
    ("2.9", "2.5-2.9"),
    ("3.4", "3.0-3.4"),
    ("3.9", "3.5-3.9"),
    ("4.4", "4.0-4.4"),
    (None, "excellent (4.5-5.0)"),
)
DELIVERY_DAY_BANDS = (("-0.01", "negative"), (2, "0-2 days"), (5, "3-5 days"), (8, "6-8 days"), (None, "9+ days"))
DELAY_BANDS = ((-1, "early"), (0, "on the day"), (2, "1-2 days late"), (5, "3-5 days late"), (None, "6+ days late"))


def band(value: Column, bounds: Sequence[tuple]) -> Column:
    """Label of the first bound that `value` does not exceed; NULL stays NULL."""
    label = None
    for bound, name in bounds:
        hit = value.isNotNull() if bound is None else value <= F.lit(bound).cast("decimal(8,2)")
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label

