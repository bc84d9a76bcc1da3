"""Times of RFC 3339 as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: date, T, time, any fraction, and a zone of Z, +hh:mm or +hhmm; without a zone the session's holds.
SHAPE = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\z"


def parse_time(value: Column) -> Column:
    """The time, or null for what is no time. Digits beyond microseconds are cut off."""
    return F.when(value.rlike(SHAPE), F.try_to_timestamp(value))
