"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000   # short rows that one broadcast may hold


def broadcast_checked(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, marked for broadcast if there are at most ``most``; else left to a shuffle
    join.  ``rows`` must be cheap to read (a written or checkpointed table of short rows)."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
