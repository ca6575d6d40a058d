"""Sizes that decide how a join is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side that has been counted is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the table has at most so many rows, else the table as it is. Counts them, so the table should be cheap to read."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
