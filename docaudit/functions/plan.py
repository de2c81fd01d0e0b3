"""Checked broadcasts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """df marked for broadcast only if it has at most `limit` rows (a job counts no further); else Spark joins as it would."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
