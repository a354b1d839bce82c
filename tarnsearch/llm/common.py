"""Helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a checked table may be broadcast (two or three BIGINT columns: under 40 MB).
BROADCAST_ROWS = 1_000_000


def one_row_per_id(df: DataFrame, id_col: str, unique_ids: bool) -> DataFrame:
    """Rows without a null id; where ids aren't known to be unique, one row per id."""
    df = df.where(F.col(id_col).isNotNull())
    return df if unique_ids else df.dropDuplicates([id_col])


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side whose counted ``rows`` are within ``limit``; beyond it a shuffle join is left to do."""
    return F.broadcast(df) if rows <= limit else df
