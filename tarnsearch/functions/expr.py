"""Building blocks of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; nested expressions stay small."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))
