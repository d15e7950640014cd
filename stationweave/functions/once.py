"""Columns that are worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with further columns that no filter or later expression copies into itself.

    The optimizer writes a projected column out wherever a filter or another
    column uses it, which repeats a costly parse many times. A generator over one
    value is a border for it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
