"""Small plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_above(df: DataFrame, condition: Column) -> DataFrame:
    """Filter that stays above the projection it reads.

    A pushed-down filter repeats the projection's expressions inside its condition; for
    parsed JSON that means one parse per field it touches. The row id makes the
    projection non-deterministic, so its columns are computed once and then tested.
    """
    held = df.withColumn("_held", F.monotonically_increasing_id())
    return held.filter(condition & (F.col("_held") >= 0)).drop("_held")
