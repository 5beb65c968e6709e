"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_present(df: DataFrame, array: Column, name: str) -> DataFrame:
    """One row per non-null element.

    The outer generator keeps the optimiser from copying a long array
    expression into a filter on its size, which costs far more than it saves.
    """
    return df.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())
