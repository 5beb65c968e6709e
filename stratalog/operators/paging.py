"""Pages of ordered results and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def page_after(df: DataFrame, *, key: str, after, limit: int) -> DataFrame:
    """Rows with ``key`` beyond ``after``, at most ``limit``, with ``next_after`` set while more follow.

    The filter reaches the scan and the sort is a bounded take, so a page costs
    no full sort.
    """
    taken = df.where(F.col(key) > after).orderBy(key).limit(limit + 1)
    # at most limit + 1 rows from here on
    numbered = taken.withColumn("_n", F.row_number().over(W.orderBy(key)))
    whole = W.partitionBy()
    more = F.max("_n").over(whole) > limit
    cursor = F.max(F.when(F.col("_n") == limit, F.col(key))).over(whole)
    return numbered.withColumn("next_after", F.when(more, cursor)).where(F.col("_n") <= limit).drop("_n")


def page_after_place(df: DataFrame, *, order: Sequence[str], after: Sequence | None = None, limit: int = 200) -> DataFrame:
    """The next ``limit`` rows in ``order`` beyond the place ``after``, with ``next_after`` (a place) while more follow.

    ``order`` identifies a row and is never null. The bound of its first column reaches
    the scan, so in a table laid out in this order the footers of the files say where a
    page begins; the sort is a bounded take.
    """
    place = F.struct(*order)
    if after is not None:
        df = df.where(F.col(order[0]) >= F.lit(after[0])).where(place > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, after)]))
    taken = df.orderBy(*order).limit(limit + 1)
    # at most limit + 1 rows from here on
    numbered = taken.withColumn("_n", F.row_number().over(W.orderBy(*order)))
    whole = W.partitionBy()
    cursor = F.max(F.when(F.col("_n") == limit, place)).over(whole)
    return numbered.withColumn("next_after", F.when(F.max("_n").over(whole) > limit, cursor)).where(F.col("_n") <= limit).drop("_n")


def page_offset(df: DataFrame, *, order: Sequence[str | Column], offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit-1 in order, with ``next_offset`` set while more follow."""
    taken = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = taken.withColumn("_n", F.row_number().over(W.orderBy(*order)))
    more = F.max("_n").over(W.partitionBy()) > limit
    cursor = F.when(more, F.lit(offset + limit)).cast("long")
    return numbered.withColumn("next_offset", cursor).where(F.col("_n") <= limit).drop("_n")


def top(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def matching(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring search over several columns; blank text matches all."""
    needle = text.strip().lower()
    if not needle:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle)), F.lit(False))
    return df.where(hit)


def in_box(df: DataFrame, west: float, south: float, east: float, north: float, *, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    if not (-180 <= west <= east <= 180 and -90 <= south <= north <= 90):
        raise ValueError("box must be west <= east and south <= north within the globe")
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))
