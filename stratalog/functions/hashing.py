"""Ids and content digests, computed in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import fixed
from stratalog.functions.text import _c

FAN_OUT = 4096


def name_uuid(name: str | Column, namespace: str = fixed.URL_NAMESPACE) -> Column:
    """Version-5 UUID of a name: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(_c(name), "UTF-8")))
    part = lambda start, n: F.substring(h, start, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12)
    )


def stable_id(prefix: str, *parts: str | Column) -> Column:
    """Deterministic id of ``prefix:part:part...``; the prefix keeps id spaces apart."""
    return name_uuid(F.concat(F.lit(f"{prefix}:"), F.concat_ws(":", *[_c(p).cast("string") for p in parts])))


def canonical(*columns: str | Column) -> Column:
    """Text of a row in which values, types of null and column borders cannot be confused."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def ordered_digest(df: DataFrame, by: Sequence[str], position: str, columns: Sequence[str]) -> DataFrame:
    """``by``, ``n`` and ``digest``: SHA-256 over the rows of each group in order of ``position``.

    ``position`` is a dense row number that is unique within a group. Rows are
    hashed in blocks of FAN_OUT, block hashes in blocks again, and so on, so no
    task ever holds more than FAN_OUT entries of one group at a time.
    """
    by = list(by)
    row_hash = F.sha2(canonical(*columns), 256)
    level = df.select(*by, F.col(position).cast("long").alias("_p"), row_hash.alias("_h"), F.lit(1).alias("_n"))
    for _ in range(3):
        level = level.groupBy(*by, F.floor(F.col("_p") / FAN_OUT).alias("_b")).agg(*_combined())
        level = level.withColumnRenamed("_b", "_p")
    return level.groupBy(*by).agg(*_combined()).select(*by, F.col("_n").alias("n"), F.col("_h").alias("digest"))


def _combined() -> list[Column]:
    entries = F.array_sort(F.collect_list(F.struct("_p", "_h")))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["_p"], e["_h"])), "\n")
    return [F.sum("_n").cast("long").alias("_n"), F.sha2(text, 256).alias("_h")]


def fingerprint(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive content fingerprint: count and two independent sums of row hashes."""
    columns = list(columns or [c for c in df.columns if c not in by])
    hashed = df.select(*by, F.md5(canonical(*columns)).alias("_h"))
    piece = lambda start: F.conv(F.substring("_h", start, 8), 16, 10).cast("decimal(20,0)")
    return hashed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(piece(1)).alias("sum_head"), F.sum(piece(9)).alias("sum_tail")
    )
