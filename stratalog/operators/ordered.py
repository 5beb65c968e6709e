"""Ordered computations per key that never put a whole key into one task.

``ordered_scan`` is the one place where row numbers, neighbours and running
aggregates are made. It picks between three ways:

* plain window, when there is a key and a count shows that the largest fits one task;
* blocks given by the caller (``block=``): a column that grows with the order
  and bounds the rows per (key, block), such as ``sample_no div 65536`` on an
  axis where sample numbers are unique;
* range blocks: the rows are range-partitioned on (key, order), written once,
  and each partition is a block.

With blocks, each block is scanned on its own, a summary row per block is
combined over the blocks of its key, and the carried value is joined back.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.session import group_rows, group_sizes, settle

BLOCK = "_block"
AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def number() -> tuple:
    """1-based position."""
    return ("number",)


def lag(value: str | Column) -> tuple:
    return ("lag", value)


def lead(value: str | Column) -> tuple:
    return ("lead", value)


def upto(aggregate: str, value: str | Column) -> tuple:
    """Aggregate over the rows up to and including this one."""
    return ("upto", aggregate, value)


def before(aggregate: str, value: str | Column) -> tuple:
    """Aggregate over the rows strictly before this one."""
    return ("before", aggregate, value)


def onward(aggregate: str, value: str | Column) -> tuple:
    """Aggregate over this row and the rows after it."""
    return ("onward", aggregate, value)


def last_known(value: str | Column) -> tuple:
    """Latest non-null value up to and including this row."""
    return ("last_known", value)


def ordered_scan(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    outputs: Mapping[str, tuple],
    *,
    block: Column | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add one column per output, computed per ``key`` in ascending ``order``.

    (key, order) should identify a row; where it does not, the order among
    equal rows is undefined, as in any window. ``sizes`` passes on a
    (largest key, all rows) count that the caller already has.
    """
    key, order = list(key), list(order)
    values = {
        name: F.col(spec[-1]) if isinstance(spec[-1], str) else spec[-1]
        for name, spec in outputs.items()
        if spec[0] != "number"
    }
    df = df.withColumns({f"_v_{name}": column for name, column in values.items()})
    scratch_columns = [f"_v_{name}" for name in values]
    if block is not None:
        result = _by_block(df.withColumn(BLOCK, block), key, order, outputs)
    else:
        limit = group_rows(df.sparkSession)
        largest, total = sizes or ((df.count(),) * 2 if not key else group_sizes(df, key))
        # without a key a plain window would put the table into one task
        if key and largest <= limit:
            window = W.partitionBy(*key).orderBy(*order)
            result = df.withColumns({n: _inside(n, s, window) for n, s in outputs.items()})
        else:
            shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
            parts = max(shuffle, math.ceil(total / limit), 2)
            ranged = df.repartitionByRange(parts, *key, *order)
            ranged = settle(ranged.withColumn(BLOCK, F.spark_partition_id()))
            result = _by_block(ranged, key, order, outputs)
    return result.drop(*scratch_columns, BLOCK)


def _inside(name: str, spec: tuple, window) -> Column:
    kind, value = spec[0], F.col(f"_v_{name}") if spec[0] != "number" else None
    if kind == "number":
        return F.row_number().over(window).cast("long")
    if kind == "lag":
        return F.lag(value).over(window)
    if kind == "lead":
        return F.lead(value).over(window)
    if kind == "last_known":
        frame = window.rowsBetween(W.unboundedPreceding, 0)
        return F.last(value, ignorenulls=True).over(frame)
    bounds = {
        "upto": (W.unboundedPreceding, 0),
        "before": (W.unboundedPreceding, -1),
        "onward": (0, W.unboundedFollowing),
    }[kind]
    return AGGREGATES[spec[1]](value).over(window.rowsBetween(*bounds))


def _merge(aggregate: str, here: Column, carried: Column) -> Column:
    if aggregate in ("sum", "count"):
        total = F.coalesce(here, carried) + F.when(here.isNotNull(), F.coalesce(carried, here - here)).otherwise(
            carried - carried
        )
        return total
    pick = F.greatest if aggregate == "max" else F.least
    return pick(here, carried)


def _by_block(df: DataFrame, key: list[str], order: list[str], outputs: Mapping[str, tuple]) -> DataFrame:
    within = W.partitionBy(*key, BLOCK).orderBy(*order)
    df = df.withColumns({name: _inside(name, spec, within) for name, spec in outputs.items()})
    place = F.struct(*order)

    summaries, carries = {}, {}
    across = W.partitionBy(*key).orderBy(BLOCK)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    later = across.rowsBetween(1, W.unboundedFollowing)
    for name, spec in outputs.items():
        kind, s, c = spec[0], f"_s_{name}", f"_c_{name}"
        value = F.col(f"_v_{name}") if kind != "number" else None
        if kind == "number":
            summaries[s] = F.count(F.lit(1))
            carries[c] = F.coalesce(F.sum(s).over(earlier), F.lit(0))
        elif kind == "lag":
            summaries[s] = F.max_by(F.struct(value.alias("v")), place)
            carries[c] = F.lag(s).over(across)["v"]
        elif kind == "lead":
            summaries[s] = F.min_by(F.struct(value.alias("v")), place)
            carries[c] = F.lead(s).over(across)["v"]
        elif kind == "last_known":
            summaries[s] = F.max_by(value, F.when(value.isNotNull(), place))
            carries[c] = F.last(s, ignorenulls=True).over(earlier)
        else:
            frame = later if kind == "onward" else earlier
            summaries[s] = AGGREGATES[spec[1]](value)
            combine = F.sum if spec[1] in ("sum", "count") else AGGREGATES[spec[1]]
            carries[c] = combine(s).over(frame)

    summary = df.groupBy(*key, BLOCK).agg(*[column.alias(n) for n, column in summaries.items()])
    carried = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in key],
        F.col(BLOCK).alias("_k_block"),
        *[column.alias(n) for n, column in carries.items()],
    )
    match = F.col(BLOCK) == F.col("_k_block")
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = df.join(carried, match, "left")

    edge = {}
    if any(spec[0] == "lag" for spec in outputs.values()):
        edge["_first"] = F.row_number().over(within) == 1
    if any(spec[0] == "lead" for spec in outputs.values()):
        edge["_last"] = F.lead(F.lit(1)).over(within).isNull()
    joined = joined.withColumns(edge) if edge else joined
    final = {}
    for name, spec in outputs.items():
        kind, here, carry = spec[0], F.col(name), F.col(f"_c_{name}")
        if kind == "number":
            final[name] = here + carry
        elif kind == "lag":
            final[name] = F.when(F.col("_first"), carry).otherwise(here)
        elif kind == "lead":
            final[name] = F.when(F.col("_last"), carry).otherwise(here)
        elif kind == "last_known":
            final[name] = F.coalesce(here, carry)
        else:
            final[name] = _merge(spec[1], here, carry)
    drop = [f"_k_{k}" for k in key] + ["_k_block", *carries, *edge]
    return joined.withColumns(final).drop(*drop)


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` first rows of each key under ``order``, exact for any key size.

    For a small ``k`` Spark cuts every partition down to k rows per key before
    the shuffle (WindowGroupLimit). Beyond its threshold the cut is made over
    salted keys first.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(1024))
        salted = W.partitionBy(*key, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k).drop("_salt", "_r")
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
