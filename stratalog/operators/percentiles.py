"""Exact, linearly interpolated percentiles per group, for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.
That is fine while groups are small. Beyond the limit the answer is narrowed
first: a mergeable sketch gives a bracket that must hold the wanted order
statistics, the rows below the bracket are only counted, and just the values
inside it are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.ordered import ordered_scan, upto
from stratalog.session import group_rows, group_sizes


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], *, accuracy: int | None = None, largest: int | None = None
) -> DataFrame:
    """``by`` columns, ``n`` and ``q`` (array<double>, one per probability); nulls and NaN are skipped.

    ``largest`` passes on an upper bound of the rows of a group where the caller has one.
    """
    by, probabilities = list(by), [float(p) for p in probabilities]
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    clean = clean.select(*by, F.col(value).cast("double").alias("_x"))
    if largest is None:
        largest, _ = group_sizes(clean, by)
    if largest <= group_rows(df.sparkSession):
        exact = F.percentile("_x", F.array(*[F.lit(p) for p in probabilities]))
        return clean.groupBy(*by).agg(F.count("_x").alias("n"), exact.alias("q"))
    return _bracketed(clean, by, probabilities, accuracy or max(10_000, largest // 200_000))


def exact_medians(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``by`` columns and the median of every value column, nulls skipped; one pass while groups are small."""
    by, values = list(by), list(values)
    largest, _ = group_sizes(df, by)
    if largest <= group_rows(df.sparkSession):
        return df.groupBy(*by).agg(*[F.percentile(F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")), F.lit(0.5)).alias(v) for v in values])
    entries = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values])
    long = df.select(*by, F.explode_outer(entries).alias("_e")).select(*by, "_e.name", "_e.x")
    found = exact_percentiles(long, [*by, "name"], "x", [0.5], largest=largest)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == v, F.col("q")[0])).alias(v) for v in values])


def _bracketed(clean: DataFrame, by: list[str], probabilities: list[float], accuracy: int) -> DataFrame:
    # the sketch is off by at most n / accuracy ranks; four times that leaves room for the
    # rounding of ranks once a group has ``accuracy`` rows, and smaller groups keep all theirs
    step = 4.0 / accuracy
    asked = []
    for p in probabilities:
        asked += [max(p - step, 0.0), min(p + step, 1.0)]
    sketch = clean.groupBy(*by).agg(
        F.count("_x").alias("n"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
        F.percentile_approx("_x", F.array(*[F.lit(a) for a in asked]), F.lit(accuracy)).alias("_b"),
    )
    brackets = []
    for i, p in enumerate(probabilities):
        few = F.col("n") < accuracy
        low = F.col("_min") if p - step <= 0 else F.when(few, F.col("_min")).otherwise(F.get("_b", F.lit(2 * i)))
        high = F.col("_max") if p + step >= 1 else F.when(few, F.col("_max")).otherwise(F.get("_b", F.lit(2 * i + 1)))
        brackets.append(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), low.alias("lo"), high.alias("hi")))
    wanted = sketch.select(*by, "n", F.array(*brackets).alias("_brackets"))

    renamed = [f"_g_{b}" for b in by]
    side = wanted.select(*[F.col(b).alias(r) for b, r in zip(by, renamed)], "n", "_brackets")
    # one row where there are no groups; otherwise the planner knows the bytes
    side = side if by else F.broadcast(side)
    match = F.lit(True)
    for b, r in zip(by, renamed):
        match = match & F.col(b).eqNullSafe(F.col(r))
    rows = (
        clean.join(side, match)
        .select(*by, "n", "_x", F.explode("_brackets").alias("_w"))
        .where(F.col("_x") <= F.col("_w.hi"))
        # everything under the bracket becomes one counted row per group
        .select(
            *by, "n", F.col("_w.i").alias("_i"), F.col("_w.p").alias("_p"),
            F.when(F.col("_x") >= F.col("_w.lo"), F.col("_x")).alias("_x"),
        )
        .groupBy(*by, "n", "_i", "_p", "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = ordered_scan(rows, [*by, "_i"], ["_x"], {"_cum": upto("sum", "_c")})
    place = (F.col("n") - 1) * F.col("_p")
    lower, upper = F.floor(place), F.ceil(place)
    holds = lambda r: (F.col("_cum") > r) & (F.col("_cum") - F.col("_c") <= r)
    picked = ranked.groupBy(*by, "n", "_i", "_p").agg(
        F.max(F.when(holds(lower), F.col("_x"))).alias("_lo"),
        F.max(F.when(holds(upper), F.col("_x"))).alias("_hi"),
    )
    frac = (F.col("n") - 1) * F.col("_p") - F.floor((F.col("n") - 1) * F.col("_p"))
    valued = picked.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac)
    # one entry per probability: the array is as long as the caller's list
    q = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"])
    return valued.groupBy(*by, "n").agg(q.alias("q"))
