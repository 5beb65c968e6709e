"""Descriptive profiles of logs and per-hole aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.numbers import _is_finite, positive_minimum, strictly_increasing
from stratalog.operators.ordered import lag, number, ordered_scan


def scalar_profile(
    rows: DataFrame, *, log: Sequence[str], source_row: str = "source_row", start: str = "start", end: str = "end",
    token: str = "token", numeric: Column | None = None, block: Column | None = None,
) -> DataFrame:
    """One row per log: counts by kind of value, coordinate range, decreases and equal neighbours in depth."""
    text = F.col(token).cast("string")
    null = text.isNull() | text.isin("", "null")
    value = text.try_cast("double")
    is_number = F.lit(True) if numeric is None else numeric
    seen = ordered_scan(rows, log, [source_row], {"_before": lag(start)}, block=block)
    present = ~null & is_number
    good = present & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return seen.groupBy(*log).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(null).alias("null_count"),
        F.count_if(present & ~good).alias("non_finite_count"),
        F.count_if(F.col(start) == F.col(end)).alias("point_count"),
        F.min(start).alias("coordinate_min"),
        F.max(end).alias("coordinate_max"),
        F.count_if(F.col(start) < F.col("_before")).alias("decreasing_start_count"),
        F.count_if(F.col(start) == F.col("_before")).alias("adjacent_equal_start_count"),
        F.min(F.when(good, value)).alias("value_min"),
        F.max(F.when(good, value)).alias("value_max"),
    )


def category_counts(rows: DataFrame, *, log: Sequence[str], token: str = "token") -> DataFrame:
    text = F.col(token).cast("string")
    return rows.where(text.isNotNull() & ~text.isin("", "null")).groupBy(*log, token).agg(F.count(F.lit(1)).alias("n"))


def depth_resets(rows: DataFrame, *, log: Sequence[str], order: str, depth: str, block: Column | None = None) -> DataFrame:
    """Rows whose depth is below the previous row's, with the previous depth."""
    seen = ordered_scan(rows, log, [order], {"previous_depth": lag(depth)}, block=block)
    return seen.where(F.col(depth) < F.col("previous_depth"))


def spectrum_profile(spectra: DataFrame, *, by: Sequence[str], values: str) -> DataFrame:
    """Value range and counts of odd channels over all spectra of a group; arrays are reduced before the shuffle."""
    v = F.col(values)
    finite_ = F.filter(v, _is_finite)
    per_row = spectra.select(
        *by,
        F.size(v).alias("channels"),
        F.array_min(finite_).cast("double").alias("lo"),
        F.array_max(finite_).cast("double").alias("hi"),
        (F.size(v) - F.size(finite_)).alias("odd"),
        F.size(F.filter(finite_, lambda x: x < 0)).alias("below"),
        F.size(F.filter(finite_, lambda x: x > 1)).alias("above"),
    )
    return per_row.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"), F.min("channels").alias("channels_min"), F.max("channels").alias("channels_max"),
        F.min("lo").alias("value_min"), F.max("hi").alias("value_max"), F.sum("odd").alias("non_finite_count"),
        F.sum("below").alias("below_zero"), F.sum("above").alias("above_one"),
    )


def wavelength_check(streams: DataFrame, *, wavelengths: str, count: str) -> DataFrame:
    """Streams whose wavelength axis is not finite and strictly increasing, or has the wrong length."""
    ok = strictly_increasing(wavelengths) & (F.size(wavelengths) == F.col(count))
    return streams.where(~F.coalesce(ok, F.lit(False)))


def profile_statistics(profiles: DataFrame, *, by: Sequence[str], values: str = "values") -> DataFrame:
    """Channel counts, zeros, value range and sample-number errors of profile logs."""
    v = F.col(values)
    return profiles.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(F.size(v)).alias("channels_min"),
        F.max(F.size(v)).alias("channels_max"),
        F.sum(F.size(F.filter(v, lambda x: x == 0))).alias("zero_count"),
        F.sum(F.size(F.filter(v, lambda x: ~_is_finite(x)))).alias("non_finite_count"),
        F.min(F.array_min(v)).alias("value_min"),
        F.max(F.array_max(v)).alias("value_max"),
    )


def positive_minima(profiles: DataFrame, *, keep: Sequence[str], values: str = "values") -> DataFrame:
    return profiles.select(*keep, positive_minimum(values).alias("positive_min"))


def channel_histogram(profiles: DataFrame, *, by: Sequence[str], values: str = "values") -> DataFrame:
    return profiles.groupBy(*by, F.size(values).alias("channels")).agg(F.count(F.lit(1)).alias("n"))


def logged_holes(holes: DataFrame, measurements: DataFrame, *, hole: str = "hole_id") -> DataFrame:
    """Holes with logged range, drawn length, measurement and anomaly counts; aggregated before the join."""
    per_hole = measurements.groupBy(hole).agg(
        F.min("depth_from_m").alias("logged_from_m"), F.max("depth_to_m").alias("logged_to_m"),
        F.count(F.lit(1)).alias("measurement_count"), F.count_if("is_anomaly").alias("anomaly_count"),
    )
    joined = holes.join(per_hole, hole, "left")
    return joined.withColumns(
        {
            "measurement_count": F.coalesce("measurement_count", F.lit(0)),
            "anomaly_count": F.coalesce("anomaly_count", F.lit(0)),
            "drawn_length_m": F.greatest("borehole_length_m", "logged_to_m"),
        }
    )


def dashboard(holes: DataFrame, measurements: DataFrame) -> DataFrame:
    """One row: holes, measurements, anomalies, low-confidence intervals."""
    h = holes.agg(F.count(F.lit(1)).alias("holes"))
    m = measurements.agg(
        F.count(F.lit(1)).alias("measurements"), F.count_if("is_anomaly").alias("anomalies"),
        F.count_if(F.col("confidence") < 0.5).alias("low_confidence"),
    )
    # one row on either side, by construction
    return h.join(F.broadcast(m), F.lit(True))


def distinct_labels(measurements: DataFrame, *, hole: str, label: str) -> DataFrame:
    """Distinct labels and low-confidence intervals per hole."""
    per_label = measurements.groupBy(hole, label).agg(F.count_if(F.col("confidence") < 0.5).alias("_low"))
    return per_label.groupBy(hole).agg(F.count(label).alias("labels"), F.sum("_low").alias("low_confidence"))


def first_per_key(df: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key, folded map-side."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_f")).select(*key, "_f.*")


def upper_median(df: DataFrame, *, by: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """Element at position floor(n/2) of the sorted values (not interpolated)."""
    present = df.where(F.col(value).isNotNull())
    ranked = ordered_scan(present, by, [value, *tie], {"_k": number()})
    sizes = present.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    place = F.col("_k") - 1 == F.floor(F.col("n") / 2)
    joined = ranked.join(sizes, list(by)) if by else ranked.join(F.broadcast(sizes), F.lit(True))
    return joined.where(place).select(*by, F.col(value).alias("upper_median"), "n")


def core_diameter(rows: DataFrame, *, hole: str = "hole_id") -> DataFrame:
    """Core width in metres from image rows: upper median of metres per pixel times the pixel width."""
    scale = (F.col("depth_to_m") - F.col("depth_from_m")) / F.greatest(F.col("y_to_px") - F.col("y_from_px"), F.lit(1))
    mid = upper_median(rows.withColumn("_s", scale), by=[hole], value="_s", tie=["depth_from_m"])
    width = rows.groupBy(hole).agg(F.max("core_width_px").alias("core_width_px"))
    return mid.join(width, hole).select(hole, (F.col("core_width_px") * F.col("upper_median")).alias("diameter_m"))


def issue_counts(issues: DataFrame, by: Sequence[str] = ("code",)) -> DataFrame:
    return issues.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def batch_totals(holes: DataFrame, columns: Sequence[str]) -> DataFrame:
    return holes.agg(F.count(F.lit(1)).alias("holes"), *[F.sum(c).alias(c) for c in columns])


def hole_summary(
    boreholes: DataFrame, datasets: DataFrame, axis: DataFrame, *, hole: str = "hole_id", counts: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Hole row with dataset names and instruments in source order, sample count, depth range and record counts.

    The joined texts are single cells of the result; they hold the distinct
    names of one hole.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", "dataset_name")))
    named = datasets.groupBy(hole).agg(
        F.count(F.lit(1)).alias("dataset_count"),
        F.array_join(F.filter(F.transform(ordered, lambda d: F.trim(d["dataset_name"])), lambda n: n != ""), "; ").alias("dataset_names"),
    )
    instruments = datasets.where("trim(instrument) <> ''").groupBy(hole, F.trim("instrument").alias("_i")).agg(F.min("position").alias("_p"))
    tools = instruments.groupBy(hole).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_i"))), lambda d: d["_i"]), "; ").alias("instruments")
    )
    extent = axis.groupBy(hole).agg(
        F.count(F.lit(1)).alias("sample_count"), F.min("depth_from_m").alias("depth_from_m"), F.max("depth_to_m").alias("depth_to_m")
    )
    result = boreholes.join(named, hole, "left").join(tools, hole, "left").join(extent, hole)
    for name, table in (counts or {}).items():
        result = result.join(table.groupBy(hole).agg(F.count(F.lit(1)).alias(name)), hole, "left")
        result = result.withColumn(name, F.coalesce(name, F.lit(0)))
    return result


def informative_sample(samples: DataFrame, *, key: Sequence[str], label: str, sample: str = "sample_no") -> DataFrame:
    """Per key the sample with a label closest to the middle of the axis (the later one on a tie), else the middle."""
    extent = samples.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    mid = F.floor(F.col("n") / 2)
    joined = samples.join(extent, list(key)).where(F.col(label).isNotNull())
    best = joined.groupBy(*key).agg(F.min_by(sample, F.struct(F.abs(F.col(sample) - mid), -F.col(sample))).alias("_best"))
    return extent.join(best, list(key), "left").select(*key, F.coalesce("_best", mid).cast("long").alias(sample))


def spread_sample(samples: DataFrame, *, key: Sequence[str], label: str, sample: str = "sample_no") -> DataFrame:
    """First of nine samples spread over the axis that has a label; the middle one of them if none has."""
    extent = samples.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    places = F.array_sort(
        F.array_distinct(F.array(*[F.least((F.col("n") * f).cast("long"), F.col("n") - 1) for f in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)]))
    )
    candidates = extent.withColumn("_c", places)
    middle = F.get("_c", F.floor(F.size("_c") / 2).cast("int"))
    asked = candidates.select(*key, middle.alias("_mid"), F.explode("_c").alias(sample))
    found = asked.join(samples.select(*key, sample, label), [*key, sample], "left")
    return found.groupBy(*key).agg(
        F.coalesce(F.min(F.when(F.col(label).isNotNull(), F.col(sample))), F.max("_mid")).alias(sample)
    )
