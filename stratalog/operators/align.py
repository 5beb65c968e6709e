"""Logs against the sample axis: axis election, alignment with multiplicity, duplicate collapse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.hashing import ordered_digest
from stratalog.functions.numbers import decimal_close, finite, same_float32
from stratalog.functions.text import column_label
from stratalog.operators.intervals import covering
from stratalog.operators.ordered import number, ordered_scan


def occurrences(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "occurrence", block: Column | None = None) -> DataFrame:
    """k for the k-th row with the same key, in order."""
    return ordered_scan(df, key, order, {name: number()}, block=block)


def align_to_axis(
    log: DataFrame, axis: DataFrame, *, on: Sequence[str], log_order: Sequence[str], axis_order: Sequence[str], log_key: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(aligned, unmatched): the k-th log row of a repeated position meets the k-th axis row of it.

    Positions repeat, so the occurrence number is part of the join key; the
    join is then one-to-one and cannot fan out.
    """
    left = occurrences(log, [*log_key, *on], log_order)
    right = occurrences(axis, on, axis_order)
    return left.join(right, [*on, "occurrence"]), left.join(right, [*on, "occurrence"], "left_anti")


def axis_digests(rows: DataFrame, *, log: Sequence[str], source_row: str = "source_row", start: str = "start", end: str = "end") -> DataFrame:
    """Row count and ordered digest of the depth texts of every log."""
    return ordered_digest(rows, log, source_row, [start, end])


def elect_axis(digests: DataFrame, *, hole: Sequence[str], log: str) -> DataFrame:
    """Per hole the most common (row count, digest), more rows on a tie, with its lexically first log."""
    votes = digests.where(F.col("n") > 0).groupBy(*hole, "n", "digest").agg(F.count(F.lit(1)).alias("votes"), F.min(log).alias(log))
    best = F.max_by(F.struct("n", "digest", "votes", log), F.struct("votes", "n", "digest"))
    return votes.groupBy(*hole).agg(best.alias("b")).select(*hole, "b.*")


def collapse_duplicates(logs: DataFrame, *, key: Sequence[str], content: str, name: str, position: str, filled: str) -> DataFrame:
    """One row per distinct content, empty ones dropped, repeated names suffixed " (k)" in source order.

    Copies are folded with min-by, so a group of copies costs one partial row
    per partition.
    """
    key = list(key)
    first = F.min_by(F.struct(F.col(name).alias("n"), F.col(filled).alias("f")), F.col(position))
    folded = logs.groupBy(*key, content).agg(
        first.alias("_r"), F.min(position).alias(position), (F.count(F.lit(1)) - 1).alias("duplicates")
    )
    kept = folded.where(F.col("_r.f") > 0).withColumn("_label", column_label("_r.n"))
    kept = kept.withColumn("_fold", F.lower("_label"))
    totals = kept.groupBy(*key, "_fold").agg(F.count(F.lit(1)).alias("_total"))
    numbered = ordered_scan(kept, [*key, "_fold"], [position], {"_k": number()})
    joined = numbered.join(totals, [*key, "_fold"])
    label = F.when(F.col("_total") == 1, F.col("_label")).otherwise(F.concat("_label", F.lit(" ("), F.col("_k").cast("string"), F.lit(")")))
    return joined.select(*key, content, position, label.alias("column_name"), "duplicates")


def axis_positions(axis: DataFrame, trays: DataFrame, sections: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Samples with tray and section ordinal and their 1-based positions within both."""
    interval = lambda df, p: df.select(
        *key, F.col("ordinal").alias(f"{p}_ordinal"), F.col("sample_no_from").alias(f"_{p}f"), F.col("sample_no_to").alias(f"_{p}t")
    )
    placed = covering(axis, interval(trays, "tray"), key=key, at="sample_no", lo="_trayf", hi="_trayt")
    placed = covering(placed, interval(sections, "section"), key=key, at="sample_no", lo="_sectionf", hi="_sectiont")
    return placed.withColumns(
        {
            "tray_sample_no": F.col("sample_no") - F.col("_trayf") + 1,
            "section_sample_no": F.col("sample_no") - F.col("_sectionf") + 1,
        }
    ).drop("_trayf", "_trayt", "_sectionf", "_sectiont")


def tray_local_sections(sections: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """1-based number of each section within its tray."""
    return ordered_scan(sections, [*key, "tray_ordinal"], ["ordinal"], {"section_in_tray": number()})


def log_off_axis(log: DataFrame, axis: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Log rows whose position is not on the axis at all."""
    return log.join(axis.select(*on).distinct(), list(on), "left_anti")


def vector_disagreements(digests: DataFrame, *, hole: Sequence[str]) -> DataFrame:
    """Holes whose dense logs do not share one depth vector."""
    counts = digests.groupBy(*hole).agg(F.count_distinct("digest").alias("vectors"), F.count_distinct("n").alias("lengths"))
    return counts.where((F.col("vectors") > 1) | (F.col("lengths") > 1))


def position_log_check(values: DataFrame, positions: DataFrame, *, key: Sequence[str], log: str, value: str, expected: str, nulls_allowed: bool = False) -> DataFrame:
    """Per log: samples compared, mismatches and nulls against the computed position.

    A log passes when ``mismatches`` is 0 and, unless nulls are allowed, ``nulls`` is 0.
    """
    joined = values.join(positions.select(*key, "sample_no", F.col(expected).alias("_e")), [*key, "sample_no"], "full")
    number_ = finite(value)
    # infinity is not a missing value: it can never agree
    token = F.col(value).cast("string")
    missing = token.isNull() | token.isin("", "null", "NaN")
    result = joined.groupBy(*key, log).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(missing).alias("nulls"),
        F.count_if(~missing & ~F.coalesce(number_ == F.col("_e"), F.lit(False))).alias("mismatches"),
    )
    ok = (F.col("mismatches") == 0) & (F.col("nulls") < F.col("samples"))
    return result.withColumn("passed", ok if nulls_allowed else ok & (F.col("nulls") == 0))


def minima_check(minima: DataFrame, reference: DataFrame, *, key: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """Profile minima against a reference log: passed within tolerance, or equal at float32 where only text precision differs."""
    joined = minima.join(reference, [*key, "sample_no"], "full")
    both = F.col("positive_min").isNotNull() & F.col("value").isNotNull()
    gap = F.abs(F.col("positive_min") - F.col("value"))
    result = joined.groupBy(*key).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(both).alias("compared"), F.max(gap).alias("max_difference"),
        F.count_if(F.col("positive_min").isNull()).alias("missing_profile"),
        F.count_if(both & ~(gap <= tolerance)).alias("beyond"),
        F.count_if(both & ~same_float32("positive_min", "value")).alias("float32_different"),
    )
    usable = (F.col("compared") > 0) & (F.col("missing_profile") == 0)
    return result.withColumns(
        {"passed": usable & (F.col("beyond") == 0), "same_at_float32": usable & (F.col("float32_different") == 0)}
    )


def image_depth_check(images: DataFrame, trays: DataFrame, *, key: Sequence[str], allow_float32: bool = False) -> DataFrame:
    """Image frames against their tray by ordinal: matched, basis or the reason why not."""
    joined = images.join(
        trays.select(*key, "ordinal", F.col("depth_from_m").alias("_tf"), F.col("depth_to_m").alias("_tt")), [*key, "ordinal"], "full"
    )
    close = decimal_close("depth_from_m", "_tf") & decimal_close("depth_to_m", "_tt")
    bits = same_float32("depth_from_m", "_tf") & same_float32("depth_to_m", "_tt") & F.lit(allow_float32)
    basis = (
        F.when(F.col("_tf").isNull(), "no tray with this ordinal")
        .when(F.col("depth_from_m").isNull(), "no image for this tray")
        .when(close, "decimal")
        .when(bits, "float32")
        .otherwise("depth bounds differ")
    )
    return joined.select(*key, "ordinal", basis.alias("basis"), basis.isin("decimal", "float32").alias("matched"))


def duplicate_alias_check(logs: DataFrame, *, key: Sequence[str], name: str, digest: str) -> DataFrame:
    """Same-named logs: copies and whether their content is identical."""
    counted = logs.groupBy(*key, name).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(digest).alias("contents"), F.count_if(F.col(digest).isNull()).alias("unhashed"))
    return counted.where("copies > 1").withColumn("identical", (F.col("contents") == 1) & (F.col("unhashed") == 0))


def sequence_signatures(images: DataFrame, *, key: Sequence[str], ordinal: str, columns: Sequence[str]) -> DataFrame:
    """Digest of an image log's whole ordered sequence, for comparing duplicate logs."""
    return ordered_digest(images, key, ordinal, [ordinal, *columns])


def typed_values(rows: DataFrame, *, interval: bool, numeric: bool) -> DataFrame:
    """Canonical scalar rows from source rows (source_row, start, end, token): raw token kept, blanks as null."""
    token = F.col("token")
    missing = token.isNull() | token.isin("", "null")
    none = F.lit(None)
    return rows.select(
        *[c for c in rows.columns if c not in {"start", "end", "token"}],
        (none if interval else F.col("source_row")).cast("long").alias("sample_no"),
        (none if interval else F.col("start")).cast("double").alias("depth_m"),
        (F.col("start") if interval else none).cast("long").alias("sample_no_from"),
        (F.col("end") if interval else none).cast("long").alias("sample_no_to"),
        F.when(~missing & F.lit(numeric), token.try_cast("double")).alias("value_numeric"),
        F.when(~missing & F.lit(not numeric), token).alias("value_text"),
        token.alias("value_raw"),
    )
