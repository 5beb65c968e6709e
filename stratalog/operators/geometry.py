"""Hole traces, trace segments and depth tables of core photographs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.geo import great_circle_km, offset_at, position_at, trace_depths
from stratalog.functions import fixed
from stratalog.operators.intervals import HALF_OPEN, fill_gaps, first_cover
from stratalog.operators.ordered import before, number, ordered_scan, upto
from stratalog.session import group_rows, group_sizes, settle_table


def trace_points(holes: DataFrame, *, hole: str = "hole_id", length: str = "drawn_length_m", step: float = 5.0) -> DataFrame:
    """Points every ``step`` metres down each hole and always its bottom, as offsets from the collar."""
    points = holes.select(hole, "inclination_deg", "azimuth_deg", F.posexplode_outer(trace_depths(length, step)).alias("point", "_d"))
    points = points.where("_d is not null")
    at = offset_at("_d", "inclination_deg", "azimuth_deg")
    return points.withColumn("_o", at).select(
        hole, "point", F.bround("_d", 2).alias("depth_m"),
        *[F.bround(F.col(f"_o.{c}"), 3).alias(c) for c in ("east_m", "north_m", "tvd_m")],
    )


def trace_with_calls(points: DataFrame, measurements: DataFrame, *, hole: str = "hole_id") -> DataFrame:
    """Trace points with the first measurement that covers their depth; neutral values where none does."""
    m = measurements.select(
        hole, F.col("depth_from_m").alias("_f"), F.col("depth_to_m").alias("_t"), "mineral", "confidence", "anomaly_score", "is_anomaly"
    )
    found = first_cover(points, m, point_key=[hole, "point"], key=[hole], at="depth_m", lo="_f", hi="_t", pick=["_f", "_t"], bounds=HALF_OPEN)
    return found.select(
        *points.columns,
        F.coalesce("mineral", F.lit("")).alias("mineral"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
    )


def trace_segments(holes: DataFrame, runs: DataFrame, *, hole: str = "hole_id", label: str = "call", stretch: float = 1.0, block: Column | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Runs and unlogged gaps down each hole with both end points in space.

    Holes without length, dip or azimuth have nothing to draw and are left out.
    """
    drawn = holes.where("drawn_length_m > 0 and inclination_deg is not null and azimuth_deg is not null")
    filled = fill_gaps(
        runs.select(hole, "from_m", "to_m", label), drawn, key=[hole], lo="from_m", hi="to_m", length="drawn_length_m", block=block, sizes=sizes
    )
    where = ["latitude", "longitude", "elevation_m", "inclination_deg", "azimuth_deg"]
    joined = filled.join(drawn.select(hole, *where), hole)
    end = lambda d: position_at(d, *where, stretch)
    kind = F.when(~F.col("logged"), "not logged").when(F.col(label).isNull(), "uncertain reading").otherwise(F.col(label))
    return joined.select(hole, "from_m", "to_m", "logged", kind.alias("label"), end("from_m").alias("start"), end("to_m").alias("end"))


def row_depths(rows: DataFrame, *, tray: Sequence[str], order: str, length: str) -> DataFrame:
    """Depth range of each image row: its share, by length, of the tray's depth range.

    ``rows`` carries the tray's depth_from and depth_to.
    """
    total = rows.groupBy(*tray).agg(F.sum(length).alias("_total"))
    reached = ordered_scan(rows, tray, [order], {"_upto": upto("sum", length)}).join(total, list(tray))
    span = F.col("depth_to") - F.col("depth_from")
    whole = F.greatest(F.col("_total"), F.lit(1))
    start = F.col("depth_from") + span * ((F.col("_upto") - F.col(length)) / whole)
    return reached.withColumns(
        {"depth_from_m": F.bround(start, 4), "depth_to_m": F.bround(F.col("depth_from") + span * (F.col("_upto") / whole), 4)}
    ).drop("_upto", "_total")


def pack_sheets(rows: DataFrame, *, hole: Sequence[str], order: Sequence[str], height: str, limit: int) -> DataFrame:
    """Rows with ``sheet_index``, ``y_from_px`` and ``y_to_px``: stacked in order, a new sheet when the next row would not fit.

    Where a sheet ends depends on all rows before it. Holes that fit one task
    (counted) are packed there; otherwise every row points at the row that would
    start the following sheet, and the starts are found by pointer doubling.
    """
    hole, order = list(hole), list(order)
    largest, _ = group_sizes(rows, hole)
    pack = _pack_small if largest <= group_rows(rows.sparkSession) else _pack_large
    return pack(rows, hole, order, height, limit)


def _pack_small(rows: DataFrame, hole: list[str], order: list[str], height: str, limit: int) -> DataFrame:
    """Holes side by side in sorted partitions; only the open sheet is carried from batch to batch."""
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("sheet_index", T.IntegerType()), T.StructField("y_from_px", T.LongType()), T.StructField("y_to_px", T.LongType())]
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sheet, filled = None, 0, 0
        for batch in batches:
            sheets, tops = [], []
            for key, h in zip(zip(*[batch[c] for c in hole]), batch[height]):
                if key != current:
                    current, sheet, filled = key, 0, 0
                elif filled + h > limit:
                    sheet, filled = sheet + 1, 0
                sheets.append(sheet)
                tops.append(filled)
                filled += h
            yield batch.assign(sheet_index=sheets, y_from_px=tops, y_to_px=[t + h for t, h in zip(tops, batch[height])])

    return rows.repartition(*hole).sortWithinPartitions(*hole, *order).mapInPandas(pack, schema)


def _pack_large(rows: DataFrame, hole: list[str], order: list[str], height: str, limit: int) -> DataFrame:
    placed = ordered_scan(rows, hole, order, {"_no": number(), "_end": upto("sum", height)})
    placed = settle_table(placed.withColumn("_begin", F.col("_end") - F.col(height)), "sheet-rows")
    # a sheet that starts at row i ends before the first row whose end exceeds begin(i) + limit
    marks = placed.select(*hole, (F.col("_begin") + limit).alias("_at"), F.lit(1).alias("_ask"), F.col("_no").alias("_i"), F.lit(0).alias("_c"))
    ends = placed.select(*hole, F.col("_end").alias("_at"), F.lit(0).alias("_ask"), F.col("_no").alias("_i"), F.lit(1).alias("_c"))
    counted = ordered_scan(ends.unionByName(marks), hole, ["_at", "_ask", "_i"], {"_n": upto("sum", "_c")}).where("_ask = 1")
    jump = counted.select(*hole, F.col("_i").alias("_no"), F.greatest(F.col("_n") + 1, F.col("_i") + 1).alias("_next"))
    jump = settle_table(jump, "sheet-jumps")
    starts = placed.where("_no = 1").select(*hole, "_no")
    largest, total = group_sizes(placed, hole)
    for _ in range(math.ceil(math.log2(largest + 1)) + 1):
        onward = starts.join(jump, [*hole, "_no"]).select(*hole, F.col("_next").alias("_no"))
        grown = settle_table(starts.unionByName(onward).distinct(), "sheet-starts")
        if grown.count() == starts.count():
            break
        starts = grown
        step = jump.select(*hole, F.col("_no").alias("_next"), F.col("_next").alias("_far"))
        jump = settle_table(
            jump.join(step, [*hole, "_next"], "left").select(*hole, "_no", F.coalesce("_far", "_next").alias("_next")), "sheet-jumps"
        )
    marked = placed.join(starts.withColumn("_start", F.lit(1)), [*hole, "_no"], "left")
    sheets = ordered_scan(
        marked, hole, ["_no"],
        {"_sheet": upto("sum", F.coalesce("_start", F.lit(0))), "_base": upto("max", F.when(F.col("_start") == 1, F.col("_begin")))},
        sizes=(largest, total),
    )
    return sheets.select(
        *rows.columns, (F.col("_sheet") - 1).cast("int").alias("sheet_index"),
        (F.col("_begin") - F.col("_base")).cast("long").alias("y_from_px"), (F.col("_end") - F.col("_base")).cast("long").alias("y_to_px"),
    )


def photo_provenance(holes: DataFrame, sources: DataFrame, *, hole: str = "hole_id", km: float = fixed.SAME_HOLE_KM) -> DataFrame:
    """Per source dataset of a photo strip whether it belongs to the hole: same name, or a collar close by."""
    joined = sources.join(holes.select(hole, "latitude", "longitude"), hole)
    gap = great_circle_km("collar_lat", "collar_lon", "latitude", "longitude", fixed.EARTH_RADIUS_KM_ROUND)
    verdict = (
        F.when(F.col("dataset_name") == F.col(hole), "named")
        .when(F.col("collar_lat").isNull() | F.col("collar_lon").isNull(), "no collar")
        .when(gap > km, "elsewhere")
        .otherwise("near")
    )
    return joined.select(hole, "dataset_name", gap.alias("distance_km"), verdict.alias("verdict")).withColumn(
        "belongs", F.col("verdict").isin("named", "near")
    )


def core_strip(sections: DataFrame, mappings: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Section depths with the image region that shows the section's first sample, and which way depth runs on it."""
    images = mappings.where("status = 'available'").select(
        *key, F.col("sample_no_from").alias("_f"), F.col("sample_no_to").alias("_t"), "image_region_id", "width_px", "height_px", "source_depth_direction"
    )
    found = first_cover(
        sections, images, point_key=[*key, "ordinal"], key=key, at="sample_no_from", lo="_f", hi="_t", pick=["_f", "image_region_id"], bounds="closed"
    ).where("image_region_id is not null")
    flipped = F.coalesce(F.col("source_depth_direction"), F.lit("")).rlike(r"(?i)right.?to.?left|decreas")
    return found.select(*sections.columns, "image_region_id", "width_px", "height_px", flipped.alias("flip"))
