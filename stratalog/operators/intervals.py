"""Interval joins, nearest samples, tiling checks and gap filling.

Every interval states its bounds: ``closed`` means both ends belong to it,
``half_open`` that the upper end does not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.arrays import explode_present
from stratalog.operators.ordered import before, lag, lead, number, onward, ordered_scan, upto
from stratalog.session import settle_table

HALF_OPEN, CLOSED = "half_open", "closed"


# shortest bucket, and the factor between neighbouring length classes
SHORTEST, FACTOR = 2.0**-20, 4.0


def _levels(intervals: DataFrame, lo: str, hi: str) -> tuple[Column, list[int]]:
    """Length class of an interval, and the classes that occur (a few dozen at most)."""
    length = F.greatest((F.col(hi) - F.col(lo)).cast("double"), F.lit(SHORTEST))
    level = F.ceil(F.log2(length / SHORTEST) / math.log2(FACTOR) - 1e-9).cast("int")
    present = [r[0] for r in intervals.select(level.alias("l")).distinct().collect() if r[0] is not None]
    return level, sorted(present)


def covering(
    points: DataFrame,
    intervals: DataFrame,
    *,
    key: Sequence[str],
    at: str,
    lo: str,
    hi: str,
    bounds: str = CLOSED,
) -> DataFrame:
    """Points joined to the intervals of the same key that cover them.

    Columns of ``intervals`` other than the key are added, so they must not
    clash with those of ``points``. An interval is registered in the one or two
    buckets of its own length class, so long and short intervals mix without
    blowing up; the join itself is an equi-join on (key, class, bucket), which
    spreads a heavy key over its depth and lets AQE split what is still heavy.
    """
    key = list(key)
    level, present = _levels(intervals, lo, hi)
    # the slack of the class may make a bucket a trifle shorter than its interval: a third bucket then
    size = F.lit(SHORTEST) * F.pow(F.lit(FACTOR), F.col("_lv"))
    present = present or [0]

    bucket = lambda c: F.floor(F.col(c).cast("double") / size)
    right = intervals.withColumn("_lv", level)
    right = right.withColumn("_bk", F.explode(F.sequence(bucket(lo), bucket(hi))))
    right = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in key],
        F.col("_lv").alias("_k_lv"),
        F.col("_bk").alias("_k_bk"),
        *[c for c in intervals.columns if c not in key],
    )
    left = points.withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in present])) if len(present) > 1 else F.lit(present[0]))
    left = left.withColumn("_bk", bucket(at))
    match = (F.col("_lv") == F.col("_k_lv")) & (F.col("_bk") == F.col("_k_bk"))
    for k in key:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    upper = F.col(at) <= F.col(hi) if bounds == CLOSED else F.col(at) < F.col(hi)
    # never broadcast: the size Spark expects of the points leaves out that they are repeated per class
    joined = left.hint("merge").join(right, match & (F.col(at) >= F.col(lo)) & upper)
    return joined.drop("_lv", "_bk", "_k_lv", "_k_bk", *[f"_k_{k}" for k in key])


def first_cover(
    points: DataFrame,
    intervals: DataFrame,
    *,
    point_key: Sequence[str],
    key: Sequence[str],
    at: str,
    lo: str,
    hi: str,
    pick: Sequence[str],
    bounds: str = HALF_OPEN,
) -> DataFrame:
    """One row per point: the covering interval that is first in ``pick`` order, nulls where none covers."""
    added = [c for c in intervals.columns if c not in key]
    found = covering(
        points, intervals, key=key, at=at, lo=lo, hi=hi, bounds=bounds
    ).groupBy(*point_key).agg(F.min_by(F.struct(*added), F.struct(*pick)).alias("_m"))
    renamed = [f"_p_{c}" for c in point_key]
    side = found.select(*[F.col(c).alias(r) for c, r in zip(point_key, renamed)], "_m")
    match = F.lit(True)
    for c, r in zip(point_key, renamed):
        match = match & F.col(c).eqNullSafe(F.col(r))
    return points.join(side, match, "left").select(*points.columns, *[F.col(f"_m.{c}").alias(c) for c in added])


def overlapping(
    left: DataFrame,
    right: DataFrame,
    *,
    key: Sequence[str],
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    bounds: str = HALF_OPEN,
) -> DataFrame:
    """Pairs of overlapping intervals of one key, each pair once.

    Two intervals overlap exactly when one's start lies in the other; splitting
    on which start comes first turns the overlap into two point joins.
    """
    (la, lb), (ra, rb) = left_bounds, right_bounds
    columns = [*left.columns, *[c for c in right.columns if c not in key]]
    first = covering(left, right, key=key, at=la, lo=ra, hi=rb, bounds=bounds)
    second = covering(right, left, key=key, at=ra, lo=la, hi=lb, bounds=bounds)
    return first.select(*columns).unionByName(second.where(F.col(ra) > F.col(la)).select(*columns))


def nearest(
    targets: DataFrame,
    samples: DataFrame,
    *,
    key: Sequence[str],
    at: str,
    sample_at: str,
    sample_id: str,
    target_id: str,
    block: Column | None = None,
) -> DataFrame:
    """Targets with ``sample_id`` and ``distance`` of the nearest sample of the same key.

    Ties go to the lower sample id. Targets and samples are merged in one
    ordered pass: the best sample at or above a target is a running maximum,
    the best one at or below a running minimum from the other end.
    """
    key = list(key)
    place, ident = F.col(sample_at).cast("double"), F.col(sample_id)
    merged = samples.select(
        *key, place.alias("_at"), F.lit(0).alias("_is_target"), ident.cast("long").alias("_sid"), F.lit(None).cast("long").alias("_tid")
    ).unionByName(
        targets.select(
            *key, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_is_target"),
            F.lit(None).cast("long").alias("_sid"), F.col(target_id).cast("long").alias("_tid"),
        )
    )
    below = F.when(F.col("_sid").isNotNull(), F.struct("_at", (-F.col("_sid")).alias("neg")))
    above = F.when(F.col("_sid").isNotNull(), F.struct("_at", F.col("_sid").alias("sid")))
    scanned = ordered_scan(
        merged.where(F.col("_at").isNotNull()),
        key,
        ["_at", "_is_target", "_sid", "_tid"],
        {"_down": upto("max", below), "_up": onward("min", above)},
        block=block,
    ).where(F.col("_is_target") == 1)
    down = F.struct((F.col("_at") - F.col("_down._at")).alias("d"), (-F.col("_down.neg")).alias("s"))
    up = F.struct((F.col("_up._at") - F.col("_at")).alias("d"), F.col("_up.sid").alias("s"))
    best = F.least(F.when(F.col("_down").isNotNull(), down), F.when(F.col("_up").isNotNull(), up))
    found = scanned.select(*key, F.col("_tid").alias(target_id), best["s"].alias(sample_id), best["d"].alias("distance"))
    return targets.join(found, [*key, target_id], "left")


def tiling_violations(
    intervals: DataFrame, *, key: Sequence[str], lo: str, hi: str, extent: DataFrame | None = None, count: str = "n"
) -> DataFrame:
    """Closed integer intervals that do not tile 0..n-1: (key, lo, hi, problem)."""
    key = list(key)
    scanned = ordered_scan(
        intervals.select(*key, F.col(lo).alias("lo"), F.col(hi).alias("hi")),
        key, ["lo", "hi"], {"_prev": lag("hi"), "_next": lead("lo")},
        block=F.floor(F.col("lo") / 65536),
    )
    if extent is not None:
        scanned = scanned.join(extent.select(*key, F.col(count).alias("_n")), key, "left")
    else:
        scanned = scanned.withColumn("_n", F.lit(None).cast("long"))
    expected = F.coalesce(F.col("_prev") + 1, F.lit(0))
    problem = (
        F.when(F.col("hi") < F.col("lo"), "empty")
        .when(F.col("lo") > expected, "gap")
        .when(F.col("lo") < expected, "overlap")
        .when(F.col("_next").isNull() & (F.col("hi") != F.col("_n") - 1), "wrong end")
    )
    return scanned.withColumn("problem", problem).where("problem is not null").select(*key, "lo", "hi", "problem")


def self_overlaps(
    intervals: DataFrame, *, key: Sequence[str], lo: str, hi: str, order: Sequence[str] = (), bounds: str = CLOSED,
    block: Column | None = None,
) -> DataFrame:
    """Intervals that start before an earlier one of the same key has ended; linear, one pass."""
    scanned = ordered_scan(intervals, key, [lo, hi, *order], {"reached": before("max", hi)}, block=block)
    meets = F.col(lo) <= F.col("reached") if bounds == CLOSED else F.col(lo) < F.col("reached")
    return scanned.where(meets)


#: Rectangles of one grid cell that a task compares at once, and comparisons that it makes together.
CELL_ROWS, PAIRS = 4096, 1 << 20


def _cells_of(frame: list[str], boxes: DataFrame) -> tuple[DataFrame, Callable[[Column, str], Column]]:
    """Rows of ``boxes`` once per grid cell (cx, cy) that they touch, with the grid of their frame, and the cell of a position on an axis."""
    spread = lambda at, size: F.greatest(F.avg(size), (F.max(F.col(at) + F.col(size)) - F.min(at)) / F.sqrt(F.count(F.lit(1))), F.lit(1e-9))
    sides = boxes.groupBy(*frame).agg(spread("x", "width").alias("side_x"), spread("y", "height").alias("side_y"), F.min("x").alias("from_x"), F.min("y").alias("from_y"))
    cell = lambda at, axis: F.floor((at - F.col(f"from_{axis}")) / F.col(f"side_{axis}"))
    across = lambda at, size, axis: F.explode(F.sequence(cell(F.col(at), axis), cell(F.col(at) + F.col(size), axis)))
    return boxes.join(sides, frame).withColumn("cx", across("x", "width", "x")).withColumn("cy", across("y", "height", "y")), cell


def rectangle_pairs(regions: DataFrame, *, frame: Sequence[str], ident: str) -> DataFrame:
    """All pairs (frame, ``a`` < ``b``) of rectangles (x, y, width, height) of one frame that meet.

    A pair is made in the one grid cell that holds the corner where its overlap begins,
    so it comes once and nothing is left to be made distinct.
    """
    frame = list(frame)
    boxes = regions.select(*frame, F.col(ident).alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    placed, cell = _cells_of(frame, boxes)
    other = placed.select(*[F.col(c).alias(f"_{c}") for c in [*frame, "cx", "cy", "id", "x", "y", "width", "height"]])
    meet = (F.col("id") < F.col("_id")) & (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy"))
    for c in frame:
        meet = meet & (F.col(c) == F.col(f"_{c}"))
    for at, size, axis in (("x", "width", "cx"), ("y", "height", "cy")):
        meet = meet & (F.col(at) < F.col(f"_{at}") + F.col(f"_{size}")) & (F.col(f"_{at}") < F.col(at) + F.col(size))
        meet = meet & (cell(F.greatest(at, f"_{at}"), at) == F.col(axis))
    # never broadcast: the size Spark expects leaves out that rows are repeated per cell
    return placed.hint("merge").join(other, meet).select(*frame, F.col("id").alias("a"), F.col("_id").alias("b"))


def rectangle_overlaps(regions: DataFrame, *, frame: Sequence[str], ident: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per rectangle (x, y, width, height) that meets others of its frame: ``overlaps`` (how many) and ``witness`` (the smallest of them).

    Equal rectangles are folded to one with a count. The others are dealt to grid cells
    about as large as a rectangle, and not more of them than rectangles; a pair is counted
    in the one cell that holds the corner where it begins. A crowded cell is dealt as pairs
    of blocks. What leaves a task is a count per rectangle, never a pair.
    """
    frame = list(frame)
    boxes = regions.groupBy(*frame, "x", "y", "width", "height").agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("first"), F.max(ident).alias("last"))
    boxes = settle_table(boxes.select(*frame, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")], "n", "first", "last").withColumn("box", F.monotonically_increasing_id()), "rectangles")
    placed, _ = _cells_of(frame, boxes)
    crowds = placed.groupBy(*frame, "cx", "cy").agg(F.count(F.lit(1)).alias("in_cell")).where("in_cell > 1")
    blocks = F.ceil(F.col("in_cell") / cell_rows).cast("int")
    dealt = placed.join(crowds, [*frame, "cx", "cy"]).withColumn("own", F.pmod(F.xxhash64("box"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    group = [*frame, "cx", "cy", "lo", "hi"]
    ordered = dealt.repartition(*group).sortWithinPartitions(*group, "first")
    names = ["x", "y", "width", "height", "n", "own", "lo", "hi", "cx", "cy", "from_x", "from_y", "side_x", "side_y"]
    kind = boxes.schema["first"].dataType.simpleString()

    def run(batches):
        held = None
        for batch in batches:
            rows = batch.to_pandas()
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            keys = held[group]
            edges = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            if len(edges) > 1:
                yield from _met(held.iloc[: edges[-1]], edges, names)
                held = held.iloc[edges[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield from _met(held, np.array([0, len(held)]), names)

    columns = ordered.select(*group, *[c for c in names if c not in group], "box", "first")
    each = columns.mapInArrow(run, f"box bigint, others bigint, nearest {kind}")
    summed = each.groupBy("box").agg(F.sum("others").alias("others"), F.min("nearest").alias("nearest"))
    # equal rectangles meet unless they are empty
    twins = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("n")).otherwise(F.lit(1))
    found = boxes.withColumn("n", twins).join(summed, "box", "left").where("n > 1 or others > 0").select(*[F.col(c).alias(f"_{c}") for c in [*frame, "x", "y", "width", "height", "n", "first"]], "others", "nearest")
    same = [regions[c].cast("double") == F.col(f"_{c}") for c in ("x", "y", "width", "height")]
    joined = regions.join(found, [*[regions[c] == F.col(f"_{c}") for c in frame], *same])
    twin = F.when(F.col("_n") > 1, F.when(regions[ident] == F.col("_first"), F.lit(None)).otherwise(F.col("_first")))
    # the first of equal rectangles has the next one of them as its twin
    seconds = joined.where((F.col("_n") > 1) & (regions[ident] != F.col("_first"))).groupBy(*[f"_{c}" for c in [*frame, "x", "y", "width", "height"]]).agg(F.min(regions[ident]).alias("_second")).toDF(*[f"k_{c}" for c in [*frame, "x", "y", "width", "height"]], "_second")
    joined = joined.join(seconds, [F.col(f"_{c}") == F.col(f"k_{c}") for c in [*frame, "x", "y", "width", "height"]], "left")
    twin = F.coalesce(twin, F.when(regions[ident] == F.col("_first"), F.col("_second")))
    return joined.select(*[regions[c] for c in frame], regions[ident], (F.col("_n") - 1 + F.coalesce("others", F.lit(0))).alias("overlaps"), F.least("nearest", twin).alias("witness"))


def _met(rows: pd.DataFrame, edges: np.ndarray, names: list[str]):
    """box, others, nearest of the rows of whole groups, each from one of ``edges`` to the next, in order of ``first``."""
    x0, y0, width, height, n, own, lo, hi, cx, cy, from_x, from_y, side_x, side_y = (rows[c].to_numpy() for c in names)
    x1, y1 = x0 + width, y0 + height
    sizes = np.diff(edges)
    opens, size = np.repeat(edges[:-1], sizes), np.repeat(sizes, sizes)
    total = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < len(rows):
        end = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS, "right")) - 1)
        span = size[start:end]
        i = np.repeat(np.arange(start, end), span)
        j = np.repeat(opens[start:end], span) + np.arange(len(i)) - np.repeat(np.cumsum(span) - span, span)
        meet = (x0[i] < x1[j]) & (x0[j] < x1[i]) & (y0[i] < y1[j]) & (y0[j] < y1[i]) & (i != j)
        i, j = i[meet], j[meet]
        left, top = np.maximum(x0[i], x0[j]), np.maximum(y0[i], y0[j])
        here = (np.floor((left - from_x[i]) / side_x[i]) == cx[i]) & (np.floor((top - from_y[i]) / side_y[i]) == cy[i])
        here &= (lo[i] == hi[i]) | (own[i] != own[j])
        i, j = i[here], j[here]
        who, at = np.unique(i, return_index=True)
        if len(who):
            others = np.bincount(i, n[j], len(rows))[who].astype(np.int64)
            first = rows["first"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rows["box"].to_numpy()[who]), pa.array(others), pa.array(first[j[at]])], names=["box", "others", "nearest"])
        start = end


def numbered_within(df: DataFrame, *, key: Sequence[str], order: Sequence[str], name: str, block: Column | None = None) -> DataFrame:
    """1-based position within a parent (sample in section, section in tray)."""
    return ordered_scan(df, key, order, {name: number()}, block=block)


def fill_gaps(
    runs: DataFrame, extent: DataFrame, *, key: Sequence[str], lo: str, hi: str, length: str, block: Column | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Segments covering 0..length of each key without overlap: clipped runs and the gaps between them.

    ``logged`` tells runs from gaps; the other run columns are null in gaps.
    Keys of ``extent`` without runs become one gap.
    """
    key = list(key)
    ext = extent.select(*key, F.col(length).cast("double").alias("_len")).where("_len > 0")
    others = [c for c in runs.columns if c not in {*key, lo, hi}]
    clipped = ext.join(runs, key, "left")
    # least() and greatest() skip nulls: no run may come of a hole
    # without runs, and a run beyond the end reaches nothing
    bottom = F.least(F.col(hi).cast("double"), F.col("_len"))
    clipped = clipped.withColumn(hi, F.when(F.col(hi).isNotNull() & (bottom > F.col(lo)), bottom))
    seen = ordered_scan(clipped, key, [lo, hi], {"_reached": before("max", hi), "_next": lead(F.lit(1))}, block=block, sizes=sizes)
    reached = F.coalesce("_reached", F.lit(0.0))
    top = F.when(F.col(hi).isNotNull(), F.greatest(F.col(lo).cast("double"), reached))
    kept = F.coalesce(F.col(hi) > top, F.lit(False))
    end = F.coalesce(F.greatest(reached, F.col(hi)), reached)
    piece = lambda a, b, logged: F.struct(a.alias("lo"), b.alias("hi"), F.lit(logged).alias("logged"))
    pieces = F.array(
        F.when(kept & (top > reached), piece(reached, top, False)),
        F.when(kept, piece(top, F.col(hi), True)),
        F.when(F.col("_next").isNull() & (end < F.col("_len")), piece(end, F.col("_len"), False)),
    )
    laid = explode_present(seen, pieces, "_p")
    return laid.select(
        *key, F.col("_p.lo").alias(lo), F.col("_p.hi").alias(hi),
        *[F.when(F.col("_p.logged"), F.col(c)).alias(c) for c in others], F.col("_p.logged").alias("logged"),
    )


def section_parent(sections: DataFrame, trays: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Sections with the tray that wholly contains them, else the first that contains their start.

    Both sides carry ``ordinal``, ``sample_no_from`` and ``sample_no_to``.
    """
    t = trays.select(
        *key, F.col("ordinal").alias("tray_ordinal"), F.col("sample_no_from").alias("_tf"), F.col("sample_no_to").alias("_tt")
    )
    found = covering(sections, t, key=key, at="sample_no_from", lo="_tf", hi="_tt", bounds=CLOSED)
    best = found.groupBy(*key, "ordinal").agg(
        F.min_by("tray_ordinal", F.struct(F.col("_tt") < F.col("sample_no_to"), F.col("tray_ordinal"))).alias("tray_ordinal"),
        F.bool_or(F.col("_tt") >= F.col("sample_no_to")).alias("contained"),
    )
    return sections.join(best, [*key, "ordinal"], "left")


def with_interval_depths(intervals: DataFrame, samples: DataFrame, *, key: Sequence[str], depth: str = "depth_m") -> DataFrame:
    """Intervals with depths read at their first and last sample; unresolved ones are dropped."""
    top = samples.select(*key, F.col("sample_no").alias("sample_no_from"), F.col(depth).alias("depth_from_m"))
    bottom = samples.select(*key, F.col("sample_no").alias("sample_no_to"), F.col(depth).alias("depth_to_m"))
    joined = intervals.join(top, [*key, "sample_no_from"]).join(bottom, [*key, "sample_no_to"])
    return joined.where("depth_from_m is not null and depth_to_m is not null")


def coverage_violations(samples: DataFrame, mappings: DataFrame, *, key: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Samples that are not covered by exactly one mapping: (key, sample_no, covers)."""
    hits = covering(
        samples.select(*key, "sample_no"), mappings.select(*key, lo, hi), key=key, at="sample_no", lo=lo, hi=hi
    ).groupBy(*key, "sample_no").agg(F.count(F.lit(1)).alias("covers"))
    found = samples.select(*key, "sample_no").join(hits, [*key, "sample_no"], "left")
    return found.withColumn("covers", F.coalesce("covers", F.lit(0))).where("covers <> 1")


def in_range(df: DataFrame, *, at: str, start=None, end=None) -> DataFrame:
    """Closed depth range with open-ended bounds; the comparisons reach the Parquet scan."""
    if start is not None:
        df = df.where(F.col(at) >= start)
    if end is not None:
        df = df.where(F.col(at) <= end)
    return df


def touching_range(df: DataFrame, *, lo: str = "depth_from_m", hi: str = "depth_to_m", start=None, end=None) -> DataFrame:
    """Intervals that touch a closed range."""
    if start is not None:
        df = df.where(F.col(hi) >= start)
    if end is not None:
        df = df.where(F.col(lo) <= end)
    return df


def lookup_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    return df.join(small, list(on), how)
