"""Mineral calls per interval, runs of equal calls, and confidence in a call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import fixed
from stratalog.functions.text import group_label
from stratalog.operators.intervals import HALF_OPEN, covering, overlapping
from stratalog.operators.ordered import lag, number, ordered_scan, upto
from stratalog.operators.percentiles import exact_medians
from stratalog.session import group_sizes


def dominant(df: DataFrame, *, by: Sequence[str], label: str, order: Sequence[str]) -> DataFrame:
    """Most frequent label per group, the first seen in ``order`` on a tie.

    Null labels count towards ``n_all`` only. Counts are combined map-side per
    (group, label), so the shuffle carries distinct labels, not samples. With a
    single numeric order column this first step is a hash aggregation.
    """
    by = list(by)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"), F.min(place).alias("_first"))
    named = F.col(label).isNotNull()
    # a tie goes to the smaller first position: compare (-count, first) and take the minimum
    pick = F.when(named, F.struct((-F.col("_c")).alias("neg"), F.col("_first").alias("first")))
    best = counts.groupBy(*by).agg(
        F.min_by(label, pick).alias(label),
        F.coalesce(F.max(F.when(named, F.col("_c"))), F.lit(0)).alias("n_label"),
        F.sum("_c").alias("n_all"),
        F.coalesce(F.sum(F.when(named, F.col("_c"))), F.lit(0)).alias("n_valid"),
    )
    return best.withColumns(
        {
            "share_of_all": F.col("n_label") / F.col("n_all"),
            "share_of_valid": F.when(F.col("n_valid") > 0, F.col("n_label") / F.col("n_valid")).otherwise(F.lit(0.0)),
        }
    )


def metre_calls(samples: DataFrame, *, key: Sequence[str], depth: str, label: str, order: Sequence[str], width: float = 1.0) -> DataFrame:
    """One call per interval of ``width``: dominant label, share over all its samples, ok or missing."""
    metre = (F.floor(F.col(depth) / width) * width).cast("double")
    binned = samples.where(F.col(depth).isNotNull()).withColumn("depth_from_m", metre)
    calls = dominant(binned, by=[*key, "depth_from_m"], label=label, order=order)
    found = F.col(label).isNotNull()
    return calls.select(
        *key,
        "depth_from_m",
        (F.col("depth_from_m") + width).alias("depth_to_m"),
        F.col(label).alias("call"),
        F.when(found, F.col("share_of_all")).alias("call_pct"),
        F.col("share_of_all").alias("confidence"),
        F.when(found, "ok").otherwise("missing").alias("quality_flag"),
        F.col("n_all").alias("n_samples"),
    )


def interval_bound(samples: DataFrame, *, key: Sequence[str], depth: str, width: float = 1.0) -> tuple[int, int]:
    """Upper bounds (largest key, all keys) of the intervals ``metre_calls`` can give, from depth ranges alone.

    Reads the key and depth columns only, so a scan over the calls need not be
    run once just to be counted.
    """
    spans = samples.groupBy(*key).agg(F.min(depth).alias("a"), F.max(depth).alias("b")).where("a is not null")
    n = F.floor(F.col("b") / width) - F.floor(F.col("a") / width) + 1
    row = spans.agg(F.max(n), F.sum(n)).first()
    return int(row[0] or 0), int(row[1] or 0)


def overlay_anomalies(metres: DataFrame, anomalies: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Metres marked with the first anomaly that strictly overlaps them."""
    a = anomalies.select(
        *key, F.col("depth_from_m").alias("_af"), F.col("depth_to_m").alias("_at"), F.col("anomaly_score").alias("_as"), F.col("why").alias("_aw")
    )
    m = metres.select(*key, "depth_from_m", "depth_to_m")
    pairs = overlapping(m, a, key=key, left_bounds=("depth_from_m", "depth_to_m"), right_bounds=("_af", "_at"), bounds=HALF_OPEN)
    first = pairs.groupBy(*key, "depth_from_m").agg(F.min_by(F.struct("_as", "_aw"), F.struct("_af", "_at")).alias("_hit"))
    joined = metres.join(first, [*key, "depth_from_m"], "left")
    return joined.select(
        *metres.columns, F.col("_hit").isNotNull().alias("is_anomaly"), F.col("_hit._as").alias("anomaly_score"), F.col("_hit._aw").alias("why")
    )


def metre_summary(
    readings: DataFrame, *, key: Sequence[str], depth: str, mineral: str, order: Sequence[str],
    quality: Sequence[str] = ("wt", "err", "snr"), width: float = 1.0, blanks: Sequence[str] = fixed.NOT_ROCK,
) -> DataFrame:
    """One row per metre over all readings: dominant mineral among the valid ones, coverage, agreement, medians.

    Coverage is the share of readings that are rock, agreement the share of
    the dominant mineral among those; medians are taken over valid readings.
    """
    key = [*key, "depth"]
    upper = F.upper(F.trim(F.coalesce(F.col(mineral), F.lit(""))))
    valid = ~upper.isin(list(blanks))
    binned = readings.where(F.col(depth).isNotNull()).withColumns(
        {"depth": (F.floor(F.col(depth) / width) * width).cast("double"), "_m": F.when(valid, F.col(mineral))}
    )
    summary = dominant(binned, by=key, label="_m", order=order).select(
        *key,
        F.coalesce("_m", F.lit("NO DATA")).alias("mineral"),
        F.col("n_all").alias("n_readings"),
        "n_valid",
        (F.col("n_valid") / F.col("n_all")).alias("coverage"),
        F.col("share_of_valid").alias("agreement"),
    )
    if quality:
        summary = summary.join(exact_medians(binned.where(F.col("_m").isNotNull()), key, quality), key, "left")
    return summary


@dataclass(frozen=True)
class Rule:
    """One strike against an interval: fires when ``test`` is true or cannot be answered."""

    name: str
    needs: str | None
    test: Column
    reason: str


def standard_rules() -> list[Rule]:
    below = lambda column, limit: F.col(column) < limit
    tests = [
        (fixed.COVERAGE_RULE, below("coverage", fixed.COVERAGE_RULE[2])),
        (fixed.AGREEMENT_RULE, below("agreement", fixed.AGREEMENT_RULE[2])),
        (fixed.FIT_RULE, F.col("err") > fixed.FIT_RULE[2]),
        (fixed.SIGNAL_RULE, below("snr", fixed.SIGNAL_RULE[2])),
        (fixed.DOMINANCE_RULE, below("wt", fixed.DOMINANCE_RULE[2])),
    ]
    return [Rule(name, needs, test, reason) for (name, needs, _, reason), test in tests]


def confidence(calls: DataFrame, rules: Sequence[Rule], available: Sequence[str]) -> DataFrame:
    """Strikes, confidence, class and reasons; rules whose input is not available are left out."""
    active = [r for r in rules if r.needs is None or r.needs in available]
    if not active:
        raise ValueError("no confidence rule has its input")
    fired = [F.coalesce(r.test, F.lit(True)) for r in active]
    strikes = sum((f.cast("int") for f in fired[1:]), fired[0].cast("int"))
    why = F.concat_ws(" ; ", *[F.when(f, F.lit(r.reason)) for f, r in zip(fired, active)])
    n = F.col("n_flags")
    return calls.withColumns({"why": why, "n_flags": strikes}).withColumns(
        {
            "confidence": F.bround(1 - n / len(active), 2),
            "conf_class": F.when(n == 0, "high").when(n == 1, "medium").otherwise("low"),
        }
    )


def merge_runs(
    calls: DataFrame, *, key: Sequence[str], lo: str, hi: str, state: Sequence[str],
    order: Sequence[str] = (), touching: float | None = 1e-6, block: Column | None = None, sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Neighbouring intervals with equal state become one run (null equals null).

    With ``touching`` set, a gap larger than it also ends a run. Runs are made
    by a change flag and its running sum, both block-wise, so a deep hole is
    spread over tasks; the final grouping shuffles one partial row per run and
    input partition.
    """
    key, state = list(key), list(state)
    previous = F.struct(*[F.col(s) for s in state], F.col(hi).alias("_hi"))
    if block is None and sizes is None:
        sizes = group_sizes(calls, key)
    seen = ordered_scan(calls, key, [lo, *order], {"_prev": lag(previous)}, block=block, sizes=sizes)
    same = F.lit(True)
    for s in state:
        same = same & F.col(s).eqNullSafe(F.col(f"_prev.{s}"))
    if touching is not None:
        same = same & (F.abs(F.col("_prev._hi") - F.col(lo)) < touching)
    starts = F.when(F.col("_prev").isNotNull() & same, 0).otherwise(1)
    islands = ordered_scan(
        seen.withColumn("_start", starts), key, [lo, *order], {"_run": upto("sum", "_start")}, block=block, sizes=sizes
    )
    return (
        islands.groupBy(*key, "_run", *state)
        .agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n"))
        .drop("_run")
    )


def uncertain_as_null(call: str, confidence_column: str, quality: str, least: float) -> Column:
    unsure = (F.col(quality) == "missing") | (F.coalesce(F.col(confidence_column), F.lit(0.0)) < least)
    return F.when(~unsure, F.col(call))


def label_codes(runs: DataFrame, *, label: str, order: Sequence[str]) -> DataFrame:
    """(label, code): codes in order of first appearance. One row per distinct label."""
    firsts = runs.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(F.struct(*order)).alias("_first"))
    return ordered_scan(firsts, [], ["_first"], {"code": number()}).select(label, (F.col("code") - 1).alias("code"))


def reason_bits(why: str | Column, reasons: Sequence[str]) -> Column:
    """Bit mask of the reasons named in a "; "-separated text, bit i for reasons[i]."""
    text = F.col(why) if isinstance(why, str) else why
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p))
    bits = F.lit(0)
    for i, reason in enumerate(reasons):
        bits = bits.bitwiseOR(F.when(F.array_contains(parts, reason), F.lit(1 << i)).otherwise(F.lit(0)))
    return bits


def label_metres(runs: DataFrame, *, label: str, lo: str, hi: str, by: Sequence[str] = ()) -> DataFrame:
    """Metres per label over all runs, or per ``by``."""
    return runs.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.sum(F.col(hi) - F.col(lo)).alias("metres"))


def longest_label(runs: DataFrame, *, by: Sequence[str], label: str, lo: str, hi: str) -> DataFrame:
    """The label with most metres per key; the smaller label on a tie."""
    metres = label_metres(runs, label=label, lo=lo, hi=hi, by=by)
    best = F.min_by(F.struct(label, "metres"), F.struct((-F.col("metres")).alias("neg"), F.col(label)))
    return metres.groupBy(*by).agg(best.alias("_b")).select(*by, F.col(f"_b.{label}").alias(label), F.col("_b.metres").alias("metres"))


def interval_calls(samples: DataFrame, intervals: DataFrame, *, key: Sequence[str], ident: str, labels: Sequence[str], sample: str = "sample_no") -> DataFrame:
    """Dominant label of each interval's closed sample range, for each label column (tray calls)."""
    found = covering(
        samples.select(*key, sample, *labels),
        intervals.select(*key, ident, F.col("sample_no_from").alias("_f"), F.col("sample_no_to").alias("_t")),
        key=key, at=sample, lo="_f", hi="_t",
    )
    # all label columns side by side as rows: one join and one aggregation whatever their number
    entries = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("label")) for name in labels])
    long = found.select(*key, ident, sample, F.explode_outer(entries).alias("_e")).select(*key, ident, sample, "_e.name", "_e.label")
    best = dominant(long, by=[*key, ident, "name"], label="label", order=[sample])
    wide = best.groupBy(*key, ident).agg(*[F.max(F.when(F.col("name") == name, F.col("label"))).alias(name) for name in labels])
    return intervals.join(wide, [*key, ident], "left")


def choose_log_copy(logs: DataFrame, bands: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Among copies of a log, the one with most calls in each depth range, in name-priority order.

    ``logs``: key, name_rank, copy, start, end, value; ``bands``: key, depth_from, depth_to.
    Result: key, depth_from, depth_to, name_rank, copy, n for the winning copy of each band with a call.
    """
    from stratalog.operators.intervals import covering

    called = logs.where(F.col("value").isNotNull()).withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    found = covering(called, bands, key=list(key), at="_mid", lo="depth_from", hi="depth_to", bounds="half_open")
    band = [*key, "depth_from", "depth_to"]
    counts = found.groupBy(*band, "name_rank", "copy").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("name_rank", "copy", "n"), F.struct("name_rank", (-F.col("n")).alias("neg"), "copy"))
    return counts.groupBy(*band).agg(best.alias("b")).select(*band, "b.*")


def display_label(value: str | Column) -> Column:
    return group_label(value)


def class_totals(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per confidence class and the share of low ones."""
    flags = {c: F.count_if(F.col("conf_class") == c).alias(c) for c in ("high", "medium", "low")}
    totals = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("intervals"), *flags.values())
    return totals.withColumn("low_share", F.col("low") / F.greatest(F.col("intervals"), F.lit(1)))


def common_checks(checks: DataFrame, *, hole: str = "hole_id", check: str = "check") -> DataFrame:
    """Checks available in every hole."""
    holes = checks.agg(F.count_distinct(hole).alias("_holes"))
    counts = checks.groupBy(check).agg(F.count_distinct(hole).alias("_n"))
    # one row, by construction
    return counts.join(F.broadcast(holes), F.col("_n") == F.col("_holes")).select(check)
