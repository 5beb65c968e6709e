"""Calls, runs, intervals and samples over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions.text import group_label, species_group
from stratalog.operators import calls, intervals, profiles
from stratalog.operators.ordered import lag, ordered_scan
from stratalog.plans.registry import query
from stratalog.plans.views import INTERVALS_SQL, LENGTH_H, READINGS_SQL, SCAN_SQL, intervals as ranges, readings, sample_block, scan
from stratalog.session import table

DAY = 24.0

DAILY_SQL = f"""{READINGS_SQL},
counted AS (
  SELECT hole, CAST(floor(depth_h / 24) * 24 AS DOUBLE) AS depth_from_m, replace(upper(call), '_', '-') AS call, count(*) AS c,
         min((us, event_id)) AS first FROM readings GROUP BY 1, 2, 3),
daily AS (
  SELECT hole, depth_from_m, depth_from_m + 24 AS depth_to_m,
         arg_min(call, (-c, first)) FILTER (call IS NOT NULL) AS call,
         CAST(coalesce(max(c) FILTER (call IS NOT NULL), 0) AS BIGINT) AS n_label, CAST(sum(c) AS BIGINT) AS n_samples
  FROM counted GROUP BY 1, 2)"""


def daily(spark, folder):
    samples = readings(spark, folder).withColumn("call", group_label("call"))
    return calls.metre_calls(samples, key=["hole"], depth="depth_h", label="call", order=["seq"], width=DAY)


@query(
    "dominant_daily_call",
    f"""WITH {DAILY_SQL}
SELECT hole, depth_from_m, depth_to_m, call, CASE WHEN call IS NOT NULL THEN round(n_label / n_samples, 6) END AS call_pct,
       round(n_label / n_samples, 6) AS confidence, CASE WHEN call IS NULL THEN 'missing' ELSE 'ok' END AS quality_flag, n_samples FROM daily""",
)
def dominant_daily_call(spark, folder):
    return daily(spark, folder).withColumns({"call_pct": F.round("call_pct", 6), "confidence": F.round("confidence", 6)})


def daily_runs(spark, folder):
    state = F.when((F.col("quality_flag") == "ok") & (F.col("confidence") >= 0.4), F.col("call"))
    metres = daily(spark, folder).withColumn("call", state)
    return calls.merge_runs(metres, key=["hole"], lo="depth_from_m", hi="depth_to_m", state=["call"], sizes=days_bound(spark, folder))


def days_bound(spark, folder):
    return calls.interval_bound(readings(spark, folder), key=["hole"], depth="depth_h", width=DAY)


DAILY_RUNS_SQL = f"""{DAILY_SQL},
stated AS (SELECT hole, depth_from_m, depth_to_m, CASE WHEN n_label / n_samples >= 0.4 THEN call END AS call FROM daily),
flagged AS (
  SELECT *, CASE WHEN lag(depth_to_m) OVER w = depth_from_m AND lag(call) OVER w IS NOT DISTINCT FROM call THEN 0 ELSE 1 END AS s
  FROM stated WINDOW w AS (PARTITION BY hole ORDER BY depth_from_m)),
islands AS (SELECT *, sum(s) OVER (PARTITION BY hole ORDER BY depth_from_m ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
runs AS (
  SELECT hole, call, min(depth_from_m) AS depth_from_m, max(depth_to_m) AS depth_to_m, count(*) AS n FROM islands GROUP BY hole, run, call)"""


@query("daily_call_runs", f"WITH {DAILY_RUNS_SQL} SELECT hole, call, depth_from_m, depth_to_m, n FROM runs")
def daily_call_runs(spark, folder):
    """Flagship: every hole's log as runs of one call, uncertain days as null."""
    return daily_runs(spark, folder).select("hole", "call", "depth_from_m", "depth_to_m", "n")


@query(
    "event_type_runs",
    f"""WITH {SCAN_SQL},
flagged AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY hole ORDER BY sample_no) = event_type THEN 0 ELSE 1 END AS s FROM scan),
islands AS (SELECT *, sum(s) OVER (PARTITION BY hole ORDER BY sample_no ROWS UNBOUNDED PRECEDING) AS run FROM flagged)
SELECT hole, event_type, min(sample_no) AS sample_no_from, max(sample_no) AS sample_no_to, count(*) AS n FROM islands GROUP BY hole, run, event_type""",
)
def event_type_runs(spark, folder):
    samples = scan(spark, folder).select("hole", "event_type", F.col("sample_no").alias("sample_no_from"), F.col("sample_no").alias("sample_no_to"))
    return calls.merge_runs(
        samples, key=["hole"], lo="sample_no_from", hi="sample_no_to", state=["event_type"], touching=None, block=sample_block("sample_no_from")
    ).select("hole", "event_type", "sample_no_from", "sample_no_to", "n")


@query(
    "logged_and_unlogged_segments",
    f"""WITH {DAILY_RUNS_SQL},
tail AS (SELECT hole, max(depth_to_m) AS e FROM runs GROUP BY 1),
gaps AS (SELECT hole, coalesce(lag(depth_to_m) OVER (PARTITION BY hole ORDER BY depth_from_m), 0) AS a, depth_from_m AS b FROM runs)
SELECT hole, depth_from_m, depth_to_m, call, TRUE AS logged FROM runs
UNION ALL SELECT hole, a, b, NULL, FALSE FROM gaps WHERE b > a
UNION ALL SELECT hole, e, 720.0, NULL, FALSE FROM tail WHERE e < 720""",
)
def logged_and_unlogged_segments(spark, folder):
    runs = daily_runs(spark, folder).select("hole", "depth_from_m", "depth_to_m", "call")
    # the greater of the planned and the logged length
    extent = runs.groupBy("hole").agg(F.greatest(F.lit(LENGTH_H), F.max("depth_to_m")).alias("length"))
    return intervals.fill_gaps(
        runs, extent, key=["hole"], lo="depth_from_m", hi="depth_to_m", length="length", sizes=days_bound(spark, folder)
    ).select("hole", "depth_from_m", "depth_to_m", "call", "logged")


@query(
    "daily_reading_summary",
    f"""WITH {READINGS_SQL},
binned AS (SELECT *, CAST(floor(depth_h / 24) * 24 AS DOUBLE) AS depth FROM readings),
counted AS (SELECT hole, depth, call, count(*) AS c, min((us, event_id)) AS first FROM binned GROUP BY 1, 2, 3),
modes AS (
  SELECT hole, depth, arg_min(call, (-c, first)) FILTER (call IS NOT NULL) AS mineral, coalesce(max(c) FILTER (call IS NOT NULL), 0) AS top,
         CAST(sum(c) AS BIGINT) AS n_readings, CAST(coalesce(sum(c) FILTER (call IS NOT NULL), 0) AS BIGINT) AS n_valid FROM counted GROUP BY 1, 2),
medians AS (SELECT hole, depth, quantile_cont(value, 0.5) AS wt, quantile_cont(k, 0.5) AS snr FROM binned WHERE call IS NOT NULL GROUP BY 1, 2)
SELECT m.hole, m.depth, coalesce(mineral, 'NO DATA') AS mineral, n_readings, n_valid, round(n_valid / n_readings, 6) AS coverage,
       CASE WHEN n_valid > 0 THEN round(top / n_valid, 6) ELSE 0.0 END AS agreement, round(wt, 6) AS wt, round(CAST(snr AS DOUBLE), 6) AS snr
FROM modes m LEFT JOIN medians d ON m.hole = d.hole AND m.depth = d.depth""",
)
def daily_reading_summary(spark, folder):
    result = _summary(spark, folder)
    return result.withColumns({c: F.round(c, 6) for c in ("coverage", "agreement", "wt", "snr")})


def _summary(spark, folder):
    samples = readings(spark, folder).withColumns({"wt": F.col("value"), "snr": F.col("k").cast("double")})
    return calls.metre_summary(
        samples, key=["hole"], depth="depth_h", mineral="call", order=["seq"], quality=["wt", "snr"], width=DAY
    )


CONFIDENCE_SQL = f"""WITH {READINGS_SQL},
binned AS (SELECT *, CAST(floor(depth_h / 24) * 24 AS DOUBLE) AS depth FROM readings),
counted AS (SELECT hole, depth, call, count(*) AS c FROM binned GROUP BY 1, 2, 3),
modes AS (
  SELECT hole, depth, coalesce(max(c) FILTER (call IS NOT NULL), 0) AS top, sum(c) AS n, coalesce(sum(c) FILTER (call IS NOT NULL), 0) AS v
  FROM counted GROUP BY 1, 2),
medians AS (SELECT hole, depth, quantile_cont(value, 0.5) AS wt, quantile_cont(CAST(k AS DOUBLE), 0.5) AS snr FROM binned WHERE call IS NOT NULL GROUP BY 1, 2),
fired AS (
  SELECT m.hole, m.depth, v / n < 0.5 AS f1, CASE WHEN v > 0 THEN top / v ELSE 0 END < 0.6 AS f2,
         coalesce(snr < 200, TRUE) AS f4, coalesce(wt < 0.4, TRUE) AS f5
  FROM modes m LEFT JOIN medians d ON m.hole = d.hole AND m.depth = d.depth),
scored AS (SELECT *, CAST(f1 AS INTEGER) + CAST(f2 AS INTEGER) + CAST(f4 AS INTEGER) + CAST(f5 AS INTEGER) AS n_flags FROM fired)"""


@query(
    "daily_confidence",
    CONFIDENCE_SQL + """
SELECT hole, depth, n_flags, round_even(1 - n_flags / 4, 2) AS confidence,
       CASE WHEN n_flags = 0 THEN 'high' WHEN n_flags = 1 THEN 'medium' ELSE 'low' END AS conf_class,
       concat_ws(' ; ', CASE WHEN f1 THEN 'over half this metre had no usable reading' END,
         CASE WHEN f2 THEN 'the readings within this metre disagree with each other' END,
         CASE WHEN f4 THEN 'weak signal (low signal-to-noise)' END, CASE WHEN f5 THEN 'no single mineral clearly dominates' END) AS why FROM scored""",
)
def daily_confidence(spark, folder):
    graded = calls.confidence(_summary(spark, folder), calls.standard_rules(), ["snr", "weight"])
    return graded.select("hole", "depth", "n_flags", "confidence", "conf_class", "why")


@query(
    "confidence_class_totals",
    CONFIDENCE_SQL + """
SELECT hole, count(*) AS intervals, CAST(count_if(n_flags = 0) AS BIGINT) AS high, CAST(count_if(n_flags = 1) AS BIGINT) AS medium,
       CAST(count_if(n_flags > 1) AS BIGINT) AS low,
       round(count_if(n_flags > 1) / count(*), 6) AS low_share FROM scored GROUP BY 1""",
)
def confidence_class_totals(spark, folder):
    graded = calls.confidence(_summary(spark, folder), calls.standard_rules(), ["snr", "weight"])
    return calls.class_totals(graded, ["hole"]).withColumn("low_share", F.round("low_share", 6))


@query(
    "confidence_runs",
    CONFIDENCE_SQL + """,
stated AS (
  SELECT hole, depth, CASE WHEN n_flags = 0 THEN 'high' WHEN n_flags = 1 THEN 'medium' ELSE 'low' END AS conf_class,
         CAST(f1 AS INTEGER) + 2 * CAST(f2 AS INTEGER) + 4 * CAST(f4 AS INTEGER) + 8 * CAST(f5 AS INTEGER) AS bits FROM scored),
flagged AS (
  SELECT *, CASE WHEN lag(depth) OVER w + 24 = depth AND lag(conf_class) OVER w = conf_class AND lag(bits) OVER w = bits THEN 0 ELSE 1 END AS s
  FROM stated WINDOW w AS (PARTITION BY hole ORDER BY depth)),
islands AS (SELECT *, sum(s) OVER (PARTITION BY hole ORDER BY depth ROWS UNBOUNDED PRECEDING) AS run FROM flagged)
SELECT hole, conf_class, bits, min(depth) AS depth_from_m, max(depth) + 24 AS depth_to_m, count(*) AS n FROM islands GROUP BY hole, run, conf_class, bits""",
)
def confidence_runs(spark, folder):
    rules = [r for r in calls.standard_rules() if r.needs != "error"]
    graded = calls.confidence(_summary(spark, folder), rules, ["snr", "weight"])
    stated = graded.select(
        "hole", F.col("depth").alias("depth_from_m"), (F.col("depth") + DAY).alias("depth_to_m"), "conf_class", calls.reason_bits("why", [r.reason for r in rules]).alias("bits")
    )
    return calls.merge_runs(
        stated, key=["hole"], lo="depth_from_m", hi="depth_to_m", state=["conf_class", "bits"], sizes=days_bound(spark, folder)
    ).select("hole", "conf_class", "bits", "depth_from_m", "depth_to_m", "n")


@query(
    "tray_calls",
    f"""WITH {SCAN_SQL}, {INTERVALS_SQL.strip()},
c1 AS (SELECT hole, sample_no // 10 AS ordinal, call, count(*) AS c, min(sample_no) AS f FROM scan WHERE call IS NOT NULL GROUP BY 1, 2, 3),
c2 AS (SELECT hole, sample_no // 10 AS ordinal, event_type AS tir_call, count(*) AS c, min(sample_no) AS f FROM scan GROUP BY 1, 2, 3),
m1 AS (SELECT hole, ordinal, arg_min(call, (-c, f)) AS call FROM c1 GROUP BY 1, 2),
m2 AS (SELECT hole, ordinal, arg_min(tir_call, (-c, f)) AS tir_call FROM c2 GROUP BY 1, 2)
SELECT t.hole, t.ordinal, sample_no_from, sample_no_to, call, tir_call FROM tray t
LEFT JOIN m1 ON m1.hole = t.hole AND m1.ordinal = t.ordinal LEFT JOIN m2 ON m2.hole = t.hole AND m2.ordinal = t.ordinal""",
)
def tray_calls(spark, folder):
    samples = scan(spark, folder)
    trays = ranges(samples, 10, "tray")
    found = calls.interval_calls(
        samples.withColumn("tir_call", F.col("event_type")), trays, key=["hole"], ident="ordinal", labels=["call", "tir_call"]
    )
    return found.select("hole", "ordinal", "sample_no_from", "sample_no_to", "call", "tir_call")


@query(
    "sample_positions",
    f"""WITH {SCAN_SQL}, {INTERVALS_SQL.strip()}
SELECT s.hole, s.sample_no, t.ordinal AS tray_ordinal, c.ordinal AS section_ordinal, s.sample_no - t.sample_no_from + 1 AS tray_sample_no,
       s.sample_no - c.sample_no_from + 1 AS section_sample_no
FROM scan s JOIN tray t ON s.hole = t.hole AND s.sample_no BETWEEN t.sample_no_from AND t.sample_no_to
JOIN section c ON s.hole = c.hole AND s.sample_no BETWEEN c.sample_no_from AND c.sample_no_to""",
)
def sample_positions(spark, folder):
    from stratalog.operators.align import axis_positions

    samples = scan(spark, folder)
    placed = axis_positions(samples.select("hole", "sample_no"), ranges(samples, 10, "tray"), ranges(samples, 5, "section"), key=["hole"])
    return placed.select("hole", "sample_no", "tray_ordinal", "section_ordinal", "tray_sample_no", "section_sample_no")


@query(
    "section_parent_trays",
    f"""WITH {SCAN_SQL}, {INTERVALS_SQL.strip()},
cut AS (SELECT hole, ordinal, sample_no_from, CASE WHEN ordinal % 3 = 0 THEN sample_no_to + 6 ELSE sample_no_to END AS sample_no_to FROM section)
SELECT c.hole, c.ordinal, arg_min(t.ordinal, (CAST(t.sample_no_to < c.sample_no_to AS INTEGER), t.ordinal)) AS tray_ordinal,
       bool_or(t.sample_no_to >= c.sample_no_to) AS contained
FROM cut c JOIN tray t ON c.hole = t.hole AND c.sample_no_from BETWEEN t.sample_no_from AND t.sample_no_to GROUP BY 1, 2""",
)
def section_parent_trays(spark, folder):
    samples = scan(spark, folder)
    longer = F.when(F.col("ordinal") % 3 == 0, F.col("sample_no_to") + 6).otherwise(F.col("sample_no_to"))
    sections = ranges(samples, 5, "section").select("hole", "ordinal", "sample_no_from", longer.alias("sample_no_to"))
    found = intervals.section_parent(sections, ranges(samples, 10, "tray"), key=["hole"])
    return found.select("hole", "ordinal", "tray_ordinal", "contained")


@query(
    "section_numbers_in_tray",
    f"""WITH {SCAN_SQL}, {INTERVALS_SQL.strip()}
SELECT hole, ordinal, ordinal // 2 AS tray_ordinal, row_number() OVER (PARTITION BY hole, ordinal // 2 ORDER BY ordinal) AS section_in_tray FROM section""",
)
def section_numbers_in_tray(spark, folder):
    from stratalog.operators.align import tray_local_sections

    sections = ranges(scan(spark, folder), 5, "section").select("hole", "ordinal", F.floor(F.col("ordinal") / 2).alias("tray_ordinal"))
    return tray_local_sections(sections, key=["hole"]).select("hole", "ordinal", "tray_ordinal", "section_in_tray")


@query(
    "tray_depths",
    f"""WITH {SCAN_SQL}, {INTERVALS_SQL.strip()}
SELECT t.hole, t.ordinal, round(a.depth_h, 6) AS depth_from_m, round(b.depth_h, 6) AS depth_to_m FROM tray t
JOIN scan a ON a.hole = t.hole AND a.sample_no = t.sample_no_from JOIN scan b ON b.hole = t.hole AND b.sample_no = t.sample_no_to""",
)
def tray_depths(spark, folder):
    samples = scan(spark, folder)
    trays = ranges(samples, 10, "tray").select("hole", "ordinal", "sample_no_from", "sample_no_to")
    found = intervals.with_interval_depths(trays, samples, key=["hole"], depth="depth_h")
    return found.select("hole", "ordinal", F.round("depth_from_m", 6).alias("depth_from_m"), F.round("depth_to_m", 6).alias("depth_to_m"))


@query(
    "tray_tiling_problems",
    f"""WITH {SCAN_SQL}, {INTERVALS_SQL.strip()},
broken AS (
  SELECT hole, sample_no_from AS lo, CASE WHEN ordinal % 4 = 1 THEN sample_no_to - 1 WHEN ordinal % 4 = 2 THEN sample_no_to + 2 ELSE sample_no_to END AS hi FROM tray),
seen AS (SELECT *, lag(hi) OVER w AS p, lead(lo) OVER w AS nx FROM broken WINDOW w AS (PARTITION BY hole ORDER BY lo, hi)),
size AS (SELECT hole, count(*) AS n FROM scan GROUP BY 1),
judged AS (
  SELECT s.hole, lo, hi, CASE WHEN hi < lo THEN 'empty' WHEN lo > coalesce(p + 1, 0) THEN 'gap' WHEN lo < coalesce(p + 1, 0) THEN 'overlap'
         WHEN nx IS NULL AND hi <> n - 1 THEN 'wrong end' END AS problem FROM seen s JOIN size z ON s.hole = z.hole)
SELECT hole, lo, hi, problem FROM judged WHERE problem IS NOT NULL""",
)
def tray_tiling_problems(spark, folder):
    samples = scan(spark, folder)
    to = F.col("sample_no_to")
    moved = F.when(F.col("ordinal") % 4 == 1, to - 1).when(F.col("ordinal") % 4 == 2, to + 2).otherwise(to)
    trays = ranges(samples, 10, "tray").select("hole", F.col("sample_no_from").alias("a"), moved.alias("b"))
    extent = samples.groupBy("hole").agg(F.count(F.lit(1)).alias("n"))
    return intervals.tiling_violations(trays, key=["hole"], lo="a", hi="b", extent=extent)


@query(
    "samples_not_covered_once",
    f"""WITH {SCAN_SQL}, {INTERVALS_SQL.strip()},
mapped AS (SELECT hole, sample_no_from AS lo, sample_no_to + (ordinal % 2) AS hi FROM tray WHERE ordinal % 5 <> 3)
SELECT s.hole, s.sample_no, count(m.hole) AS covers FROM scan s LEFT JOIN mapped m ON s.hole = m.hole AND s.sample_no BETWEEN m.lo AND m.hi
GROUP BY 1, 2 HAVING count(m.hole) <> 1""",
)
def samples_not_covered_once(spark, folder):
    samples = scan(spark, folder).select("hole", "sample_no")
    trays = ranges(scan(spark, folder), 10, "tray").where("ordinal % 5 <> 3")
    mapped = trays.select("hole", F.col("sample_no_from").alias("lo"), (F.col("sample_no_to") + F.col("ordinal") % 2).alias("hi"))
    return intervals.coverage_violations(samples, mapped, key=["hole"], lo="lo", hi="hi").select("hole", "sample_no", F.col("covers").cast("long").alias("covers"))


@query(
    "nearest_sample_to_depths",
    f"""WITH {SCAN_SQL},
target AS (SELECT hole, t AS target_id, t * 48.0 AS depth FROM (SELECT DISTINCT hole FROM scan), range(0, 16) r(t))
SELECT g.hole, target_id, arg_min(sample_no, (abs(depth_h - depth), sample_no)) AS sample_no, round(min(abs(depth_h - depth)), 6) AS distance
FROM target g JOIN scan s ON s.hole = g.hole GROUP BY 1, 2""",
)
def nearest_sample_to_depths(spark, folder):
    samples = scan(spark, folder)
    targets = samples.select("hole").distinct().withColumn("target_id", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<long>")))
    targets = targets.withColumn("depth", F.col("target_id") * 48.0)
    found = intervals.nearest(targets, samples, key=["hole"], at="depth", sample_at="depth_h", sample_id="sample_no", target_id="target_id")
    return found.select("hole", "target_id", "sample_no", F.round("distance", 6).alias("distance"))


@query(
    "daily_calls_with_anomalies",
    f"""WITH {DAILY_SQL},
anomaly AS (SELECT hole, depth_h AS a, depth_h + 6 AS b, value AS anomaly_score FROM readings WHERE value > 150),
hit AS (
  SELECT d.hole, d.depth_from_m, arg_min(anomaly_score, (a, b)) AS anomaly_score FROM daily d
  JOIN anomaly x ON x.hole = d.hole AND a < depth_to_m AND b > depth_from_m GROUP BY 1, 2)
SELECT d.hole, d.depth_from_m, d.call, h.hole IS NOT NULL AS is_anomaly, h.anomaly_score FROM daily d
LEFT JOIN hit h ON h.hole = d.hole AND h.depth_from_m = d.depth_from_m""",
)
def daily_calls_with_anomalies(spark, folder):
    marked = readings(spark, folder).where("value > 150").select(
        "hole", F.col("depth_h").alias("depth_from_m"), (F.col("depth_h") + 6).alias("depth_to_m"), F.col("value").alias("anomaly_score"), F.lit("value").alias("why")
    )
    found = calls.overlay_anomalies(daily(spark, folder), marked, key=["hole"])
    return found.select("hole", "depth_from_m", "call", "is_anomaly", "anomaly_score")


@query(
    "band_dominant_by_midpoint",
    f"""WITH {SCAN_SQL},
band AS (SELECT hole, b, b * 50.0 AS lo, b * 50.0 + 30 AS hi FROM (SELECT DISTINCT hole, CAST(floor((depth_h + 0.5) / 50) AS BIGINT) AS b FROM scan)),
inside AS (SELECT b.hole, b.b, s.call, count(*) AS c, min(sample_no) AS f FROM band b JOIN scan s ON s.hole = b.hole AND depth_h + 0.5 >= lo AND depth_h + 0.5 < hi
  WHERE s.call IS NOT NULL GROUP BY 1, 2, 3)
SELECT hole, b AS band, arg_min(call, (-c, f)) AS call, round(max(c) / sum(c), 6) AS coverage FROM inside GROUP BY 1, 2""",
)
def band_dominant_by_midpoint(spark, folder):
    samples = scan(spark, folder).where("call is not null").select("hole", "sample_no", "call", (F.col("depth_h") + 0.5).alias("mid"))
    bands = samples.select("hole", F.floor(F.col("mid") / 50).alias("band")).distinct()
    bands = bands.select("hole", "band", (F.col("band") * 50.0).alias("lo"), (F.col("band") * 50.0 + 30).alias("hi"))
    found = intervals.covering(samples, bands, key=["hole"], at="mid", lo="lo", hi="hi", bounds="half_open")
    best = calls.dominant(found, by=["hole", "band"], label="call", order=["sample_no"])
    return best.select("hole", "band", "call", F.round("share_of_all", 6).alias("coverage"))


@query(
    "metres_per_call",
    f"WITH {DAILY_RUNS_SQL} SELECT call, sum(depth_to_m - depth_from_m) AS metres FROM runs WHERE call IS NOT NULL GROUP BY 1",
)
def metres_per_call(spark, folder):
    return calls.label_metres(daily_runs(spark, folder), label="call", lo="depth_from_m", hi="depth_to_m")


@query(
    "longest_call_per_hole",
    f"""WITH {DAILY_RUNS_SQL}, m AS (SELECT hole, call, sum(depth_to_m - depth_from_m) AS metres FROM runs WHERE call IS NOT NULL GROUP BY 1, 2)
SELECT hole, arg_min(call, (-metres, call)) AS call, max(metres) AS metres FROM m GROUP BY 1""",
)
def longest_call_per_hole(spark, folder):
    return calls.longest_label(daily_runs(spark, folder), by=["hole"], label="call", lo="depth_from_m", hi="depth_to_m")


@query(
    "call_codes",
    f"""WITH {DAILY_RUNS_SQL}, f AS (SELECT call, min((hole, depth_from_m)) AS first FROM runs WHERE call IS NOT NULL GROUP BY 1)
SELECT call, row_number() OVER (ORDER BY first) - 1 AS code FROM f""",
)
def call_codes(spark, folder):
    return calls.label_codes(daily_runs(spark, folder), label="call", order=["hole", "depth_from_m"])


@query(
    "distinct_calls_per_hole",
    f"""WITH {DAILY_SQL} SELECT hole, count(DISTINCT call) AS labels, CAST(count_if(n_label / n_samples < 0.5) AS BIGINT) AS low_confidence FROM daily GROUP BY 1""",
)
def distinct_calls_per_hole(spark, folder):
    return profiles.distinct_labels(daily(spark, folder), hole="hole", label="call")


@query(
    "best_log_copy",
    """WITH hit AS (
  SELECT l_suppkey AS hole, lo AS depth_from, hi AS depth_to, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS name_rank, l_linenumber AS copy
  FROM lineitem, (VALUES (10.0::DOUBLE, 14.0::DOUBLE), (12.0, 30.0), (30.0, 31.0)) b(lo, hi) WHERE l_quantity + l_tax / 2 >= lo AND l_quantity + l_tax / 2 < hi AND l_linestatus = 'O'),
c AS (SELECT hole, depth_from, depth_to, name_rank, copy, count(*) AS n FROM hit GROUP BY 1, 2, 3, 4, 5)
SELECT hole, depth_from, depth_to, arg_min(name_rank, (name_rank, -n, copy)) AS name_rank, arg_min(copy, (name_rank, -n, copy)) AS copy, arg_min(n, (name_rank, -n, copy)) AS n FROM c GROUP BY 1, 2, 3""",
)
def best_log_copy(spark, folder):
    items = table(spark, folder, "lineitem")
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    logs = items.select(
        F.col("l_suppkey").alias("hole"), rank.alias("name_rank"), F.col("l_linenumber").alias("copy"), F.col("l_quantity").alias("start"),
        (F.col("l_quantity") + F.col("l_tax")).alias("end"), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("value"),
    )
    ranges_ = F.array(*[F.struct(F.lit(lo).alias("depth_from"), F.lit(hi).alias("depth_to")) for lo, hi in ((10.0, 14.0), (12.0, 30.0), (30.0, 31.0))])
    bands = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("hole"), F.inline(ranges_))
    return calls.choose_log_copy(logs, bands, key=["hole"])


@query(
    "informative_samples",
    f"""WITH {SCAN_SQL}, size AS (SELECT hole, count(*) AS n FROM scan GROUP BY 1),
best AS (SELECT s.hole, arg_min(sample_no, (abs(sample_no - n // 2), -sample_no)) AS b FROM scan s JOIN size z ON s.hole = z.hole WHERE call IS NOT NULL GROUP BY 1)
SELECT z.hole, coalesce(b, n // 2) AS sample_no FROM size z LEFT JOIN best x ON x.hole = z.hole""",
)
def informative_samples(spark, folder):
    return profiles.informative_sample(scan(spark, folder), key=["hole"], label="call")


@query(
    "spread_samples",
    f"""WITH {SCAN_SQL}, size AS (SELECT hole, count(*) AS n FROM scan GROUP BY 1),
places AS (SELECT DISTINCT hole, least(CAST(floor(n * f) AS BIGINT), n - 1) AS p
  FROM size, (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS f)),
mid AS (SELECT hole, list_sort(list(p))[len(list(p)) // 2 + 1] AS m FROM places GROUP BY 1)
SELECT p.hole, coalesce(min(p.p) FILTER (s.call IS NOT NULL), max(m.m)) AS sample_no FROM places p JOIN mid m ON m.hole = p.hole
JOIN scan s ON s.hole = p.hole AND s.sample_no = p.p GROUP BY 1""",
)
def spread_samples(spark, folder):
    return profiles.spread_sample(scan(spark, folder), key=["hole"], label="call")


@query(
    "value_resets",
    f"""WITH {SCAN_SQL}, seen AS (SELECT hole, sample_no, k, lag(k) OVER (PARTITION BY hole ORDER BY sample_no) AS previous FROM scan)
SELECT hole, sample_no, k, previous FROM seen WHERE k < previous""",
)
def value_resets(spark, folder):
    found = profiles.depth_resets(scan(spark, folder), log=["hole"], order="sample_no", depth="k", block=sample_block())
    return found.select("hole", "sample_no", "k", F.col("previous_depth").alias("previous"))


@query(
    "previous_reading",
    f"""WITH {READINGS_SQL} SELECT hole, event_id, lag(value) OVER (PARTITION BY hole ORDER BY us, event_id) AS before FROM readings""",
)
def previous_reading(spark, folder):
    rows = readings(spark, folder).select("hole", "event_id", "us", "value")
    return ordered_scan(rows, ["hole"], ["us", "event_id"], {"before": lag("value")}).select("hole", "event_id", "before")


@query(
    "species_groups",
    """SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'CHLORITE' WHEN 'blue' THEN 'KAOLIN' ELSE upper(split_part(p_name, ' ', 1)) END AS grp FROM part""",
)
def species_groups(spark, folder):
    name = F.split_part("p_name", F.lit(" "), F.lit(1))
    return table(spark, folder, "part").select("p_partkey", species_group(name, {"red": "CHLORITE", "blue": "KAOLIN"}).alias("grp"))
