"""The questions callers ask of a release, as compositions of the operators (R01-R21), run on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.numbers import finite_channels, image_position, nonfinite_channels
from stratalog.operators import geometry, intervals, neighbours, paging, profiles, relations, scoring
from stratalog.plans.registry import query
from stratalog.plans.score_queries import SCALED_SQL, scaled_table
from stratalog.plans.views import SCAN_SQL, SITES_SQL, km_sql, readings, scan, sites, spectra
from stratalog.session import scratch, settle_table, table
from stratalog.sources import sinks

# ---------------------------------------------------------------- library queries


def usable(availability: str = "availability_status", binding: str = "binding_status") -> Column:
    """A log whose payload is present and whose binding is verified."""
    return F.coalesce((F.col(availability) == "payload_present") & (F.col(binding) == "verified"), F.lit(False))


def log_status(axis_id: Column | str | None = None) -> Column:
    """Why a log gives no values, or available."""
    other_axis = ~F.col("axis_id").eqNullSafe(F.lit(axis_id) if isinstance(axis_id, str) else axis_id) if axis_id is not None else F.lit(False)
    return (
        F.when(~F.col("availability_status").eqNullSafe(F.lit("payload_present")), "metadata_only")
        .when(~F.col("binding_status").eqNullSafe(F.lit("verified")) | other_axis, "axis_binding_unavailable")
        .otherwise("available")
    )


def group_log(logs: DataFrame, *, by: list[str], region: str = "SWIR") -> DataFrame:
    """First usable mineral-group log of the wanted region per revision."""
    tir = F.coalesce(F.col("output_region").rlike("(?i)TIR"), F.lit(False)) | F.col("source_log_name").rlike("(?i)TSAT")
    fits = usable() & (F.col("log_kind") == "scalar") & (F.col("metric_key") == "mineral_group") & F.col("source_log_name").rlike(r"(?i)^grp\s*1")
    wanted = logs.where(fits & (tir if region == "TIR" else ~tir))
    return profiles.first_per_key(wanted, key=by, order=["log_kind", "source_log_name", "log_id"])


def log_values(values: DataFrame, logs: DataFrame, *, log_id, axis_id, start=None, end=None, after: int = -1, limit: int = 1000) -> DataFrame:
    """A page of one log's values in a depth range with a status per row; no rows where the log is not available.

    Filters on log, axis, sample and depth all reach the scan.
    """
    chosen = values.where((F.col("log_id") == log_id) & (F.col("axis_id") == axis_id))
    allowed = logs.where((F.col("log_id") == log_id) & (log_status(axis_id) == "available")).select("log_id")
    ranged = intervals.in_range(chosen, at="depth_m", start=start, end=end).join(F.broadcast(allowed.limit(1)), "log_id", "left_semi")
    status = F.when(F.col("value_numeric").isNull() & F.col("value_text").isNull(), "source_null").otherwise("available")
    return paging.page_after(ranged.withColumn("status", status), key="sample_no", after=after, limit=limit)


def sample_results(logs: DataFrame, scalars: DataFrame, spectra_: DataFrame, samples: DataFrame) -> DataFrame:
    """For each asked sample (axis_id, sample_no) every log's value or status; spectra with odd channels as null."""
    asked = samples.select(F.col("axis_id").alias("want_axis"), "sample_no").distinct()
    pairs = logs.join(asked, logs["dataset_axis_id"] == F.col("want_axis"))
    status = log_status(F.col("want_axis"))
    s = scalars.select("log_id", "sample_no", "value_numeric", "value_text", F.lit(True).alias("_s"))
    p = spectra_.select("log_id", "sample_no", "values")
    joined = pairs.withColumn("_st", status).join(s, ["log_id", "sample_no"], "left").join(p, ["log_id", "sample_no"], "left")
    spectral = F.col("log_kind") == "spectral"
    found = (
        F.when(F.col("_st") != "available", F.col("_st"))
        .when(spectral & F.col("values").isNull(), "spectral_mapping_unavailable")
        .when(spectral, "available")
        .when(F.col("_s").isNull(), "sample_result_unavailable")
        .when(F.col("value_numeric").isNull() & F.col("value_text").isNull(), "source_null")
        .otherwise("available")
    )
    return joined.withColumn("status", found).select(
        F.col("want_axis").alias("axis_id"), "sample_no", "log_id", "status",
        F.when(F.col("status") == "available", F.col("value_numeric")).alias("value_numeric"), F.when(F.col("status") == "available", F.col("value_text")).alias("value_text"),
        finite_channels("values").alias("spectra"), nonfinite_channels("values").alias("nonfinite_channels"),
    )


def profile_values(profiles_: DataFrame, samples: DataFrame, *, log_id, axis_id, start=None, end=None, after: int = -1, limit: int = 1000) -> DataFrame:
    """A page of a profile log: the samples of the depth range decide which profile rows are read."""
    wanted = intervals.in_range(samples.where(F.col("axis_id") == axis_id), at="md_m", start=start, end=end).select("sample_no", "md_m")
    rows = profiles_.where(F.col("log_id") == log_id).join(wanted, "sample_no")
    return paging.page_after(rows.withColumn("status", F.lit("available_uncalibrated_profile")), key="sample_no", after=after, limit=limit)


ANOMALY_ORDER = ["hole_id", "depth_from_m"]


def anomalies_of(anomalies: DataFrame, *, flag: str | None = None, start=None, end=None, after=None, limit: int = 200) -> DataFrame:
    """Anomaly intervals touching a depth range, by hole and depth: the page beyond ``after``, with ``next_after``."""
    chosen = anomalies if flag is None else anomalies.where(F.col("flag") == flag)
    return paging.page_after_place(intervals.touching_range(chosen, start=start, end=end), order=ANOMALY_ORDER, after=after, limit=limit)


# ---------------------------------------------------------------- on the given tables

# nations read as releases, customers as boreholes, suppliers as instruments


def _release_tables(spark, folder):
    c = sites(spark, folder)
    key = F.col("hole_id")
    active = table(spark, folder, "nation").where("n_nationkey = 3").select(F.col("n_nationkey").alias("release_id"))
    members = table(spark, folder, "customer").select(F.col("c_nationkey").alias("release_id"), F.col("c_custkey").alias("dataset_revision_id"))
    revisions = c.select(key.alias("dataset_revision_id"), key.alias("borehole_id"), key.alias("borehole_revision_id"), F.col("project").alias("source_project_name"), F.when(key % 2 == 0, "scanner").alias("instrument_name"))
    boreholes = c.select(key.alias("borehole_id"), "hole_id")
    collars = c.select(key.alias("borehole_revision_id"), F.when(key % 3 == 0, F.col("hole_name")).alias("project_name"), "latitude", "longitude")
    axes = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("dataset_revision_id")).agg(F.min("o_totalprice").alias("depth_min_m"), F.max("o_totalprice").alias("depth_max_m"))
    return active, members, revisions, boreholes, collars, axes.withColumn("axis_id", F.col("dataset_revision_id"))


CATALOGUE_SQL = f"""{SITES_SQL}, ax AS (SELECT o_custkey, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders GROUP BY 1),
cat AS (SELECT hole_id, coalesce(CASE WHEN hole_id % 3 = 0 THEN hole_name END, project, '') AS project, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, a AS scan_from_m, b AS scan_to_m,
  CASE WHEN hole_id % 2 = 0 THEN 'scanner' ELSE '' END AS instrument FROM sites JOIN customer ON c_custkey = hole_id JOIN ax ON o_custkey = hole_id WHERE c_nationkey = 3)"""


def _catalogue(spark, folder):
    found = relations.release_catalogue(*_release_tables(spark, folder))
    return found.withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})


@query("release_catalogue", f"WITH {CATALOGUE_SQL} SELECT * FROM cat")
def release_catalogue(spark, folder):
    return _catalogue(spark, folder).select("hole_id", "project", "latitude", "longitude", "scan_from_m", "scan_to_m", "instrument")


@query("release_catalogue_in_box", f"WITH {CATALOGUE_SQL} SELECT DISTINCT hole_id, latitude, longitude FROM cat WHERE longitude BETWEEN 116 AND 122 AND latitude BETWEEN -33 AND -18")
def release_catalogue_in_box(spark, folder):
    return paging.in_box(_catalogue(spark, folder), 116, -33, 122, -18).select("hole_id", "latitude", "longitude").distinct()


@query("hole_list_page", f"WITH {SITES_SQL} SELECT hole_id, hole_name FROM sites WHERE lower(hole_name) LIKE '%7%' AND hole_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ORDER BY hole_id LIMIT 200")
def hole_list_page(spark, folder):
    found = paging.matching(sites(spark, folder), "7", ["hole_name"])
    flagged = table(spark, folder, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("hole_id"))
    return paging.top(relations.semi(found, flagged, ["hole_id"]).select("hole_id", "hole_name"), ["hole_id"], 200)


@query("nearby_holes", f"""WITH {SITES_SQL}, p AS (SELECT n_nationkey AS point, -30.0 + n_nationkey * 0.4 AS la, 117.0 + n_nationkey * 0.3 AS lo FROM nation),
d AS (SELECT point, hole_id, round({km_sql("la", "lo", "latitude", "longitude")}, 6) AS km FROM p, sites), r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, hole_id) AS place FROM d WHERE km <= 60)
SELECT point, hole_id, round(km, 4) AS distance_km FROM r WHERE place <= 20""")
def nearby_holes(spark, folder):
    """The 20 nearest holes within 60 km of each point."""
    from stratalog.operators.ordered import top_per_key

    n = F.col("n_nationkey")
    points = table(spark, folder, "nation").select(n.alias("point"), (F.lit(-30.0) + n * 0.4).alias("at_lat"), (F.lit(117.0) + n * 0.3).alias("at_lon"))
    near = neighbours.within_radius(points, sites(spark, folder), 60.0).withColumn("km", F.round("distance_km", 6))
    best = top_per_key(near.select("point", "hole_id", "km"), ["point"], [F.col("km"), F.col("hole_id")], 20)
    return best.select("point", "hole_id", F.round("km", 4).alias("distance_km"))


@query("datasets_of_holes", "SELECT c_custkey AS hole_id, o_orderkey AS dataset_id, o_orderstatus AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3")
def datasets_of_holes(spark, folder):
    holes = table(spark, folder, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("hole_id"))
    datasets = table(spark, folder, "orders").select(F.col("o_custkey").alias("hole_id"), F.col("o_orderkey").alias("dataset_id"), F.col("o_orderstatus").alias("status"))
    return holes.join(datasets, "hole_id", "left")


def _logs(spark, folder):
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("log_id"), (key % 50).alias("dataset_revision_id"), F.element_at(F.array(F.lit("scalar"), F.lit("spectral"), F.lit("profile")), (key % 3 + 1).cast("int")).alias("log_kind"),
        F.when(key % 2 == 0, "mineral_group").otherwise("snr").alias("metric_key"), F.concat(F.lit("Grp1 s"), F.when(key % 4 == 0, "TSAT").otherwise("TSAS")).alias("source_log_name"),
        F.when(key % 7 == 0, "metadata_only").otherwise("payload_present").alias("availability_status"), (key % 5).alias("interpretation_set_id"), (key % 3).alias("spectral_stream_id"), "p_size",
    )


def _full_logs(spark, folder):
    logs = _logs(spark, folder)
    bindings = logs.where("log_id % 11 <> 0").select("log_id", (F.col("log_id") % 50).alias("axis_id"), F.when(F.col("log_id") % 13 == 0, "pending").otherwise("verified").alias("status"))
    sets = logs.select("interpretation_set_id").distinct().where("interpretation_set_id > 0").withColumn("output_region", F.when(F.col("interpretation_set_id") == 2, "TIR").otherwise("SWIR"))
    streams = logs.select("spectral_stream_id").distinct().withColumn("region_code", F.concat(F.lit("R"), F.col("spectral_stream_id").cast("string")))
    metrics = logs.select("dataset_revision_id", "metric_key").distinct().withColumn("is_probability", F.col("metric_key") == "snr")
    return relations.log_catalogue(logs, bindings, sets, streams, metrics)


LOGS_SQL = """logs AS (SELECT p_partkey AS log_id, p_partkey % 50 AS dataset_revision_id, ['scalar', 'spectral', 'profile'][p_partkey % 3 + 1] AS log_kind, CASE WHEN p_partkey % 2 = 0 THEN 'mineral_group' ELSE 'snr' END AS metric_key,
 'Grp1 s' || CASE WHEN p_partkey % 4 = 0 THEN 'TSAT' ELSE 'TSAS' END AS source_log_name, CASE WHEN p_partkey % 7 = 0 THEN 'metadata_only' ELSE 'payload_present' END AS availability_status,
 CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 50 END AS axis_id, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'pending' ELSE 'verified' END AS binding_status,
 CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 2 THEN 'TIR' ELSE 'SWIR' END AS output_region, 'R' || p_partkey % 3 AS spectral_region, p_partkey % 2 = 1 AS is_probability FROM part)"""


@query("log_catalogue", f"WITH {LOGS_SQL} SELECT * FROM logs")
def log_catalogue(spark, folder):
    return _full_logs(spark, folder).select(
        "log_id", "dataset_revision_id", "log_kind", "metric_key", "source_log_name", "availability_status", "axis_id", "binding_status", "output_region", "spectral_region", "is_probability"
    )


@query("log_statuses", f"""WITH {LOGS_SQL} SELECT log_id, CASE WHEN availability_status <> 'payload_present' THEN 'metadata_only' WHEN binding_status IS DISTINCT FROM 'verified' THEN 'axis_binding_unavailable' ELSE 'available' END AS status FROM logs""")
def log_statuses(spark, folder):
    return _full_logs(spark, folder).select("log_id", log_status().alias("status"))


@query("mineral_group_logs", f"""WITH {LOGS_SQL}, u AS (SELECT *, coalesce(output_region, '') = 'TIR' OR source_log_name LIKE '%TSAT%' AS tir FROM logs WHERE availability_status = 'payload_present' AND binding_status = 'verified' AND log_kind = 'scalar' AND metric_key = 'mineral_group')
SELECT dataset_revision_id, arg_min(log_id, (source_log_name, log_id)) FILTER (NOT tir) AS swir_log, arg_min(log_id, (source_log_name, log_id)) FILTER (tir) AS tir_log FROM u GROUP BY 1""")
def mineral_group_logs(spark, folder):
    logs = _full_logs(spark, folder)
    pick = lambda region, name: group_log(logs, by=["dataset_revision_id"], region=region).select("dataset_revision_id", F.col("log_id").alias(name))
    return pick("SWIR", "swir_log").join(pick("TIR", "tir_log"), "dataset_revision_id", "full")


@query("one_log_per_channel_count", f"WITH {LOGS_SQL} SELECT dataset_revision_id, l.p_size AS channels, min(log_id) AS log_id FROM logs JOIN part l ON l.p_partkey = log_id WHERE log_kind = 'spectral' AND p_size % 2 = 0 GROUP BY 1, 2")
def one_log_per_channel_count(spark, folder):
    spectral = _logs(spark, folder).where("log_kind = 'spectral' and p_size % 2 = 0").select("dataset_revision_id", F.col("p_size").alias("channels"), "log_id")
    return profiles.first_per_key(spectral, key=["dataset_revision_id", "channels"], order=["log_id"])


def _values(spark, folder, hole):
    s = scan(spark, folder, hole)
    return s.select(
        F.col("hole").alias("log_id"), F.col("hole").alias("axis_id"), "sample_no", F.col("depth_h").alias("depth_m"), F.when(F.col("k") % 5 > 0, F.col("value")).alias("value_numeric"), F.lit(None).cast("string").alias("value_text")
    )


@query("scalar_values_page", f"""WITH {SCAN_SQL}, h AS (SELECT min(hole) AS h FROM scan),
r AS (SELECT s.sample_no, CASE WHEN k % 5 > 0 THEN value END AS value_numeric, CASE WHEN k % 5 > 0 THEN 'available' ELSE 'source_null' END AS status FROM scan s JOIN h ON s.hole = h.h WHERE depth_h BETWEEN 50 AND 600 AND sample_no > 3),
p AS (SELECT *, row_number() OVER (ORDER BY sample_no) AS n, count(*) OVER () AS c FROM r)
SELECT sample_no, value_numeric, status, CASE WHEN c > 20 THEN (SELECT sample_no FROM p WHERE n = 20) END AS next_after FROM p WHERE n <= 20""")
def scalar_values_page(spark, folder):
    first = table(spark, folder, "events").agg(F.min("user_id")).first()[0]
    values = _values(spark, folder, first)
    logs = readings(spark, folder).select(F.col("hole").alias("log_id"), F.col("hole").alias("axis_id")).distinct().withColumns({"availability_status": F.lit("payload_present"), "binding_status": F.lit("verified")})
    page = log_values(values, logs, log_id=first, axis_id=first, start=50, end=600, after=3, limit=20)
    return page.select("sample_no", "value_numeric", "status", "next_after")


@query("profile_values_page", f"""WITH {SCAN_SQL}, h AS (SELECT max(hole) AS h FROM scan), r AS (SELECT sample_no, value FROM scan JOIN h ON hole = h WHERE depth_h <= 400)
SELECT sample_no, round(value, 6) AS first_channel, 'available_uncalibrated_profile' AS status FROM r ORDER BY sample_no LIMIT 10""")
def profile_values_page(spark, folder):
    last = table(spark, folder, "events").agg(F.max("user_id")).first()[0]
    s = scan(spark, folder, last)
    rows = s.select(F.col("hole").alias("log_id"), "sample_no", F.array("value", "value").alias("values"))
    page = profile_values(rows.where(F.col("log_id") == last), s.select(F.col("hole").alias("axis_id"), "sample_no", F.col("depth_h").alias("md_m")), log_id=last, axis_id=last, end=400, limit=10)
    return page.select("sample_no", F.round(F.get("values", F.lit(0)), 6).alias("first_channel"), "status")


@query("sample_results", f"""WITH {SCAN_SQL}, mid AS (SELECT hole, count(*) // 2 AS m FROM scan GROUP BY 1), l AS (SELECT hole, i FROM mid, range(0, 4) r(i))
SELECT l.hole AS axis_id, m AS sample_no, l.hole * 10 + i AS log_id,
 CASE WHEN i = 1 THEN 'metadata_only' WHEN i = 2 AND l.hole % 4 > 0 THEN 'spectral_mapping_unavailable' WHEN i = 2 THEN 'available' WHEN i = 3 AND l.hole % 2 = 0 THEN 'axis_binding_unavailable' WHEN i = 3 THEN 'sample_result_unavailable' WHEN k % 5 = 0 THEN 'source_null' ELSE 'available' END AS status,
 CASE WHEN i = 0 AND k % 5 > 0 THEN value END AS value_numeric, CASE WHEN i = 2 AND l.hole % 4 = 0 THEN 1 ELSE 0 END AS odd FROM l JOIN mid ON mid.hole = l.hole JOIN scan s ON s.hole = l.hole AND s.sample_no = m""")
def sample_results_query(spark, folder):
    s = scan(spark, folder)
    mid = s.groupBy("hole").agg(F.floor(F.count(F.lit(1)) / 2).alias("sample_no"))
    h, i = F.col("hole"), F.col("i")
    logs = mid.select("hole", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select(
        (h * 10 + i).alias("log_id"), h.alias("dataset_axis_id"), F.when((i == 3) & (h % 2 == 0), h + 1).otherwise(h).alias("axis_id"), F.lit("verified").alias("binding_status"),
        F.when(i == 1, "metadata_only").otherwise("payload_present").alias("availability_status"), F.when(i == 2, "spectral").otherwise("scalar").alias("log_kind"),
    )
    scalars = s.select((h * 10).alias("log_id"), "sample_no", F.when(F.col("k") % 5 > 0, F.col("value")).alias("value_numeric"), F.lit(None).cast("string").alias("value_text"))
    curves = s.where("hole % 4 = 0").select((h * 10 + 2).alias("log_id"), "sample_no", F.array("value", F.lit(float("nan"))).alias("values"))
    found = sample_results(logs, scalars, curves, mid.select(h.alias("axis_id"), "sample_no"))
    return found.select("axis_id", "sample_no", "log_id", "status", "value_numeric", F.greatest(F.coalesce(F.size("nonfinite_channels"), F.lit(0)), F.lit(0)).alias("odd"))


@query("issues_of_revisions", "SELECT o_custkey AS dataset_revision_id, o_orderpriority AS code, o_orderkey AS scope FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'")
def issues_of_revisions(spark, folder):
    issues = table(spark, folder, "orders").select(F.col("o_custkey").alias("dataset_revision_id"), F.col("o_orderpriority").alias("code"), F.col("o_orderkey").alias("scope"))
    return issues.where(F.col("code").rlike("^[12]"))


FLAGS = ["insufficient data", "normal", "watch", "elevated", "high"]


@query(
    "anomaly_page",
    f"""WITH {SCALED_SQL},
ranked AS (SELECT *, 100.0 * (row_number() OVER (ORDER BY robust_distance, hole, depth_from_m) - 1) / greatest(count(*) OVER () - 1, 1) AS score FROM normed),
flagged AS (SELECT hole, depth_from_m, CASE WHEN hole % 9 = 4 THEN 'insufficient data' WHEN coverage < 0.30 THEN 'insufficient data' WHEN score < 95 THEN 'normal' WHEN max_z >= 6 THEN 'high' WHEN max_z >= 4 THEN 'elevated' ELSE 'watch' END AS flag FROM ranked),
numbered AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY hole, depth_from_m) AS place, count(*) OVER (PARTITION BY flag) AS n FROM flagged WHERE depth_from_m + 120 >= 240 AND depth_from_m <= 6000)
SELECT flag, (place - 1) // 10 AS page, CAST(hole AS BIGINT) AS hole_id, depth_from_m, n > 10 * ((place - 1) // 10 + 1) AS more FROM numbered WHERE place <= 20""",
)
def anomaly_page(spark, folder):
    """Two pages of every flag from written anomaly scores, the second beyond the place where the first ends."""
    scored, _ = scaled_table(spark, folder)
    ranked = scoring.combined_rank(scored, ["robust_distance"], ["hole", "depth_from_m"], "score")
    covered = F.when(F.col("hole") % 9 == 4, 0.0).otherwise(F.col("coverage"))
    rows = ranked.withColumn("coverage", covered).withColumn("flag", scoring.flag("score", "coverage", "max_z"))
    path = scratch(spark, "anomalies")
    rows = rows.select(F.col("hole").cast("long").alias("hole_id"), "depth_from_m", "depth_to_m", "flag", "robust_distance", "max_z")
    sinks.write_anomalies(rows, rows.groupBy("hole_id").agg(F.max("max_z").alias("max_z")), path)
    stored = spark.read.parquet(f"{path}/anomalies")
    pages = []
    for flag in FLAGS:
        after = None
        for number in range(2):
            page = settle_table(anomalies_of(stored, flag=flag, start=240, end=6000, after=after, limit=10), "page")
            pages.append(page.select("flag", F.lit(number).cast("long").alias("page"), "hole_id", "depth_from_m", F.col("next_after").isNotNull().alias("more")))
            first = page.first()  # a page: at most ten rows
            after = first["next_after"] if first else None
            if after is None:
                break
    every = pages[0]
    for page in pages[1:]:
        every = every.unionByName(page)
    return every


@query("spectra_nearest_depth", f"""WITH {SCAN_SQL}, n AS (SELECT hole, arg_min(sample_no, (abs(depth_h - 300), sample_no)) AS s FROM scan GROUP BY 1)
SELECT n.hole, s AS sample_no, event_type AS mineral, round(value, 6) AS first_channel FROM n JOIN scan ON scan.hole = n.hole AND scan.sample_no = s""")
def spectra_nearest_depth(spark, folder):
    s = scan(spark, folder)
    targets = s.select("hole").distinct().withColumns({"target_id": F.lit(0).cast("long"), "depth": F.lit(300.0)})
    near = intervals.nearest(targets, s, key=["hole"], at="depth", sample_at="depth_h", sample_id="sample_no", target_id="target_id")
    return near.select("hole", "sample_no").join(s.select("hole", "sample_no", F.col("event_type").alias("mineral"), F.round("value", 6).alias("first_channel")), ["hole", "sample_no"])


@query("core_strip_rows", f"""WITH {SCAN_SQL}, c AS (SELECT hole, sample_no // 5 AS ordinal, min(sample_no) AS a FROM scan GROUP BY 1, 2)
SELECT hole, ordinal, a AS sample_no_from, a // 20 AS image_region_id, a // 20 % 2 = 1 AS flip FROM c WHERE a // 20 % 3 > 0""")
def core_strip_rows(spark, folder):
    s = scan(spark, folder)
    sections = s.groupBy("hole", F.floor(F.col("sample_no") / 5).alias("ordinal")).agg(F.min("sample_no").alias("sample_no_from"))
    region = F.floor(F.col("sample_no") / 20).alias("image_region_id")
    maps = s.groupBy("hole", region).agg(F.min("sample_no").alias("sample_no_from"), F.max("sample_no").alias("sample_no_to"))
    r = F.col("image_region_id")
    maps = maps.withColumns({"status": F.when(r % 3 == 0, "missing").otherwise("available"), "width_px": F.lit(400), "height_px": F.lit(25), "source_depth_direction": F.when(r % 2 == 1, "Right to left").otherwise("left to right")})
    return geometry.core_strip(sections, maps, key=["hole"]).select("hole", "ordinal", "sample_no_from", "image_region_id", "flip")


@query("marked_images", f"""WITH {SCAN_SQL}, m AS (SELECT hole, sample_no // 20 AS r, min(sample_no) AS a, max(sample_no) AS b FROM scan GROUP BY 1, 2)
SELECT s.hole, s.sample_no, m.r AS image_region_id, round(CASE WHEN b > a THEN (s.sample_no - a) / (b - a) ELSE 0.5 END, 6) AS p FROM scan s JOIN m ON m.hole = s.hole AND s.sample_no BETWEEN a AND b""")
def marked_images(spark, folder):
    s = scan(spark, folder)
    maps = s.groupBy("hole", F.floor(F.col("sample_no") / 20).alias("image_region_id")).agg(F.min("sample_no").alias("a"), F.max("sample_no").alias("b"))
    found = intervals.covering(s.select("hole", "sample_no"), maps, key=["hole"], at="sample_no", lo="a", hi="b")
    return found.select("hole", "sample_no", "image_region_id", F.round(image_position("sample_no", "a", "b"), 6).alias("p"))


@query("release_summary", "SELECT 3 AS release_id, count(*) AS datasets, min(c_custkey) AS first_dataset FROM customer WHERE c_nationkey = 3")
def release_summary(spark, folder):
    active, members, *_ = _release_tables(spark, folder)
    current = members.join(F.broadcast(active), "release_id")
    return current.groupBy("release_id").agg(F.count(F.lit(1)).alias("datasets"), F.min("dataset_revision_id").alias("first_dataset"))


@query("full_spectrum_flags", "SELECT vec_id, vec_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1) AS has_full_spectrum FROM embeddings")
def full_spectrum_flags(spark, folder):
    known = table(spark, folder, "customer").where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("vec_id")).withColumn("_k", F.lit(True))
    return spectra(spark, folder).select("vec_id").join(known, "vec_id", "left").select("vec_id", F.coalesce("_k", F.lit(False)).alias("has_full_spectrum"))
