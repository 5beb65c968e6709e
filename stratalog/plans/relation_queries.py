"""Catalogue joins, set operations, aggregates, paging and geometry over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import fixed, geo, hashing, numbers, text
from stratalog.operators import align, geometry, intervals, neighbours, paging, profiles, relations
from stratalog.plans.call_queries import DAILY_RUNS_SQL, DAILY_SQL, daily, daily_runs, days_bound
from stratalog.plans.registry import query
from stratalog.plans.views import LENGTH_H, MEMBERS_SQL, SCAN_SQL, SITES_SQL, km_sql, members, sample_block, scan, sites, spectra
from stratalog.session import table

# ---------------------------------------------------------------- joins


@query(
    "aligned_line_copies",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey, l_quantity, l_shipdate) AS k FROM lineitem WHERE l_suppkey % 10 <> 0)
SELECT a.l_orderkey, a.l_linenumber, a.k AS occurrence, a.l_partkey AS axis_part, b.l_partkey AS log_part
FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.k = b.k""",
)
def aligned_line_copies(spark, folder):
    aligned, _ = _line_copies(spark, folder)
    return aligned.select("l_orderkey", "l_linenumber", "occurrence", "axis_part", "log_part")


def _line_copies(spark, folder):
    items = table(spark, folder, "lineitem")
    rest = ["l_suppkey", "l_quantity", "l_shipdate"]
    axis = items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("axis_part"), "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    log = items.where("l_suppkey % 10 <> 0").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("log_part"), *rest, "l_extendedprice")
    log = log.select("l_orderkey", "l_linenumber", "log_part", F.col("l_extendedprice").alias("price"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.col("l_shipdate").alias("d"))
    return align.align_to_axis(
        log, axis, on=["l_orderkey", "l_linenumber"], log_order=["price", "log_part", "s", "q", "d"],
        axis_order=["axis_part", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"],
    )


@query(
    "lines_off_axis",
    """SELECT l_orderkey, l_linenumber FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem a WHERE a.l_returnflag = 'R' AND a.l_orderkey = l.l_orderkey AND a.l_linenumber = l.l_linenumber)""",
)
def lines_off_axis(spark, folder):
    items = table(spark, folder, "lineitem")
    return align.log_off_axis(items.select("l_orderkey", "l_linenumber"), items.where("l_returnflag = 'R'"), on=["l_orderkey", "l_linenumber"])


@query(
    "sites_near_points",
    f"""WITH {SITES_SQL}, p AS (SELECT n_nationkey AS point, -34.0 + n_nationkey * 0.7 AS at_lat, 115.5 + n_nationkey * 0.5 AS at_lon FROM nation)
SELECT point, hole_id, round({km_sql("at_lat", "at_lon", "latitude", "longitude")}, 4) AS distance_km FROM p, sites
WHERE {km_sql("at_lat", "at_lon", "latitude", "longitude")} <= 100""",
)
def sites_near_points(spark, folder):
    points = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("point"), (F.lit(-34.0) + F.col("n_nationkey") * 0.7).alias("at_lat"), (F.lit(115.5) + F.col("n_nationkey") * 0.5).alias("at_lon")
    )
    found = neighbours.within_radius(points, sites(spark, folder), 100.0)
    return found.select("point", "hole_id", F.round("distance_km", 4).alias("distance_km"))


@query(
    "distance_of_two_holes",
    f"""WITH {SITES_SQL}, e AS (SELECT min(hole_id) AS a, max(hole_id) AS b FROM sites)
SELECT e.a, e.b, round({km_sql("x.latitude", "x.longitude", "y.latitude", "y.longitude")}, 4) AS distance_km
FROM e JOIN sites x ON x.hole_id = e.a JOIN sites y ON y.hole_id = e.b""",
)
def distance_of_two_holes(spark, folder):
    s = sites(spark, folder)
    first, last = s.agg(F.min("hole_id"), F.max("hole_id")).first()
    return relations.hole_distance(s, first, last).withColumn("distance_km", F.round("distance_km", 4))


@query("holes_with_large_orders", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def holes_with_large_orders(spark, folder):
    flagged = table(spark, folder, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return relations.semi(table(spark, folder, "customer"), flagged, ["c_custkey"]).select("c_custkey", "c_name")


@query("holes_without_orders", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def holes_without_orders(spark, folder):
    known = table(spark, folder, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return relations.anti(table(spark, folder, "customer"), known, ["c_custkey"]).select("c_custkey", "c_name")


def _changed_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = orders.where("o_orderkey % 11 <> 3").select(
        F.when(F.col("o_orderkey") % 13 == 5, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return orders, changed


CHANGED_SQL = """changed AS (
  SELECT CASE WHEN o_orderkey % 13 = 5 THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus
  FROM orders WHERE o_orderkey % 11 <> 3)"""


@query(
    "table_differences",
    f"""WITH {CHANGED_SQL}
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only left' WHEN a.o_orderkey IS NULL THEN 'only right' ELSE 'differs' END AS difference
FROM orders a FULL JOIN changed b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""",
)
def table_differences(spark, folder):
    a, b = _changed_orders(spark, folder)
    return relations.table_difference(a, b, key=["o_orderkey"], columns=["o_totalprice", "o_orderstatus"])


@query(
    "conflicting_orders",
    f"""WITH {CHANGED_SQL} SELECT a.o_orderkey FROM orders a JOIN changed b ON a.o_orderkey = b.o_orderkey
WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""",
)
def conflicting_orders(spark, folder):
    a, b = _changed_orders(spark, folder)
    return relations.conflicts(a, b, key=["o_orderkey"], columns=["o_totalprice", "o_orderstatus"])


@query(
    "manifest_reconciliation",
    """WITH m AS (SELECT o_orderkey AS path, o_orderstatus, o_orderkey % 8 AS nbytes FROM orders), f AS (SELECT l_orderkey AS path, count(*) AS size FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(m.path, f.path) AS path, o_orderstatus AS st, nbytes, size FROM m FULL JOIN f ON m.path = f.path)
SELECT path, 'missing' AS finding FROM j WHERE st = 'F' AND size IS NULL
UNION ALL SELECT path, 'size differs' FROM j WHERE st = 'F' AND size IS DISTINCT FROM nbytes AND size IS NOT NULL
UNION ALL SELECT path, 'marked absent but present' FROM j WHERE st = 'O' AND size IS NOT NULL
UNION ALL SELECT path, 'incomplete record' FROM j WHERE st = 'P'
UNION ALL SELECT path, 'unlisted file' FROM j WHERE (st = 'P' OR st IS NULL) AND size IS NOT NULL""",
)
def manifest_reconciliation(spark, folder):
    status = F.create_map(F.lit("F"), F.lit("complete"), F.lit("O"), F.lit("unavailable"), F.lit("P"), F.lit("failed"))
    manifest = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("path"), F.try_element_at(status, F.col("o_orderstatus")).alias("status"), (F.col("o_orderkey") % 8).alias("nbytes")
    )
    listing = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.count(F.lit(1)).alias("size"))
    found = relations.reconcile(manifest, listing, key=["path"])
    return found.select(F.col("path").cast("long").alias("path"), "finding")


@query(
    "resolved_hole_places",
    f"""WITH {SITES_SQL},
collar AS (SELECT hole_id, longitude AS lon, latitude AS lat, CASE WHEN hole_id % 2 = 0 THEN -60.0 END AS dip FROM sites WHERE hole_id % 3 <> 0)
SELECT s.hole_id, round(CASE WHEN s.hole_id % 5 = 0 THEN c.lon ELSE s.longitude END, 6) AS lon, round(s.latitude, 6) AS lat, CAST(coalesce(c.dip, -90.0) AS DOUBLE) AS dip,
  concat_ws(',', CASE WHEN s.hole_id % 5 = 0 AND c.lon IS NOT NULL THEN 'lon' END, CASE WHEN c.dip IS NULL THEN 'dip=vertical' END) AS filled
FROM sites s LEFT JOIN collar c ON c.hole_id = s.hole_id""",
)
def resolved_hole_places(spark, folder):
    s = sites(spark, folder)
    holes = s.select(
        F.col("hole_id").cast("string").alias("hole_id"), F.col("hole_name").alias("name"), F.when(F.col("hole_id") % 5 != 0, F.col("longitude")).alias("lon"),
        F.col("latitude").alias("lat"), F.lit(10.0).alias("elevation"), F.lit(100.0).alias("total"),
    )
    collars = s.where("hole_id % 3 <> 0").select(
        F.concat(F.upper("hole_name"), F.lit(" [chips]")).alias("name"), F.col("hole_id").alias("position"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"),
        F.lit(1.0).alias("elevation"), F.lit(1.0).alias("total"), F.when(F.col("hole_id") % 2 == 0, F.lit(-60.0)).alias("dip"), F.lit(None).cast("double").alias("azimuth"),
    )
    found = relations.resolve_places(holes, collars)
    return found.select(F.col("hole_id").cast("long").alias("hole_id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "dip", F.array_join("filled", ",").alias("filled"))


@query(
    "lookup_with_fallback",
    """WITH a AS (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(coalesce(a.d, b.d) AS DATE) AS d FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey""",
)
def lookup_with_fallback(spark, folder):
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("d"), "l_returnflag")
    latest = lambda df: df.groupBy("o_orderkey").agg(F.max("d").alias("d"))
    orders = table(spark, folder, "orders").select("o_orderkey")
    return relations.with_fallback(orders, latest(items.where("l_returnflag = 'R'")), latest(items), on=["o_orderkey"], columns=["d"])


MEMBERSHIP_SQL = """official AS (SELECT DISTINCT l_suppkey AS dataset_id, l_partkey AS log_id, CASE WHEN l_returnflag = 'R' AND l_quantity > 48 THEN 'scalar' ELSE 'spectral' END AS kind FROM lineitem),
local AS (SELECT p_partkey AS log_id, CASE WHEN p_size % 2 = 0 THEN 'scalar' ELSE 'spectral' END AS kind FROM part)"""


def _membership(spark, folder):
    """Logs that every line assigns to its supplier, of a kind by return flag and quantity, and the log of every part, of the kind of its size."""
    kind = lambda scalar: F.when(scalar, "scalar").otherwise("spectral").alias("kind")
    official = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("dataset_id"), F.col("l_partkey").alias("log_id"), kind((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48))
    ).distinct()
    local = table(spark, folder, "part").select(F.col("p_partkey").alias("log_id"), kind(F.col("p_size") % 2 == 0))
    return local, official


@query("logs_of_several_datasets", f"WITH {MEMBERSHIP_SQL} SELECT l.kind, l.log_id, count(DISTINCT dataset_id) AS datasets FROM local l JOIN official o ON l.log_id = o.log_id AND l.kind = o.kind GROUP BY 1, 2 HAVING count(DISTINCT dataset_id) > 1")
def logs_of_several_datasets(spark, folder):
    return relations.membership(*_membership(spark, folder))[2]


@query("official_logs_not_held", f"WITH {MEMBERSHIP_SQL} SELECT o.dataset_id, o.log_id, o.kind FROM official o LEFT JOIN local l ON l.log_id = o.log_id AND l.kind = o.kind WHERE l.log_id IS NULL")
def official_logs_not_held(spark, folder):
    return relations.membership(*_membership(spark, folder))[1].select("dataset_id", "log_id", "kind")


@query("unassigned_logs", f"WITH {MEMBERSHIP_SQL} SELECT l.log_id, l.kind FROM local l LEFT JOIN official o ON l.log_id = o.log_id AND l.kind = o.kind WHERE o.log_id IS NULL")
def unassigned_logs(spark, folder):
    return relations.unassigned(*_membership(spark, folder)).select("log_id", "kind")


@query(
    "profiles_matched_to_datasets",
    f"""WITH {SCAN_SQL},
bad AS (SELECT hole, max(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS b FROM scan GROUP BY 1)
SELECT hole, 'd' || i AS dataset_id, CASE WHEN i = 0 THEN 1 WHEN b = 1 THEN 0 ELSE 1 END::BIGINT AS matches,
       CASE WHEN i = 0 THEN 'p0' WHEN b = 1 THEN NULL ELSE 'p1' END AS profile_id FROM bad, range(0, 2) r(i)""",
)
def profiles_matched_to_datasets(spark, folder):
    samples = scan(spark, folder)
    minima = samples.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1))))
    minima = minima.select("hole", F.concat(F.lit("p"), F.col("p").cast("string")).alias("profile_id"), "sample_no", (F.col("value") + F.col("p") * 1000).alias("positive_min"))
    off = F.when((F.col("p") == 1) & (F.col("k") == 0), 0.5).otherwise(0.00005)
    refs = samples.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1))))
    refs = refs.select("hole", F.concat(F.lit("d"), F.col("p").cast("string")).alias("dataset_id"), F.lit("l").alias("log_id"), "sample_no", (F.col("value") + F.col("p") * 1000 + off).alias("value"))
    return relations.match_profiles(minima, refs, hole=["hole"])


@query(
    "profiles_by_unique_count",
    """WITH d AS (SELECT c_nationkey AS hole, c_custkey AS dataset_id, n AS sample_count FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
u AS (SELECT hole, sample_count, min(dataset_id) AS dataset_id FROM d GROUP BY 1, 2 HAVING count(*) = 1)
SELECT hole, dataset_id, dataset_id + 1000000 AS log_id, sample_count FROM u""",
)
def profiles_by_unique_count(spark, folder):
    counts = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("dataset_id")).agg(F.count(F.lit(1)).alias("sample_count"))
    named = table(spark, folder, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_nationkey").alias("hole"))
    datasets = counts.join(named, "dataset_id")
    logs = datasets.select("hole", (F.col("dataset_id") + 1000000).alias("log_id"), "sample_count")
    return relations.unique_by_count(logs, datasets, hole=["hole"])


@query(
    "overlapping_order_windows",
    """WITH w AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS lo FROM orders),
r AS (SELECT *, max(lo + 20) OVER (PARTITION BY o_custkey ORDER BY lo, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM w)
SELECT o_custkey, o_orderkey, lo, reached FROM r WHERE lo <= reached""",
)
def overlapping_order_windows(spark, folder):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    windows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", day.alias("lo"), (day + 20).alias("hi"))
    found = intervals.self_overlaps(windows, key=["o_custkey"], lo="lo", hi="hi", order=["o_orderkey"])
    return found.select("o_custkey", "o_orderkey", "lo", "reached")


@query(
    "overlapping_rectangles",
    """WITH r AS (SELECT o_custkey AS f, o_orderkey AS id, o_orderkey % 50 AS x, o_orderkey * 7 % 400 AS y FROM orders)
SELECT a.f, a.id AS a, b.id AS b FROM r a JOIN r b ON a.f = b.f AND a.id < b.id AND a.x < b.x + 20 AND b.x < a.x + 20 AND a.y < b.y + 30 AND b.y < a.y + 30""",
)
def overlapping_rectangles(spark, folder):
    regions = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).alias("x"), (F.col("o_orderkey") * 7 % 400).alias("y"),
        F.lit(20).alias("width"), F.lit(30).alias("height"),
    )
    return intervals.rectangle_pairs(regions, frame=["f"], ident="id")


@query(
    "payload_files",
    """SELECT p_partkey AS log_id, CASE WHEN p_partkey % 3 = 0 THEN 'listed/' || p_partkey WHEN p_partkey % 3 = 1 THEN 'scalars/' || p_partkey || '_a.csv' END AS path FROM part""",
)
def payload_files(spark, folder):
    logs = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("log_id"), F.col("p_partkey").alias("k"))
    manifest = logs.where("k % 3 = 0").select("log_id", F.concat(F.lit("listed/"), "log_id").alias("file"))
    named = logs.select("log_id", "k", F.explode(F.array(F.lit("_a.csv"), F.lit("_b.csv"), F.lit("_c.part"))).alias("e"))
    keep = (F.col("e") == "_a.csv") | (F.col("e") == "_c.part") | (F.col("k") % 3 == 2)
    files = named.where(keep).select(F.concat(F.lit("scalars/"), "log_id", "e").alias("path")).unionByName(manifest.select(F.col("file").alias("path")))
    return relations.payload_files(logs.select("log_id"), manifest, files).select(F.col("log_id").cast("long").alias("log_id"), "path")


@query(
    "trace_points_with_calls",
    f"""WITH {DAILY_SQL},
ends AS (SELECT hole, greatest(720.0, max(depth_to_m)) AS len FROM daily GROUP BY 1),
p AS (SELECT hole, point, point * 37.0::DOUBLE AS d FROM (SELECT hole, unnest(range(0, CAST(ceil(len / 37) AS BIGINT))) AS point FROM ends)
  UNION ALL SELECT hole, CAST(ceil(len / 37) AS BIGINT), len FROM ends)
SELECT p.hole, CAST(point AS INTEGER) AS point, d AS depth_m, round_even(d * 0.5, 3) AS east_m, coalesce(call, '') AS mineral FROM p
LEFT JOIN daily x ON x.hole = p.hole AND d >= depth_from_m AND d < depth_to_m""",
)
def trace_points_with_calls(spark, folder):
    holes = daily(spark, folder).groupBy(F.col("hole").alias("hole_id")).agg(F.greatest(F.lit(LENGTH_H), F.max("depth_to_m")).alias("drawn_length_m"))
    holes = holes.select("hole_id", F.lit(-60.0).alias("inclination_deg"), F.lit(90.0).alias("azimuth_deg"), "drawn_length_m")
    points = geometry.trace_points(holes, step=37.0)
    measured = daily(spark, folder).select(
        F.col("hole").alias("hole_id"), "depth_from_m", "depth_to_m", F.col("call").alias("mineral"), "confidence", F.lit(0.0).alias("anomaly_score"), F.lit(False).alias("is_anomaly")
    )
    found = geometry.trace_with_calls(points, measured)
    return found.select(F.col("hole_id").alias("hole"), "point", "depth_m", "east_m", "mineral")


@query(
    "trace_segments_in_space",
    f"""WITH {DAILY_RUNS_SQL}, {SITES_SQL.strip()},
seg AS (
  SELECT hole, depth_from_m AS a, depth_to_m AS b, coalesce(call, 'uncertain reading') AS label FROM runs
  UNION ALL SELECT hole, a, b, 'not logged' FROM (SELECT hole, coalesce(lag(depth_to_m) OVER (PARTITION BY hole ORDER BY depth_from_m), 0) AS a, depth_from_m AS b FROM runs) WHERE b > a
  UNION ALL SELECT hole, e, 720.0, 'not logged' FROM (SELECT hole, max(depth_to_m) AS e FROM runs GROUP BY 1) WHERE e < 720)
SELECT hole, a AS from_m, b AS to_m, label, round(longitude + b * cos(radians(-60)) * sin(radians(45)) / (110540.0 * cos(radians(latitude))), 7) AS end_lon,
       round(latitude + b * cos(radians(-60)) * cos(radians(45)) / 110540.0, 7) AS end_lat, round(b * sin(radians(-60)), 5) AS end_altitude
FROM seg JOIN sites ON sites.hole_id = seg.hole""",
)
def trace_segments_in_space(spark, folder):
    runs = daily_runs(spark, folder).select(F.col("hole").alias("hole_id"), F.col("depth_from_m").alias("from_m"), F.col("depth_to_m").alias("to_m"), "call")
    drawn = runs.groupBy("hole_id").agg(F.greatest(F.lit(LENGTH_H), F.max("to_m")).alias("drawn_length_m"))
    holes = sites(spark, folder).join(drawn, "hole_id").withColumns(
        {"inclination_deg": F.lit(-60.0), "azimuth_deg": F.lit(45.0), "elevation_m": F.lit(None).cast("double")}
    )
    found = geometry.trace_segments(holes, runs, sizes=days_bound(spark, folder))
    return found.select(
        F.col("hole_id").alias("hole"), "from_m", "to_m", "label", F.round("end.lon", 7).alias("end_lon"), F.round("end.lat", 7).alias("end_lat"), F.round("end.altitude_m", 5).alias("end_altitude")
    )


# ---------------------------------------------------------------- aggregates


@query(
    "scalar_log_profile",
    f"""WITH {SCAN_SQL}, seen AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'null' WHEN k % 10 = 1 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS token, CAST(k AS DOUBLE) AS d,
  lag(k) OVER (PARTITION BY hole ORDER BY sample_no) AS p FROM scan)
SELECT hole, count(*) AS row_count, CAST(count_if(k % 10 = 0) AS BIGINT) AS null_count, CAST(count_if(k % 10 = 1) AS BIGINT) AS non_finite_count, CAST(count_if(k % 2 = 0) AS BIGINT) AS point_count,
       min(d) AS coordinate_min, max(d + k % 2) AS coordinate_max, CAST(count_if(k < p) AS BIGINT) AS decreasing_start_count, CAST(count_if(k = p) AS BIGINT) AS adjacent_equal_start_count,
       min(value) FILTER (k % 10 > 1) AS value_min, max(value) FILTER (k % 10 > 1) AS value_max FROM seen GROUP BY 1""",
)
def scalar_log_profile(spark, folder):
    token = F.when(F.col("k") % 10 == 0, "null").when(F.col("k") % 10 == 1, "NaN").otherwise(F.col("value").cast("string"))
    rows = scan(spark, folder).select("hole", "sample_no", F.col("k").cast("double").alias("start"), (F.col("k") + F.col("k") % 2).cast("double").alias("end"), token.alias("token"))
    return profiles.scalar_profile(rows, log=["hole"], source_row="sample_no", block=sample_block())


@query("category_counts", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def category_counts(spark, folder):
    return profiles.category_counts(table(spark, folder, "lineitem"), log=["l_suppkey"], token="l_returnflag")


@query(
    "elected_axes",
    f"""WITH {SCAN_SQL},
rows AS (SELECT hole, l AS log, sample_no, CASE WHEN l = 2 AND hole % 3 = 0 THEN us + 1 ELSE us END AS us FROM scan, range(0, 3) r(l) WHERE NOT (l = 1 AND hole % 5 = 0 AND sample_no = 0)),
d AS (SELECT hole, log, count(*) AS n, string_agg(CAST(us AS VARCHAR), ',' ORDER BY sample_no) AS g FROM rows GROUP BY 1, 2),
v AS (SELECT hole, n, g, count(*) AS votes, min(log) AS log FROM d GROUP BY 1, 2, 3)
SELECT hole, max(n) FILTER (votes > 1 OR total = 3) AS n, max(votes) AS votes FROM (SELECT *, count(*) OVER (PARTITION BY hole) AS total FROM v) GROUP BY 1""",
)
def elected_axes(spark, folder):
    rows = scan(spark, folder).select("hole", "sample_no", "us", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("log"))
    rows = rows.where(~((F.col("log") == 1) & (F.col("hole") % 5 == 0) & (F.col("sample_no") == 0)))
    moved = F.when((F.col("log") == 2) & (F.col("hole") % 3 == 0), F.col("us") + 1).otherwise(F.col("us"))
    rows = rows.select("hole", "log", F.col("sample_no").alias("source_row"), moved.alias("start"), moved.alias("end"))
    digests = align.axis_digests(rows, log=["hole", "log"])
    return align.elect_axis(digests, hole=["hole"], log="log").select("hole", "n", "votes")


@query(
    "collapsed_documents",
    """WITH f AS (SELECT source, sha256(text) AS h, min(doc_id) AS position, arg_min(lang, doc_id) AS label, count(*) - 1 AS duplicates FROM documents WHERE text IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY source, lower(label) ORDER BY position) AS k, count(*) OVER (PARTITION BY source, lower(label)) AS t FROM f)
SELECT source, h AS content, position, CASE WHEN t = 1 THEN label ELSE label || ' (' || k || ')' END AS column_name, duplicates FROM k""",
)
def collapsed_documents(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null").select("source", "doc_id", "lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    found = align.collapse_duplicates(docs.withColumn("filled", F.lit(1)), key=["source"], content="content", name="lang", position="doc_id", filled="filled")
    return found.select("source", "content", F.col("doc_id").alias("position"), "column_name", "duplicates")


@query(
    "hole_summaries",
    """WITH d AS (SELECT o_custkey AS hole_id, o_orderkey AS position, o_orderpriority AS name, o_orderstatus AS tool FROM orders),
t AS (SELECT hole_id, tool, min(position) AS p FROM d GROUP BY 1, 2),
x AS (SELECT o_custkey AS hole_id, count(*) AS sample_count, min(l_quantity) AS depth_from_m, max(l_quantity + 1) AS depth_to_m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS hole_id, n.dataset_count, dataset_names, instruments, x.sample_count, x.depth_from_m, x.depth_to_m, n.dataset_count AS order_count
FROM customer JOIN x ON x.hole_id = c_custkey
LEFT JOIN (SELECT hole_id, count(*) AS dataset_count, string_agg(name, '; ' ORDER BY position) AS dataset_names FROM d GROUP BY 1) n ON n.hole_id = c_custkey
LEFT JOIN (SELECT hole_id, string_agg(tool, '; ' ORDER BY p) AS instruments FROM t GROUP BY 1) i ON i.hole_id = c_custkey""",
)
def hole_summaries(spark, folder):
    orders = table(spark, folder, "orders")
    holes = table(spark, folder, "customer").select(F.col("c_custkey").alias("hole_id"))
    datasets = orders.select(F.col("o_custkey").alias("hole_id"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("dataset_name"), F.col("o_orderstatus").alias("instrument"))
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("depth_from_m"), (F.col("l_quantity") + 1).alias("depth_to_m"))
    axis = items.join(orders.select("o_orderkey", F.col("o_custkey").alias("hole_id")), "o_orderkey")
    return profiles.hole_summary(holes, datasets, axis, counts={"order_count": datasets})


def _measurements(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("hole_id"), (F.col("o_orderkey") % 100).cast("double").alias("depth_from_m"), (F.col("o_orderkey") % 100 + 1).cast("double").alias("depth_to_m"),
        (F.col("o_totalprice") > 400000).alias("is_anomaly"), (F.col("o_totalprice") / 500000).alias("confidence"),
    )


@query(
    "logged_holes",
    """WITH m AS (SELECT o_custkey, CAST(min(o_orderkey % 100) AS DOUBLE) AS a, CAST(max(o_orderkey % 100 + 1) AS DOUBLE) AS b, count(*) AS n, CAST(count_if(o_totalprice > 400000) AS BIGINT) AS x FROM orders GROUP BY 1)
SELECT c_custkey AS hole_id, a AS logged_from_m, b AS logged_to_m, coalesce(n, 0) AS measurement_count, coalesce(x, 0) AS anomaly_count, greatest(c_acctbal, b) AS drawn_length_m
FROM customer LEFT JOIN m ON o_custkey = c_custkey""",
)
def logged_holes(spark, folder):
    found = profiles.logged_holes(sites(spark, folder), _measurements(spark, folder))
    return found.select("hole_id", "logged_from_m", "logged_to_m", "measurement_count", "anomaly_count", "drawn_length_m")


@query(
    "dashboard_counts",
    "SELECT (SELECT count(*) FROM customer) AS holes, count(*) AS measurements, CAST(count_if(o_totalprice > 400000) AS BIGINT) AS anomalies, CAST(count_if(o_totalprice / 500000 < 0.5) AS BIGINT) AS low_confidence FROM orders",
)
def dashboard_counts(spark, folder):
    return profiles.dashboard(sites(spark, folder), _measurements(spark, folder))


@query("upper_medians", "WITH r AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, l_quantity AS upper_median, n FROM r WHERE k = n // 2")
def upper_medians(spark, folder):
    return profiles.upper_median(table(spark, folder, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey"), by=["l_suppkey"], value="l_quantity", tie=["l_orderkey"])


@query("first_orders", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def first_orders(spark, folder):
    return profiles.first_per_key(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), key=["o_custkey"], order=["o_orderkey"])


@query("issue_counts", "SELECT o_orderpriority AS code, o_orderstatus AS severity, count(*) AS n FROM orders GROUP BY 1, 2")
def issue_counts(spark, folder):
    issues = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("severity"))
    return profiles.issue_counts(issues, ["code", "severity"])


@query("batch_totals", "SELECT count(*) AS holes, sum(c_custkey)::BIGINT AS c_custkey, sum(c_nationkey)::BIGINT AS c_nationkey FROM customer")
def batch_totals(spark, folder):
    return profiles.batch_totals(table(spark, folder, "customer"), ["c_custkey", "c_nationkey"])


@query(
    "checks_in_every_hole",
    "WITH c AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_linenumber < 7 OR l_suppkey % 9 > 0) SELECT CAST(l_linenumber AS VARCHAR) AS check FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l_suppkey) FROM c)",
)
def checks_in_every_hole(spark, folder):
    from stratalog.operators.calls import common_checks

    rows = table(spark, folder, "lineitem").where("l_linenumber < 7 or l_suppkey % 9 > 0")
    return common_checks(rows.select(F.col("l_suppkey").alias("hole_id"), F.col("l_linenumber").cast("string").alias("check")))


@query(
    "core_diameters",
    """WITH r AS (SELECT o_custkey AS hole_id, (1 + o_orderkey % 5) / greatest(o_orderkey % 400 + 1, 1) AS s FROM orders),
k AS (SELECT hole_id, s, row_number() OVER (PARTITION BY hole_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY hole_id) AS n FROM r)
SELECT hole_id, round(400 * s, 6) AS diameter_m FROM k WHERE i = n // 2""",
)
def core_diameters(spark, folder):
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("hole_id"), key.cast("double").alias("depth_from_m"), (key + 1 + key % 5).cast("double").alias("depth_to_m"), F.lit(0).alias("y_from_px"), (key % 400 + 1).alias("y_to_px"), F.lit(400).alias("core_width_px")
    )
    return profiles.core_diameter(rows).withColumn("diameter_m", F.round("diameter_m", 6))


@query(
    "image_row_depths",
    """WITH r AS (SELECT o_custkey, o_orderkey, 10 + o_orderkey % 90 AS len FROM orders), s AS (SELECT *, sum(len) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS u, sum(len) OVER (PARTITION BY o_custkey) AS t FROM r)
SELECT o_custkey, o_orderkey, round_even(100 + 8 * ((u - len) / t), 4) AS depth_from_m, round_even(100 + 8 * (u / t), 4) AS depth_to_m FROM s""",
)
def image_row_depths(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 90 + 10).alias("len"), F.lit(100.0).alias("depth_from"), F.lit(108.0).alias("depth_to"))
    return geometry.row_depths(rows, tray=["o_custkey"], order="o_orderkey", length="len").select("o_custkey", "o_orderkey", "depth_from_m", "depth_to_m")


@query(
    "packed_sheets",
    """WITH RECURSIVE r AS (SELECT o_custkey AS h, o_orderkey AS k, o_orderkey % 300 + 20 AS px, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (
  SELECT h, k, n, px, 0 AS sheet, CAST(0 AS BIGINT) AS y FROM r WHERE n = 1
  UNION ALL SELECT r.h, r.k, r.n, r.px, CASE WHEN s.y + s.px + r.px > 1000 THEN s.sheet + 1 ELSE s.sheet END, CASE WHEN s.y + s.px + r.px > 1000 THEN 0 ELSE s.y + s.px END
  FROM s JOIN r ON r.h = s.h AND r.n = s.n + 1)
SELECT h AS hole_id, k AS o_orderkey, px AS height_px, sheet AS sheet_index, y AS y_from_px, y + px AS y_to_px FROM s""",
)
def packed_sheets(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("hole_id"), "o_orderkey", (F.col("o_orderkey") % 300 + 20).cast("long").alias("height_px"))
    return geometry.pack_sheets(rows, hole=["hole_id"], order=["o_orderkey"], height="height_px", limit=1000)


# ---------------------------------------------------------------- set operations


@query("orders_differing_both_ways", f"WITH {CHANGED_SQL} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' ELSE 'unlisted' END AS side FROM orders a FULL JOIN changed b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL")
def orders_differing_both_ways(spark, folder):
    a, b = _changed_orders(spark, folder)
    return relations.set_difference(a, b, ["o_orderkey"])


@query(
    "multiset_surplus",
    """WITH a AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def multiset_surplus(spark, folder):
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    side = lambda f: items.where(F.col("l_returnflag") == f).drop("l_returnflag")
    return relations.multiset_difference(side("A"), side("R"))


@query("overridden_members", f"WITH {MEMBERS_SQL} SELECT * FROM base WHERE dataset_id NOT IN (SELECT dataset_id FROM incoming) UNION ALL SELECT * FROM incoming")
def overridden_members(spark, folder):
    return relations.override_members(*members(spark, folder), member="dataset_id", revision="dataset_revision_id")[0]


@query("replaced_members", f"WITH {MEMBERS_SQL} SELECT b.dataset_id, b.dataset_revision_id AS previous_revision, i.dataset_revision_id AS incoming_revision FROM base b JOIN incoming i USING (dataset_id) WHERE b.dataset_revision_id <> i.dataset_revision_id")
def replaced_members(spark, folder):
    return relations.override_members(*members(spark, folder), member="dataset_id", revision="dataset_revision_id")[1]


@query(
    "parent_chain_levels",
    """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 5 THEN -p_partkey WHEN p_partkey % 97 = 3 THEN p_partkey WHEN p_partkey % 101 = 7 THEN p_partkey + 1 WHEN p_partkey % 101 = 8 THEN p_partkey - 1 WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part),
c AS (SELECT id, CAST(0 AS BIGINT) AS level FROM n WHERE parent IS NULL UNION ALL SELECT n.id, level + 1 FROM n JOIN c ON n.parent = c.id)
SELECT n.id, c.level FROM n LEFT JOIN c ON c.id = n.id""",
)
def parent_chain_levels(spark, folder):
    """Parents by halving, some of them missing, some nodes their own parents, some pairs each other's."""
    k = F.col("p_partkey")
    parent = F.when(k % 11 == 5, -k).when(k % 97 == 3, k).when(k % 101 == 7, k + 1).when(k % 101 == 8, k - 1).when(k > 1, F.floor(k / 2))
    nodes = table(spark, folder, "part").select(k.alias("id"), parent.alias("parent"))
    return relations.parent_chain(nodes, ident="id", parent="parent")


@query("united_by_name", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def united_by_name(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return relations.union_all([c, s])


@query("shared_keys", "SELECT o_custkey AS id FROM orders INTERSECT SELECT l_suppkey FROM lineitem")
def shared_keys(spark, folder):
    a = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"))
    return a.intersect(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("id")))


@query("remapped_ids", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders")
def remapped_ids(spark, folder):
    ids = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return relations.remap(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ids, ["o_custkey"])


@query(
    "factored_headers",
    "SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS l_returnflag, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS l_linestatus FROM lineitem GROUP BY 1",
)
def factored_headers(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return relations.factor_shared(items, by=["l_orderkey"], columns=["l_returnflag", "l_linestatus"])[0]


@query("unfactored_rows", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def unfactored_rows(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    columns = ["l_returnflag", "l_linestatus"]
    header, rest = relations.factor_shared(items, by=["l_orderkey"], columns=columns)
    return relations.unfactor_shared(header, rest, by=["l_orderkey"], columns=columns).select("l_orderkey", "l_linenumber", *columns)


@query("upserted_customers", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer UNION ALL SELECT s_suppkey + 10000000, s_name FROM supplier")
def upserted_customers(spark, folder):
    current = table(spark, folder, "customer").select("c_custkey", "c_name")
    fresh = table(spark, folder, "supplier").select((F.col("s_suppkey") + 10000000).alias("c_custkey"), F.col("s_name").alias("c_name"))
    changed = current.where("c_custkey % 4 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"))
    return relations.upsert(current, changed.unionByName(fresh), key=["c_custkey"])


# ---------------------------------------------------------------- paging and filters


@query("page_after_key", "SELECT o_orderkey, o_totalprice, 1100 AS next_after FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def page_after_key(spark, folder):
    page = paging.page_after(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), key="o_orderkey", after=1000, limit=100)
    return page.withColumn("next_after", F.col("next_after").cast("int"))


@query("page_by_offset", "SELECT p_partkey, p_brand, 70 AS next_offset FROM part ORDER BY p_brand, p_partkey LIMIT 50 OFFSET 20")
def page_by_offset(spark, folder):
    page = paging.page_offset(table(spark, folder, "part").select("p_partkey", "p_brand"), order=["p_brand", "p_partkey"], offset=20, limit=50)
    return page.withColumn("next_offset", F.col("next_offset").cast("int"))


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, folder):
    return paging.top(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)


@query("samples_in_depth_range", f"WITH {SCAN_SQL} SELECT hole, sample_no, round(depth_h, 6) AS depth_h FROM scan WHERE depth_h >= 100 AND depth_h <= 200.5 AND sample_no > 5")
def samples_in_depth_range(spark, folder):
    found = intervals.in_range(scan(spark, folder), at="depth_h", start=100, end=200.5).where("sample_no > 5")
    return found.select("hole", "sample_no", F.round("depth_h", 6).alias("depth_h"))


@query("days_touching_range", f"WITH {DAILY_SQL} SELECT hole, depth_from_m, call FROM daily WHERE depth_to_m >= 96 AND depth_from_m <= 168")
def days_touching_range(spark, folder):
    return intervals.touching_range(daily(spark, folder), start=96, end=168).select("hole", "depth_from_m", "call")


@query("sites_in_box", f"WITH {SITES_SQL} SELECT hole_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM sites WHERE longitude BETWEEN 117 AND 121.25 AND latitude BETWEEN -30 AND -20")
def sites_in_box(spark, folder):
    return paging.in_box(sites(spark, folder), 117, -30, 121.25, -20).select("hole_id", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


@query("name_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%widget%' OR lower(p_type) LIKE '%widget%'")
def name_search(spark, folder):
    return paging.matching(table(spark, folder, "part"), " Widget ", ["p_name", "p_type"]).select("p_partkey", "p_name")


@query("coalesced_lengths", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, o_orderpriority, '') AS project, greatest(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 5 = 0 THEN 250000.0::DOUBLE END) AS length FROM orders")
def coalesced_lengths(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        "o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")), "o_orderpriority", F.lit("")).alias("project"),
        F.greatest(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 5 == 0, F.lit(250000.0))).alias("length"),
    )


# ---------------------------------------------------------------- functions


@query("stable_ids", """WITH h AS (SELECT DISTINCT user_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('hole:' || user_id)) AS h FROM events)
SELECT user_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def stable_ids(spark, folder):
    return table(spark, folder, "events").select("user_id").distinct().select("user_id", hashing.stable_id("hole", "user_id").alias("id"))


@query(
    "table_fingerprints",
    """WITH h AS (SELECT o_orderstatus, md5('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS h FROM orders)
SELECT o_orderstatus, count(*) AS n, CAST(sum(('0x' || substr(h, 1, 8))::UBIGINT) AS VARCHAR) AS sum_head, CAST(sum(('0x' || substr(h, 9, 8))::UBIGINT) AS VARCHAR) AS sum_tail FROM h GROUP BY 1""",
)
def table_fingerprints(spark, folder):
    found = hashing.fingerprint(table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority"), ["o_orderstatus"])
    return found.withColumns({c: F.col(c).cast("string") for c in ("sum_head", "sum_tail")})


@query(
    "ordered_digests",
    f"""WITH {SCAN_SQL},
l0 AS (SELECT hole, sample_no AS p, sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}') AS h FROM scan),
l1 AS (SELECT hole, p // 4096 AS p, count(*) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h FROM l0 GROUP BY 1, 2),
l2 AS (SELECT hole, p // 4096 AS p, sum(n) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h FROM l1 GROUP BY 1, 2),
l3 AS (SELECT hole, p // 4096 AS p, sum(n) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h FROM l2 GROUP BY 1, 2)
SELECT hole, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS digest FROM l3 GROUP BY 1""",
)
def ordered_digests(spark, folder):
    return hashing.ordered_digest(scan(spark, folder), ["hole"], "sample_no", ["event_id", "event_type"])


@query(
    "text_functions",
    """SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS folded, regexp_replace(upper(p_name), '[\\s_]+', '-', 'g') AS label,
 CASE WHEN lower(p_type) IN ('small', 'economy') THEN NULL ELSE p_type END AS kept, regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '_', 'g') AS stem, p_size > 25 AS big, split_part(p_brand, '#', 2) || '_x' AS safe FROM part""",
)
def text_functions(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", text.fold_name("p_name").alias("folded"), text.group_label("p_name").alias("label"), text.blank_to_null("p_type", ["small", "economy"]).alias("kept"),
        text.file_stem("p_brand").alias("stem"), text.lenient_boolean(F.when(F.col("p_size") > 25, " Yes ").otherwise("no")).alias("big"),
        text.file_name(F.concat(F.lit("é"), F.split_part("p_brand", F.lit("#"), F.lit(2)), F.lit("_x."))).alias("safe"),
    ).withColumn("safe", F.substring("safe", 2, 100))


@query(
    "log_name_parts",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'sTSAS' ELSE 'ujCLST' END AS family, CASE WHEN p_size % 2 = 0 THEN 'SWIR' ELSE 'TIR' END AS region,
 CASE WHEN p_size % 3 = 0 THEN 'Error' ELSE 'Grp' END AS token, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS INTEGER) END AS rank, CASE WHEN p_size % 3 = 0 THEN 'fit_error' ELSE 'mineral_group' END AS metric FROM part""",
)
def log_name_parts(spark, folder):
    token = F.when(F.col("p_size") % 3 == 0, F.lit("Error")).otherwise(F.concat(F.lit("Grp"), F.col("p_size").cast("string")))
    name = F.concat_ws(" ", token, F.when(F.col("p_size") % 2 == 0, "sTSAS").otherwise("ujCLST"))
    return table(spark, folder, "part").select("p_partkey", text.parse_log_name(name).alias("p")).select("p_partkey", "p.family", "p.region", "p.token", "p.rank", "p.metric")


@query(
    "image_positions",
    f"""WITH {SCAN_SQL}, r AS (SELECT hole, sample_no, sample_no // 10 * 10 AS a, least(sample_no // 10 * 10 + 9, max(sample_no) OVER (PARTITION BY hole)) AS b FROM scan)
SELECT hole, sample_no, round(CASE WHEN b > a THEN (sample_no - a) / (b - a) ELSE 0.5 END, 6) AS p, round(CASE WHEN b > a THEN (sample_no - a) / (b - a) ELSE 0.5 END * 399, 5) AS x_px FROM r""",
)
def image_positions(spark, folder):
    samples = scan(spark, folder)
    last = samples.groupBy("hole").agg(F.max("sample_no").alias("_m"))
    first = F.floor(F.col("sample_no") / 10) * 10
    ranged = samples.join(last, "hole").select("hole", "sample_no", first.alias("a"), F.least(first + 9, F.col("_m")).alias("b"), F.lit(400).alias("w"))
    return ranged.select("hole", "sample_no", F.round(numbers.image_position("sample_no", "a", "b"), 6).alias("p"), F.round(numbers.image_pixel("sample_no", "a", "b", "w"), 5).alias("x_px"))


@query("spectral_regions", "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'VSWIR' WHEN 1 THEN 'TIR' ELSE 'UNCLASSIFIED' END AS region FROM embeddings")
def spectral_regions(spark, folder):
    ends = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(380), F.lit(2500))).when(F.col("vec_id") % 3 == 1, F.array(F.lit(14500), F.lit(6000))).otherwise(F.array(F.lit(380), F.lit(632)))
    return spectra(spark, folder).select("vec_id", numbers.spectral_region(ends, F.lit("nm"), "UNCLASSIFIED").alias("region"))


@query("odd_channels", "SELECT vec_id, 3 + CAST(vec_id % 2 AS INTEGER) AS first_odd, CAST(1 + vec_id % 2 AS INTEGER) AS odd FROM embeddings")
def odd_channels(spark, folder):
    odd = F.transform("values", lambda v, i: F.when((i == 3) & (F.col("vec_id") % 2 == 0), F.lit(float("nan"))).when((i.isin(4, 9)) & (F.col("vec_id") % 2 == 1), F.lit(float("inf"))).otherwise(v))
    marked = spectra(spark, folder).select("vec_id", numbers.nonfinite_channels(odd).alias("n"))
    return marked.select("vec_id", F.get("n", F.lit(0)).alias("first_odd"), F.size("n").alias("odd"))


@query(
    "depth_tolerances",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS BOOLEAN) AS close, CAST(l_extendedprice AS FLOAT) = CAST(l_extendedprice + 0.0001 AS FLOAT) AS same_bits FROM lineitem",
)
def depth_tolerances(spark, folder):
    price = F.col("l_extendedprice")
    shifted = (price.cast("decimal(20,6)") + F.when(F.col("l_partkey") % 2 == 0, F.lit("0.00001")).otherwise(F.lit("0.000011")).cast("decimal(20,6)")).cast("string")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.decimal_close(price.cast("decimal(20,6)").cast("string"), shifted).alias("close"), numbers.same_float32(price, price + 0.0001).alias("same_bits")
    )


@query("hole_offsets", f"WITH {SITES_SQL} SELECT hole_id, round(borehole_length_m * 0.5 * sin(radians(30)), 6) AS east_m, round(borehole_length_m * 0.5 * cos(radians(30)), 6) AS north_m, round(borehole_length_m * sin(radians(60)), 6) AS tvd_m FROM sites")
def hole_offsets(spark, folder):
    found = sites(spark, folder).select("hole_id", geo.offset_at("borehole_length_m", F.lit(-60.0), F.lit(30.0)).alias("o"))
    return found.select("hole_id", *[F.round(f"o.{c}", 6).alias(c) for c in ("east_m", "north_m", "tvd_m")])


@query("geojson_features", f"""WITH {SITES_SQL} SELECT hole_id, 'Feature' AS type, round(longitude, 6) AS lon, project FROM sites""")
def geojson_features(spark, folder):
    from stratalog.sources.sinks import feature_lines

    lines = feature_lines(sites(spark, folder), properties=["project"], ident="hole_id")
    parsed = lines.select(F.from_json("value", "type string, id long, geometry struct<coordinates:array<double>>, properties struct<project:string>").alias("f"))
    return parsed.select(F.col("f.id").alias("hole_id"), "f.type", F.round(F.get("f.geometry.coordinates", F.lit(0)), 6).alias("lon"), "f.properties.project")


MISSING = fixed.MODEL_NULLS


@query("category_labels", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE lower(o_orderpriority) END AS label FROM orders")
def category_labels(spark, folder):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.element_at(F.array(*[F.lit(f" {t.upper()} ") for t in MISSING]), (F.col("o_orderkey") % len(MISSING) + 1).cast("int"))).otherwise(F.col("o_orderpriority"))
    return table(spark, folder, "orders").select("o_orderkey", text.category(raw).alias("label"))
