"""Values, names, pages and projections that the larger queries do not show."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import numbers, text
from stratalog.operators import intervals, paging, profiles, relations, routing
from stratalog.plans.registry import query
from stratalog.plans.views import SCAN_SQL, scan
from stratalog.session import scratch, settle_table, table
from stratalog.sources import documents, sinks


@query(
    "compact_numbers",
    """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) / 3.14159265 / pow(10.0, 2 * l_linenumber) AS small, CAST(l_extendedprice AS DOUBLE) * 12345.6789 AS large, CAST(l_quantity AS DOUBLE) AS whole FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN small = floor(small) THEN CAST(CAST(small AS BIGINT) AS VARCHAR) ELSE printf('%g', small) END AS small,
 CASE WHEN large = floor(large) THEN CAST(CAST(large AS BIGINT) AS VARCHAR) ELSE printf('%g', -large) END AS large, CAST(CAST(whole AS BIGINT) AS VARCHAR) AS whole FROM v""",
)
def compact_numbers(spark, folder):
    """Number texts of many magnitudes, with exponents on both ends."""
    price = F.col("l_extendedprice").cast("double")
    large = price * 12345.6789
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (price / 3.14159265 / F.pow(F.lit(10.0), 2 * F.col("l_linenumber"))).alias("small"), F.when(large == F.floor(large), large).otherwise(-large).alias("large"), F.col("l_quantity").cast("double").alias("whole"))
    return rows.select("l_orderkey", "l_linenumber", *[text.number_text(c).alias(c) for c in ("small", "large", "whole")])


@query(
    "measured_values",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 5, 6) THEN CAST(l_quantity AS DOUBLE) WHEN l_linenumber = 7 THEN -3.5e27 END AS measured,
 CASE WHEN l_linenumber IN (1, 5, 6) THEN CAST(l_quantity AS DOUBLE) WHEN l_linenumber = 2 THEN -3.4028234663852886e38 WHEN l_linenumber = 7 THEN -3.5e27 END AS finite FROM lineitem""",
)
def measured_values(spark, folder):
    """Readings as text: numbers, the scanner's absent value, no numbers and words."""
    n = F.col("l_linenumber")
    value = F.when(n == 2, "-3.4028234663852886e38").when(n == 3, "nan").when(n == 4, "-Infinity").when(n == 7, "-3.5e27").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("double").cast("string")))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.when((F.col("l_orderkey") % 5 == 0) & (n == 3), "n/a").otherwise(value).alias("value"))
    return rows.select("l_orderkey", "l_linenumber", numbers.measured("value").alias("measured"), numbers.finite("value").alias("finite"))


@query(
    "decoded_hole_names",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'hole ' || p_partkey || '+a' WHEN 1 THEN 'é/' || p_partkey WHEN 2 THEN CAST(p_partkey AS VARCHAR) END AS hole FROM part""",
)
def decoded_hole_names(spark, folder):
    """Percent-encoded folder names: spaces and signs, letters of two bytes, plain ones and broken escapes."""
    k = F.col("p_partkey")
    name = k.cast("string")
    folder_name = F.when(k % 4 == 0, F.concat(F.lit("hole%20"), name, F.lit("+a"))).when(k % 4 == 1, F.concat(F.lit("%C3%A9%2F"), name)).when(k % 4 == 2, name).otherwise(F.concat(name, F.lit("%zz")))
    return table(spark, folder, "part").select("p_partkey", text.decode_path_name(folder_name).alias("hole"))


@query(
    "wavelength_axis_problems",
    "SELECT p_partkey AS stream_id FROM part WHERE p_partkey % 8 IN (1, 2, 3, 4)",
)
def wavelength_axis_problems(spark, folder):
    """Wavelength axes from sizes of parts: a step back, a value twice, no number, a channel too few, and good ones."""
    k = F.col("p_partkey") % 8
    base = F.col("p_size").cast("double")
    value = lambda i: base + F.when((k == 1) & (i == 3), 0.5).when((k == 2) & (i == 4), 3.0).when((k == 3) & (i == 5), float("nan")).otherwise(i.cast("double"))
    axis = F.transform(F.sequence(F.lit(0), F.when(k == 4, 6).otherwise(7)), value)
    streams = table(spark, folder, "part").select(F.col("p_partkey").alias("stream_id"), axis.alias("wavelengths"), F.lit(8).alias("band_count"))
    return profiles.wavelength_check(streams, wavelengths="wavelengths", count="band_count").select("stream_id")


@query(
    "membership_list_problems",
    """WITH m AS (SELECT l_returnflag AS path, CASE WHEN l_linestatus = 'F' THEN 'scalar' ELSE 'image' END AS kind, CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS log_id, l_suppkey AS d FROM lineitem),
g AS (SELECT path, kind, log_id, count(*) AS n, count(DISTINCT d) AS ds FROM m GROUP BY 1, 2, 3)
SELECT path, kind, log_id, CASE WHEN log_id = '' THEN 'blank log id' WHEN ds > 1 AND kind <> 'image' THEN 'log of several datasets' ELSE 'log listed twice' END AS problem FROM g WHERE log_id = '' OR (ds > 1 AND kind <> 'image') OR n > ds""",
)
def membership_list_problems(spark, folder):
    """Every line as an entry of a collection file: its part a log of its supplier's dataset."""
    members = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("path"), F.when(F.col("l_linestatus") == "F", "scalar").otherwise("image").alias("kind"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_partkey").cast("string")).alias("log_id"), F.col("l_suppkey").alias("dataset_id"),
    )
    return documents.membership_problems(members)


@query(
    "summary_of_complete_holes",
    """SELECT c_custkey AS hole_id, n AS dataset_count, round(t, 2) AS total FROM customer JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS t FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3) ON o_custkey = c_custkey WHERE c_custkey % 3 > 0""",
)
def summary_of_complete_holes(spark, folder):
    """Summary rows of the holes whose outputs are all there, written as CSV and read back."""
    orders = table(spark, folder, "orders")
    states = table(spark, folder, "customer").select(F.col("c_custkey").alias("hole_id"), F.when(F.col("c_custkey") % 3 > 0, "complete").otherwise("failed").alias("status"))
    outputs = orders.select(F.col("o_custkey").alias("hole_id"), F.col("o_orderstatus").alias("folder"))
    complete = routing.present_outputs(states, outputs, ["F", "O", "P"]).select("hole_id")
    summary = orders.groupBy(F.col("o_custkey").alias("hole_id")).agg(F.count(F.lit(1)).alias("dataset_count"), F.round(F.sum("o_totalprice").cast("double"), 2).alias("total"))
    path = scratch(spark, "summary")
    sinks.written_summary(complete.join(summary, "hole_id"), path, ["hole_id", "dataset_count", "total"])
    return spark.read.schema("hole_id long, dataset_count long, total double").option("header", "true").csv(path)


@query(
    "sample_pages_by_depth",
    f"""WITH {SCAN_SQL}, n AS (SELECT hole, sample_no, depth_h, row_number() OVER (ORDER BY hole, sample_no) AS place, count(*) OVER () AS total FROM scan WHERE depth_h >= 100 AND depth_h <= 900)
SELECT (place - 1) // 100 AS page, hole, sample_no, round(depth_h, 6) AS depth_h, total > 100 * ((place - 1) // 100 + 1) AS more FROM n WHERE place <= 300""",
)
def sample_pages_by_depth(spark, folder):
    """Three pages of the samples of a depth range, each beyond the last sample of the one before."""
    found = intervals.in_range(scan(spark, folder), at="depth_h", start=100, end=900).select("hole", "sample_no", "depth_h")
    pages, after = [], None
    for number in range(3):
        page = settle_table(paging.page_after_place(found, order=["hole", "sample_no"], after=after, limit=100), "page")
        pages.append(page.select(F.lit(number).cast("long").alias("page"), "hole", "sample_no", F.round("depth_h", 6).alias("depth_h"), F.col("next_after").isNotNull().alias("more")))
        first = page.first()  # a page: at most a hundred rows
        after = first["next_after"] if first else None
        if after is None:
            break
    every = pages[0]
    for page in pages[1:]:
        every = every.unionByName(page)
    return every


@query("interval_page_by_kind", "SELECT p_partkey, p_brand, 70 AS next_offset FROM part WHERE p_size % 3 = 1 ORDER BY p_brand, p_partkey LIMIT 50 OFFSET 20")
def interval_page_by_kind(spark, folder):
    """A page of the parts of one kind."""
    kind = table(spark, folder, "part").where("p_size % 3 = 1").select("p_partkey", "p_brand")
    return paging.page_offset(kind, order=["p_brand", "p_partkey"], offset=20, limit=50).withColumn("next_offset", F.col("next_offset").cast("int"))


@query(
    "dataset_projection",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS name, CAST(c_custkey AS VARCHAR) AS key FROM c UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM o UNION ALL SELECT 'lineitem', l_orderkey || '/' || l_linenumber FROM l
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey IN (SELECT l_partkey FROM l) UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)
UNION ALL SELECT 'events', CAST(event_id AS VARCHAR) FROM events WHERE user_id IN (SELECT c_custkey FROM c)""",
)
def dataset_projection(spark, folder):
    """The rows of all tables that belong to the customers of one nation."""
    read = lambda name: table(spark, folder, name)
    customers = read("customer").where("c_nationkey = 3").select("c_custkey")
    orders = relations.semi(read("orders"), customers.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).select("o_orderkey")
    lines = settle_table(relations.semi(read("lineitem"), orders.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"]).select("l_orderkey", "l_partkey", "l_suppkey"), "projection")
    members = {
        "c_custkey": customers, "o_custkey": customers.withColumnRenamed("c_custkey", "o_custkey"), "user_id": customers.withColumnRenamed("c_custkey", "user_id"), "l_orderkey": lines.select("l_orderkey"),
        "p_partkey": lines.select(F.col("l_partkey").alias("p_partkey")), "s_suppkey": lines.select(F.col("l_suppkey").alias("s_suppkey")),
    }
    tables = {"customer": ["c_custkey"], "orders": ["o_custkey"], "lineitem": ["l_orderkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "events": ["user_id"], "region": ["r_regionkey"]}
    kept = relations.project_tables({name: (read(name), on) for name, on in tables.items()}, members)
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "events": ["event_id"], "region": ["r_regionkey"]}
    rows = [df.select(F.lit(name).alias("name"), F.concat_ws("/", *[F.col(c).cast("string") for c in keys[name]]).alias("key")) for name, df in kept.items()]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every


@query("rows_in_depth_view", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + 2 >= 10 AND l_quantity <= 20.5")
def rows_in_depth_view(spark, folder):
    """Image rows that a view of a depth range shows, those across its ends included."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("depth_from_m"), (F.col("l_quantity") + 2).cast("double").alias("depth_to_m"))
    return intervals.touching_range(rows, start=10, end=20.5).select("l_orderkey", "l_linenumber")


@query("listed_flags", "SELECT l_orderkey, l_linenumber, l_returnflag IN ('A', 'N') AS listed FROM lineitem")
def listed_flags(spark, folder):
    """Whether a line's flag is one of a fixed set of ids."""
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", routing.has_any(["A", "N"], "l_returnflag").alias("listed"))
