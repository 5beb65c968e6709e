"""Sources, sinks and streams over files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.operators import align, profiles, quality, relations, routing
from stratalog.plans.call_queries import DAILY_SQL
from stratalog.plans.registry import query
from stratalog.plans.score_queries import SCALED_SQL, scaled_table
from stratalog.plans.views import READINGS_SQL, SCAN_SQL, SITES_SQL, instant, intervals as ranges, readings, scan, sites, spectra, order_of
from stratalog.session import scratch, settle_table, table
from stratalog.sources import documents, files, logs, sinks
from stratalog.streaming import ingest

#: Rows of a log: the number of logs, and with it of files and tasks, grows with the events.
LOG_ROWS = 2_000


def _scalar_files(spark, folder):
    """events as scalar CSV logs, a few per run: StartDepth, EndDepth, value with blanks and null tokens."""
    path = scratch(spark, "scalars")
    value = F.when(F.col("k") % 10 == 0, "null").when(F.col("k") % 10 == 1, "").otherwise(F.col("event_type"))
    rows = readings(spark, folder).select(F.expr(f"event_id div {LOG_ROWS}").alias("log"), F.col("event_id").cast("double").alias("StartDepth"), F.col("event_id").cast("double").alias("EndDepth"), value.alias("value"))
    rows.repartition("log").sortWithinPartitions("log", "StartDepth").write.partitionBy("log").option("header", "true").option("emptyValue", "").csv(path)
    return path


def _log_of(column: str = "path"):
    return F.regexp_extract(column, r"log=(\d+)", 1).cast("long")


SCALARS_SQL = f"""{READINGS_SQL},
rows AS (SELECT event_id // {LOG_ROWS} AS log, event_id, CASE WHEN k % 10 = 0 THEN 'null' WHEN k % 10 = 1 THEN '' ELSE event_type END AS token,
  row_number() OVER (PARTITION BY event_id // {LOG_ROWS} ORDER BY event_id) - 1 AS source_row FROM readings)"""


@query("strict_scalar_log", f"WITH {SCALARS_SQL} SELECT log, source_row, CAST(event_id AS DOUBLE) AS start, token FROM rows")
def strict_scalar_log(spark, folder):
    rows = logs.read_scalar_log(spark, _scalar_files(spark, folder))
    return rows.select(_log_of().alias("log"), "source_row", "start", "token")


@query("lenient_scalar_log", f"WITH {SCALARS_SQL} SELECT log, source_row, CAST(event_id AS DOUBLE) AS start, token FROM rows WHERE token NOT IN ('', 'null')")
def lenient_scalar_log(spark, folder):
    rows = logs.read_scalar_log(spark, _scalar_files(spark, folder), mode="lenient")
    return rows.select(_log_of().alias("log"), "source_row", "start", "token")


@query("literal_scalar_log", f"""WITH {SCALARS_SQL} SELECT log, source_row, 'a "' || token || '", b' AS token FROM rows""")
def literal_scalar_log(spark, folder):
    path = scratch(spark, "literal")
    value = F.when(F.col("k") % 10 == 0, "null").when(F.col("k") % 10 == 1, "").otherwise(F.col("event_type"))
    text = F.concat_ws(",", F.col("event_id").cast("string"), F.col("event_id").cast("string"), F.concat(F.lit('a "'), value, F.lit('", b')))
    rows = readings(spark, folder).select(F.expr(f"event_id div {LOG_ROWS}").alias("log"), "event_id", text.alias("value"))
    heads = rows.select("log").distinct().select("log", F.lit(-1).cast("long").alias("event_id"), F.lit("StartDepth,EndDepth,value").alias("value"))
    placed = rows.unionByName(heads).repartition("log").sortWithinPartitions("log", "event_id").select("log", "value")
    placed.write.partitionBy("log").text(path)
    found = logs.read_scalar_log(spark, path, mode="literal", glob="*")
    return found.select(_log_of().alias("log"), "source_row", "token")


@query("canonical_scalar_values", f"""WITH {SCALARS_SQL} SELECT log, source_row AS sample_no, CASE WHEN token NOT IN ('', 'null') THEN token END AS value_text, token AS value_raw FROM rows""")
def canonical_scalar_values(spark, folder):
    """CSV logs to typed canonical Parquet and back."""
    rows = logs.read_scalar_log(spark, _scalar_files(spark, folder)).withColumn("log", _log_of()).drop("path")
    typed = align.typed_values(rows, interval=False, numeric=False)
    target = scratch(spark, "canonical")
    sinks.write_canonical(typed, target, partitions=["log"], order="source_row")
    stored = spark.read.parquet(target)
    return stored.select(F.col("log").cast("long").alias("log"), "sample_no", "value_text", "value_raw")


@query(
    "prepared_logs",
    f"""WITH {SCALARS_SQL}, seen AS (SELECT *, lag(event_id) OVER (PARTITION BY log ORDER BY source_row) AS p FROM rows)
SELECT log, count(*) AS row_count, CAST(count_if(token IN ('', 'null')) AS BIGINT) AS null_count, count(*) AS point_count, CAST(min(event_id) AS DOUBLE) AS coordinate_min, CAST(max(event_id) AS DOUBLE) AS coordinate_max,
 CAST(count_if(event_id < p) AS BIGINT) AS decreasing_start_count, CAST(ceil(count(*) / 4096) AS BIGINT) AS chunks, CAST(0 AS BIGINT) AS stored_differently FROM seen GROUP BY 1""",
)
def prepared_logs(spark, folder):
    """A whole preparation: read raw CSV logs, profile them, write typed Parquet, read it back and compare, index the chunks."""
    rows = settle_table(logs.read_scalar_log(spark, _scalar_files(spark, folder)).withColumn("log", _log_of()).drop("path"), "raw")
    profile = profiles.scalar_profile(rows, log=["log"], numeric=F.lit(False), block=F.floor(F.col("source_row") / 65536))
    typed = align.typed_values(rows, interval=False, numeric=False)
    target = scratch(spark, "prepared")
    sinks.write_canonical(typed, target, partitions=["log"], order="source_row")
    differing = sinks.read_back_difference(typed, target).groupBy("log").agg(F.count(F.lit(1)).alias("_d"))
    chunks = sinks.chunk_index(spark.read.parquet(target), log=["log"], row="source_row", coordinate="depth_m").groupBy("log").agg(F.count(F.lit(1)).alias("chunks"))
    joined = profile.join(chunks, "log").join(differing, "log", "left").withColumn("stored_differently", F.coalesce("_d", F.lit(0)))
    return joined.select("log", "row_count", "null_count", "point_count", "coordinate_min", "coordinate_max", "decreasing_start_count", "chunks", "stored_differently")


@query(
    "canonical_read_back",
    """WITH o AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus FROM orders)
SELECT *, CAST(1 AS BIGINT) AS surplus FROM o WHERE o_orderkey % 50 = 0 OR o_orderkey % 50 = 1
UNION ALL SELECT o_orderkey, o_totalprice + 1, o_orderstatus, -1 FROM o WHERE o_orderkey % 50 = 1
UNION ALL SELECT *, -1 FROM o WHERE o_orderkey % 50 = 2""",
)
def canonical_read_back(spark, folder):
    """A stored copy in which rows are missing, changed and doubled, against the rows that were meant."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    target = scratch(spark, "orders")
    at = F.col("o_orderkey") % 50
    price = F.when(at == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    broken = orders.where(at != 0).withColumn("o_totalprice", price).unionByName(orders.where(at == 2))
    sinks.write_canonical(broken, target, partitions=["o_orderstatus"], order="o_orderkey")
    return sinks.read_back_difference(orders, target)


@query("chunk_index", f"WITH {SCAN_SQL} SELECT hole, sample_no // 16 AS row_group, min(sample_no) AS source_row_from, max(sample_no) + 1 AS source_row_to_exclusive, count(*) AS row_count, min(us) AS coordinate_min, max(us) AS coordinate_max FROM scan GROUP BY 1, 2")
def chunk_index(spark, folder):
    return sinks.chunk_index(scan(spark, folder), log=["hole"], row="sample_no", coordinate="us", rows=16)


@query("depth_profiles", f"WITH {SCAN_SQL} SELECT hole, sample_no, round(value + k, 6) AS total FROM scan")
def depth_profiles(spark, folder):
    """JSON-lines profiles written per hole and read back with their sample numbers checked."""
    path = scratch(spark, "profiles")
    rows = scan(spark, folder).select(F.expr("hole div 100").alias("log"), "hole", F.to_json(F.struct(F.col("sample_no").alias("sampleNo"), F.array("value", F.col("k").cast("double"), F.col("hole").cast("double")).alias("floatprofdata"))).alias("value"))
    rows.repartition("log", "hole").drop("hole").write.partitionBy("log").text(path)
    raw = logs.read_profiles(spark, path, glob="*")
    return raw.select(F.get("values", F.lit(2)).cast("long").alias("hole"), "sample_no", F.round(F.get("values", F.lit(0)) + F.get("values", F.lit(1)), 6).alias("total"))


@query("float32_spectra", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last, 64 AS channels FROM embeddings")
def float32_spectra(spark, folder):
    """Spectra written as raw float32 matrices and read back by byte ranges."""
    target = scratch(spark, "spectra")
    rows = spectra(spark, folder).select("vec_id", "values", (F.col("vec_id") % 4).alias("part"))
    from stratalog.operators.ordered import number, ordered_scan

    numbered = ordered_scan(rows, ["part"], ["vec_id"], {"n": number()})
    written = files.write_spectra(numbered, target, name="part", values="values", order="n")
    listed = files.list_files(spark, target, "*.f32").join(written, F.col("relative_path") == F.col("file")).withColumn("bands", F.lit(64))
    found = files.read_spectra(listed.select("path", "size", "bands", "part"), rows_per_block=64, keep=["part"])
    back = found.join(numbered.select("part", "vec_id", (F.col("n") - 1).alias("sample_no")), ["part", "sample_no"])
    return back.select("vec_id", F.round(F.get("values", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get("values", F.lit(63)).cast("double"), 6).alias("last"), F.size("values").alias("channels"))


@query("measurement_tables", f"""WITH {SCAN_SQL} SELECT CASE WHEN hole % 2 = 0 THEN CAST(hole AS VARCHAR) ELSE 'tail' END AS hole_id, CAST(sample_no AS DOUBLE) AS sample_no, CASE WHEN hole % 2 = 0 THEN CAST(k AS VARCHAR) END AS snr, event_type AS call FROM scan WHERE k <> 5""")
def measurement_tables(spark, folder):
    """Two kinds of measurement CSV with different headers, one without hole ids, united by name."""
    path = scratch(spark, "measurements")
    rows = scan(spark, folder).select("hole", F.col("hole").cast("string").alias("hole_id"), "sample_no", F.when(F.col("k") != 5, F.col("us")).alias("depth_from_m"), F.col("k").alias("snr"), F.col("event_type").alias("call"))
    rows.where("hole % 2 = 0").drop("hole").write.option("header", "true").csv(path)
    rows.where("hole % 2 = 1").select("call", "sample_no", "depth_from_m").write.mode("append").option("header", "true").csv(path)
    data, _ = logs.read_measurements(spark, path, id_columns=["hole_id"])
    named = F.when(F.col("hole_id").startswith("part-"), "tail").otherwise(F.col("hole_id"))
    return data.select(named.alias("hole_id"), "sample_no", "snr", "call")


@query("wide_measurements", f"""WITH {SCAN_SQL} SELECT CAST(hole AS VARCHAR) AS hole_id, sample_no, CAST(sample_no AS DOUBLE) AS depth_from_m, CAST(sample_no + 1 AS DOUBLE) AS depth_to_m, event_type AS call, CAST(k AS VARCHAR) AS snr FROM scan""")
def wide_measurements(spark, folder):
    entries = F.array(F.struct(F.lit("call").alias("name"), F.col("event_type").alias("value")), F.struct(F.lit("snr").alias("name"), F.col("k").cast("string").alias("value")))
    long = scan(spark, folder).select(
        F.col("hole").cast("string").alias("hole_id"), "sample_no", F.col("sample_no").cast("double").alias("depth_from_m"), (F.col("sample_no") + 1).cast("double").alias("depth_to_m"), F.explode(entries).alias("e")
    ).select("hole_id", "sample_no", "depth_from_m", "depth_to_m", "e.name", "e.value")
    return sinks.wide_measurements(long, names=["call", "snr"])


@query(
    "core_interval_rows",
    f"""WITH {SCAN_SQL}, s AS (SELECT hole, sample_no // 5 AS o, min(sample_no) AS a, max(sample_no) AS b FROM scan GROUP BY 1, 2)
SELECT s.hole AS hole_id, CAST(o AS VARCHAR) AS section_no, o // 2 AS tray_index, a AS sample_start, b AS sample_end, round(x.depth_h, 6) AS depth_from_m, round(y.depth_h + 1, 6) AS depth_to_m,
 CASE WHEN o // 2 % 3 > 0 THEN 'tray/' || (o // 2) || '.jpg' END AS thumbnail_path FROM s JOIN scan x ON x.hole = s.hole AND x.sample_no = a JOIN scan y ON y.hole = s.hole AND y.sample_no = b""",
)
def core_interval_rows(spark, folder):
    samples = scan(spark, folder)
    axis = samples.select(F.col("hole").alias("hole_id"), "sample_no", F.col("depth_h").alias("depth_from_m"), (F.col("depth_h") + 1).alias("depth_to_m"))
    layout = ranges(samples, 5, "section").select(
        F.col("hole").alias("hole_id"), F.lit("d").alias("dataset_id"), F.lit("core").alias("dataset_name"), F.floor(F.col("ordinal") / 2).alias("tray_index"), F.lit("t").alias("tray_no"),
        F.col("ordinal").cast("string").alias("section_no"), F.col("sample_no_from").alias("sample_start"), F.col("sample_no_to").alias("sample_end"),
    )
    trays = ranges(samples, 10, "tray").select(F.col("hole").alias("hole_id"), F.lit("d").alias("dataset_id"), F.col("ordinal").alias("tray_index"), F.col("depth_min").alias("tray_depth_from_m"), F.col("depth_max").alias("tray_depth_to_m"))
    thumbs = trays.where("tray_index % 3 > 0").select("hole_id", "dataset_id", "tray_index", F.concat(F.lit("tray/"), F.col("tray_index").cast("string"), F.lit(".jpg")).alias("thumbnail_path"))
    found = sinks.core_intervals(layout, trays, thumbs, axis)
    return found.select("hole_id", "section_no", "tray_index", "sample_start", "sample_end", F.round("depth_from_m", 6).alias("depth_from_m"), F.round("depth_to_m", 6).alias("depth_to_m"), "thumbnail_path")


@query(
    "signal_rows",
    """SELECT 'h' || label AS hole_id, 's' || vec_id AS signal_name, CASE WHEN vec_id % 5 < 4 THEN vec_id END AS sample_no, CASE WHEN vec_id % 5 = 4 THEN 'metadata_only' ELSE 'complete' END AS status,
CASE WHEN vec_id % 5 < 4 THEN CAST(vec_id AS DOUBLE) + 1 END AS depth_from_m, CASE WHEN vec_id % 5 < 4 THEN round(CAST(embedding[64] AS DOUBLE), 6) END AS last, CASE WHEN vec_id % 5 < 4 THEN 64 ELSE 0 END AS channels FROM embeddings""",
)
def signal_rows(spark, folder):
    s = spectra(spark, folder)
    log = F.col("vec_id").cast("string")
    hole = F.concat(F.lit("h"), F.col("label").cast("string")).alias("hole_id")
    listed = s.select(hole, log.alias("log_id"), F.concat(F.lit("s"), log).alias("signal_name"), F.lit("spectrum").alias("signal_type"), F.when(F.col("vec_id") % 5 != 4, "complete").alias("status"), F.lit("nm").alias("channel_units"))
    values = s.select(log.alias("log_id"), F.col("vec_id").alias("sample_no"), "values")
    none = values.where("false").select("log_id", "sample_no", F.col("values").cast("array<double>").alias("values"))
    axis = s.select(hole, F.col("vec_id").alias("sample_no"), (F.col("vec_id") + 1.0).alias("depth_from_m"), (F.col("vec_id") + 2.0).alias("depth_to_m"))
    rows = sinks.signal_rows(listed, values, none, axis)
    channels = F.when(F.col("values").isNotNull(), F.size("values")).otherwise(0).alias("channels")
    return rows.select("hole_id", "signal_name", "sample_no", "status", "depth_from_m", F.round(F.get("values", F.lit(63)), 6).alias("last"), channels)


@query("wide_spectra", "SELECT vec_id, round(CAST(CASE WHEN vec_id % 2 = 0 THEN embedding[1] END AS DOUBLE), 6) AS wl_380_nm, round(CAST(CASE WHEN vec_id % 2 = 0 THEN embedding[2] ELSE embedding[1] END AS DOUBLE), 6) AS wl_384p5_nm FROM embeddings")
def wide_spectra(spark, folder):
    s = spectra(spark, folder).withColumn("stream_id", F.col("vec_id") % 2)
    streams = s.select("stream_id", F.when(F.col("stream_id") == 0, F.array(F.lit(380.0), F.lit(384.5))).otherwise(F.array(F.lit(384.5))).alias("wavelengths"), F.lit("nm").alias("unit")).distinct()
    wide = sinks.wide_spectra(s, streams, keys=["vec_id"])
    return wide.select("vec_id", *[F.round(c, 6).alias(c) for c in ("wl_380_nm", "wl_384p5_nm")])


@query(
    "asset_listing",
    """WITH k AS (SELECT l_orderkey, o_custkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT CAST(o_custkey AS VARCHAR) AS hole_id, 'tray' AS asset_kind, 'complete' AS status, 'core ' || o_custkey AS dataset_name, 'log ' || l_orderkey AS asset_name, CAST(l_linenumber AS BIGINT) AS sample_no,
  CAST(l_quantity AS DOUBLE) AS depth_from_m, CAST(l_quantity + 1 AS DOUBLE) AS depth_to_m, l_orderkey || '/' || l_linenumber AS file_path, CAST(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_linenumber * 100 END AS BIGINT) AS nbytes, '' AS notes FROM k
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'log ' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'metadata_only' ELSE 'partial' END, 'core ' || o_custkey, 'log ' || o_orderkey, NULL, NULL, NULL, NULL, 0,
  'downloaded ' || CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END || ' of 5' FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def asset_listing(spark, folder):
    """Every line a file of its order's log, every order a log of its customer's dataset."""
    orders = table(spark, folder, "orders")
    hole, log = F.col("o_custkey").cast("string").alias("hole_id"), F.concat(F.lit("log "), F.col("o_orderkey").cast("string"))
    dataset = F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("dataset_id")
    n = F.col("l_linenumber")
    listed = table(spark, folder, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        hole, dataset, F.col("l_orderkey").alias("log_id"), F.lit("tray").alias("kind"), log.alias("log_name"), n.cast("long").alias("sample_no"),
        F.col("l_quantity").cast("double").alias("depth_from_m"), (F.col("l_quantity") + 1).cast("double").alias("depth_to_m"),
        F.concat_ws("/", F.col("l_orderkey").cast("string"), n.cast("string")).alias("file"), F.when(n != 3, n * 100).alias("nbytes"),
    )
    held = orders.select(
        hole, dataset, F.col("o_orderkey").alias("log_id"), log.alias("log_name"), F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").alias("status"),
        F.when(F.col("o_orderstatus") == "P", 2).alias("downloaded"), F.lit(5).alias("sample_count"),
    )
    datasets = orders.select(hole, dataset, F.concat(F.lit("core "), F.col("o_custkey").cast("string")).alias("dataset_name")).distinct()
    return sinks.asset_rows(listed, held, datasets)


@query("exported_and_imported", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def exported_and_imported(spark, folder):
    scope = table(spark, folder, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    target = scratch(spark, "export")
    sinks.export_table(rows, target, scope=scope, on=["o_custkey"], key=["o_orderkey"])
    schema = T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderstatus", T.StringType())])
    expected = relations.semi(rows, scope, ["o_custkey"]).count()
    return sinks.import_table(spark, target, schema, expected).drop("o_custkey")


@query(
    "written_anomalies",
    f"WITH {SCALED_SQL} SELECT CAST(hole AS VARCHAR) AS hole_id, depth_from_m, round(robust_distance, 5) AS robust_distance, round(max_z, 5) AS max_z, round(max(max_z) OVER (PARTITION BY hole), 5) AS hole_max_z FROM normed",
)
def written_anomalies(spark, folder):
    """Interval scores written as Parquet and JSON lines, with the hole table: all three read back and joined."""
    target = scratch(spark, "anomalies")
    scored, _ = scaled_table(spark, folder)
    intervals = scored.select(F.col("hole").cast("string").alias("hole_id"), "depth_from_m", "depth_to_m", "robust_distance", "max_z")
    holes = intervals.groupBy("hole_id").agg(F.max("max_z").alias("max_z"))
    sinks.write_anomalies(intervals, holes, target)
    table_ = spark.read.parquet(f"{target}/anomalies").select("hole_id", "depth_from_m", F.round("robust_distance", 5).alias("robust_distance"))
    lines = spark.read.schema("hole_id string, depth_from_m double, max_z double").json(f"{target}/anomalies_json")
    most = spark.read.parquet(f"{target}/hole_anomalies").select("hole_id", F.round("max_z", 5).alias("hole_max_z"))
    return table_.join(lines.withColumn("max_z", F.round("max_z", 5)), ["hole_id", "depth_from_m"]).join(most, "hole_id")


@query("replaced_measurements", "SELECT o_orderkey, o_custkey AS hole_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def replaced_measurements(spark, folder):
    target = scratch(spark, "replaced")
    incoming = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("hole_id"))
    known = table(spark, folder, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("hole_id"))
    sinks.replace_measurements(incoming, known.where("hole_id % 2 = 0"), target)
    sinks.replace_measurements(incoming, known, target)
    return sinks.current_measurements(spark, target)


@query("band_maps", "SELECT vec_id, CAST(1 + CAST(embedding[1] > 0 AS INTEGER) AS INTEGER) AS bands FROM embeddings")
def band_maps(spark, folder):
    first = F.get("values", F.lit(0))
    rows = spectra(spark, folder).select("vec_id", F.when(first > 0, first.cast("string")).otherwise("n/a").alias("band_500"), F.lit("1.5").alias("band_900"))
    return rows.select("vec_id", F.size(logs.band_map(rows)).alias("bands"))


@query("file_inventory", "SELECT o_orderpriority AS name, count(*) AS rows FROM orders GROUP BY 1")
def file_inventory(spark, folder):
    """Files written from orders, listed with size and SHA-256, checked against hashes of their stored bytes."""
    path = scratch(spark, "inventory")
    orders = table(spark, folder, "orders").select("o_orderpriority", F.col("o_orderkey").cast("string").alias("value"))
    orders.repartition("o_orderpriority").write.partitionBy("o_orderpriority").text(path)
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("expected"), "content")
    both = files.inventory(spark, path).join(stored, "path").where("sha256 = expected")
    name = F.try_url_decode(F.regexp_extract("path", r"o_orderpriority=([^/]+)/", 1))
    return both.select(name.alias("name"), (F.size(F.split(F.col("content").cast("string"), "\n")) - 1).alias("n")).groupBy("name").agg(F.sum("n").alias("rows"))


@query("package_documents", "SELECT CAST(c_custkey AS VARCHAR) AS hole_id, 12 - CAST(c_custkey % 2 AS INTEGER) + CAST(c_custkey % 3 = 0 AS INTEGER) AS problems, c_name AS name FROM customer")
def package_documents(spark, folder):
    """Hole documents from JSON files: one borehole.json and for every second hole a datasets.json."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("hole_id"), "c_custkey", "c_name")
    repeated = F.when(F.col("c_custkey") % 3 == 0, F.lit(',"name":"twice"')).otherwise(F.lit(""))
    holes = rows.select("hole_id", F.lit("borehole.json").alias("document"), F.concat(F.lit('{"name":"first"'), repeated, F.lit(',"label":"'), "c_name", F.lit('"}')).alias("text"))
    sets = rows.where("c_custkey % 2 = 1").select("hole_id", F.lit("datasets.json").alias("document"), F.concat(F.lit('[{"dataset_id":"d'), "hole_id", F.lit('"}]')).alias("text"))
    docs = holes.unionByName(sets)
    docs = docs.withColumn("top", F.when(F.col("text").startswith("{"), "object").otherwise("array"))
    problems = documents.document_problems(docs, rows).groupBy("hole_id").agg(F.count(F.lit(1)).cast("int").alias("problems"))
    names = docs.where("document = 'borehole.json'").select("hole_id", F.get_json_object("text", "$.label").alias("name"))
    return names.join(problems, "hole_id")


@query("header_collars", f"""WITH {SITES_SQL} SELECT hole_id, CASE WHEN hole_id % 5 = 1 THEN 'document type or entity declared' WHEN hole_id % 5 = 2 THEN 'repeated node' END AS problem,
 CASE WHEN hole_id % 5 IN (1, 3) THEN NULL ELSE round(latitude, 4) END AS latitude FROM sites""")
def header_collars(spark, folder):
    k = F.col("hole_id") % 5
    lat = F.when(k == 3, "0.000000").otherwise(F.round("latitude", 6).cast("string"))
    xml = F.concat(
        F.when(k == 1, "<!DOCTYPE x>").otherwise(""), F.lit("<Header><Latitude>"), lat, F.lit("</Latitude><Longitude>"), F.round("longitude", 6).cast("string"), F.lit("</Longitude>"),
        F.when(k == 2, "<Project>a</Project><Project>b</Project>").otherwise("<Project>a</Project>"), F.lit("</Header>"),
    )
    rows = sites(spark, folder).select("hole_id", "latitude", "longitude").select("hole_id", xml.alias("description"))
    found = documents.header_collars(rows)
    return found.select("hole_id", F.col("header_problem").alias("problem"), F.round("latitude", 4).alias("latitude"))


@query("membership_collections", "SELECT o_custkey AS dataset_id, o_orderkey AS log_id, CASE WHEN o_orderkey % 2 = 0 THEN 'scalar' ELSE 'spectral' END AS kind FROM orders")
def membership_collections(spark, folder):
    """Dataset-collection XML written from orders and read back as dataset-log rows."""
    path = scratch(spark, "collections")
    log = F.col("o_orderkey").cast("string")
    listed = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<Logs><Log><LogID>"), log, F.lit("</LogID></Log></Logs>"))).otherwise(
        F.concat(F.lit("<SpectralLogs><SpectralLog><logID>"), log, F.lit("</logID></SpectralLog></SpectralLogs>"))
    )
    body = F.concat(F.lit("<Dataset><DatasetID>"), F.col("o_custkey").cast("string"), F.lit("</DatasetID>"), listed, F.lit("</Dataset>"))
    table(spark, folder, "orders").select(body.alias("value")).write.text(path)
    found = documents.read_membership(spark, path, multiline=False)
    return found.select(F.col("dataset_id").cast("long").alias("dataset_id"), F.col("log_id").cast("long").alias("log_id"), "kind")


@query("collar_catalogue", f"""WITH {SITES_SQL} SELECT CAST(hole_id AS VARCHAR) AS hole_id, round(longitude, 6) AS longitude, CAST(-90.0 AS DOUBLE) AS inclination_deg FROM sites WHERE hole_id % 3 = 1 AND hole_id % 2 = 1""")
def collar_catalogue(spark, folder):
    """GeoJSON collections, one per line, of collars and other points; holes already known are left out."""
    path = scratch(spark, "geojson")
    s = sites(spark, folder)
    role = F.when(F.col("hole_id") % 3 == 1, "collar").otherwise("toe")
    feature = F.struct(F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"), F.struct(role.alias("feature_role"), F.col("hole_id").cast("string").alias("hole")).alias("properties"))
    s.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value")).write.text(path)
    known = s.where("hole_id % 2 = 0").select(F.col("hole_id").cast("string").alias("hole_id"))
    found = logs.read_collar_catalogue(spark, path, known, multiline=False)
    return found.select("hole_id", F.round("longitude", 6).alias("longitude"), "inclination_deg")


@query("hole_table", f"WITH {SITES_SQL} SELECT CAST(hole_id AS VARCHAR) AS hole_id, round(latitude, 6) AS latitude, CAST(-90.0 AS DOUBLE) AS inclination_deg FROM sites WHERE hole_id % 6 <> 5")
def hole_table(spark, folder):
    path = scratch(spark, "holes")
    lat = F.when(F.col("hole_id") % 6 == 5, "unknown").otherwise(F.col("latitude").cast("string"))
    sites(spark, folder).select("hole_id", "hole_name", lat.alias("latitude"), "longitude", F.lit("").alias("inclination_deg")).write.option("header", "true").csv(path)
    return logs.read_holes(spark, path).select("hole_id", F.round("latitude", 6).alias("latitude"), "inclination_deg")


@query("keyed_collars", "SELECT 'part' || p_size AS key, min(p_partkey) AS p_partkey FROM part GROUP BY p_size")
def keyed_collars(spark, folder):
    rows = table(spark, folder, "part").select(F.concat(F.lit("PART "), F.col("p_size").cast("string"), F.lit(" [chips]")).alias("name"), F.col("p_partkey"), F.col("p_partkey").alias("position"))
    return logs.keyed_collars(rows, name="name", position="position").select("key", "p_partkey")


@query("listed_hole_ids", "SELECT CAST(o_custkey AS VARCHAR) AS hole_id FROM orders WHERE o_custkey % 9 > 0 GROUP BY 1")
def listed_hole_ids(spark, folder):
    path = scratch(spark, "ids")
    key = F.col("o_custkey")
    text = F.when(key % 9 == 0, F.concat(F.lit("# "), key.cast("string"))).otherwise(F.concat(F.lit("  "), key.cast("string")))
    table(spark, folder, "orders").select(text.alias("value")).write.text(path)
    return logs.read_hole_ids(spark, path).select("hole_id")


@query("isolated_packages", f"WITH {SITES_SQL} SELECT hole_id, latitude IS NOT NULL AND hole_id % 8 <> 0 AS passed FROM sites")
def isolated_packages(spark, folder):
    """Package checks per hole: the bad ones are set aside with their reason, the others go on."""
    s = sites(spark, folder).withColumn("latitude", F.when(F.col("hole_id") % 8 == 0, F.col("latitude") + 200).otherwise(F.col("latitude")))
    bad = quality.collar_range(s, key=["hole_id"]).select(F.col("key").cast("long").alias("hole_id"), "rule", "detail")
    return routing.isolate(s.select("hole_id"), bad)[1].select("hole_id", (F.col("status") == "passed").alias("passed"))


# ---------------------------------------------------------------- streams


def _event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return ingest.stream_table(spark, folder, schema, glob="events.parquet")


@query(
    "streamed_daily_calls",
    f"""WITH {DAILY_SQL} SELECT hole, depth_from_m, lower(call) AS call, round(n_label / n_samples, 6) AS confidence, n_samples FROM daily""",
)
def streamed_daily_calls(spark, folder):
    """Running counts kept by a stream over events; the call is taken from them on read."""
    us = F.unix_micros(instant("ts"))
    samples = _event_stream(spark, folder).select(
        F.col("user_id").alias("hole"), ((us - 1704067200000000) / 3.6e9).alias("depth_h"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("call"), order_of(us, F.col("event_id")).alias("at")
    )
    running = ingest.running_counts(samples, key=["hole"], depth="depth_h", label="call", order="at", width=24.0)
    updates = ingest.drain(running, "update", scratch(spark, "stream"))
    latest = ingest.latest_counts(updates, key=["hole"], label="call")
    return ingest.finished_calls(latest, key=["hole"], label="call").withColumn("confidence", F.round("confidence", 6))


@query("streamed_window_counts", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_window_counts(spark, folder):
    """Tumbling day windows with a watermark, with the last count of every window, open ones included."""
    events = _event_stream(spark, folder).withColumn("ts", instant("ts"))
    counted = ingest.windowed_counts(events, time="ts", label="event_type")
    updates = ingest.drain(counted, "update", scratch(spark, "stream"))
    counts = updates.groupBy("window_start", "event_type").agg(F.max("n").alias("n"))
    day = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window_start").cast("timestamp_ntz")).cast("date")
    return counts.select(day.alias("day"), "event_type", "n")


@query("streamed_revisions", "SELECT o_orderkey AS dataset_revision_id, CAST(o_custkey AS VARCHAR) AS input_digest FROM orders")
def streamed_revisions(spark, folder):
    """Revisions loaded twice by a stream: the repeated ones are no-ops."""
    source, target, state = scratch(spark, "revisions"), scratch(spark, "loaded"), scratch(spark, "stream")
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("dataset_revision_id"), F.col("o_custkey").cast("string").alias("input_digest"))
    for chosen in (rows, rows.where("dataset_revision_id % 2 = 0")):
        chosen.write.mode("append").parquet(source)
        ingest.ingest(ingest.stream_table(spark, source, rows.schema), target, state).awaitTermination()
    return spark.read.parquet(target).select("dataset_revision_id", "input_digest")


@query("streamed_distinct_packages", "SELECT count(DISTINCT (user_id, event_type)) AS packages FROM events")
def streamed_distinct_packages(spark, folder):
    events = _event_stream(spark, folder).select(instant("ts").alias("at"), F.col("user_id").alias("dataset_revision_id"), F.col("event_type").alias("input_digest"))
    once = ingest.drop_repeated_packages(events, time="at", within=None)
    return ingest.drain(once, "append", scratch(spark, "stream")).agg(F.count(F.lit(1)).alias("packages"))


EVENT_FILES = 4
#: Which of the files an event is in: a quarter of the time span each, but for every fiftieth, which comes two files later.
EVENT_FILES_SQL = """e AS (SELECT *, epoch_us(ts) AS us FROM events),
s AS (SELECT min(us) AS lo, max(us) AS hi FROM e),
q AS (SELECT e.*, CAST(least(3, (us - lo) * 4 // (hi - lo + 1) + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS f FROM e, s),
m AS (SELECT f, max(max(us)) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM q GROUP BY f)"""


def _event_files(spark, folder):
    """The events as a stream of files that come one after the other, a batch each."""
    path = scratch(spark, "event-files")
    events = table(spark, folder, "events").withColumn("ts", instant("ts"))
    us = F.unix_micros("ts")
    lo, hi = events.agg(F.min(us), F.max(us)).first()
    place = F.least(F.lit(EVENT_FILES - 1).cast("long"), F.expr(f"(unix_micros(ts) - {lo}) * {EVENT_FILES} div ({hi} - {lo} + 1)") + F.when(F.col("event_id") % 50 == 0, 2).otherwise(0))
    for k in range(EVENT_FILES):
        events.where(place == k).coalesce(1).write.mode("append").parquet(path)
    return ingest.stream_table(spark, path, events.schema, files_per_trigger=1)


@query(
    "streamed_late_rows",
    f"""WITH {EVENT_FILES_SQL}
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) FILTER (WHERE mark IS NULL OR us >= mark - 86400000000) AS n, count(*) FILTER (WHERE us < mark - 86400000000) AS n_late FROM q JOIN m USING (f) GROUP BY 1, 2""",
)
def streamed_late_rows(spark, folder):
    """Day counts of a stream of several files, rows on time and rows too late apart."""
    path = scratch(spark, "on-time")
    ingest.count_on_time(_event_files(spark, folder), path, time="ts", label="event_type").awaitTermination()
    utc = lambda at: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(at).cast("timestamp_ntz")).cast("date")
    counts = spark.read.parquet(f"{path}/counts").select(utc("window_start").alias("day"), "event_type", "n", F.lit(0).cast("long").alias("n_late"))
    late = spark.read.parquet(f"{path}/late").groupBy(utc("ts").alias("day"), "event_type").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("n_late"))
    return counts.unionByName(late).groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))


@query(
    "streamed_recent_packages",
    f"""WITH {EVENT_FILES_SQL},
k AS (SELECT f, user_id, event_type, min((us, event_id)) AS first, max(us) AS seen FROM q GROUP BY ALL)
SELECT user_id, event_type, first[2] AS event_id FROM k JOIN m USING (f) WHERE NOT EXISTS (SELECT 1 FROM k g WHERE g.f < k.f AND g.user_id = k.user_id AND g.event_type = k.event_type AND g.seen >= m.mark - 172800000000)""",
)
def streamed_recent_packages(spark, folder):
    """Packages that a stream of several files had not seen in the two days before."""
    path = scratch(spark, "packages")
    packages = _event_files(spark, folder).select("user_id", "event_type", "ts", "event_id")
    ingest.keep_first_packages(packages, path, time="ts", ident="user_id", digest="event_type", within="2 days").awaitTermination()
    return spark.read.parquet(f"{path}/kept").select("user_id", "event_type", "event_id")
