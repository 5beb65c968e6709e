"""Writers: canonical logs, wide and long outputs, exchange files and read-back checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.text import column_label, wavelength_column
from stratalog.operators.relations import multiset_difference
from stratalog.session import settle_table

ROWS_PER_FILE = 1_000_000
CHUNK_ROWS = 4_096

# most wavelength axes that one wide table may join; more are refused
MAX_STREAMS = 10_000


def write_canonical(df: DataFrame, path: str, *, partitions: Sequence[str], order: str, mode: str = "errorifexists") -> None:
    """Typed Parquet partitioned by log, each file a contiguous range of ``order`` so that footers prune depth reads.

    A heavy log is cut by row block before writing, so it becomes many files
    written by many tasks.
    """
    block = F.floor(F.coalesce(F.col(order), F.lit(0)) / ROWS_PER_FILE)
    placed = df.repartition(*[F.col(p) for p in partitions], block).sortWithinPartitions(*partitions, order)
    placed.write.mode(mode).partitionBy(*partitions).option("compression", "zstd").parquet(path)


def chunk_index(df: DataFrame, *, log: Sequence[str], row: str, coordinate: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Row range and coordinate range per chunk of ``rows`` rows (an audit table; Parquet footers do the pruning)."""
    return df.groupBy(*log, F.floor(F.col(row) / rows).alias("row_group")).agg(
        F.min(row).alias("source_row_from"), (F.max(row) + 1).alias("source_row_to_exclusive"), F.count(F.lit(1)).alias("row_count"),
        F.min(coordinate).alias("coordinate_min"), F.max(coordinate).alias("coordinate_max"),
    )


def read_back_difference(written: DataFrame, path: str) -> DataFrame:
    """Rows by which the stored table differs from what was meant to be written; empty means equal, nulls included."""
    stored = written.sparkSession.read.parquet(path)
    types = dict(written.dtypes)
    return multiset_difference(written, stored.select(*[F.col(c).cast(types[c]) for c in written.columns]))


def wide_measurements(values: DataFrame, *, names: Sequence[str] | None = None) -> DataFrame:
    """hole_id, sample_no, depth_from_m, depth_to_m and one column per log, from long (.., name, value) rows.

    Give ``names`` to spare the job that looks for them.
    """
    if names is None:
        names = sorted(r[0] for r in values.select("name").distinct().limit(10_001).collect())
        if len(names) > 10_000:
            raise ValueError("more than 10 000 distinct logs: keep the long form")
    keys = ["hole_id", "sample_no", "depth_from_m", "depth_to_m"]
    return values.groupBy(*keys).pivot("name", list(names)).agg(F.first("value", ignorenulls=True))


def core_intervals(layout: DataFrame, tray_depths: DataFrame, thumbnails: DataFrame, axis: DataFrame) -> DataFrame:
    """Core layout rows with depths from the axis, tray depths and thumbnail path by tray index."""
    top = axis.select("hole_id", F.col("sample_no").alias("sample_start"), "depth_from_m")
    bottom = axis.select("hole_id", F.col("sample_no").alias("sample_end"), "depth_to_m")
    joined = layout.join(top, ["hole_id", "sample_start"], "left").join(bottom, ["hole_id", "sample_end"], "left")
    joined = joined.join(tray_depths.select("hole_id", "dataset_id", "tray_index", "tray_depth_from_m", "tray_depth_to_m"), ["hole_id", "dataset_id", "tray_index"], "left")
    joined = joined.join(thumbnails.select("hole_id", "dataset_id", "tray_index", "thumbnail_path"), ["hole_id", "dataset_id", "tray_index"], "left")
    return joined.select(
        "hole_id", "dataset_name", "tray_no", "tray_index", "section_no", "sample_start", "sample_end",
        "depth_from_m", "depth_to_m", "tray_depth_from_m", "tray_depth_to_m", "thumbnail_path",
    )


def signal_rows(logs: DataFrame, spectra: DataFrame, profiles: DataFrame, axis: DataFrame) -> DataFrame:
    """Signals in long form: spectra as arrays, profiles as JSON, one placeholder row per log without data.

    ``logs``: hole_id, log_id, signal_name, signal_type, status, channel_units.
    """
    meta = logs.select("hole_id", "log_id", "signal_name", "signal_type", F.coalesce("status", F.lit("metadata_only")).alias("status"), "channel_units")
    depth = axis.select("hole_id", "sample_no", "depth_from_m", "depth_to_m")
    columns = ["hole_id", "signal_name", "signal_type", "status", "sample_no", "depth_from_m", "depth_to_m", "channel_units", "values", "values_json"]
    done = meta.where("status = 'complete'")
    s = done.join(spectra.select("log_id", "sample_no", F.col("values").cast("array<double>").alias("values")), "log_id")
    p = done.join(profiles.select("log_id", "sample_no", F.to_json(F.struct(F.col("sample_no").alias("sampleNo"), F.col("values").alias("floatprofdata"))).alias("values_json")), "log_id")
    empty = meta.where("status <> 'complete'").withColumn("sample_no", F.lit(None).cast("long"))
    nothing = {"values": F.lit(None).cast("array<double>"), "values_json": F.lit(None).cast("string")}
    full = lambda df: df.withColumns({k: v for k, v in nothing.items() if k not in df.columns})
    rows = full(s).unionByName(full(p), allowMissingColumns=True).unionByName(full(empty), allowMissingColumns=True)
    return rows.join(depth, ["hole_id", "sample_no"], "left").select(*columns)


def wide_spectra(spectra: DataFrame, streams: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Spectra with one column per wavelength over the union of all axes; for exchange, not for analysis.

    The wavelength axes (one row per stream) decide the columns before any
    spectrum is read; the values go straight into place without a shuffle per channel.
    """
    axes = {r["stream_id"]: r["names"] for r in streams.select(
        "stream_id", F.transform("wavelengths", lambda w: wavelength_column(w, F.col("unit"))).alias("names")
    ).limit(MAX_STREAMS + 1).collect()}
    if len(axes) > MAX_STREAMS:
        raise ValueError(f"more than {MAX_STREAMS} spectral streams: write them in parts")
    names = list(dict.fromkeys(n for a in axes.values() for n in a))
    at = {stream: {n: i for i, n in enumerate(a)} for stream, a in axes.items()}
    columns = []
    for name in names:
        value = F.lit(None).cast("double")
        for stream, places in at.items():
            if name in places:
                value = F.when(F.col("stream_id") == stream, F.get("values", F.lit(places[name])).cast("double")).otherwise(value)
        columns.append(value.alias(name))
    return spectra.select(*keys, *columns)


def asset_rows(files: DataFrame, logs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Files as assets, plus a row with a note for every log that is not completely there."""
    names = datasets.select("hole_id", "dataset_id", "dataset_name")
    present = files.join(names, ["hole_id", "dataset_id"], "left").select(
        "hole_id", F.coalesce("kind", F.lit("asset")).alias("asset_kind"), F.lit("complete").alias("status"), "dataset_name",
        F.coalesce("log_name", "kind", F.lit("asset")).alias("asset_name"), "sample_no", "depth_from_m", "depth_to_m",
        F.col("file").alias("file_path"), F.coalesce("nbytes", F.lit(0)).cast("long").alias("nbytes"), F.lit("").alias("notes"),
    )
    counted = files.select("hole_id", "log_id").distinct().withColumn("_has", F.lit(True))
    status = F.coalesce("status", F.lit("metadata_only"))
    partial = logs.join(counted, ["hole_id", "log_id"], "left").where(~((status == "complete") & F.coalesce("_has", F.lit(False))))
    partial = partial.join(names, ["hole_id", "dataset_id"], "left").select(
        "hole_id", column_label("log_name", "image").alias("asset_kind"), status.alias("status"), "dataset_name",
        F.coalesce("log_name", F.lit("image")).alias("asset_name"), F.lit(None).cast("long").alias("sample_no"),
        F.lit(None).cast("double").alias("depth_from_m"), F.lit(None).cast("double").alias("depth_to_m"), F.lit(None).cast("string").alias("file_path"),
        F.lit(0).cast("long").alias("nbytes"),
        F.concat_ws(" ", F.lit("downloaded"), F.coalesce("downloaded", F.lit(0)).cast("string"), F.lit("of"), F.coalesce("sample_count", F.lit(0)).cast("string")).alias("notes"),
    )
    return present.unionByName(partial)


def write_anomalies(intervals: DataFrame, holes: DataFrame, root: str) -> None:
    """Interval and hole scores: Parquet and JSON lines, both ordered by hole and depth, and the hole table.

    Footers of the ordered Parquet files prune to a hole without a folder per
    hole. JSON lines, each with its hole, stand in for one nested document,
    which would gather every interval in a single row.
    """
    kept = settle_table(intervals, "anomalies")
    # ranges of (hole, depth): a heavy hole is written by several tasks
    kept.repartitionByRange("hole_id", "depth_from_m").sortWithinPartitions("hole_id", "depth_from_m").write.parquet(f"{root}/anomalies")
    placed = kept.repartitionByRange("hole_id", "depth_from_m").sortWithinPartitions("hole_id", "depth_from_m")
    placed.write.option("ignoreNullFields", "false").json(f"{root}/anomalies_json")
    holes.write.parquet(f"{root}/hole_anomalies")


def feature_lines(df: DataFrame, *, properties: Sequence[str], lat: str = "latitude", lon: str = "longitude", ident: str | None = None) -> DataFrame:
    """One GeoJSON Feature per row as text, for newline-delimited GeoJSON of any size."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    parts = [F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")]
    if ident:
        parts.insert(1, F.col(ident).alias("id"))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("value")
    )


def export_table(df: DataFrame, path: str, *, scope: DataFrame | None = None, on: Sequence[str] = (), key: Sequence[str] = ()) -> None:
    """Scoped rows as gzip JSON lines; ``key`` orders them over the whole output."""
    rows = df if scope is None else df.join(scope.select(*on).distinct(), list(on), "left_semi")
    rows = rows.orderBy(*key) if key else rows
    rows.write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def import_table(spark: SparkSession, path: str, schema: T.StructType, expected_rows: int) -> DataFrame:
    """Typed rows of an export; refuses malformed lines, other columns and another row count."""
    text = spark.read.text(path)
    names = F.array_sort(F.json_object_keys("value"))
    wanted = F.array_sort(F.array(*[F.lit(f.name) for f in schema.fields]))
    stats = text.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(names == wanted, F.lit(False))).alias("odd")).first()
    if stats["odd"]:
        raise ValueError(f"{stats['odd']} rows have missing or unknown fields")
    if stats["n"] != expected_rows:
        raise ValueError(f"{stats['n']} rows, the manifest says {expected_rows}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def replace_measurements(incoming: DataFrame, holes: DataFrame, path: str) -> tuple[int, int]:
    """Write the rows of known holes as the next version of the table; (written, skipped).

    Versions lie side by side below ``path``. ``current_measurements`` reads the last that was
    written to its end, so a failed job leaves the table as it was.
    """
    spark = incoming.sparkSession
    known = incoming.join(holes.select("hole_id"), "hole_id", "left_semi")
    total = incoming.count()
    target = f"{path}/version_{max(_versions(spark, path, complete=False), default=0) + 1:09d}"
    known.write.mode("errorifexists").parquet(target)
    written = spark.read.parquet(target).count()
    return written, total - written


def current_measurements(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version that ``replace_measurements`` wrote."""
    return spark.read.parquet(f"{path}/version_{max(_versions(spark, path, complete=True)):09d}")


def _versions(spark: SparkSession, path: str, *, complete: bool) -> list[int]:
    # one entry per version; the job's own marker tells a complete one
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = jvm.Path(f"{path}/version_*" + ("/_SUCCESS" if complete else ""))
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    places = [status.getPath() for status in found or []]
    return [int((p.getParent() if complete else p).getName().removeprefix("version_")) for p in places]


def written_summary(states: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Summary rows of complete holes as CSV, ordered by hole."""
    states.select(*fields).orderBy("hole_id").write.mode("overwrite").option("header", "true").csv(path)


def depth_text(column: str | Column) -> Column:
    from stratalog.functions.text import number_text

    return F.coalesce(number_text(column), F.lit(""))
