"""Readers of scalar, profile and measurement logs and of hole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import fixed
from stratalog.functions.numbers import finite
from stratalog.functions.text import fold_name
from stratalog.operators.ordered import number, ordered_scan
from stratalog.sources.files import first_lines, list_files

MAX_HEADERS = 1_000


def numbered_rows(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` with file ``path`` and 0-based ``source_row`` within the file.

    Rows of a file split keep their order in a task, and splits are ordered by
    their start; counting per split and carrying over gives the row number
    without bringing a file together.
    """
    placed = df.select(
        *keep, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    counted = ordered_scan(placed, ["path"], ["_start", "_at"], {"source_row": number()}, block=F.col("_start"))
    return counted.withColumn("source_row", F.col("source_row") - 1).drop("_start", "_at")


def read_scalar_log(spark: SparkSession, path: str, *, mode: str = "strict", glob: str = "*.csv") -> DataFrame:
    """path, source_row, start, end, token of StartDepth,EndDepth,value files.

    strict: exactly three columns, numeric depths, anything else fails the read.
    lenient: short rows, non-numeric depths and blank calls are skipped.
    literal: only the first two commas separate, quotes are text.
    """
    if mode == "strict":
        reader = spark.read.option("header", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true")
        reader = reader.option("emptyValue", "").option("nullValue", "\u0000").option("pathGlobFilter", glob)
        rows = reader.schema("start double, end double, token string").csv(path)
        # the reader gives null for an empty field; the canonical token of it is the empty text
        return numbered_rows(rows.withColumn("token", F.coalesce("token", F.lit(""))), ["start", "end", "token"])
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    if mode not in ("lenient", "literal"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = F.split("value", ",", 3) if mode == "literal" else F.split("value", ",")
    rows = numbered_rows(text.withColumn("_p", parts), ["_p"])
    parsed = rows.select(
        "path", "source_row",
        F.trim(F.get("_p", F.lit(0))).try_cast("double").alias("start"),
        F.trim(F.get("_p", F.lit(1))).try_cast("double").alias("end"),
        F.get("_p", F.lit(2)).alias("token"),
    ).where("start is not null and end is not null and token is not null")
    # the header is row 0 of the text
    parsed = parsed.withColumn("source_row", F.col("source_row") - 1)
    if mode == "lenient":
        parsed = parsed.withColumn("token", F.trim("token"))
        parsed = parsed.where(~F.upper("token").isin(fixed.NOT_ROCK))
    return parsed


def read_profiles(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """path, sample_no, values of JSON-lines profiles; a malformed line fails the read."""
    rows = (
        spark.read.schema("sampleNo long, floatprofdata array<double>").option("mode", "FAILFAST").option("allowNonNumericNumbers", "false")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)
    )
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("sampleNo").alias("sample_no"), F.col("floatprofdata").alias("values"))


def profile_number_errors(profiles: DataFrame) -> DataFrame:
    """Profile logs whose sample numbers are not 0..n-1, each once."""
    stats = profiles.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count("sample_no").alias("c"), F.min("sample_no").alias("lo"), F.max("sample_no").alias("hi")
    )
    ends = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("c") == F.col("n"))
    repeated = profiles.groupBy("path", "sample_no").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("path")
    return stats.where(~ends).select("path").unionByName(repeated).distinct()


def read_measurements(spark: SparkSession, folder: str, *, id_columns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, incomplete): all measurement tables of a folder united by column name.

    Files with one header are read together, so the plan grows with the number
    of distinct headers, not of files. hole_id comes from the file name when
    the table has none. Rows without a depth are dropped; ``incomplete`` holds
    rows in which a declared identity column is blank, which callers must
    refuse.
    """
    heads = first_lines(list_files(spark, folder, "*.csv"))
    if heads.select("line").distinct().limit(MAX_HEADERS + 1).count() > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    # paths only: Spark's own file listing keeps as many on the driver
    groups: dict[str, list[str]] = {}
    for row in heads.orderBy("path").toLocalIterator():
        groups.setdefault(row["line"], []).append(row["path"])
    if not groups:
        raise ValueError(f"no measurement tables in {folder}")
    frames = []
    for paths in groups.values():
        frame = spark.read.option("header", "true").csv(paths)
        stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.csv$", "")
        hole = F.col("hole_id") if "hole_id" in frame.columns else stem
        frames.append(frame.select(hole.alias("hole_id"), *[F.col(f"`{c}`") for c in frame.columns if c != "hole_id"]))
    data = frames[0]
    for frame in frames[1:]:
        data = data.unionByName(frame, allowMissingColumns=True)
    for c in ("depth_from_m", "depth_to_m", "sample_no"):
        if c in data.columns:
            data = data.withColumn(c, F.col(c).try_cast("double"))
    present = [c for c in id_columns if c in data.columns]
    blank = F.lit(False)
    for c in present:
        blank = blank | F.col(c).isNull() | (F.trim(c) == "")
    return data.where("depth_from_m is not null"), data.where(blank)


def read_holes(spark: SparkSession, path: str) -> DataFrame:
    """Hole table with typed coordinates; rows without both coordinates are dropped."""
    raw = spark.read.option("header", "true").csv(path)
    typed = {c: finite(c) for c in ("latitude", "longitude", "elevation_m", "borehole_length_m", "easting", "northing") if c in raw.columns}
    if "inclination_deg" in raw.columns:
        typed["inclination_deg"] = F.coalesce(finite("inclination_deg"), F.lit(-90.0))
    if "azimuth_deg" in raw.columns:
        typed["azimuth_deg"] = F.coalesce(finite("azimuth_deg"), F.lit(0.0))
    return raw.withColumn("hole_id", F.trim("hole_id")).withColumns(typed).na.drop(subset=["latitude", "longitude"])


def read_hole_ids(spark: SparkSession, path: str, given: Sequence[str] = ()) -> DataFrame:
    """hole_id and position: ids given first, then those of a text or delimited file, first occurrence kept.

    A header naming an id column chooses that column; otherwise the first one.
    Blank lines and comments are skipped.
    """
    text = numbered_rows(spark.read.text(path), ["value"])
    separator = "\t" if path.lower().endswith(".tsv") else "," if path.lower().endswith(".csv") else None
    cells = F.split("value", separator) if separator else F.array("value")
    rows = text.withColumn("_cells", F.transform(cells, lambda c: F.trim(F.replace(c, F.lit("﻿"), F.lit("")))))
    rows = rows.where(F.exists("_cells", lambda c: c != ""))
    head = rows.orderBy("source_row").limit(1).select("_cells", "source_row").first()
    if head is None:
        listed = spark.createDataFrame([], "hole_id string, position long")
    else:
        names = [c.lower().replace(" ", "_") for c in head["_cells"]]
        column = next((i for i, n in enumerate(names) if n in fixed.ID_HEADERS), None)
        body = rows if column is None else rows.where(F.col("source_row") > head["source_row"])
        listed = body.select(F.get("_cells", F.lit(column or 0)).alias("hole_id"), (F.col("source_row") + len(given)).alias("position"))
    first = spark.createDataFrame([(str(g).strip(), i) for i, g in enumerate(given)], "hole_id string, position long")
    every = first.unionByName(listed).where("hole_id <> '' and not startswith(hole_id, '#')")
    return every.groupBy("hole_id").agg(F.min("position").alias("position"))


def read_collar_catalogue(spark: SparkSession, path: str, known: DataFrame | None = None, multiline: bool = True) -> DataFrame:
    """Collar points of GeoJSON feature collections, first per hole, without holes already known.

    With ``multiline=False`` every line is a collection of its own and large inputs split over tasks.
    """
    schema = (
        "features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<"
        "feature_role:string,hole:string,elevation_m:double,total_depth_m:double,dip:double,azimuth:double>>>"
    )
    features = spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path).select(F.posexplode("features").alias("position", "f"))
    p = F.col("f.properties")
    collars = features.where((F.col("f.geometry.type") == "Point") & (p["feature_role"] == "collar")).select(
        F.trim(p["hole"]).alias("hole_id"), "position", F.get("f.geometry.coordinates", F.lit(0)).alias("longitude"),
        F.get("f.geometry.coordinates", F.lit(1)).alias("latitude"), p["elevation_m"].alias("elevation_m"), p["total_depth_m"].alias("borehole_length_m"),
        F.coalesce(p["dip"], F.lit(-90.0)).alias("inclination_deg"), F.coalesce(p["azimuth"], F.lit(0.0)).alias("azimuth_deg"),
    ).where("hole_id <> ''")
    others = [c for c in collars.columns if c not in ("hole_id", "position")]
    first = collars.groupBy("hole_id").agg(F.min_by(F.struct(*others), "position").alias("_f")).select("hole_id", "_f.*")
    return first if known is None else first.join(known.select("hole_id"), "hole_id", "left_anti")


def keyed_collars(collars: DataFrame, *, name: str, position: str) -> DataFrame:
    """Collar rows by folded name, the first in source order winning."""
    others = [c for c in collars.columns if c != position]
    keyed = collars.withColumn("key", fold_name(name)).where("key <> ''")
    return keyed.groupBy("key").agg(F.min_by(F.struct(*others), position).alias("_c")).select("key", "_c.*")


def band_map(df: DataFrame, prefix: str = "band_") -> Column:
    """map<string,double> of the band columns that hold a number."""
    entries = F.array(*[F.struct(F.lit(c).alias("key"), finite(c).alias("value")) for c in df.columns if c.startswith(prefix)])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
