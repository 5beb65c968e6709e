"""Files as tables: listings, byte ranges and hashes, read by tasks and never by the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.session import settle_table


def list_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path, relative path and size of every file below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    root = folder.rstrip("/").removeprefix("file://")
    return reader.load(folder).select(
        "path", F.substring_index("path", f"{root}/", -1).alias("relative_path"), F.col("length").alias("size")
    )


def tasks_for(files: DataFrame, bytes_per_task: int) -> int:
    """Number of tasks for work that follows file bytes.

    Rows that only name files are tiny, so adaptive execution would merge them
    into a single task; the count is therefore fixed from the listed sizes.
    """
    total = files.agg(F.sum("size")).first()[0] or 0
    return int(max(files.sparkSession.sparkContext.defaultParallelism * 2, min(total // bytes_per_task, 200_000)))


def file_system(path: str):
    """(Arrow file system, inner path) of a path as Spark lists it: unescaped, with or without scheme."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    authority, _, inner = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{inner}"


def open_file(path: str):
    """Seekable handle on any file system Arrow knows (local, HDFS, S3)."""
    system, inner = file_system(path)
    return system.open_input_file(inner)


def inventory(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Listing with ``sha256``; each file is hashed in 4 MiB pieces whatever its size."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = []
            for path in batch["path"]:
                h = hashlib.sha256()
                with open_file(path) as handle:
                    while piece := handle.read(4 * 1024 * 1024):
                        h.update(piece)
                hashes.append(h.hexdigest())
            yield batch.assign(sha256=hashes)

    files = list_files(spark, folder, glob)
    spread = files.repartition(tasks_for(files, 512 * 1024 * 1024), "path")
    return spread.mapInPandas(digest, "path string, relative_path string, size long, sha256 string")


def first_lines(files: DataFrame) -> DataFrame:
    """First line of each file, reading no more than it takes."""

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for path in batch["path"]:
                with open_file(path) as handle:
                    data = b""
                    while b"\n" not in data and (piece := handle.read(65536)):
                        data += piece
                lines.append(data.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r"))
            yield pd.DataFrame({"path": batch["path"], "line": lines})

    # only heads are read: many files per task
    spread = files.select("path").repartition(tasks_for(files, 4 * 1024 * 1024 * 1024), "path")
    return spread.mapInPandas(head, "path string, line string")


def read_spectra(files: DataFrame, *, rows_per_block: int = 4096, keep: Sequence[str] = ()) -> DataFrame:
    """One row per spectrum of row-major little-endian float32 files: path, keep columns, sample_no, values.

    ``files`` has path, size and bands. A file is cut into blocks of rows and
    each task seeks to its blocks, so one large file is read by many tasks.
    A file whose size is not a whole number of rows is left to ``ragged_files``.
    """
    whole = files.where((F.col("bands") > 0) & (F.col("size") % (F.col("bands") * 4) == 0) & (F.col("size") > 0))
    total = (F.col("size") / (F.col("bands") * 4)).cast("long")
    shards = whole.select("path", *keep, "bands", total.alias("_rows")).withColumn(
        "_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1, F.lit(rows_per_block).cast("long")))
    )
    shards = shards.withColumn("_count", F.least(F.lit(rows_per_block).cast("long"), F.col("_rows") - F.col("_start")))
    kept = shards.select("path", *keep).schema.fields
    schema = T.StructType([*kept, T.StructField("sample_no", T.LongType()), T.StructField("values", T.ArrayType(T.FloatType()))])
    names = schema.fieldNames()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.to_dict("records"):
                width, start, count = int(shard["bands"]), int(shard["_start"]), int(shard["_count"])
                with open_file(shard["path"]) as handle:
                    handle.seek(start * width * 4)
                    raw = handle.read(count * width * 4)
                matrix = np.frombuffer(raw, "<f4").reshape(count, width)
                part = pd.DataFrame({"sample_no": np.arange(start, start + count), "values": list(matrix)})
                for name in ("path", *keep):
                    part[name] = shard[name]
                yield part[names]

    spread = tasks_for(whole, 128 * 1024 * 1024)
    return shards.drop("_rows").repartition(spread, "path", "_start").mapInPandas(decode, schema)


def ragged_files(files: DataFrame) -> DataFrame:
    return files.where((F.col("bands") <= 0) | (F.col("size") % (F.col("bands") * 4) != 0) | (F.col("size") == 0))


def write_spectra(spectra: DataFrame, folder: str, *, name: str, values: str, order: str, rows_per_file: int = 65_536) -> DataFrame:
    """Row-major float32 files of at most ``rows_per_file`` rows; ``name``, block and ``file`` of each.

    Every file is written by one task from a bounded block of rows under a
    fixed name, so a repeated task overwrites its own file with the same bytes.
    """
    target = folder.rstrip("/")

    def save(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        key, block = part[name].iloc[0], int(part["_block"].iloc[0])
        system, root = file_system(target)
        system.create_dir(root)
        label = f"{key}_{block}.f32"
        with system.open_output_stream(f"{root}/{label}") as handle:
            handle.write(np.stack(part[values].to_numpy()).astype("<f4").tobytes())
        return pd.DataFrame({name: [key], "block": [block], "file": [label]})

    placed = spectra.withColumn("_block", F.floor((F.col(order) - 1) / rows_per_file))
    schema = T.StructType([spectra.schema[name], T.StructField("block", T.LongType()), T.StructField("file", T.StringType())])
    return settle_table(placed.groupBy(name, "_block").applyInPandas(save, schema), "written")


def file_hole(path: str | Column = "path", depth: int = 2) -> Column:
    """Hole id from the folder ``depth`` places from the end of a path."""
    p = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(p, "/"), -depth)
