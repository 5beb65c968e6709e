"""Session settings, size checks and reliable materialisation.

Nothing here holds a global session: every helper takes the DataFrame or the
session it should act on.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most rows of one group that a single task may be asked to order or gather.
GROUP_ROWS_KEY = "stratalog.groupRows"
GROUP_ROWS = 2_000_000
# Rows that a task gets of a table dealt by its size.
TASK_ROWS = 1_000_000


def build_session(app: str = "stratalog", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library expects; cluster settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.enabled": "false",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, so that it need not be installed on them; once per application."""
    if spark.conf.get("stratalog.shipped", None):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # the driver's own folder: Spark serves the archive to the executors from there
    archive = os.path.join(tempfile.mkdtemp(prefix="stratalog-"), "stratalog.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as package:
        for folder, _, names in os.walk(os.path.join(root, "stratalog")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    package.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("stratalog.shipped", "true")


def _limit(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def group_rows(spark: SparkSession) -> int:
    return _limit(spark, GROUP_ROWS_KEY, GROUP_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = spark.conf.get("stratalog.localFolder", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("stratalog.localFolder", folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from the written copy.

    Used where a later step must see the very same rows in the very same
    blocks twice (range blocks, sampled rows), also after a lost executor.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame, label: str) -> DataFrame:
    """Like ``settle`` but columnar, so that later reads prune columns and push filters."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(rows in the largest group, rows in all), from one map-side combined count."""
    if not by:
        total = df.count()
        return total, total
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    row = counts.agg(F.max("_n"), F.sum("_n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def dealt(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` hashed by ``by`` into as many parts as keep ``TASK_ROWS`` to a task, however large it is."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(parts, -(-df.count() // TASK_ROWS)), *by)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
