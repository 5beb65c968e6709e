"""Incremental ingest, running interval calls and duplicate drop with Structured Streaming."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stratalog.operators.release import plan_load


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


#: Stored rows that a bucket of the ingest target holds on average before later batches use twice as many buckets.
BUCKET_ROWS = 100_000


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet rows below ``path`` with their partition columns; none where nothing has been written."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except Exception as error:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _bucket(ident: str, level) -> Column:
    return F.pmod(F.xxhash64(ident), F.pow(F.lit(2), F.lit(level)).cast("long"))


def stored_near(stored: DataFrame, wanted: DataFrame, ident: str, level: int) -> DataFrame:
    """The rows of the target in the buckets, of every level up to ``level``, that the ids of ``wanted`` fall in.

    A level is closed when its buckets hold ``BUCKET_ROWS`` on average, so what an id
    makes one read is bounded by that times the number of levels, however much is stored.
    """
    near = F.lit(False)
    for k in range(level + 1):
        # bounded by the ids of the batch and by the buckets of the level
        buckets = [r[0] for r in wanted.select(_bucket(ident, k)).distinct().collect()] if k else [0]
        near = near | ((F.col("level") == k) & F.col("bucket").isin(buckets))
    return stored.where(near)


def ingest(
    revisions: DataFrame, target: str, checkpoint: str, *, ident: str = "dataset_revision_id", digest: str = "input_digest", bucket_rows: int = BUCKET_ROWS
) -> StreamingQuery:
    """Append new revisions; a repeated one with the same digest is a no-op, another digest fails the batch.

    The target is laid out by level, bucket of the id's hash and batch: a batch reads
    only the buckets of its own ids. A batch that is replayed after a failure writes
    the same partitions again, so a row is stored exactly once. The rows of each batch
    are noted in ``<target>-sizes``, from which the level follows.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates([ident, digest]).persist()
        try:
            before = _stored(spark, f"{target}-sizes", SIZES).where(F.col("batch") < batch_id)
            held = before.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            level = max(0, math.ceil(math.log2(max(held, 1) / bucket_rows)))
            kept = T.StructType([*batch.schema.fields, *[T.StructField(c, T.LongType()) for c in ("level", "bucket", "batch")]])
            stored = _stored(spark, target, kept).where(F.col("batch") < batch_id)
            plan = plan_load(stored_near(stored, once, ident, level).select(*batch.columns), once, ident=ident, digest=digest).persist()
            twice = once.groupBy(ident).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            if not plan.where("action = 'conflict'").isEmpty() or not twice.isEmpty():
                raise ValueError("a revision arrived with other content than before")
            new = once.join(plan.where("action = 'load'").select(ident), ident, "left_semi").select(*batch.columns)
            placed = new.withColumns({"level": F.lit(level).cast("long"), "bucket": _bucket(ident, level), "batch": F.lit(batch_id).cast("long")})
            # a first or large batch has more rows than its buckets are meant for: no task writes a bucket alone
            pieces = max(1, math.ceil(once.count() / (bucket_rows * 2**level)))
            dealt = placed.repartition(F.col("bucket"), F.pmod(F.xxhash64(F.lit("piece"), ident), F.lit(pieces)))
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level", "bucket", "batch").parquet(target)
            written = _stored(spark, target, kept).where(F.col("batch") == batch_id)
            written.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{target}-sizes/batch={batch_id}")
            plan.unpersist()
        finally:
            once.unpersist()

    return (
        revisions.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


SIZES = T.StructType([T.StructField("rows", T.LongType()), T.StructField("batch", T.LongType())])
MARKS = T.StructType([T.StructField("mark", T.TimestampType()), T.StructField("batch", T.LongType())])


def _mark(spark: SparkSession, folder: str, batch_id: int):
    """The latest time of all batches before this one; every batch notes its own, so the last one says it."""
    return _stored(spark, f"{folder}/marks", MARKS).where(F.col("batch") < batch_id).agg(F.max("mark")).first()[0]


def _note(batch: DataFrame, folder: str, batch_id: int, time: str, mark) -> None:
    latest = batch.agg(F.max(time).cast("timestamp").alias("mark"))
    if mark is not None:
        latest = latest.select(F.greatest("mark", F.lit(mark)).alias("mark"))
    latest.write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")


def count_on_time(events: DataFrame, folder: str, *, time: str, label: str, late: str = "1 day", length: str = "1 day") -> StreamingQuery:
    """Label counts per tumbling window, with the rows that came too late put aside instead of dropped unseen.

    A row is late if its time lies more than ``late`` before the latest time of the
    batches before its own. Written below ``folder``: ``counts`` (window_start, label,
    n: what a batch adds), ``late`` (the rows) and ``marks``, each by batch and
    overwritten when a batch is replayed. Nothing else is kept as state.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        mark = _mark(batch.sparkSession, folder, batch_id)
        overdue = F.lit(False) if mark is None else F.coalesce(F.col(time) < F.lit(mark) - F.expr(f"INTERVAL {late}"), F.lit(False))
        batch = batch.persist()
        on_time = batch.where(~overdue).groupBy(F.window(time, length), label).agg(F.count(F.lit(1)).alias("n"))
        on_time.select(F.col("window.start").alias("window_start"), label, "n").write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")
        batch.where(overdue).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        _note(batch, folder, batch_id, time, mark)
        batch.unpersist()

    return events.writeStream.foreachBatch(load).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def keep_first_packages(packages: DataFrame, folder: str, *, time: str, ident: str = "dataset_revision_id", digest: str = "input_digest", within: str = "7 days") -> StreamingQuery:
    """Each (revision, digest) once within a horizon: kept unless an earlier batch had it no longer than ``within`` before the latest time.

    Written below ``folder`` by batch: ``kept`` (the first row in order of time) and
    ``seen`` (revision, digest and latest time). A batch reads only what is not older
    than the horizon, by the minima of the files, so the state that it meets is bounded.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        spark, key = batch.sparkSession, [ident, digest]
        mark = _mark(spark, folder, batch_id)
        batch = batch.persist()
        firsts = batch.groupBy(*key).agg(F.min(F.struct(time, *[c for c in batch.columns if c not in {*key, time}])).alias("_first"), F.max(time).alias("seen_at"))
        known = T.StructType([batch.schema[ident], batch.schema[digest], T.StructField("seen_at", batch.schema[time].dataType), T.StructField("batch", T.LongType())])
        if mark is not None:
            recent = _stored(spark, f"{folder}/seen", known).where(F.col("batch") < batch_id).where(F.col("seen_at") >= F.lit(mark) - F.expr(f"INTERVAL {within}"))
            first_here = firsts.join(recent.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct(), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_anti")
        else:
            first_here = firsts
        first_here.select(*key, "_first.*").select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/kept/batch={batch_id}")
        firsts.select(*key, "seen_at").write.mode("overwrite").parquet(f"{folder}/seen/batch={batch_id}")
        _note(batch, folder, batch_id, time, mark)
        batch.unpersist()

    return packages.writeStream.foreachBatch(load).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def running_counts(samples: DataFrame, *, key: Sequence[str], depth: str, label: str, order: str, width: float = 1.0) -> DataFrame:
    """Count and first position per (key, interval, label), updated as samples arrive.

    Only associative values are kept as state; ``finished_calls`` takes the
    mode from them on read. State is one row per label and interval.
    """
    interval = (F.floor(F.col(depth) / width) * width).cast("double").alias("depth_from_m")
    return samples.groupBy(*key, interval, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))


def finished_calls(counts: DataFrame, *, key: Sequence[str], label: str) -> DataFrame:
    """Dominant label and its share of all samples per interval, from the running counts."""
    by = [*key, "depth_from_m"]
    named = F.col(label).isNotNull()
    pick = F.when(named, F.struct((-F.col("n")).alias("neg"), "first_seen"))
    best = counts.groupBy(*by).agg(F.min_by(label, pick).alias("call"), F.max(F.when(named, F.col("n"))).alias("_n"), F.sum("n").alias("n_samples"))
    return best.select(*by, "call", (F.coalesce("_n", F.lit(0)) / F.col("n_samples")).alias("confidence"), "n_samples")


def windowed_counts(events: DataFrame, *, time: str, label: str, late: str = "1 day", length: str = "1 day") -> DataFrame:
    """Label counts per tumbling window; state of a window is dropped once the watermark passes it."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, length), label).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), label, "n")
    )


def drop_repeated_packages(packages: DataFrame, *, time: str, ident: str = "dataset_revision_id", digest: str = "input_digest", within: str | None = "7 days") -> DataFrame:
    """Each (revision, digest) once within the watermark; once for good with ``within=None``, whose state grows with the packages."""
    if within is None:
        return packages.dropDuplicates([ident, digest])
    return packages.withWatermark(time, within).dropDuplicatesWithinWatermark([ident, digest])


def drain(frame: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a finite stream to its end into Parquet below ``folder``, one part per batch; gives all output rows.

    A batch that is run again after a failure overwrites its own part.
    """
    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    frame.sparkSession.createDataFrame([], frame.schema).write.parquet(f"{folder}/rows/batch=-1")
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/rows").drop("batch")


def latest_counts(updates: DataFrame, *, key: Sequence[str], label: str) -> DataFrame:
    """Last state of update-mode output: counts only grow, so the largest is the latest."""
    return updates.groupBy(*key, "depth_from_m", label).agg(F.max("n").alias("n"), F.min("first_seen").alias("first_seen"))


