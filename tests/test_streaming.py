import threading

import pytest
from pyspark.sql import functions as F

from stratalog.operators import release
from stratalog.session import scratch
from stratalog.streaming import ingest

SCHEMA = "dataset_revision_id long, input_digest string"


def _arrive(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def _load(spark, source, target, state, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    ingest.ingest(ingest.stream_table(spark, source, schema, files_per_trigger=1), target, state, **more).awaitTermination()


def _stored(spark, target):
    return sorted((r.dataset_revision_id, r.input_digest) for r in spark.read.parquet(target).collect())


def test_bucketed_target_replayed_and_conflicting(spark):
    source, target, state = (scratch(spark, name) for name in ("in", "out", "state"))
    _arrive(spark, source, [(i, f"d{i}") for i in range(300)])
    _load(spark, source, target, state, bucket_rows=20)
    _arrive(spark, source, [(i, f"d{i}") for i in range(250, 600)])
    _load(spark, source, target, state, bucket_rows=20)
    wanted = [(i, f"d{i}") for i in range(600)]
    assert _stored(spark, target) == wanted
    assert {r.level for r in spark.read.parquet(target).select("level").distinct().collect()} == {0, 4}
    # all batches once more, as after a lost checkpoint: each writes what it wrote
    _load(spark, source, target, scratch(spark, "state"), bucket_rows=20)
    assert _stored(spark, target) == wanted
    _arrive(spark, source, [(7, "other")])
    with pytest.raises(Exception, match="other content"):
        _load(spark, source, target, state, bucket_rows=20)
    assert _stored(spark, target) == wanted


def test_a_batch_reads_its_buckets_only(spark):
    source, target, state = (scratch(spark, name) for name in ("in", "out", "state"))
    few = spark.createDataFrame([(3, "x"), (8, "y")], SCHEMA)
    read = []
    for step in range(4):
        n = 200 * 2**step
        _arrive(spark, source, [(100_000 * step + i, "d") for i in range(n)])
        _load(spark, source, target, state, bucket_rows=25)
        stored = spark.read.parquet(target)
        level = stored.agg(F.max("level")).first()[0]
        read.append((stored.count(), ingest.stored_near(stored.where("level > 0"), few, "dataset_revision_id", level).count()))
    # fifteen times the rows, but no more than two buckets of each level
    assert read[-1][0] == 3000 and read[-1][1] <= 2 * 4 * 60 and read[-1][1] < read[-1][0] / 8


def test_repeated_files_of_late_rows(spark):
    """Counts and late rows are the same when all batches are replayed."""
    schema = spark.createDataFrame([], "at timestamp, kind string").schema
    source, out = scratch(spark, "in"), scratch(spark, "out")
    for rows in ([("2024-01-05", "a"), ("2024-01-01", "a")], [("2024-01-03 12:00", "b"), ("2024-01-04", "b"), ("2024-01-09", None)], [("2024-01-07", "a"), ("2024-01-08 01:00", "a"), (None, "c")]):
        spark.createDataFrame(rows, "at string, kind string").select(F.col("at").cast("timestamp").alias("at"), "kind").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        stream = ingest.stream_table(spark, source, schema, files_per_trigger=1)
        query = ingest.count_on_time(stream, out, time="at", label="kind")
        query.awaitTermination()
        late = sorted(str(r["at"]) for r in spark.read.parquet(f"{out}/late").collect())
        assert late == ["2024-01-03 12:00:00", "2024-01-07 00:00:00"]
        assert spark.read.parquet(f"{out}/counts").agg(F.sum("n")).first()[0] == 5
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/state")
        fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs, True)


def test_two_writers_one_release(spark):
    """Of writers that saw the same predecessor exactly one wins, and readers never see half a release."""
    root = scratch(spark, "release")

    def rows(name, n):
        listed = spark.createDataFrame([(i, f"{name}{i}") for i in range(n)], "dataset_id long, dataset_revision_id string")
        return listed.withColumn("input_digest", F.sha2("dataset_revision_id", 256))

    def publish(name, previous, said):
        listed = rows(name, 50)
        checks = listed.select("dataset_revision_id", "input_digest", F.lit("passed").alias("status"))
        try:
            said[name] = release.publish(spark, root, listed, checks, name, previous)
        except ValueError as error:
            said[name] = str(error)

    said = {}
    publish("base", None, said)
    assert said["base"] is True
    writers = [threading.Thread(target=publish, args=(name, "base", said)) for name in ("left", "right")]
    for writer in writers:
        writer.start()
    while any(writer.is_alive() for writer in writers):
        seen = {r.dataset_revision_id.rstrip("0123456789") for r in release.release_members(spark, root).collect()}
        assert len(seen) == 1 and release.release_members(spark, root).count() == 50
    assert sorted(said[n] is True for n in ("left", "right")) == [False, True]
    winner = next(n for n in ("left", "right") if said[n] is True)
    assert said["right" if winner == "left" else "left"] == "the active release has changed"
    assert release.active_release(spark, root).first()["release_id"] == winner


def test_create_once(spark):
    path = scratch(spark, "pointer") + "/one.json"
    made = []
    threads = [threading.Thread(target=lambda k=k: made.append((release.create_once(spark, path, f"text {k}"), k))) for k in range(8)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert sum(won for won, _ in made) == 1
    assert spark.read.text(path).first()[0] == f"text {next(k for won, k in made if won)}"


def test_a_large_first_batch_is_written_by_several_tasks(spark):
    source, target, state = scratch(spark, "source"), scratch(spark, "target"), scratch(spark, "state")
    _arrive(spark, source, [(i, f"d{i}") for i in range(600)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _load(spark, source, target, state, bucket_rows=20)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = spark.read.parquet(target)
    assert stored.count() == 600 and len(stored.inputFiles()) > 1
