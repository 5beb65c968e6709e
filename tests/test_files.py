"""Readers, writers and streams on files written by the test."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from stratalog.operators.align import typed_values
from stratalog.sources import documents, files, logs, sinks
from stratalog.streaming import ingest


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_strict_scalar_log(spark, tmp_path):
    write(tmp_path / "a" / "1.csv", "﻿StartDepth,EndDepth,V\n0.5,0.5,null\n1.5,1.5,\n2.5,2.5,\"a,b\"\n")
    found = rows(logs.read_scalar_log(spark, str(tmp_path / "a")), "source_row", "start", "token")
    assert found == [(0, 0.5, "null"), (1, 1.5, ""), (2, 2.5, "a,b")]
    for bad in ("1,1\n", "x,1,a\n", "1,1,a,b\n"):
        write(tmp_path / "b" / "1.csv", "StartDepth,EndDepth,V\n" + bad)
        with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ"):
            logs.read_scalar_log(spark, str(tmp_path / "b")).collect()


def test_lenient_and_literal_logs(spark, tmp_path):
    write(tmp_path / "1.csv", 'StartDepth,EndDepth,V\n0,1,Talc\nshort\nx,2,Talc\n1,2, wood \n2,3,"open, quote\n')
    assert rows(logs.read_scalar_log(spark, str(tmp_path), mode="lenient"), "start", "token") == [(0.0, "Talc"), (2.0, '"open')]
    assert rows(logs.read_scalar_log(spark, str(tmp_path), mode="literal"), "start", "token") == [(0.0, "Talc"), (1.0, " wood "), (2.0, '"open, quote')]


def test_row_numbers_survive_file_splits(spark, tmp_path):
    write(tmp_path / "1.csv", "StartDepth,EndDepth,V\n" + "".join(f"{i},{i},{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    found = logs.read_scalar_log(spark, str(tmp_path))
    parts = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    wrong = found.where(F.col("source_row") != F.col("start")).count()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts > 1 and wrong == 0 and found.count() == 3000


def test_canonical_round_trip_keeps_raw_tokens(spark, tmp_path):
    df = spark.createDataFrame([("L", 0, 1.0, 1.0, "3.5"), ("L", 1, 2.0, 2.0, "null"), ("L", 2, 3.0, 3.0, "")], "log_id string, source_row long, start double, end double, token string")
    typed = typed_values(df, interval=False, numeric=True)
    sinks.write_canonical(typed, str(tmp_path / "c"), partitions=["log_id"], order="source_row")
    assert sinks.read_back_difference(typed, str(tmp_path / "c")).isEmpty()
    assert not sinks.read_back_difference(typed.withColumn("value_raw", F.lit("x")), str(tmp_path / "c")).isEmpty()
    assert rows(typed, "sample_no", "value_numeric", "value_raw") == [(0, 3.5, "3.5"), (1, None, "null"), (2, None, "")]
    assert rows(sinks.chunk_index(typed, log=["log_id"], row="source_row", coordinate="depth_m", rows=2), "row_group", "row_count", "coordinate_max") == [(0, 2, 2.0), (1, 1, 3.0)]


def test_profiles(spark, tmp_path):
    write(tmp_path / "p.jsonl", '{"sampleNo":0,"floatprofdata":[0,2.5]}\n{"sampleNo":1,"floatprofdata":[1,1]}\n')
    good = logs.read_profiles(spark, str(tmp_path))
    assert good.count() == 2 and logs.profile_number_errors(good).isEmpty()
    write(tmp_path / "q.jsonl", '{"sampleNo":0,"floatprofdata":[0]}\n{"sampleNo":2,"floatprofdata":[1]}\n')
    write(tmp_path / "r.jsonl", '{"sampleNo":1,"floatprofdata":[0]}\n{"sampleNo":1,"floatprofdata":[1]}\n{"sampleNo":0,"floatprofdata":[1]}\n')
    assert logs.profile_number_errors(logs.read_profiles(spark, str(tmp_path))).count() == 2


def test_spectra_blocks_and_ragged_files(spark, tmp_path):
    matrix = [[float(i * 3 + j) for j in range(3)] for i in range(10)]
    write(tmp_path / "a b.f32", b"".join(struct.pack("<3f", *row) for row in matrix))
    write(tmp_path / "bad.f32", b"12345")
    listed = files.list_files(spark, str(tmp_path), "*.f32").withColumn("bands", F.lit(3))
    found = files.read_spectra(listed.select("path", "size", "bands"), rows_per_block=4)
    assert [list(r["values"]) for r in found.orderBy("sample_no").collect()] == matrix
    assert files.ragged_files(listed).count() == 1
    hashes = {r.relative_path: r.sha256 for r in files.inventory(spark, str(tmp_path)).collect()}
    assert hashes["bad.f32"] == hashlib.sha256(b"12345").hexdigest()


def test_measurements_unite_by_name(spark, tmp_path):
    write(tmp_path / "h1.csv", "﻿sample_no,depth_from_m,SNR\n0,1.0,5\n1,,6\n")
    write(tmp_path / "x.csv", "hole_id,depth_from_m,Min1 sTSAS\nh2,2.0,Talc\n ,3.0,Talc\n")
    data, blank = logs.read_measurements(spark, str(tmp_path), id_columns=["hole_id"])
    assert rows(data, "hole_id", "depth_from_m", "SNR", "Min1 sTSAS") == [(" ", 3.0, None, "Talc"), ("h1", 1.0, "5", None), ("h2", 2.0, None, "Talc")]
    assert blank.count() == 1
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        logs.read_measurements(spark, str(tmp_path / "none"))


def test_hole_lists(spark, tmp_path):
    text = write(tmp_path / "ids.txt", "﻿Hole ID\nA1\n# note\n\nB2\nA1\n")
    assert rows(logs.read_hole_ids(spark, text, ["Z9", "B2"]).orderBy("position"), "hole_id", "position") == [("A1", 3), ("B2", 1), ("Z9", 0)]
    table = write(tmp_path / "ids.csv", "name,borehole_id\nx,C3\ny,D4\n")
    assert rows(logs.read_hole_ids(spark, table), "hole_id") == [("C3",), ("D4",)]
    plain = write(tmp_path / "plain.csv", "E5,1\nF6,2\n")
    assert rows(logs.read_hole_ids(spark, plain), "hole_id") == [("E5",), ("F6",)]


def test_documents(spark, tmp_path):
    write(tmp_path / "h" / "borehole.json", '{"a": 1, "a": 2}')
    write(tmp_path / "h" / "datasets.json", '[{"dataset_id": "d", "dataset_name": "n"}, {"dataset_id": "e"}]')
    write(tmp_path / "h" / "tray_depths.json", "[]")
    write(tmp_path / "h" / "package_manifest.json", '{"x": NaN}')
    docs = documents.read_documents(spark, str(tmp_path))
    found = {r.document: r.problem for r in documents.document_problems(docs, spark.createDataFrame([("h",)], "hole_id string")).collect()}
    assert found["borehole.json"] == "repeated key" and found["tray_depths.json"] == "wrong top-level type" and "non-finite" in found["package_manifest.json"]
    assert found["logs_scalar.json"] == "missing" and "datasets.json" not in found
    assert rows(documents.records(docs, "datasets.json", "dataset_id string, dataset_name string"), "position", "dataset_id") == [(0, "d"), (1, "e")]


def test_xml_headers(spark):
    xml = ["<H><Latitude>-30.5</Latitude><Longitude>120</Longitude><Project> P </Project></H>", "<!doctype x><H/>", "<H><Project>a</Project><Project>b</Project></H>", "<broken", "", None, "<H><Latitude>0.0</Latitude><Longitude>120</Longitude></H>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "i int, description string")
    found = documents.header_collars(df).orderBy("i").collect()
    assert [r.latitude for r in found] == [-30.5, None, None, None, None, None, None]
    assert [r.header_problem for r in found] == [None, "document type or entity declared", "repeated node", None, None, None, None]


def test_membership_xml(spark, tmp_path):
    write(
        tmp_path / "c.xml",
        "<DatasetCollection><Dataset><DatasetID>d1</DatasetID><Logs><Log><LogID>a</LogID></Log><Log><LogID>b</LogID></Log></Logs><SpectralLogs><SpectralLog><logID>s</logID></SpectralLog></SpectralLogs></Dataset>"
        "<Dataset><DatasetID>d2</DatasetID><Logs><Log><LogID>a</LogID></Log></Logs><ImageLogs><Log><LogID>i</LogID></Log></ImageLogs></Dataset></DatasetCollection>",
    )
    found = documents.read_membership(spark, str(tmp_path))
    assert rows(found, "dataset_id", "kind", "log_id") == [("d1", "scalar", "a"), ("d1", "scalar", "b"), ("d1", "spectral", "s"), ("d2", "image", "i"), ("d2", "scalar", "a")]
    assert rows(documents.membership_problems(found), "log_id", "problem") == [("a", "log of several datasets")]


def test_collars_from_geojson(spark, tmp_path):
    point = lambda hole, role, x: {"geometry": {"type": "Point", "coordinates": [x, -30.0]}, "properties": {"feature_role": role, "hole": hole, "dip": None}}
    line = {"geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"feature_role": "trace", "hole": "T"}}
    path = write(tmp_path / "c.geojson", json.dumps({"features": [point(" A ", "collar", 1.0), point("A", "collar", 2.0), point("B", "collar", 3.0), line, point("", "collar", 1.0)]}))
    known = spark.createDataFrame([("B",)], "hole_id string")
    assert rows(logs.read_collar_catalogue(spark, path, known), "hole_id", "longitude", "inclination_deg") == [("A", 1.0, -90.0)]
    lines = sinks.feature_lines(logs.read_collar_catalogue(spark, path), properties=["hole_id"])
    assert json.loads(lines.orderBy("value").first().value)["geometry"] == {"type": "Point", "coordinates": [1.0, -30.0]}


def test_exchange_refuses_other_columns_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    sinks.export_table(df, str(tmp_path / "x"), key=["k"])
    assert rows(sinks.import_table(spark, str(tmp_path / "x"), df.schema, 2)) == rows(df)
    with pytest.raises(ValueError, match="manifest"):
        sinks.import_table(spark, str(tmp_path / "x"), df.schema, 3)
    with pytest.raises(ValueError, match="fields"):
        sinks.import_table(spark, str(tmp_path / "x"), T.StructType([T.StructField("k", T.LongType())]), 2)


def test_wide_outputs(spark):
    long = spark.createDataFrame([("h", 0, 0.0, 1.0, "b", "x"), ("h", 0, 0.0, 1.0, "a", "y"), ("h", 1, 1.0, 2.0, "a", "z")], "hole_id string, sample_no long, depth_from_m double, depth_to_m double, name string, value string")
    wide = sinks.wide_measurements(long)
    assert wide.columns[4:] == ["a", "b"] and rows(wide, "sample_no", "a", "b") == [(0, "y", "x"), (1, "z", None)]


def test_anomaly_outputs(spark, tmp_path):
    intervals = spark.createDataFrame([("h", 0.0, 99.0), ("g", 1.0, 1.0)], "hole_id string, depth_from_m double, anomaly_score double")
    sinks.write_anomalies(intervals, spark.createDataFrame([("h", 1)], "hole_id string, rank int"), str(tmp_path / "o"))
    assert rows(spark.read.parquet(str(tmp_path / "o/anomalies")), "hole_id", "anomaly_score") == [("g", 1.0), ("h", 99.0)]
    assert spark.read.json(str(tmp_path / "o/anomalies_json")).count() == 2


def test_replayed_and_conflicting_revisions(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = spark.createDataFrame([("r1", "d1"), ("r2", "d2")], "dataset_revision_id string, input_digest string")
    first.write.parquet(source)
    ingest.ingest(ingest.stream_table(spark, source, first.schema), target, state).awaitTermination()
    first.where("input_digest = 'd1'").write.mode("append").parquet(source)
    ingest.ingest(ingest.stream_table(spark, source, first.schema), target, state).awaitTermination()
    assert rows(spark.read.parquet(target), "dataset_revision_id") == [("r1",), ("r2",)]
    spark.createDataFrame([("r1", "other")], first.schema).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="other content"):
        ingest.ingest(ingest.stream_table(spark, source, first.schema), target, state).awaitTermination()
