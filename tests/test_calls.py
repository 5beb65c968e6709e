import pytest
from pyspark.sql import functions as F

from conftest import rows
from stratalog.operators import calls


def samples(spark, data):
    return spark.createDataFrame(data, "hole string, sample_no long, depth double, call string")


def test_first_seen_wins_a_tie(spark):
    df = samples(spark, [("h", 0, 0.1, "B"), ("h", 1, 0.2, "A"), ("h", 2, 0.3, "A"), ("h", 3, 0.4, "B"), ("h", 4, 0.5, None)])
    r = calls.dominant(df, by=["hole"], label="call", order=["sample_no"]).first()
    assert (r["call"], r["n_label"], r["n_all"], r["n_valid"]) == ("B", 2, 5, 4)
    assert r["share_of_all"] == pytest.approx(0.4) and r["share_of_valid"] == pytest.approx(0.5)


def test_metres_and_edges(spark):
    df = samples(spark, [("h", 0, -0.5, "A"), ("h", 1, 0.0, "A"), ("h", 2, 1.0, None), ("h", 3, None, "A"), ("h", 4, 0.999, "B")])
    found = calls.metre_calls(df, key=["hole"], depth="depth", label="call", order=["sample_no"])
    assert rows(found, "depth_from_m", "call", "confidence", "quality_flag") == [(-1.0, "A", 1.0, "ok"), (0.0, "A", 0.5, "ok"), (1.0, None, 0.0, "missing")]


@pytest.mark.parametrize("heavy", ["2", "1000"])
def test_runs(spark, heavy):
    spark.conf.set("stratalog.groupRows", heavy)
    df = spark.createDataFrame(
        [("h", 0.0, 1.0, "A"), ("h", 1.0, 2.0, "A"), ("h", 2.0, 3.0, None), ("h", 3.0, 4.0, None), ("h", 5.0, 6.0, None), ("h", 6.0, 7.0, "A"), ("g", 0.0, 1.0, "A")],
        "hole string, lo double, hi double, call string",
    )
    found = rows(calls.merge_runs(df, key=["hole"], lo="lo", hi="hi", state=["call"]), "hole", "lo", "hi", "call", "n")
    spark.conf.unset("stratalog.groupRows")
    assert found == [("g", 0.0, 1.0, "A", 1), ("h", 0.0, 2.0, "A", 2), ("h", 2.0, 4.0, None, 2), ("h", 5.0, 6.0, None, 1), ("h", 6.0, 7.0, "A", 1)]


def test_summary_counts_only_rock(spark):
    df = spark.createDataFrame(
        [("h", 0, 0.1, "Chlorite", 0.5), ("h", 1, 0.2, "chlorite", 0.7), ("h", 2, 0.3, " wood ", 9.0), ("h", 3, 0.4, "Chlorite", None), ("h", 4, 1.5, "INVALID", 1.0)],
        "hole string, sample_no long, d double, m string, wt double",
    )
    found = {r.depth: r for r in calls.metre_summary(df, key=["hole"], depth="d", mineral="m", order=["sample_no"], quality=["wt"]).collect()}
    assert (found[0.0].mineral, found[0.0].n_valid, found[0.0].n_readings) == ("Chlorite", 3, 4)
    assert found[0.0].agreement == pytest.approx(2 / 3) and found[0.0].wt == pytest.approx(0.6)
    assert (found[1.0].mineral, found[1.0].agreement, found[1.0].wt) == ("NO DATA", 0.0, None)


def test_a_missing_measurement_is_a_strike_and_a_missing_input_is_no_rule(spark):
    df = spark.createDataFrame([(0.9, 0.9, 100.0, 500.0, 0.8), (0.9, 0.9, None, 500.0, 0.8), (0.1, 0.1, 900.0, 1.0, 0.1)], "coverage double, agreement double, err double, snr double, wt double")
    graded = calls.confidence(df, calls.standard_rules(), ["error", "snr", "weight"]).collect()
    assert [(r.n_flags, r.conf_class, r.confidence) for r in graded] == [(0, "high", 1.0), (1, "medium", 0.8), (5, "low", 0.0)]
    assert "poor fit" in graded[1].why and graded[2].why.count(" ; ") == 4
    fewer = calls.confidence(df, calls.standard_rules(), []).collect()
    assert [r.n_flags for r in fewer] == [0, 0, 2]


def test_overlay_is_strict(spark):
    metres = spark.createDataFrame([("h", 0.0, 1.0, "A"), ("h", 1.0, 2.0, "B"), ("h", 2.0, 3.0, "C")], "hole string, depth_from_m double, depth_to_m double, call string")
    anomalies = spark.createDataFrame([("h", 1.0, 2.0, 97.0, "second"), ("h", 0.5, 1.5, 99.0, "first")], "hole string, depth_from_m double, depth_to_m double, anomaly_score double, why string")
    found = calls.overlay_anomalies(metres, anomalies, key=["hole"])
    assert rows(found, "depth_from_m", "is_anomaly", "why") == [(0.0, True, "first"), (1.0, True, "first"), (2.0, False, None)]


def test_reason_bits(spark):
    df = spark.createDataFrame([("a ; c",), ("",), (None,), ("b",)], "why string")
    assert [r[0] for r in df.select(calls.reason_bits("why", ["a", "b", "c"])).collect()] == [5, 0, 0, 2]


def test_log_copy_choice(spark):
    logs = spark.createDataFrame(
        [("h", 0, "x", 99.0, 99.0, "A"), ("h", 1, "p", 1.0, 2.0, "A"), ("h", 1, "q", 1.0, 2.0, "A"), ("h", 1, "q", 2.0, 3.0, "B"), ("h", 2, "r", 1.0, 2.0, "A"), ("h", 1, "p", 4.0, 6.0, "C")],
        "hole string, name_rank int, copy string, start double, end double, value string",
    )
    bands = spark.createDataFrame([("h", 0.0, 5.0), ("h", 5.0, 100.0), ("h", 200.0, 300.0)], "hole string, depth_from double, depth_to double")
    assert rows(calls.choose_log_copy(logs, bands, key=["hole"])) == [("h", 0.0, 5.0, 1, "q", 2), ("h", 5.0, 100.0, 0, "x", 1)]


def test_interval_bound_is_no_less_than_the_calls(spark):
    df = samples(spark, [("h", 0, -0.5, "A"), ("h", 1, 7.2, "A"), ("g", 2, 3.0, None)])
    largest, total = calls.interval_bound(df, key=["hole"], depth="depth")
    assert (largest, total) == (9, 10)
    assert calls.metre_calls(df, key=["hole"], depth="depth", label="call", order=["sample_no"]).count() <= total
    assert df.select(F.count(F.lit(1))).first()[0] == 3
