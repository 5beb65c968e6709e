import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.functions import fixed, geo, hashing, numbers, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, expression, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(expression).collect()]


def test_null_vocabularies(spark):
    assert apply(spark, [" NaN ", "n/a", "x ", "", None], text.blank_to_null("v")) == [None, None, "x", None, None]
    assert apply(spark, [" Talc", "Invalid", "none"], text.category("v")) == ["talc", None, None]
    assert apply(spark, ["white mica", "ASPECTRAL", " dark__mica "], text.group_label("v")) == ["WHITE-MICA", None, "DARK-MICA"]


def test_booleans_and_dates(spark):
    assert apply(spark, ["true", "false", "", None, "maybe"], text.strict_boolean("v")) == [True, False, None, None, None]
    assert apply(spark, ["true", "", None, "maybe"], text.unknown_boolean("v")) == [False, False, False, True]
    assert apply(spark, [" Yes", "1", "no", None], text.lenient_boolean("v")) == [True, True, False, False]
    assert apply(spark, ["2024-02-30", "2024-02-29", "unknown", ""], text.iso_date("v")) == [None, "2024-02-29", None, None]
    assert apply(spark, ["2024-02-30", "2024-02-29", "unknown"], text.broken_date("v")) == [True, False, False]


def test_names(spark):
    assert apply(spark, ["MPWD73 [chips]", "Grp1 sTSAS", None], text.fold_name("v")) == ["mpwd73", "grp1stsas", ""]
    assert apply(spark, ["é b//c", "...", "COM1", "a" * 70 + "_"], text.file_name("v")) == ["e_b_c", "item", "item", "a" * 60]
    assert apply(spark, ["__", "a b"], text.file_stem("v")) == ["hole", "a_b"]
    assert apply(spark, ["a%2Bb+c", "%zz"], text.decode_path_name("v")) == ["a+b+c", None]
    assert apply(spark, ["a/b", "/a", "a/../b", "c:x", "", "a..b"], text.safe_object_key("v")) == [True, False, False, False, False, True]


def test_species_and_log_names(spark):
    assert apply(spark, ["Chlorite-FeMg", "WHITE-MICA", "Kaolinite-WX", "mystery"], text.species_group("v")) == ["CHLORITE", "WHITE-MICA", "KAOLIN", "MYSTERY"]
    parsed = apply(spark, ["Grp1 sTSAS", "Error ujCLST", "plain", "Bound_Water uTSAT"], text.parse_log_name("v"))
    assert (parsed[0].token, parsed[0].rank, parsed[0].metric, parsed[0].region) == ("Grp", 1, "mineral_group", "SWIR")
    assert (parsed[1].token, parsed[1].rank, parsed[1].algorithm) == ("Error", None, "jCLST")
    assert parsed[2] is None and parsed[3].metric == "bound_water"


def test_column_roles():
    found = text.resolve_columns(["Min1 sTSAS (2)", "Grp1 uTSAS", "SNR", "Error"])
    assert found == {"group": "Grp1 uTSAS", "mineral": "Min1 sTSAS (2)", "weight": None, "error": "Error", "snr": "SNR"}


def test_number_text_is_percent_g(spark):
    values = [0.5, 3.0, 123.456789, 62.50175, 0.001234567, -2.5, 100000.25]
    wanted = [str(int(v)) if float(v).is_integer() else f"{v:g}" for v in values]
    assert apply(spark, values, text.number_text("v"), "double") == wanted
    assert apply(spark, [2200.5, -4.0], text.wavelength_column("v", F.lit("nm.")), "double") == ["wl_2200p5_nm", "wl_neg_4_nm"]


def test_safe_numbers(spark):
    assert apply(spark, ["1.5", "x", "NaN", "inf", None], numbers.finite("v")) == [1.5, None, None, None, None]
    assert apply(spark, [str(fixed.FLOAT32_MIN), "-5"], numbers.measured("v")) == [None, -5.0]


def test_tolerances(spark):
    df = spark.createDataFrame([(0.1, 0.10001, False), (0.1, 0.100011, False), (16777216.0, 16777217.0, True), (0.0, -0.0, False), (1e300, 1e300, False)], "a double, b double, w boolean")
    found = df.select(numbers.decimal_close("a", "b"), numbers.same_float32("a", "b"), "w").collect()
    assert [r[0] for r in found[:2]] == [True, False]
    assert [r[1] for r in found] == [r[2] for r in found]


def test_bits_tell_what_equality_does_not(spark):
    nan, other = np.float32("nan"), np.frombuffer(np.uint32(0x7FC00001).tobytes(), "<f4")[0]
    df = spark.createDataFrame([([1.0, 0.0], [1.0, -0.0]), ([1.0], [1.0]), ([1.0], [1.0, 2.0]), ([float(nan)], [float(nan)])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(numbers.equal_bits("a", "b")).collect()] == [False, True, False, True]
    assert np.asarray([other]).tobytes() != np.asarray([nan]).tobytes()


def test_spectra_helpers(spark):
    df = spark.createDataFrame([([380.0, 2500.0], "nm"), ([6000.0, 14500.0], "nm"), ([380.0, 2500.0], "um"), ([400.0, 401.0], "nm")], "w array<double>, u string")
    assert [r[0] for r in df.select(numbers.spectral_region("w", "u", "UNCLASSIFIED")).collect()] == ["VSWIR", "TIR", "UNCLASSIFIED", "UNCLASSIFIED"]
    odd = spark.createDataFrame([([1.0, float("nan"), float("inf"), -0.0],)], "v array<double>").select(numbers.finite_channels("v"), numbers.nonfinite_channels("v"), numbers.positive_minimum("v")).first()
    assert odd[0] == [1.0, None, None, 0.0] and odd[1] == [1, 2]
    rising = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, 1.0],), ([1.0],), ([1.0, float("nan")],)], "v array<double>")
    assert [r[0] for r in rising.select(numbers.strictly_increasing("v")).collect()] == [True, False, True, False]


def test_marker(spark):
    df = spark.createDataFrame([(5, 5, 5), (0, 0, 10), (10, 0, 10), (11, 0, 10)], "s int, a int, b int")
    assert [r[0] for r in df.select(numbers.image_position("s", "a", "b")).collect()] == [0.5, 0.0, 1.0, None]


def test_uuid_is_version_5(spark):
    names = ["hole:1", "étage:ø", ""]
    assert apply(spark, names, hashing.name_uuid("v")) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert apply(spark, ["a"], hashing.stable_id("p", "v", F.lit(3))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, "p:a:3"))]


def test_digest_sees_order_content_and_borders(spark):
    base = spark.createDataFrame([("g", i, str(i % 7)) for i in range(9000)], "g string, p long, v string")
    one = hashing.ordered_digest(base.repartition(1), ["g"], "p", ["v"]).first()
    many = hashing.ordered_digest(base.repartition(7), ["g"], "p", ["v"]).first()
    assert one == many and one.n == 9000
    swapped = base.withColumn("p", F.when(F.col("p") == 1, 2).when(F.col("p") == 2, 1).otherwise(F.col("p")))
    assert hashing.ordered_digest(swapped, ["g"], "p", ["v"]).first().digest != one.digest
    null = base.withColumn("v", F.when(F.col("p") > 0, F.col("v")))
    assert hashing.ordered_digest(null, ["g"], "p", ["v"]).first().digest != one.digest
    assert hashing.fingerprint(base).first() == hashing.fingerprint(base.orderBy(F.desc("p"))).first()
    assert hashing.fingerprint(base).first() != hashing.fingerprint(null).first()


def test_distance_and_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (-33.0, 115.0, -33.0, 115.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    found = [r[0] for r in df.select(geo.great_circle_km("a", "b", "c", "d")).collect()]
    assert found[0] == pytest.approx(math.pi * 6371.0088) and found[1] == 0.0 and found[2] is None
    good = spark.createDataFrame([("1", "2"), ("0", "2"), ("91", "2"), ("x", "2"), (None, "1")], "a string, b string")
    assert [r[0] for r in good.select(geo.usable_position("a", "b")).collect()] == [True, False, False, False, False]
    o = spark.range(1).select(geo.offset_at(F.lit(10.0), F.lit(-90.0), F.lit(None)).alias("o")).first().o
    assert (o.east_m, pytest.approx(o.tvd_m)) == (pytest.approx(0, abs=1e-9), 10.0)
    depths = spark.createDataFrame([(12.0,), (10.0,), (0.0,), (3.0,)], "l double").select(geo.trace_depths("l", 5.0)).collect()
    assert [r[0] for r in depths] == [[0.0, 5.0, 10.0, 12.0], [0.0, 5.0, 10.0], None, [0.0, 3.0]]
