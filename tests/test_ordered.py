import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from stratalog.operators.ordered import before, lag, last_known, lead, number, onward, ordered_scan, top_per_key, upto
from stratalog.operators.percentiles import exact_percentiles


def outputs():
    return {
        "n": number(), "prev": lag("x"), "next": lead("x"), "sum": upto("sum", "x"), "top": before("max", "x"),
        "low": onward("min", "x"), "known": last_known("x"), "seen": before("count", "x"), "where": upto("max", F.struct("x", "i")),
    }


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(3)
    # one key holds two thirds of the rows, values repeat and are sometimes missing
    data = [(("a" if i % 3 else str(i % 5)), i, None if i % 7 == 0 else int(rng.integers(0, 9))) for i in range(120)]
    data += [(None, 500, 1), (None, 501, 2)]
    return spark.createDataFrame(data, "k string, i long, x long")


def expected(table):
    return rows(ordered_scan(table, ["k"], ["i"], outputs()))


def test_blocks_equal_plain_window(table):
    assert rows(ordered_scan(table, ["k"], ["i"], outputs(), block=F.floor(F.col("i") / 8))) == expected(table)


def test_heavy_keys_equal_plain_window(table, spark):
    wanted = expected(table)
    spark.conf.set("stratalog.groupRows", "10")
    try:
        assert rows(ordered_scan(table, ["k"], ["i"], outputs())) == wanted
    finally:
        spark.conf.unset("stratalog.groupRows")


def test_global_order_without_key(table, small_groups):
    numbered = ordered_scan(table, [], ["i"], {"n": number(), "t": upto("sum", "x")})
    found = {r.i: (r.n, r.t) for r in numbered.collect()}
    total = 0
    for position, r in enumerate(sorted(table.collect(), key=lambda r: r.i), 1):
        total += r.x or 0
        assert found[r.i][0] == position
        assert (found[r.i][1] or 0) == total


def test_partition_count_does_not_matter(table):
    assert rows(ordered_scan(table.repartition(1), ["k"], ["i"], outputs())) == rows(ordered_scan(table.repartition(8), ["k"], ["i"], outputs()))


def test_top_per_key_is_exact(table):
    best = top_per_key(table.where("x is not null"), ["k"], [F.desc("x"), F.asc("i")], 4)
    brute = {}
    for r in table.collect():
        if r.x is not None:
            brute.setdefault(r.k, []).append((-r.x, r.i))
    wanted = sorted(((k, i, -x) for k, v in brute.items() for x, i in sorted(v)[:4]), key=str)
    assert rows(best, "k", "i", "x") == wanted


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_percentiles_match_numpy(spark, small_groups, accuracy):
    rng = np.random.default_rng(5)
    # a third of the values are one and the same
    data = [(g, float(v) if rng.random() > 0.3 else 1.25) for g in ("a", "b") for v in rng.normal(size=400)] + [("c", 7.0), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(data, "g string, x double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    found = {r.g: r for r in exact_percentiles(df, ["g"], "x", probabilities, accuracy=accuracy).collect()}
    for g in "abc":
        values = np.array([v for k, v in data if k == g and v is not None and v == v])
        assert found[g].n == len(values)
        np.testing.assert_allclose(found[g].q, np.quantile(values, probabilities), rtol=1e-12)


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([("a", None)], "g string, x double")
    assert exact_percentiles(empty, ["g"], "x", [0.5]).collect() == []
