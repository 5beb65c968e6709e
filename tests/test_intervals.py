import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from stratalog.operators import intervals as iv

LOOSE = settings(max_examples=4, deadline=None, phases=[Phase.generate], derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
ENDS = st.lists(st.tuples(st.sampled_from("ab"), st.integers(-40, 400), st.integers(0, 150)), min_size=1, max_size=25)


def frame(spark, data, names):
    return spark.createDataFrame([(k, i, float(a), float(a + n)) for i, (k, a, n) in enumerate(data)], f"k string, {names[0]} long, {names[1]} double, {names[2]} double")


@LOOSE
@given(points=st.lists(st.tuples(st.sampled_from("ab"), st.integers(-50, 600)), min_size=1, max_size=40), spans=ENDS, closed=st.booleans())
def test_covering_is_brute_force(spark, points, spans, closed):
    p = spark.createDataFrame([(k, i, float(x)) for i, (k, x) in enumerate(points)], "k string, p long, at double")
    found = iv.covering(p, frame(spark, spans, ("s", "lo", "hi")), key=["k"], at="at", lo="lo", hi="hi", bounds="closed" if closed else "half_open")
    wanted = [
        (i, j) for i, (k, x) in enumerate(points) for j, (q, a, n) in enumerate(spans) if k == q and a <= x and (x <= a + n if closed else x < a + n)
    ]
    assert rows(found, "p", "s") == sorted(wanted, key=str)


@LOOSE
@given(left=ENDS, right=ENDS, closed=st.booleans())
def test_overlap_pairs_once(spark, left, right, closed):
    found = iv.overlapping(
        frame(spark, left, ("a", "a0", "a1")), frame(spark, right, ("b", "b0", "b1")), key=["k"], left_bounds=("a0", "a1"), right_bounds=("b0", "b1"), bounds="closed" if closed else "half_open"
    )
    def meets(a0, a1, b0, b1):
        if closed:
            return a0 <= b1 and b0 <= a1
        # half-open: the later start lies before the other's end
        return (b0 <= a0 < b1) or (a0 < b0 < a1)
    wanted = [(i, j) for i, (k, a, n) in enumerate(left) for j, (q, b, m) in enumerate(right) if k == q and meets(a, a + n, b, b + m)]
    assert rows(found, "a", "b") == sorted(wanted, key=str)


@pytest.mark.parametrize("heavy", [False, True])
def test_nearest_ties_go_to_the_first_sample(spark, heavy):
    samples = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 20.0), ("a", 2, 20.0), ("a", 3, 30.0), ("b", 0, 5.0)], "k string, s long, d double")
    targets = spark.createDataFrame([("a", 0, 15.0), ("a", 1, 20.0), ("a", 2, 25.0), ("a", 3, -100.0), ("a", 4, 31.0), ("c", 5, 1.0)], "k string, t long, at double")
    if heavy:
        spark.conf.set("stratalog.groupRows", "2")
    found = iv.nearest(targets, samples, key=["k"], at="at", sample_at="d", sample_id="s", target_id="t")
    result = {r.t: (r.s, r.distance) for r in found.collect()}
    spark.conf.unset("stratalog.groupRows")
    assert result == {0: (0, 5.0), 1: (1, 0.0), 2: (1, 5.0), 3: (0, 110.0), 4: (3, 1.0), 5: (None, None)}


def test_tiling_accepts_and_rejects(spark):
    good = spark.createDataFrame([("a", 0, 9), ("a", 10, 19), ("a", 20, 24)], "k string, lo long, hi long")
    extent = spark.createDataFrame([("a", 25)], "k string, n long")
    assert iv.tiling_violations(good, key=["k"], lo="lo", hi="hi", extent=extent).count() == 0
    for bad, problem in (((0, 9, 11, 24), "gap"), ((0, 9, 9, 24), "overlap"), ((0, 9, 10, 23), "wrong end"), ((0, 9, 10, 8), "empty"), ((1, 9, 10, 24), "gap")):
        df = spark.createDataFrame([("a", bad[0], bad[1]), ("a", bad[2], bad[3])], "k string, lo long, hi long")
        assert problem in [r.problem for r in iv.tiling_violations(df, key=["k"], lo="lo", hi="hi", extent=extent).collect()]


@LOOSE
@given(runs=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 100), st.integers(0, 40)), min_size=0, max_size=12))
def test_filled_segments_tile_the_hole(spark, runs):
    data = spark.createDataFrame([(k, float(a), float(a + n), "x") for k, a, n in runs] or [("z", 0.0, 1.0, "x")], "k string, lo double, hi double, call string")
    extent = spark.createDataFrame([("a", 90.0), ("b", 50.0), ("none", 10.0), ("flat", 0.0)], "k string, len double")
    found = iv.fill_gaps(data, extent, key=["k"], lo="lo", hi="hi", length="len").collect()
    for k, length in (("a", 90.0), ("b", 50.0), ("none", 10.0)):
        mine = sorted((r.lo, r.hi) for r in found if r.k == k)
        assert mine[0][0] == 0 and mine[-1][1] == length
        assert all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    assert not [r for r in found if r.k == "flat"]
    logged = {"a": set(), "b": set()}
    for k, a, n in runs:
        logged[k] |= set(range(a, min(a + n, 90 if k == "a" else 50)))
    for k in "ab":
        assert sum(r.hi - r.lo for r in found if r.k == k and r.logged) == len(logged[k])


def test_rectangles(spark):
    r = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 0, 10, 10, 10), (1, 3, 9, 9, 5, 5), (2, 4, 0, 0, 10, 10)], "f int, id int, x int, y int, width int, height int")
    # the pairs (1, 3) and (2, 3), said once per rectangle
    assert rows(iv.rectangle_overlaps(r, frame=["f"], ident="id"), "id", "overlaps", "witness") == [(1, 1, 3), (2, 1, 3), (3, 2, 1)]


def test_first_cover_keeps_uncovered_points(spark):
    p = spark.createDataFrame([(1, 5.0), (1, 9.9), (1, 10.0), (1, 50.0)], "k int, at double")
    i = spark.createDataFrame([(1, 0.0, 10.0, "late"), (1, 0.0, 6.0, "first")], "k int, lo double, hi double, name string")
    found = iv.first_cover(p, i, point_key=["k", "at"], key=["k"], at="at", lo="lo", hi="hi", pick=["lo", "hi"])
    assert rows(found, "at", "name") == [(10.0, None), (5.0, "first"), (50.0, None), (9.9, "late")]


def test_exactly_one_cover(spark):
    samples = spark.createDataFrame([("a", i) for i in range(6)], "k string, sample_no long")
    maps = spark.createDataFrame([("a", 0, 2), ("a", 2, 4)], "k string, lo long, hi long")
    assert rows(iv.coverage_violations(samples, maps, key=["k"], lo="lo", hi="hi")) == [("a", 2, 2), ("a", 5, 0)]


def test_ranges_are_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id").cast("double").alias("depth_m"), F.lit(1).alias("other")).write.parquet(path)
    plan = iv.in_range(spark.read.parquet(path), at="depth_m", start=3, end=8).select("depth_m")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(depth_m" in plan and "other" not in plan
    assert np.isclose(iv.in_range(spark.read.parquet(path), at="depth_m", start=3, end=8).count(), 6)


def test_repeated_points_are_not_broadcast(spark):
    points = spark.range(8).selectExpr("id % 2 k", "id at")
    spans = spark.createDataFrame([(0, 0, 3), (0, 2, 200), (1, 1, 1)], "k long, lo long, hi long")
    found = iv.covering(points, spans, key=["k"], at="at", lo="lo", hi="hi")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "strategy=broadcast" not in plan
    assert found.count() == 2 + 3 + 1
