import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.operators import bands, features, forest, neighbours, scoring
from stratalog.operators.lof import local_outlier_factor
from stratalog.session import settle_table, shared_folder


def vectors(spark, matrix, name="v"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"id long, {name} array<double>")


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(11)
    data = []
    for hole in range(14):
        for i in range(90):
            odd = hole == 3 and 40 <= i < 50
            data.append((f"h{hole:02d}", i, i / 6.0, 50.0 if odd else float(rng.normal(5, 1)), None if i % 11 == 0 else float(rng.normal()), "TALC " if odd else str(rng.choice(["Talc", "illite", "NULL", "kaolin"]))))
    return spark.createDataFrame(data, "hole_id string, sample_no long, depth double, SNR double, wt double, call string")


def spec_for(samples):
    return features.feature_spec(samples, key=["hole_id"], depth="depth", numeric=["SNR", "wt"], categorical=["call"], bin_size=1.0, sample_no="sample_no", order=["hole_id", "sample_no"])


def test_features_match_pandas(samples):
    spec = spec_for(samples)
    assert spec.spread and [c[1] for c in spec.categories][0] in ("talc", "illite", "kaolin") and "null" not in [c[1] for c in spec.categories]
    found = {(r.hole_id, r.depth_from_m): r for r in features.interval_features(samples, spec).collect()}
    pdf = samples.toPandas()
    pdf["bin"] = np.floor(pdf["depth"])
    label = pdf["call"].str.strip().str.lower().where(lambda s: s != "null")
    for (hole, start), part in pdf.groupby(["hole_id", "bin"]):
        got = dict(zip(spec.names, found[(hole, start)].features))
        assert got["SNR [mean]"] == pytest.approx(part["SNR"].mean()) and got["SNR [sd]"] == pytest.approx(part["SNR"].std())
        assert found[(hole, start)].first_sample_no == part["sample_no"].min()
        for name in ("talc", "illite", "kaolin"):
            p, n = (label.dropna() == name).mean(), len(part)
            wanted = ((label[part.index] == name).sum() - n * p) / np.sqrt(max(n * p * (1 - p), 1e-9))
            assert got[f"call = {name}"] == pytest.approx(wanted)


def test_one_sample_bins_have_no_spread(spark):
    df = spark.createDataFrame([("a", 0.5, 1.0), ("a", 1.5, 2.0), ("b", 0.5, 3.0)], "hole_id string, depth double, x double")
    spec = features.feature_spec(df, key=["hole_id"], depth="depth", numeric=["x"], categorical=[])
    assert not spec.spread and spec.names == ["x [mean]"]


def test_scaling_matches_numpy_and_drops_flat_columns(spark):
    rng = np.random.default_rng(2)
    matrix = np.column_stack([rng.normal(size=60), np.full(60, 7.0), np.r_[np.zeros(50), rng.normal(0, 30, 10)], np.r_[np.full(58, np.nan), 1.0, 2.0]])
    df = spark.createDataFrame([(i, [None if np.isnan(x) else float(x) for x in row]) for i, row in enumerate(matrix)], "id long, features array<double>")
    spec = features.FeatureSpec([], "d", 1.0, ["a", "b", "c", "d"], [], False)
    spec = features.fit_scaling(df, spec)
    assert spec.kept == [0, 2]
    got = np.array([r[0] for r in df.orderBy("id").select(features.scaled(spec)).collect()])
    for j, column in enumerate((0, 2)):
        x = matrix[:, column]
        spread = max(np.subtract(*np.percentile(x, [75, 25])) / 1.349, 0.5 * x.std())
        np.testing.assert_allclose(got[:, j], np.clip((x - np.median(x)) / spread, -25, 25), rtol=1e-9)


def reference_pca(x):
    extremity = np.linalg.norm(x, axis=1) / np.sqrt(x.shape[1])
    inliers = x[extremity <= np.quantile(extremity, 0.8)]
    if len(inliers) < max(5, x.shape[1]):
        inliers = x
    centre = np.median(inliers, axis=0)
    _, s, vt = np.linalg.svd(inliers - centre, full_matrices=False)
    n = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.95) + 1)
    n = max(1, min(n, len(inliers) - 1, x.shape[1]))
    p = (x - centre) @ vt[:n].T
    return np.sqrt(((p / np.maximum(s[:n] / np.sqrt(len(inliers) - 1), 1e-9)) ** 2).sum(1)), np.linalg.norm(x - centre - p @ vt[:n], axis=1), n


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)) + 1.0
    scored, n = scoring.pca_scores(vectors(spark, x), "v")
    got = scored.orderBy("id").select("mahalanobis", "reconstruction_error").toPandas().to_numpy()
    m, r, k = reference_pca(x)
    assert n == k
    np.testing.assert_allclose(got[:, 0], m, rtol=1e-6)
    np.testing.assert_allclose(got[:, 1], r, rtol=1e-6, atol=1e-7)


@pytest.mark.parametrize("matrix", [np.random.default_rng(1).normal(size=(9, 3)), np.ones((30, 3))])
def test_pca_falls_back(spark, matrix):
    scored, n = scoring.pca_scores(vectors(spark, matrix), "v")
    assert n == 0
    for r in scored.collect():
        assert r.mahalanobis == pytest.approx(np.linalg.norm(r.v) / np.sqrt(3)) and r.reconstruction_error == 0


def test_fewer_inliers_than_features_uses_all_rows(spark):
    x = np.random.default_rng(6).normal(size=(12, 14))
    scored, n = scoring.pca_scores(vectors(spark, x), "v")
    m, r, k = reference_pca(x)
    assert n == k <= 11
    np.testing.assert_allclose([q.reconstruction_error for q in scored.orderBy("id").collect()], r, atol=1e-6)


def test_ranks_are_distinct_on_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0)], "id long, s double")
    ranked = scoring.combined_rank(df, ["s"], ["id"])
    assert {r.id: r.anomaly_score for r in ranked.collect()} == {3: 0.0, 1: 50.0, 2: 100.0}


def test_flags_and_reliability(spark):
    df = spark.createDataFrame([(99.0, 0.2, 9.0, 9), (94.9, 1.0, 9.0, 9), (95.0, 1.0, 6.0, 1), (95.0, 0.5, 4.0, 9), (95.0, 1.0, 3.9, 3)], "s double, c double, z double, n int")
    found = df.select(scoring.flag("s", "c", "z"), scoring.reliability("c", "n")).collect()
    assert [tuple(r) for r in found] == [("insufficient data", "low"), ("normal", "high"), ("high", "low"), ("elevated", "medium"), ("watch", "medium")]


def test_explanations_merge_groups(spark):
    labels = [("Min1 sTSAS", "talc", 0.5), ("Min1 uTSAS", "talc", 0.5), ("Min1 else", "talc", 0.5)]
    spec = features.FeatureSpec(["hole"], "depth", 1.0, ["SNR"], labels, True, kept=[0, 2, 3, 4])
    assert spec.kept_families == ["SNR [mean]", "Min1 = talc", "Min1 = talc", "Min1 else = talc"]
    names = ["Min1 = talc", "Min1 = talc", "SNR [mean]", "wt [mean]", "x [mean]"]
    df = spark.createDataFrame([([2.0, -3.0, 25.0, 0.5, -1.0],), ([0.1] * 5,)], "v array<double>")
    assert [r[0] for r in df.select(features.contributors("v", names)).collect()] == ["SNR [mean] (high, >=25.0 sd); Min1 = talc (low, 3.0 sd); x [mean] (low, 1.0 sd)", ""]


def test_whole_model_finds_the_planted_interval(samples, spark):
    scored, spec, components = scoring.score_intervals(samples, spec_for(samples), trees=60)
    table = scored.orderBy(F.desc("anomaly_score")).toPandas()
    assert table.iloc[0]["hole_id"] == "h03" and table.iloc[0]["flag"] == "high" and components >= 1
    assert {"isolation_score", "lof_score", "why", "first_sample_no"} <= set(table.columns)
    sites = spark.createDataFrame([(f"h{i:02d}", -30.0 + i * 0.01, 120.0) for i in range(13)], "hole_id string, latitude double, longitude double")
    holes = scoring.score_holes(scored, spec.kept_names, sites).orderBy("rank").toPandas()
    assert holes["rank"].tolist() == list(range(1, 15)) and holes["anomaly_score"].is_monotonic_decreasing
    profile = {h: np.vstack(p["scaled"]) for h, p in scored.select("hole_id", "scaled").toPandas().groupby("hole_id")}
    profile = {h: np.r_[np.median(m, axis=0), m.std(axis=0)] for h, m in profile.items()}
    matrix = np.vstack([profile[h] for h in sorted(profile)])
    away = np.linalg.norm(matrix - np.median(matrix, axis=0), axis=1) / np.sqrt(matrix.shape[1])
    got = holes.sort_values("hole_id")
    np.testing.assert_allclose(got["profile_distance"], away, atol=1e-4)
    d = ((matrix[:, None] - matrix[None]) ** 2).sum(2) + np.diag(np.full(14, np.inf))
    assert got["most_like"].tolist() == [sorted(profile)[i] for i in d.argmin(1)]
    lone = holes[holes["hole_id"] == "h13"].iloc[0]
    assert lone["nearest_geographic_hole"] is None and np.isnan(lone["local_anomaly_distance"])
    assert holes[holes["hole_id"] == "h00"].iloc[0]["nearest_geographic_hole"] == "h01"


@pytest.mark.parametrize("rows", [300, 60])
def test_forest_ranks_outliers_first_and_is_repeatable(spark, rows):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(rows, 3)), [[9.0, 9.0, 9.0], [-8.0, 9.0, 0.0]]])
    df = settle_table(vectors(spark, x), "v")
    first = df.withColumn("s", forest.score("v", forest.fit(df, "v", "id", trees=80), spark)).toPandas()
    again = df.withColumn("s", forest.score("v", forest.fit(df.repartition(3), "v", "id", trees=80), spark)).toPandas()
    assert set(first.sort_values("s")["id"].tail(2)) == {rows, rows + 1}
    np.testing.assert_allclose(first.sort_values("id")["s"], again.sort_values("id")["s"])
    assert first["s"].between(0, 1).all()


def brute_lof(x, k):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    lrd = 1 / (np.array([np.maximum(kd[near[i]], d[i, near[i]]).mean() for i in range(len(x))]) + 1e-10)
    return np.array([lrd[near[i]].mean() / lrd[i] for i in range(len(x))])


def test_lof_matches_brute_force(spark):
    x = np.vstack([np.random.default_rng(9).normal(size=(70, 4)), [[6.0] * 4]])
    found = local_outlier_factor(vectors(spark, x), "id", "v", 20).orderBy("id").toPandas()
    np.testing.assert_allclose(found["lof_score"], brute_lof(x, 20), rtol=1e-6)


def test_lof_with_copies_gives_every_row_a_score(spark):
    x = np.vstack([np.zeros((40, 2)), np.random.default_rng(3).normal(size=(30, 2)) + 3])
    found = local_outlier_factor(vectors(spark, x), "id", "v", 20).toPandas()
    assert len(found) == 70 and np.allclose(found[found["id"] < 40]["lof_score"], 1.0)


@pytest.mark.parametrize("k", [1, 7])
def test_cells_equal_brute_force(spark, k):
    rng = np.random.default_rng(k)
    x = np.vstack([rng.normal(size=(150, 3)), rng.normal(size=(80, 3)) * 0.01 + 5])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    df = vectors(spark, x).select(F.col("id").alias("vid"), "v")
    for small in (10, 1000):
        found = neighbours.nearest_vectors(df, k, small=small).toPandas()
        assert len(found) == len(x) * k
        got = found.sort_values(["vid", "distance"])["distance"].to_numpy().reshape(len(x), k)
        np.testing.assert_allclose(got, np.sort(d, axis=1)[:, :k], rtol=1e-9)


def test_queries_are_not_written_once_per_cell(spark):
    """In many dimensions every query must see every cell: the rows stay, the members pass by."""
    x = np.random.default_rng(2).normal(size=(2_000, 32))
    size = lambda: sum(f.stat().st_size for f in pathlib.Path(shared_folder(spark)).rglob("*") if f.is_file())
    before = size()
    found = neighbours.nearest_vectors(vectors(spark, x).select(F.col("id").alias("vid"), "v"), 3, small=10).toPandas()
    assert size() - before < 6 * x.nbytes
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert {*zip(found["vid"], found["nid"])} == {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i])[:3]}


@pytest.mark.parametrize("small", [10, 1000])
def test_ties_go_to_the_smaller_id_both_ways(spark, small):
    rng = np.random.default_rng(4)
    x = np.array([(a, b, c) for a in range(6) for b in range(6) for c in range(6)], float)
    x = x[rng.permutation(len(x))]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    df = vectors(spark, x).select(F.col("id").alias("vid"), "v")
    for k in (1, 3, 20):
        wanted = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]}
        assert {(r.vid, r.nid) for r in neighbours.nearest_vectors(df, k, small=small).collect()} == wanted
    widened = {(r.vid, r.nid) for r in neighbours.nearest_vectors(df, 2, small=small, widen=1e-9).collect()}
    assert widened == {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(d[i] <= np.sort(d[i])[1])}


@pytest.mark.parametrize("small", ["5", "1000"])
def test_sites_on_a_ring_are_all_equally_far(spark, small):
    sites = spark.createDataFrame([(0, 90.0, 0.0)] + [(i, 40.0, 12.0 * i) for i in range(1, 31)], "hole_id int, latitude double, longitude double")
    spark.conf.set("stratalog.smallVectors", small)
    try:
        found = neighbours.nearest_sites(sites, 5).where("hole_id = 0").collect()
    finally:
        spark.conf.unset("stratalog.smallVectors")
    assert sorted((r.place, r.neighbour) for r in found) == [(i, i) for i in range(1, 6)]


def test_nearest_sites_cross_the_date_line_and_break_ties_by_id(spark):
    sites = spark.createDataFrame([("a", 0.0, 179.9), ("b", 0.0, -179.9), ("c", 0.0, 170.0), ("d", 0.0, 179.9), ("e", 0.0, 179.9)], "hole_id string, latitude double, longitude double")
    found = {(r.hole_id, r.place): (r.neighbour, round(r.km, 3)) for r in neighbours.nearest_sites(sites, 2).collect()}
    assert found[("a", 1)] == ("d", 0.0) and found[("a", 2)] == ("e", 0.0) and found[("d", 1)] == ("a", 0.0)
    assert found[("b", 1)][0] == "a" and found[("b", 1)][1] == pytest.approx(22.239, abs=1e-2)
    assert found[("c", 1)][0] == "a" and len(found) == 10


def test_radius_at_the_pole_and_the_date_line(spark):
    sites = spark.createDataFrame([("p", 89.9, 0.0), ("q", 89.9, 180.0), ("w", 0.0, 179.99), ("x", 0.0, 100.0)], "hole_id string, latitude double, longitude double")
    points = spark.createDataFrame([(1, 89.9, 90.0), (2, 0.0, -179.99)], "point int, at_lat double, at_lon double")
    found = neighbours.within_radius(points, sites, 30.0)
    assert sorted((r.point, r.hole_id) for r in found.collect()) == [(1, "p"), (1, "q"), (2, "w")]


def test_band_model_is_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(12)
    data = [(i, *[float(x) for x in rng.normal(size=3)], i % 9 == 0) for i in range(120)] + [(500, 9.0, 9.0, None, False)]
    df = spark.createDataFrame(data, "id long, band_500 double, band_900 double, band_1400 double, missing boolean")
    model = bands.fit_bands(df.where("not missing"), "id", trees=40)
    model.save(str(tmp_path / "model"))
    loaded = bands.BandModel.load(spark, str(tmp_path / "model"))
    one = bands.score_bands(df, model, "id", skipped=F.col("missing")).orderBy("id").toPandas()
    two = bands.score_bands(df, loaded, "id", skipped=F.col("missing")).orderBy("id").toPandas()
    np.testing.assert_allclose(one["anomaly_score"], two["anomaly_score"])
    assert one["anomaly_score"].between(0, 1).all() and not one[one["id"] % 9 == 0]["is_anomaly"].any()
    assert one[one["id"] == 500]["is_anomaly"].all() and 1 <= one["is_anomaly"].sum() <= 20
    fewer = bands.score_bands(df.drop("band_900"), model, "id")
    assert fewer.count() == 121
