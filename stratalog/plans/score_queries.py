"""Features, scores and models over the event log, order lines and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.operators import features, forest, profiles, scoring
from stratalog.operators.bands import BandModel, fit_bands, score_bands
from stratalog.operators.lof import local_outlier_factor
from stratalog.operators.neighbours import most_similar, nearest_sites, nearest_vectors
from stratalog.plans.registry import query
from stratalog.plans.views import READINGS_SQL, SITES_SQL, km_sql, readings, sites, spectra
from stratalog.session import scratch, settle_table, table

BIN_H = 120.0
LABELS = ["click", "error", "purchase", "signup", "view"]


def spec_of(samples):
    return features.feature_spec(
        samples, key=["hole"], depth="depth_h", numeric=["value", "k"], categorical=["event_type"], bin_size=BIN_H, order=["us", "event_id"]
    )


def binned(spark, folder):
    samples = readings(spark, folder)
    spec = spec_of(samples)
    return features.interval_features(samples, spec), spec


FEATURES_SQL = f"""{READINGS_SQL},
prior AS (SELECT event_type AS label, count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1),
bins AS (
  SELECT hole, CAST(floor(depth_h / 120) * 120 AS DOUBLE) AS depth_from_m, count(*) AS n, avg(value) AS value_mean, stddev_samp(value) AS value_sd,
         avg(k) AS k_mean, stddev_samp(k) AS k_sd, {", ".join(f"count_if(event_type = '{l}') AS c_{l}" for l in LABELS)} FROM readings GROUP BY 1, 2),
spread AS (SELECT quantile_cont(n, 0.5) >= 5 AS s FROM bins),
feat AS (
  SELECT hole, depth_from_m, n, value_mean, CASE WHEN s THEN value_sd END AS value_sd, k_mean, CASE WHEN s THEN k_sd END AS k_sd, s,
         {", ".join(f"(c_{l} - n * p_{l}) / sqrt(greatest(n * p_{l} * (1 - p_{l}), 1e-9)) AS d_{l}" for l in LABELS)}
  FROM bins, spread, (SELECT {", ".join(f"max(p) FILTER (label = '{l}') AS p_{l}" for l in LABELS)} FROM prior))"""


def named_features(df, spec):
    wanted = {"value [mean]": "value_mean", "value [sd]": "value_sd", "k [mean]": "k_mean", "k [sd]": "k_sd"}
    wanted |= {f"event_type = {label}": f"d_{label}" for label in LABELS}
    at = {n: i for i, n in enumerate(spec.names)}
    return [
        (F.get("features", F.lit(at[n])) if n in at else F.lit(None).cast("double")).alias(alias) for n, alias in wanted.items()
    ]


ALL = ["value_mean", "value_sd", "k_mean", "k_sd", *[f"d_{l}" for l in LABELS]]


@query(
    "interval_features",
    f"WITH {FEATURES_SQL} SELECT hole, depth_from_m, n AS n_samples, {', '.join(f'round({c}, 6) AS {c}' for c in ALL)} FROM feat",
)
def interval_features(spark, folder):
    table_, spec = binned(spark, folder)
    flat = table_.select("hole", "depth_from_m", "n_samples", *named_features(table_, spec))
    return flat.withColumns({c: F.round(c, 6) for c in ALL})


STATS_SQL = f"""{FEATURES_SQL},
long AS (UNPIVOT (SELECT value_mean, value_sd, k_mean, k_sd FROM feat) ON value_mean, value_sd, k_mean, k_sd INTO NAME feature VALUE x),
stats AS (
  SELECT feature, count(*) AS n, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, stddev_pop(x) AS sd
  FROM long GROUP BY 1)"""


@query(
    "robust_feature_statistics",
    f"""WITH {STATS_SQL} SELECT feature, n, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(sd, 6) AS sd_pop,
round(greatest((q75 - q25) / 1.349, 0.5 * sd), 6) AS spread FROM stats""",
)
def robust_feature_statistics(spark, folder):
    table_, spec = binned(spark, folder)
    names = F.array(*[F.lit(n.replace(" [", "_").rstrip("]")) for n in spec.names])
    stats = features.feature_statistics(table_, "features").withColumn("feature", F.get(names, F.col("pos")))
    stats = stats.where(~F.contains("feature", F.lit(" = ")))
    spread = F.greatest((F.col("q75") - F.col("q25")) / 1.349, F.lit(0.5) * F.col("sd_pop"))
    return stats.select("feature", "n", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75", "sd_pop")], F.round(spread, 6).alias("spread"))


SCALED_SQL = f"""{STATS_SQL},
centre AS (SELECT {", ".join(f"max(q50) FILTER (feature = '{c}') AS m_{c}, max(greatest((q75 - q25) / 1.349, 0.5 * sd)) FILTER (feature = '{c}' AND n >= 3) AS s_{c}" for c in ALL[:4])} FROM stats),
scaled AS (
  SELECT hole, depth_from_m, n, (CAST(value_mean IS NOT NULL AS INTEGER) + CAST(value_sd IS NOT NULL AS INTEGER) + CAST(k_mean IS NOT NULL AS INTEGER)
           + CAST(k_sd IS NOT NULL AS INTEGER) + 5) / CASE WHEN s THEN 9.0 ELSE 7.0 END AS coverage,
         list_concat([{", ".join(f"coalesce(greatest(least(({c} - m_{c}) / s_{c}, 25.0), -25.0), 0.0)" for c in ALL[:4])}],
                     [{", ".join(f"greatest(least({c}, 25.0), -25.0)" for c in ALL[4:])}]) AS v, s
  FROM feat, centre),
normed AS (
  SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) / sqrt(CASE WHEN s THEN 9 ELSE 7 END) AS robust_distance,
         list_max(list_transform(v, lambda x: abs(x))) AS max_z FROM scaled)"""


def scaled_table(spark, folder):
    table_, spec = binned(spark, folder)
    table_ = settle_table(table_, "bins")
    spec = features.fit_scaling(table_, spec)
    vector = settle_table(table_.withColumn("scaled", features.scaled(spec)), "scaled")
    return vector.withColumns({"robust_distance": features.robust_norm("scaled"), "max_z": features.largest_abs("scaled")}), spec


@query(
    "scaled_distance_and_flags",
    f"""WITH {SCALED_SQL},
ranked AS (SELECT *, 100.0 * (row_number() OVER (ORDER BY robust_distance, hole, depth_from_m) - 1) / greatest(count(*) OVER () - 1, 1) AS score FROM normed)
SELECT hole, depth_from_m, round(CAST(coverage AS DOUBLE), 6) AS coverage, round(robust_distance, 5) AS robust_distance, round(max_z, 5) AS max_z,
       CASE WHEN coverage < 0.30 THEN 'insufficient data' WHEN score < 95 THEN 'normal' WHEN max_z >= 6 THEN 'high' WHEN max_z >= 4 THEN 'elevated' ELSE 'watch' END AS flag,
       CASE WHEN coverage < 0.30 OR n < 2 THEN 'low' WHEN coverage < 0.60 OR n < 4 THEN 'medium' ELSE 'high' END AS reliability FROM ranked""",
)
def scaled_distance_and_flags(spark, folder):
    scored, _ = scaled_table(spark, folder)
    ranked = scoring.combined_rank(scored, ["robust_distance"], ["hole", "depth_from_m"], "score")
    return ranked.select(
        "hole", "depth_from_m", F.round("coverage", 6).alias("coverage"), F.round("robust_distance", 5).alias("robust_distance"), F.round("max_z", 5).alias("max_z"),
        scoring.flag("score", "coverage", "max_z").alias("flag"), scoring.reliability("coverage", "n_samples").alias("reliability"),
    )


@query(
    "combined_percentile_rank",
    f"""WITH {READINGS_SQL},
d AS (SELECT hole, count(*) AS n, max(value) AS top, CAST(sum(k) AS BIGINT) AS total FROM readings GROUP BY 1),
r AS (SELECT hole, (row_number() OVER (ORDER BY n, hole) - 1 + row_number() OVER (ORDER BY top, hole) - 1 + row_number() OVER (ORDER BY total, hole) - 1)
        * 100.0 / 3 / greatest(count(*) OVER () - 1, 1) AS score FROM d)
SELECT hole, round(CAST(score AS DOUBLE), 6) AS anomaly_score, row_number() OVER (ORDER BY round(CAST(score AS DOUBLE), 6) DESC, hole) AS rank FROM r""",
)
def combined_percentile_rank(spark, folder):
    per_hole = readings(spark, folder).groupBy("hole").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.sum("k").alias("total"))
    scored = scoring.combined_rank(per_hole, ["n", "top", "total"], ["hole"])
    scored = scored.withColumn("anomaly_score", F.round("anomaly_score", 6)).withColumn("_neg", -F.col("anomaly_score"))
    from stratalog.operators.ordered import number, ordered_scan

    return ordered_scan(scored, [], ["_neg", "hole"], {"rank": number()}).select("hole", "anomaly_score", "rank")


@query(
    "score_explanations",
    f"""WITH {SCALED_SQL},
part AS (
  SELECT hole, depth_from_m, unnest(v) AS z, unnest(['value [mean]', 'value [sd]', 'k [mean]', 'k [sd]', {", ".join(f"'event_type = {l}'" for l in LABELS)}]) AS name,
         generate_subscripts(v, 1) AS i FROM scaled),
top AS (SELECT *, row_number() OVER (PARTITION BY hole, depth_from_m ORDER BY abs(z) DESC, i) AS r FROM part WHERE abs(z) >= 1)
SELECT hole, depth_from_m, string_agg(name || CASE WHEN z > 0 THEN ' (high, ' ELSE ' (low, ' END || CASE WHEN abs(z) >= 24.99 THEN '>=25.0 sd' ELSE printf('%.1f sd', abs(z)) END || ')', '; ' ORDER BY r) AS why FROM top WHERE r <= 3 GROUP BY 1, 2""",
)
def score_explanations(spark, folder):
    scored, spec = scaled_table(spark, folder)
    return scored.select("hole", "depth_from_m", features.contributors("scaled", spec.kept_families).alias("why")).where("why <> ''")


PAIRS = [("l_returnflag", "l_linestatus"), ("l_returnflag", "copy"), ("l_linestatus", "copy")]


def channels(spark, folder):
    items = table(spark, folder, "lineitem")
    copy = F.when(F.col("l_linenumber") == 7, F.lit("N/A")).when(F.col("l_linenumber") == 6, F.lit("other")).otherwise(F.concat(F.lit(" "), F.lower("l_returnflag")))
    return items.select("l_returnflag", "l_linestatus", copy.alias("copy"))


CHANNEL_SQL = """ch AS (
  SELECT lower(l_returnflag) AS l_returnflag, lower(l_linestatus) AS l_linestatus,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'other' ELSE lower(l_returnflag) END AS copy FROM lineitem)"""


@query(
    "channel_agreement",
    f"WITH {CHANNEL_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS channel_a, '{b}' AS channel_b, count(*) AS overlap, round(avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END) * 100, 6) AS agreement_pct"
        f" FROM ch WHERE {a} IS NOT NULL AND {b} IS NOT NULL HAVING count(*) >= 100"
        for a, b in PAIRS
    ),
)
def channel_agreement(spark, folder):
    return features.channel_agreement(channels(spark, folder), PAIRS).withColumn("agreement_pct", F.round("agreement_pct", 6))


@query(
    "channel_disagreements",
    f"""WITH {CHANNEL_SQL} SELECT l_returnflag AS a, copy AS b, count(*) AS n FROM ch
WHERE l_returnflag <> copy GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 5""",
)
def channel_disagreements(spark, folder):
    return features.channel_disagreements(channels(spark, folder), "l_returnflag", "copy")


@query(
    "redundant_channels",
    """SELECT 'Grp1 uTSAS' AS channel FROM lineitem
HAVING avg(CASE WHEN l_returnflag = CASE WHEN l_orderkey % 5000 = 0 THEN 'x' ELSE l_returnflag END THEN 1.0 ELSE 0.0 END) >= 0.999 AND count(*) >= 1000""",
)
def redundant_channels(spark, folder):
    items = table(spark, folder, "lineitem")
    twin = F.when(F.col("l_orderkey") % 5000 == 0, "x").otherwise(F.col("l_returnflag"))
    named = items.select(F.col("l_returnflag").alias("Grp1 sTSAS"), twin.alias("Grp1 uTSAS"), F.col("l_linestatus").alias("Min1 sTSAS"))
    dropped = features.redundant_channels(named, named.columns)
    return spark.createDataFrame([(c,) for c in dropped], "channel string")


@query(
    "top_labels",
    """WITH l AS (SELECT 'brand' AS column, lower(p_brand) AS label, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 2
  UNION ALL SELECT 'type', lower(p_type), count(*), min(p_partkey) FROM part GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first) AS r, CAST(sum(n) OVER (PARTITION BY "column") AS BIGINT) AS n_present FROM l)
SELECT "column", label, n, n_present FROM r WHERE r <= 12""",
)
def top_labels(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return features.top_categories(parts, ["brand", "type"], order=["p_partkey"])


@query(
    "column_roles",
    """WITH t AS (UNPIVOT (SELECT CAST(p_size AS VARCHAR) AS p_size, p_brand, CAST(p_retailprice AS VARCHAR) AS p_retailprice, p_type FROM part)
  ON p_size, p_brand, p_retailprice, p_type INTO NAME name VALUE v)
SELECT name, CASE WHEN avg(CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'numeric' ELSE 'categorical' END AS role FROM t GROUP BY 1""",
)
def column_roles(spark, folder):
    numeric, categorical = features.column_types(table(spark, folder, "part"), ["p_partkey", "p_name"])
    return spark.createDataFrame([(n, "numeric") for n in numeric] + [(c, "categorical") for c in categorical], "name string, role string")


@query("interval_anomalies")
def interval_anomalies(spark, folder):
    """Complete interval model: robust, principal-axis, isolation-forest and outlier-factor signals, flags and reasons."""
    samples = readings(spark, folder)
    scored, _, _ = scoring.score_intervals(samples, spec_of(samples))
    return scored.drop("scaled")


@query("hole_anomalies")
def hole_anomalies(spark, folder):
    scored, spec = scaled_table(spark, folder)
    collars = sites(spark, folder).withColumnRenamed("hole_id", "hole")
    return scoring.score_holes(scored, spec.kept_families, collars, hole="hole")


@query(
    "hole_distances",
    f"""WITH {SCALED_SQL}, {SITES_SQL.strip()},
part AS (SELECT hole, unnest(v) AS z, generate_subscripts(v, 1) AS i FROM scaled),
prof AS (SELECT hole, i, quantile_cont(z, 0.5) AS m, stddev_pop(z) AS d, count(*) AS n FROM part GROUP BY 1, 2),
p AS (SELECT hole, max(n) AS n, list_concat(list(m ORDER BY i), list(d ORDER BY i)) AS v FROM prof GROUP BY 1),
c AS (SELECT list(q ORDER BY i) AS c FROM (SELECT i, quantile_cont(x, 0.5) AS q FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p) GROUP BY i)),
away AS (SELECT hole, n, sqrt(list_sum(list_transform(list_zip(v, c), lambda t: (t[1] - t[2]) ** 2))) / sqrt(len(v)) AS d FROM p, c),
sq AS (SELECT a.hole, b.hole AS other, list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) ** 2)) AS s, len(a.v) AS w FROM p a JOIN p b ON a.hole <> b.hole),
alike AS (SELECT hole, arg_min(other, (s, other)) AS most_like FROM sq GROUP BY 1),
km AS (SELECT a.hole_id AS hole, b.hole_id AS other, {km_sql("a.latitude", "a.longitude", "b.latitude", "b.longitude")} AS km FROM sites a JOIN sites b ON a.hole_id <> b.hole_id WHERE a.hole_id IN (SELECT hole FROM p) AND b.hole_id IN (SELECT hole FROM p)),
near AS (SELECT *, row_number() OVER (PARTITION BY hole ORDER BY round(km, 9), other) AS place FROM km),
local AS (SELECT near.hole, arg_min(near.other, place) AS nearest, min(km) AS km, avg(sqrt(s) / sqrt(w)) AS d FROM near JOIN sq ON sq.hole = near.hole AND sq.other = near.other WHERE place <= 5 GROUP BY 1)
SELECT away.hole, n AS n_intervals, round_even(away.d, 4) AS profile_distance, most_like, nearest AS nearest_geographic_hole, round_even(km, 2) AS nearest_geographic_km, round_even(local.d, 4) AS local_anomaly_distance
FROM away LEFT JOIN alike USING (hole) LEFT JOIN local USING (hole)""",
)
def hole_distances(spark, folder):
    """The parts of the hole model that SQL can say: distance, likeness, and what the nearest holes on the map are like."""
    scored, spec = scaled_table(spark, folder)
    collars = sites(spark, folder).withColumnRenamed("hole_id", "hole")
    found = scoring.score_holes(scored, spec.kept_families, collars, hole="hole")
    return found.select("hole", "n_intervals", "profile_distance", "most_like", "nearest_geographic_hole", "nearest_geographic_km", "local_anomaly_distance")


@query("principal_axis_scores")
def principal_axis_scores(spark, folder):
    vectors = spectra(spark, folder).select("vec_id", F.col("values").cast("array<double>").alias("v"))
    scored, _ = scoring.pca_scores(vectors, "v")
    return scored.select("vec_id", F.round("mahalanobis", 4).alias("mahalanobis"), F.round("reconstruction_error", 4).alias("reconstruction_error"))


@query("isolation_forest_scores")
def isolation_forest_scores(spark, folder):
    vectors = spectra(spark, folder).select("vec_id", F.col("values").cast("array<double>").alias("v"))
    model = forest.fit(vectors, "v", "vec_id", trees=300)
    return vectors.select("vec_id", F.round(forest.score("v", model, spark), 6).alias("isolation_score"))


@query(
    "local_outlier_factors",
    """WITH p AS (
  SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p), n AS (SELECT * FROM r WHERE k <= 20),
kd AS (SELECT a, max(d) AS kd FROM n GROUP BY 1),
lrd AS (SELECT n.a, 1 / (avg(greatest(kd.kd, n.d)) + 1e-10) AS lrd FROM n JOIN kd ON kd.a = n.b GROUP BY 1)
SELECT n.a AS vec_id, round(avg(y.lrd) / max(x.lrd), 6) AS lof_score FROM n JOIN lrd y ON y.a = n.b JOIN lrd x ON x.a = n.a GROUP BY 1""",
)
def local_outlier_factors(spark, folder):
    vectors = spectra(spark, folder).select("vec_id", F.col("values").cast("array<double>").alias("v"))
    return local_outlier_factor(vectors, "vec_id", "v", 20).withColumn("lof_score", F.round("lof_score", 6))


@query("band_model_scores")
def band_model_scores(spark, folder):
    """Bands of each spectrum: fit on usable rows, score all, flag the most unusual share."""
    values = spectra(spark, folder)
    bands = values.select("vec_id", (F.col("label") % 7 == 6).alias("missing"), *[F.get("values", F.lit(i)).cast("double").alias(f"band_{380 + 4 * i}") for i in range(64)])
    usable = bands.where(~F.col("missing"))
    model = fit_bands(usable, "vec_id", trees=200)
    return score_bands(bands, model, "vec_id", skipped=F.col("missing")).select("vec_id", "anomaly_score", "is_anomaly", F.round("reconstruction_error", 4).alias("reconstruction_error"))


@query(
    "hole_profile_positions",
    f"""WITH {SCALED_SQL},
part AS (
  SELECT hole, unnest(v) AS z, unnest(['value [mean]', 'value [sd]', 'k [mean]', 'k [sd]', {", ".join(f"'event_type = {l}'" for l in LABELS)}]) AS name FROM scaled)
SELECT hole, name, count(*) AS n_intervals, round(quantile_cont(z, 0.5), 5) AS middle, round(stddev_pop(z), 5) AS spread FROM part GROUP BY 1, 2""",
)
def hole_profile_positions(spark, folder):
    """The profile by which whole holes are compared: median and deviation of each feature."""
    scored, spec = scaled_table(spark, folder)
    names, wide = spec.kept_names, len(spec.kept_names)
    places = [F.struct(F.lit(n).alias("name"), F.get("profile", F.lit(i)).alias("m"), F.get("profile", F.lit(wide + i)).alias("s")) for i, n in enumerate(names)]
    flat = scoring.hole_profiles(scored, hole="hole").select("hole", "n_intervals", F.explode(F.array(*places)).alias("p"))
    return flat.select("hole", "p.name", "n_intervals", F.round("p.m", 5).alias("middle"), F.round("p.s", 5).alias("spread"))


@query(
    "principal_axis_identity",
    """WITH long AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT i, quantile_cont(x, 0.5) AS m FROM long GROUP BY 1)
SELECT vec_id, round(sum((x - m) * (x - m)), 5) AS squared_distance FROM long JOIN centre USING (i) GROUP BY 1""",
)
def principal_axis_identity(spark, folder):
    """Projection and reconstruction error together give back the squared distance to the centre."""
    vectors = spectra(spark, folder).select("vec_id", F.col("values").cast("array<double>").alias("v"))
    axes = scoring.principal_axes(vectors, "v", scoring.positions(vectors, "v", vectors.count()), variance=scoring.VARIANCE_TARGET)
    scored = vectors.withColumn("s", scoring.axis_scores("v", axes))
    along = F.aggregate("s.projection", F.lit(0.0), lambda total, x: total + x * x)
    return scored.select("vec_id", F.round(along + F.col("s.reconstruction_error") * F.col("s.reconstruction_error"), 5).alias("squared_distance"))


@query(
    "forest_path_lengths",
    """WITH depth AS (
  SELECT vec_id, CASE WHEN embedding[1] <= 0 THEN 1 + 0.5 WHEN embedding[2] <= 0.05 THEN 2 + 1.25 ELSE 2 END AS a,
         CASE WHEN embedding[64] <= -0.02 THEN 1 WHEN embedding[3] <= 0 THEN 2 + 3.0 ELSE 2 + 0.25 END AS b FROM embeddings)
SELECT vec_id, round(pow(2, -((a + b) / 2) / (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0)), 9) AS score FROM depth""",
)
def forest_path_lengths(spark, folder):
    """Scores of a forest of two written-out trees: path lengths and their scale."""
    nodes = [
        (0, [0, -1, 1, -1, -1], [0.0, 0.0, 0.05, 0.0, 0.0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.0, 0.5, 0.0, 1.25, 0.0], 256),
        (1, [63, -1, 2, -1, -1], [-0.02, 0.0, 0.0, 0.0, 0.0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.0, 0.0, 0.0, 3.0, 0.25], 256),
    ]
    vectors = spectra(spark, folder).select("vec_id", F.col("values").cast("array<double>").alias("v"))
    model = spark.createDataFrame(nodes, forest.TREE_SCHEMA)
    return vectors.select("vec_id", F.round(forest.score("v", model, spark), 9).alias("score"))


@query(
    "band_model_saved",
    """SELECT count(*) AS n, CAST(count_if(label % 7 = 6) AS BIGINT) AS skipped, CAST(count_if(label % 7 <> 6) - ceil(0.95 * (count_if(label % 7 <> 6) - 1)) AS BIGINT) AS flagged, 0 AS skipped_flagged,
0.0::DOUBLE AS lowest, 1.0::DOUBLE AS highest FROM embeddings""",
)
def band_model_saved(spark, folder):
    """A band model fitted, saved, loaded and applied: how many rows it skips and flags, and the range of its scores."""
    values = spectra(spark, folder)
    bands = values.select("vec_id", (F.col("label") % 7 == 6).alias("missing"), *[F.get("values", F.lit(i)).cast("double").alias(f"band_{380 + 4 * i}") for i in range(64)])
    path = scratch(spark, "band-model")
    fit_bands(bands.where(~F.col("missing")), "vec_id").save(path)
    scored = score_bands(bands, BandModel.load(spark, path), "vec_id", skipped=F.col("missing"), keep=["missing"])
    count = lambda c: F.count_if(c)
    usable = F.when(~F.col("missing"), F.col("anomaly_score"))
    return scored.agg(
        F.count(F.lit(1)).alias("n"), count(F.col("missing")).alias("skipped"), count(F.col("is_anomaly")).alias("flagged"),
        count(F.col("missing") & F.col("is_anomaly")).cast("int").alias("skipped_flagged"), F.min(usable).alias("lowest"), F.max(usable).alias("highest"),
    )


@query(
    "band_model_identity",
    """WITH b AS (SELECT vec_id, label % 7 = 6 AS missing, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM b WHERE NOT missing GROUP BY 1)
SELECT vec_id, round(sum(((x - m) / CASE WHEN d > 0 THEN d ELSE 1 END) ** 2), 5) AS squared_distance, true AS same_when_loaded FROM b JOIN s USING (i) GROUP BY 1""",
)
def band_model_identity(spark, folder):
    """What a band model leaves over and what it projects add up to a spectrum's distance; a loaded model scores every row as the fitted one."""
    values = spectra(spark, folder)
    bands = values.select("vec_id", (F.col("label") % 7 == 6).alias("missing"), *[F.get("values", F.lit(i)).cast("double").alias(f"band_{380 + 4 * i}") for i in range(64)])
    fitted = fit_bands(bands.where(~F.col("missing")), "vec_id", trees=50)
    path = scratch(spark, "band-model")
    fitted.save(path)
    loaded = BandModel.load(spark, path)
    standard = F.array(*[(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(loaded.columns, loaded.mean, loaded.scale)])
    placed = bands.select("vec_id", standard.alias("standard")).select("vec_id", scoring.axis_scores("standard", loaded.axes).alias("s"))
    projected = F.aggregate("s.projection", F.lit(0.0), lambda acc, x: acc + x * x)
    total = placed.select("vec_id", F.round(F.col("s.reconstruction_error") * F.col("s.reconstruction_error") + projected, 5).alias("squared_distance"))
    score = lambda model, name: score_bands(bands, model, "vec_id", skipped=F.col("missing")).select("vec_id", F.struct("anomaly_score", "is_anomaly", "reconstruction_error").alias(name))
    same = score(fitted, "one").join(score(loaded, "two"), "vec_id").select("vec_id", (F.col("one") == F.col("two")).alias("same_when_loaded"))
    return total.join(same, "vec_id")


LATTICE_SQL = """WITH l AS (SELECT min(p_partkey) AS id, p_partkey % 13 AS x, p_partkey // 13 % 13 AS y, p_partkey // 338 AS z FROM part GROUP BY 2, 3, 4),
p AS (SELECT a.id, b.id AS near, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d FROM l a JOIN l b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, near) AS place FROM p)
SELECT id, near, round(sqrt(d), 9) AS distance FROM r WHERE place <= 5"""


def _lattice(spark, folder, small):
    at = F.array(*[c.cast("double") for c in (F.col("p_partkey") % 13, F.floor(F.col("p_partkey") / 13) % 13, F.floor(F.col("p_partkey") / 338))])
    entries = table(spark, folder, "part").groupBy(at.alias("v")).agg(F.min("p_partkey").alias("vid"))
    near = nearest_vectors(entries, 5, small=small)
    return near.select(F.col("vid").alias("id"), F.col("nid").alias("near"), F.round("distance", 9).alias("distance"))


@query("lattice_neighbours", LATTICE_SQL)
def lattice_neighbours(spark, folder):
    """Five nearest on a lattice that grows with the table, two parts to a point, where nearly all distances are tied."""
    return _lattice(spark, folder, None)


@query("lattice_neighbours_by_cells", LATTICE_SQL)
def lattice_neighbours_by_cells(spark, folder):
    """The same through cells, as tables too large to broadcast go."""
    return _lattice(spark, folder, 10)


@query(
    "sites_at_equal_distance",
    f"""WITH s AS (SELECT s_suppkey AS hole_id, (s_suppkey % 5) * 10.0 - 20 AS latitude, (s_suppkey % 12) * 30.0 AS longitude FROM supplier),
p AS (SELECT a.hole_id, b.hole_id AS neighbour, round({km_sql("a.latitude", "a.longitude", "b.latitude", "b.longitude")}, 6) AS km FROM s a JOIN s b ON a.hole_id <> b.hole_id),
r AS (SELECT *, row_number() OVER (PARTITION BY hole_id ORDER BY km, neighbour) AS place FROM p)
SELECT hole_id, neighbour, round(km, 3) AS km, CAST(place AS INTEGER) AS place FROM r WHERE place <= 4""",
)
def sites_at_equal_distance(spark, folder):
    """Sites on a grid of degrees: many share a position, and most distances are tied."""
    at = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("hole_id"), ((F.col("s_suppkey") % 5) * 10.0 - 20).alias("latitude"), ((F.col("s_suppkey") % 12) * 30.0).alias("longitude"))
    return nearest_sites(at, 4).withColumn("km", F.round("km", 3))


@query(
    "most_similar_spectrum",
    """WITH p AS (
  SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT a AS vec_id, arg_min(b, (d, b)) AS most_like, round(min(d), 6) AS squared_distance FROM p GROUP BY 1""",
)
def most_similar_spectrum(spark, folder):
    vectors = spectra(spark, folder).select("vec_id", F.col("values").cast("array<double>").alias("v"))
    return most_similar(vectors, ident="vec_id", vector="v").withColumn("squared_distance", F.round("squared_distance", 6))


@query(
    "nearest_five_sites",
    f"""WITH {SITES_SQL},
p AS (SELECT a.hole_id, b.hole_id AS neighbour, round({km_sql("a.latitude", "a.longitude", "b.latitude", "b.longitude")}, 9) AS km
  FROM sites a JOIN sites b ON a.hole_id <> b.hole_id AND abs(a.latitude - b.latitude) < 3),
r AS (SELECT *, row_number() OVER (PARTITION BY hole_id ORDER BY km, neighbour) AS place FROM p)
SELECT hole_id, neighbour, round(km, 4) AS km, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""",
)
def nearest_five_sites(spark, folder):
    return nearest_sites(sites(spark, folder), 5).withColumn("km", F.round("km", 4))


@query(
    "spectrum_profile",
    """SELECT label, count(*) AS sample_count, min(CAST(len(embedding) AS INTEGER)) AS channels_min, max(CAST(len(embedding) AS INTEGER)) AS channels_max,
 round(min(list_min(f))::DOUBLE, 6) AS value_min, round(max(list_max(f))::DOUBLE, 6) AS value_max, count_if(vec_id % 9 = 1) + count_if(vec_id % 7 = 2) AS non_finite_count,
 CAST(sum(len(list_filter(f, lambda x: x < 0))) AS BIGINT) AS below_zero, CAST(sum(len(list_filter(f, lambda x: x > 1))) AS BIGINT) AS above_one
FROM (SELECT *, list_concat(CASE WHEN vec_id % 9 = 1 THEN [] ELSE embedding[1:1] END, CASE WHEN vec_id % 7 = 2 THEN [] ELSE embedding[2:2] END, embedding[3:]) AS f FROM embeddings) GROUP BY 1""",
)
def spectrum_profile(spark, folder):
    """Every ninth spectrum has no number, every seventh an infinite one."""
    odd = lambda v, i: F.when((F.col("vec_id") % 9 == 1) & (i == 0), float("nan")).when((F.col("vec_id") % 7 == 2) & (i == 1), float("inf")).otherwise(v)
    rows = spectra(spark, folder).withColumn("values", F.transform("values", odd).cast("array<float>"))
    found = profiles.spectrum_profile(rows, by=["label"], values="values")
    return found.withColumns({c: F.round(c, 6) for c in ("value_min", "value_max")})


@query(
    "profile_statistics",
    """SELECT label, count(*) AS row_count, 64 AS channels_min, 64 AS channels_max, CAST(sum(len(list_filter(embedding, lambda x: x = 0))) AS BIGINT) AS zero_count,
 CAST(0 AS BIGINT) AS non_finite_count, round(min(list_min(embedding))::DOUBLE, 6) AS value_min, round(max(list_max(embedding))::DOUBLE, 6) AS value_max FROM embeddings GROUP BY 1""",
)
def profile_statistics(spark, folder):
    v = spectra(spark, folder).withColumn("values", F.col("values").cast("array<double>"))
    return profiles.profile_statistics(v, by=["label"]).withColumns({c: F.round(c, 6) for c in ("value_min", "value_max")})


@query(
    "profile_channel_histogram",
    "SELECT label, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS channels, count(*) AS n FROM embeddings GROUP BY 1, 2",
)
def profile_channel_histogram(spark, folder):
    positive = spectra(spark, folder).withColumn("values", F.filter("values", lambda x: x > 0))
    return profiles.channel_histogram(positive, by=["label"])


@query(
    "profile_positive_minima",
    "SELECT vec_id, round(coalesce(list_min(list_filter(embedding::DOUBLE[], lambda x: x > 0)), 0.0), 6) AS positive_min FROM embeddings",
)
def profile_positive_minima(spark, folder):
    v = spectra(spark, folder).withColumn("values", F.col("values").cast("array<double>"))
    return profiles.positive_minima(v, keep=["vec_id"]).withColumn("positive_min", F.round("positive_min", 6))
