"""Band model: standardise, project on leading components, isolation forest, scaled scores and a flag threshold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.operators import forest
from stratalog.operators.features import band_columns, filled_bands, quoted
from stratalog.operators.percentiles import exact_percentiles
from stratalog.operators.scoring import Axes, axis_scores, principal_axes
from stratalog.session import settle_table

CONTAMINATION = 0.05


@dataclass
class BandModel:
    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    axes: Axes
    trees: DataFrame
    low: float
    high: float
    threshold: float

    def save(self, path: str) -> None:
        spark = self.trees.sparkSession
        row = (
            self.columns, self.mean.tolist(), self.scale.tolist(), self.axes.centre.tolist(),
            [c.tolist() for c in self.axes.components], self.axes.deviation.tolist(), self.low, self.high, self.threshold,
        )
        spark.createDataFrame([row], FACTS).write.parquet(f"{path}/facts")
        self.trees.write.parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BandModel":
        r = spark.read.parquet(f"{path}/facts").first()
        axes = Axes(np.array(r["centre"]), np.array(r["components"]), np.array(r["deviation"]))
        return BandModel(list(r["columns"]), np.array(r["mean"]), np.array(r["scale"]), axes, spark.read.parquet(f"{path}/trees"), r["low"], r["high"], r["threshold"])


_VECTOR = T.ArrayType(T.DoubleType())
FACTS = T.StructType(
    [T.StructField("columns", T.ArrayType(T.StringType()))]
    + [T.StructField(n, _VECTOR) for n in ("mean", "scale", "centre")]
    + [T.StructField("components", T.ArrayType(_VECTOR)), T.StructField("deviation", _VECTOR)]
    + [T.StructField(n, T.DoubleType()) for n in ("low", "high", "threshold")]
)


def _standard(features: str, mean: np.ndarray, scale: np.ndarray) -> Column:
    parts = [(F.get(features, F.lit(i)) - F.lit(float(m))) / F.lit(float(s)) for i, (m, s) in enumerate(zip(mean, scale))]
    return F.array(*parts)


def _scored(df: DataFrame, axes: Axes, width: int) -> DataFrame:
    s = df.withColumn("_s", axis_scores("standard", axes))
    rmse = F.col("_s.reconstruction_error") / F.sqrt(F.lit(float(width)))
    return s.withColumns({"projection": F.col("_s.projection"), "reconstruction_error": rmse}).drop("_s")


def fit_bands(rows: DataFrame, row_id: str, *, prefix: str = "band_", components: int = 5, trees: int = 200, contamination: float = CONTAMINATION, seed: int = 42) -> BandModel:
    """Train on the given rows; missing bands take the column median."""
    columns = band_columns(rows, prefix)
    width = len(columns)
    filled = settle_table(filled_bands(rows.select(row_id, *[quoted(c) for c in columns]), columns).select(row_id, "features"), "bands")
    stats = filled.select(F.posexplode_outer("features").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    found = sorted(stats.collect(), key=lambda r: r.pos)  # one row per band
    mean = np.array([r.m for r in found])
    scale = np.array([r.s if r.s > 0 else 1.0 for r in found])
    standard = filled.withColumn("standard", _standard("features", mean, scale))
    axes = principal_axes(standard, "standard", np.zeros(width), count=min(components, width))
    if axes is None:
        raise ValueError("no band varies")
    projected = settle_table(_scored(standard, axes, width).select(row_id, "projection"), "projected")
    model = settle_table(forest.fit(projected, "projection", row_id, trees=trees, seed=seed), "forest")
    raw = settle_table(projected.select(forest.score("projection", model, rows.sparkSession).alias("raw")), "raw")
    ends = raw.agg(F.min("raw"), F.max("raw")).first()
    low, high = float(ends[0]), float(ends[1])
    cut = exact_percentiles(raw, [], "raw", [1 - contamination]).first()["q"][0]
    threshold = (cut - low) / (high - low) if high > low else 0.0
    return BandModel(columns, mean, scale, axes, model, low, high, threshold)


def score_bands(rows: DataFrame, model: BandModel, row_id: str, *, skipped: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Scores in 0..1 with flags; absent bands count as 0, skipped rows score 0 and are not flagged."""
    values = [F.coalesce(quoted(c).try_cast("double") if c in rows.columns else F.lit(None).cast("double"), F.lit(0.0)) for c in model.columns]
    standard = [(v - F.lit(float(m))) / F.lit(float(s)) for v, m, s in zip(values, model.mean, model.scale)]
    base = rows.withColumn("standard", F.array(*standard))
    scored = _scored(base, model.axes, len(model.columns))
    raw = forest.score("projection", model.trees, rows.sparkSession)
    spread = model.high - model.low
    unit = F.least(F.greatest((raw - model.low) / spread, F.lit(0.0)), F.lit(1.0)) if spread > 0 else F.lit(0.0)
    skip = F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(False)
    scored = scored.withColumn("_u", unit).withColumn("_skip", skip)
    return scored.select(
        row_id, *keep,
        F.when(F.col("_skip"), F.lit(0.0)).otherwise(F.bround("_u", 4)).alias("anomaly_score"),
        (~F.col("_skip") & (F.col("_u") >= model.threshold)).alias("is_anomaly"),
        "reconstruction_error",
    )
