"""Interval features: column roles, channel agreement, depth-bin aggregates and robust scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import fixed
from stratalog.functions import fixed
from stratalog.functions.text import blank_to_null, category
from stratalog.operators.ordered import top_per_key
from stratalog.operators.percentiles import exact_percentiles

MAX_CATEGORIES = 12
NUMERIC_SHARE = 0.80
SPREAD_BIN_SIZE = 5


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def column_types(df: DataFrame, identity: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns: numeric if at least 80 % of the present values parse. One pass."""
    skip = {c.lower() for c in identity}
    columns = [
        c for c in df.columns if c.lower() not in skip and not c.lower().startswith(tuple(fixed.UNSCORED_PREFIXES))
    ]
    if not columns:
        return [], []
    counts = []
    for i, c in enumerate(columns):
        text = F.trim(quoted(c).cast("string"))
        present = text.isNotNull() & (text != "")
        counts.append(F.count_if(present).alias(f"p{i}"))
        counts.append(F.count_if(present & text.try_cast("double").isNotNull()).alias(f"n{i}"))
    row = df.agg(*counts).first()
    numeric, categorical = [], []
    for i, c in enumerate(columns):
        if row[f"p{i}"]:
            (numeric if row[f"n{i}"] / row[f"p{i}"] >= NUMERIC_SHARE else categorical).append(c)
    return numeric, categorical


def channel_agreement(df: DataFrame, pairs: Sequence[tuple[str, str]], min_overlap: int = 100) -> DataFrame:
    """``channel_a, channel_b, overlap, agreement_pct`` for pairs with enough rows where both are present.

    All pairs share one aggregation pass; the result has one row per pair.
    """
    parts = []
    for i, (a, b) in enumerate(pairs):
        left, right = category(quoted(a)), category(quoted(b))
        both = left.isNotNull() & right.isNotNull()
        parts.append(F.count_if(both).alias(f"o{i}"))
        parts.append(F.count_if(both & (left == right)).alias(f"e{i}"))
    wide = df.agg(*parts)
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("channel_a"), F.lit(b).alias("channel_b"), F.col(f"o{i}").alias("overlap"), F.col(f"e{i}").alias("equal"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    report = wide.select(F.inline(rows)).where(F.col("overlap") >= min_overlap)
    return report.select("channel_a", "channel_b", "overlap", (F.col("equal") / F.col("overlap") * 100).alias("agreement_pct"))


def channel_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    """Every pair of channels of one feature that the table has."""
    pairs = []
    for feature in fixed.CHANNEL_FEATURES:
        present = [f"{feature} {c}" for c in fixed.CHANNEL_TYPES if f"{feature} {c}" in columns]
        pairs += [(a, b) for i, a in enumerate(present) for b in present[i + 1 :]]
    return pairs


def channel_disagreements(df: DataFrame, a: str, b: str, limit: int = 5) -> DataFrame:
    """Most frequent differing value pairs of two channels (top-k report)."""
    left, right = category(quoted(a)), category(quoted(b))
    different = df.select(left.alias("a"), right.alias("b")).where("a is not null and b is not null and a <> b")
    counts = different.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "a", "b").limit(limit)


def redundant_channels(df: DataFrame, categorical: Sequence[str], threshold: float = 0.999, min_overlap: int = 1000) -> list[str]:
    """Channels that repeat their preferred counterpart almost everywhere. One small action."""
    pairs = [
        (f"{f} {keep}", f"{f} {other}")
        for f in fixed.CHANNEL_FEATURES
        for keep, other in fixed.REDUNDANT_PAIRS
        if f"{f} {keep}" in categorical and f"{f} {other}" in categorical
    ]
    if not pairs:
        return []
    report = channel_agreement(df, pairs, min_overlap)
    return sorted(r.channel_b for r in report.where(F.col("agreement_pct") >= threshold * 100).collect())


#: The channels that classify the same feature, by the names of their columns.
CHANNEL_OF = {f"{feature} {kind}": feature for feature in fixed.CHANNEL_FEATURES for kind in fixed.CHANNEL_TYPES}


@dataclass
class FeatureSpec:
    """What was decided from the data, so that new data can be scored the same way."""

    key: list[str]
    depth: str
    bin_size: float
    numeric: list[str]
    categories: list[tuple[str, str, float]]  # column, label, prior
    spread: bool
    sample_no: str | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    kept: list[int] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        means = [n for c in self.numeric for n in ([f"{c} [mean]", f"{c} [sd]"] if self.spread else [f"{c} [mean]"])]
        return means + [f"{c} = {label}" for c, label, _ in self.categories]

    @property
    def prescaled(self) -> list[bool]:
        numeric = len(self.numeric) * (2 if self.spread else 1)
        return [False] * numeric + [True] * len(self.categories)

    @property
    def kept_names(self) -> list[str]:
        return [self.names[i] for i in self.kept]

    @property
    def kept_families(self) -> list[str]:
        """What each kept feature is explained as: a label of a declared channel as one of its channel's feature."""
        described = self.names[: len(self.names) - len(self.categories)]
        described += [f"{CHANNEL_OF.get(column, column)} = {label}" for column, label, _ in self.categories]
        return [described[i] for i in self.kept]


def _bin(depth: str, size: float) -> Column:
    return (F.floor(F.col(depth) / size) * size).cast("double")


def top_categories(df: DataFrame, columns: Sequence[str], k: int = MAX_CATEGORIES, order: Sequence[str] = ()) -> DataFrame:
    """``column, label, n, n_present`` for the k most frequent labels of each column (first seen wins ties)."""
    if not columns:
        raise ValueError("no categorical columns")
    entries = F.array(*[F.struct(F.lit(c).alias("column"), category(quoted(c)).alias("label")) for c in columns])
    long = df.select(*order, F.explode_outer(entries).alias("e")).select(*order, "e.*").where("label is not null")
    first = F.min(F.struct(*order)) if order else F.min("label")
    counts = long.groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"), first.alias("_first"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("n_present"))
    best = top_per_key(counts, ["column"], [F.desc("n"), F.asc("_first")], k)
    return best.join(totals, "column").select("column", "label", "n", "n_present")


def feature_spec(
    df: DataFrame, *, key: Sequence[str], depth: str, numeric: Sequence[str], categorical: Sequence[str],
    bin_size: float = 1.0, sample_no: str | None = None, order: Sequence[str] = (),
) -> FeatureSpec:
    """Decide bins, spread columns, top categories and priors. Two small actions."""
    sizes = df.groupBy(*key, _bin(depth, bin_size).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    # the size of a bin is an integer with few distinct values, so its counts stay small
    median = exact_percentiles(sizes, [], "n", [0.5]).first()
    categories = []
    if categorical:
        rows = top_categories(df, list(categorical), order=order).collect()  # at most 12 per column
        ranked = {c: sorted((r for r in rows if r["column"] == c), key=lambda r: (-r["n"], r["label"])) for c in categorical}
        categories = [(c, r["label"], r["n"] / r["n_present"]) for c in categorical for r in ranked[c]]
    return FeatureSpec(
        list(key), depth, float(bin_size), list(numeric), categories,
        bool(median and median["q"][0] >= SPREAD_BIN_SIZE), sample_no,
    )


def interval_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row per key and depth bin with ``features`` (array<double>), ``n_samples`` and ``coverage``.

    A single map-side combined aggregation: samples leave their partition only
    as one partial row per bin.
    """
    number = lambda c: quoted(c).try_cast("double")
    aggregates = [F.count(F.lit(1)).alias("n_samples")]
    if spec.sample_no:
        aggregates += [F.min(spec.sample_no).alias("first_sample_no"), F.max(spec.sample_no).alias("last_sample_no")]
    for i, c in enumerate(spec.numeric):
        aggregates.append(F.avg(number(c)).alias(f"_m{i}"))
        if spec.spread:
            aggregates.append(F.stddev_samp(number(c)).alias(f"_d{i}"))
    for i, (c, label, _) in enumerate(spec.categories):
        aggregates.append(F.count_if(category(quoted(c)) == label).alias(f"_c{i}"))
    bins = df.groupBy(*spec.key, _bin(spec.depth, spec.bin_size).alias("depth_from_m")).agg(*aggregates)

    values = []
    for i in range(len(spec.numeric)):
        values.append(F.col(f"_m{i}"))
        if spec.spread:
            values.append(F.col(f"_d{i}"))
    n = F.col("n_samples")
    for i, (_, _, prior) in enumerate(spec.categories):
        error = F.sqrt(F.greatest(n * prior * (1.0 - prior), F.lit(1e-9)))
        values.append((F.col(f"_c{i}") - n * prior) / error)
    features = F.array(*[v.cast("double") for v in values])
    kept = [*spec.key, "depth_from_m", (F.col("depth_from_m") + spec.bin_size).alias("depth_to_m"), "n_samples"]
    if spec.sample_no:
        kept += ["first_sample_no", "last_sample_no"]
    return bins.select(*kept, features.alias("features")).withColumn("coverage", coverage("features"))


def coverage(features: str) -> Column:
    """Share of features that were observed."""
    seen = F.filter(F.col(features), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.size(seen) / F.greatest(F.size(features), F.lit(1))


def feature_statistics(df: DataFrame, features: str) -> DataFrame:
    """``pos, n, q25, q50, q75, sd_pop`` per array position over the finite values."""
    long = df.select(F.posexplode_outer(features).alias("pos", "x")).where("x is not null and not isnan(x)")
    long = long.where(F.abs(F.col("x")) < float("inf"))
    # every position has at most one value per row
    quartiles = exact_percentiles(long, ["pos"], "x", [0.25, 0.5, 0.75], largest=df.count())
    spread = long.groupBy("pos").agg(F.stddev_pop("x").alias("sd_pop"))
    return quartiles.join(spread, "pos").select(
        "pos", "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "sd_pop"
    )


def fit_scaling(df: DataFrame, spec: FeatureSpec) -> FeatureSpec:
    """Centre and spread per feature; features without values or spread are dropped from ``kept``."""
    width = len(spec.names)
    stats = {r.pos: r for r in feature_statistics(df, "features").collect()}  # one row per feature
    centre, scale, kept = np.zeros(width), np.ones(width), []
    for i in range(width):
        s = stats.get(i)
        if s is None or s.n < 3:
            continue
        if spec.prescaled[i]:
            kept.append(i)
            continue
        spread = max((s.q75 - s.q25) / 1.349, 0.5 * s.sd_pop)
        if not np.isfinite(spread) or spread <= 1e-12:
            continue
        centre[i], scale[i] = s.q50, spread
        kept.append(i)
    if not kept:
        raise ValueError("no usable feature: every column is constant or empty")
    spec.centre, spec.scale, spec.kept = centre, scale, kept
    return spec


def scaled(spec: FeatureSpec, features: str = "features") -> Column:
    """array<double> of the kept features: centred, divided, missing as 0, clipped."""
    limit = fixed.SCORE_CLIP
    parts = []
    for i in spec.kept:
        x = (F.get(features, F.lit(i)) - F.lit(float(spec.centre[i]))) / F.lit(float(spec.scale[i]))
        good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        parts.append(F.when(good, F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))).otherwise(F.lit(0.0)))
    return F.array(*parts)


def robust_norm(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    return F.sqrt(total) / F.sqrt(F.greatest(F.size(v), F.lit(1)).cast("double"))


def largest_abs(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.array_max(F.transform(v, lambda x: F.abs(x)))


def contributors(vector: str, families: Sequence[str], limit: int = 3) -> Column:
    """Text naming up to ``limit`` families with the largest absolute values of at least 1; ``families`` are those of the entries."""
    groups: dict[str, list[int]] = {}
    for i, family in enumerate(families):
        groups.setdefault(family, []).append(i)
    value = lambda i: F.get(vector, F.lit(i))
    bests = []
    for name, places in groups.items():
        options = [F.struct(F.abs(value(i)).alias("a"), F.lit(-i).alias("p"), value(i).alias("z")) for i in places]
        best = F.array_max(F.array(*options))
        bests.append(F.struct((-best["a"]).alias("a"), (-best["p"]).alias("p"), F.lit(name).alias("g"), best["z"].alias("z")))
    ranked = F.slice(F.filter(F.array_sort(F.array(*bests)), lambda b: b["a"] <= -1.0), 1, limit)

    def words(b):
        direction = F.when(b["z"] > 0, "high").otherwise("low")
        size = F.when(b["a"] <= -24.99, F.lit(">=25.0 sd")).otherwise(F.format_string("%.1f sd", -b["a"]))
        return F.concat(b["g"], F.lit(" ("), direction, F.lit(", "), size, F.lit(")"))

    return F.array_join(F.transform(ranked, words), "; ")


def band_columns(df: DataFrame, prefix: str = "band_") -> list[str]:
    found = sorted(c for c in df.columns if c.startswith(prefix))
    if not found:
        raise ValueError(f"no column starts with {prefix!r}")
    return found


def filled_bands(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``features`` array of the columns, a missing value replaced by the column median, then by 0."""
    values = [blank_to_null(quoted(c)).try_cast("double") for c in columns]
    stats = feature_statistics(df.select(F.array(*values).alias("features")), "features")
    medians = {r.pos: r.q50 for r in stats.select("pos", "q50").collect()}  # one row per band
    return df.withColumn("features", F.array(*[F.coalesce(v, F.lit(float(medians.get(i, 0.0)))) for i, v in enumerate(values)]))
