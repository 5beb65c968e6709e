"""Data-quality rules. Each returns its violations as (rule, key, detail); no rows means the rule holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.arrays import explode_present
from stratalog.functions.numbers import equal_bits
from stratalog.operators.align import log_off_axis, vector_disagreements
from stratalog.operators.intervals import covering, coverage_violations, rectangle_overlaps, self_overlaps
from stratalog.operators.ordered import lag, number, ordered_scan
from stratalog.operators.relations import table_difference


def violation(rows: DataFrame, rule: str, key: Sequence[str], detail: str | Column) -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
    keys = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return rows.select(F.lit(rule).alias("rule"), keys.alias("key"), text.alias("detail"))


def all_of(violations: Sequence[DataFrame]) -> DataFrame:
    result = violations[0]
    for v in violations[1:]:
        result = result.unionByName(v)
    return result


def identity_complete(df: DataFrame, *, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Q01: identity columns are neither null nor blank."""
    found = []
    for c in columns:
        blank = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        found.append(F.when(blank, F.lit(c)))
    bad = df.withColumn("_b", F.array_compact(F.array(*found))).where(F.size("_b") > 0)
    return violation(bad, "identity complete", key, F.array_join("_b", ","))


def known_tokens(df: DataFrame, *, key: Sequence[str], column: str, tokens: Sequence[str]) -> DataFrame:
    """Q01: only known tokens (null is allowed)."""
    return violation(df.where(~F.col(column).cast("string").isin(list(tokens))), "known tokens", key, F.col(column))


def exact_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Q02: names that are missing or unexpected, decided from the schema alone."""
    return sorted(set(expected).symmetric_difference(df.columns))


def unique_key(df: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Q02: a key occurs once. Counts are combined map-side, so copies of a key cost one row per partition."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violation(repeated, "unique key", key, F.col("n"))


def row_counts(observed: DataFrame, expected: DataFrame, *, key: Sequence[str], column: str = "n", rule: str = "row count") -> DataFrame:
    """Q02, Q20: observed against expected counts, absent sides included."""
    both = observed.select(*key, F.col(column).alias("_o")).join(expected.select(*key, F.col(column).alias("_e")), list(key), "full")
    bad = both.where(~F.col("_o").eqNullSafe(F.col("_e")))
    return violation(bad, rule, key, F.format_string("observed %s, expected %s", F.col("_o").cast("string"), F.col("_e").cast("string")))


def on_axis(log: DataFrame, axis: DataFrame, *, key: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Q03: every log row lies on the axis."""
    return violation(log_off_axis(log, axis, on=on), "row on axis", key, F.concat_ws("..", *[F.col(c).cast("string") for c in on]))


def one_depth_vector(digests: DataFrame, *, hole: Sequence[str]) -> DataFrame:
    """Q03: dense logs of a hole share one depth vector."""
    return violation(vector_disagreements(digests, hole=hole), "one depth vector", hole, F.format_string("%s vectors", F.col("vectors").cast("string")))


def axis_extent(axes: DataFrame, samples: DataFrame, *, key: Sequence[str], depth: str = "md_m") -> DataFrame:
    """Q04: an axis has sample_count samples numbered 0..n-1 and the stated depth range."""
    seen = samples.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("sample_no").alias("_a"), F.max("sample_no").alias("_b"), F.min(depth).alias("_d0"), F.max(depth).alias("_d1")
    )
    joined = axes.join(seen, list(key), "left")
    problem = (
        F.when(~F.col("_n").eqNullSafe(F.col("sample_count")), "sample count")
        .when((F.col("_a") != 0) | (F.col("_b") != F.col("sample_count") - 1), "numbering")
        .when((F.col("_d0") != F.col("depth_min_m")) | (F.col("_d1") != F.col("depth_max_m")), "depth range")
    )
    return violation(joined.withColumn("_p", problem).where("_p is not null"), "axis extent", key, F.col("_p"))


def sample_membership(samples: DataFrame, intervals: DataFrame, *, axis: str = "axis_id") -> DataFrame:
    """Q05: each sample's tray and section are of that kind, nested, contain it and give its positions."""
    side = lambda p: intervals.select(
        F.col("interval_id").alias(f"{p}_interval_id"), F.col("interval_kind").alias(f"_{p}k"), F.col("parent_interval_id").alias(f"_{p}p"),
        F.col("sample_no_from").alias(f"_{p}f"), F.col("sample_no_to").alias(f"_{p}t"),
    )
    joined = samples.join(side("tray"), "tray_interval_id").join(side("section"), "section_interval_id")
    no = F.col("sample_no")
    problem = (
        F.when((F.col("_trayk") != "tray") | (F.col("_sectionk") != "section"), "kind")
        .when(~F.col("_sectionp").eqNullSafe(F.col("tray_interval_id")), "nesting")
        .when(~no.between(F.col("_trayf"), F.col("_trayt")) | ~no.between(F.col("_sectionf"), F.col("_sectiont")), "outside")
        .when((F.col("tray_sample_no") != no - F.col("_trayf") + 1) | (F.col("section_sample_no") != no - F.col("_sectionf") + 1), "position")
    )
    return violation(joined.withColumn("_p", problem).where("_p is not null"), "sample membership", [axis, "sample_no"], F.col("_p"))


def section_in_tray(intervals: DataFrame) -> DataFrame:
    """Q06: a section lies inside its parent tray."""
    parents = intervals.select(
        F.col("interval_id").alias("parent_interval_id"), F.col("interval_kind").alias("_k"), F.col("sample_no_from").alias("_f"), F.col("sample_no_to").alias("_t")
    )
    joined = intervals.join(parents, "parent_interval_id")
    bad = joined.where((F.col("_k") != "tray") | (F.col("sample_no_from") < F.col("_f")) | (F.col("sample_no_to") > F.col("_t")))
    return violation(bad, "section in tray", ["interval_id"], "parent is not a tray or does not contain the section")


def interval_depths(intervals: DataFrame, samples: DataFrame, *, axis: str = "axis_id", depth: str = "md_m") -> DataFrame:
    """Q06: observed depth range of an interval equals that of its samples."""
    found = covering(
        samples.select(axis, "sample_no", depth),
        intervals.select(axis, "interval_id", F.col("sample_no_from").alias("_f"), F.col("sample_no_to").alias("_t")),
        key=[axis], at="sample_no", lo="_f", hi="_t",
    ).groupBy("interval_id").agg(F.min(depth).alias("_a"), F.max(depth).alias("_b"))
    joined = intervals.join(found, "interval_id")
    bad = joined.where(~F.col("_a").eqNullSafe(F.col("observed_depth_min_m")) | ~F.col("_b").eqNullSafe(F.col("observed_depth_max_m")))
    return violation(bad, "interval depth range", ["interval_id"], F.concat_ws("..", F.col("_a").cast("string"), F.col("_b").cast("string")))


def chunk_sequence(chunks: DataFrame, *, asset: str = "asset_id") -> DataFrame:
    """Q10: row groups are numbered from 0 and their row ranges follow each other."""
    seen = ordered_scan(chunks, [asset], ["row_group"], {"_prev": lag("source_row_to_exclusive"), "_no": number()}, block=F.floor(F.col("row_group") / 65536))
    bad = seen.where(
        (F.col("row_group") != F.col("_no") - 1) | (F.col("source_row_from") != F.coalesce(F.col("_prev"), F.lit(0)))
    )
    return violation(bad, "chunk sequence", [asset, "row_group"], F.col("source_row_from"))


def chunk_row_totals(chunks: DataFrame, logs: DataFrame, *, key: Sequence[str] = ("log_id",)) -> DataFrame:
    """Q10: chunk rows of a log add up to its row count."""
    sums = chunks.groupBy(*key).agg(F.sum("row_count").alias("n"))
    wanted = logs.select(*key, F.col("observed_row_count").alias("n"))
    return row_counts(sums, wanted.join(sums.select(*key), list(key), "left_semi"), key=key, rule="chunk row total")


def chunk_bindings(chunks: DataFrame, bindings: DataFrame) -> DataFrame:
    """Q10: dense chunks belong to a verified binding of the same axis."""
    b = bindings.select("log_id", F.col("axis_id").alias("_a"), F.col("status").alias("_s"))
    joined = chunks.where(F.col("coordinate_kind").isin("point_depth_m", "sample_index")).join(b, "log_id", "left")
    bad = joined.where(~F.col("_a").eqNullSafe(F.col("axis_id")) | ~F.col("_s").eqNullSafe(F.lit("verified")))
    return violation(bad, "chunk binding", ["log_id", "row_group"], F.coalesce("_s", F.lit("none")))


def asset_relations(users: DataFrame, assets: DataFrame, *, key: Sequence[str], role: str | None = None) -> DataFrame:
    """Q10, Q11: (log, asset) pairs in use are registered, with the wanted role."""
    known = assets if role is None else assets.where(F.col("role") == role)
    return violation(users.join(known.select("log_id", "asset_id"), ["log_id", "asset_id"], "left_anti"), "asset relation", key, F.col("asset_id"))


def location_identity(locations: DataFrame, assets: DataFrame) -> DataFrame:
    """Q11: a stored copy has the content hash of its asset."""
    joined = locations.join(assets.select("asset_id", "sha256"), "asset_id")
    return violation(joined.where("verified_sha256 <> sha256"), "location identity", ["asset_id"], F.col("verified_sha256"))


def image_relations(frames: DataFrame, intervals: DataFrame, logs: DataFrame) -> DataFrame:
    """Q11: an image frame shows a tray of its own label and comes from an image log."""
    t = intervals.select(F.col("interval_id").alias("core_interval_id"), F.col("interval_kind").alias("_k"), F.col("source_label").alias("_l"))
    joined = frames.join(t, "core_interval_id").join(logs.select("log_id", F.col("log_kind").alias("_lk")), "log_id")
    bad = joined.where((F.col("_k") != "tray") | (F.col("source_tray_label") != F.col("_l")) | (F.col("_lk") != "image"))
    return violation(bad, "image relation", ["image_frame_id"], F.concat_ws("/", "_k", "_lk"))


def binding_rows(logs: DataFrame, bindings: DataFrame) -> DataFrame:
    """Q12: every log states its binding."""
    return violation(logs.join(bindings.select("log_id"), "log_id", "left_anti"), "binding stated", ["log_id"], "no binding row")


def payload_presence(logs: DataFrame, assets: DataFrame) -> DataFrame:
    """Q12: unavailable logs have no payload, present ones have a raw one."""
    absent = logs.where("availability_status = 'metadata_only'").join(assets.select("log_id"), "log_id", "left_semi")
    raw = assets.where("role = 'raw_source'").select("log_id")
    present = logs.where("availability_status = 'payload_present'").join(raw, "log_id", "left_anti")
    return violation(absent, "payload presence", ["log_id"], "payload of an unavailable log").unionByName(
        violation(present, "payload presence", ["log_id"], "no raw payload")
    )


def weight_not_probability(logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Q13: a mineral weight is stated not to be a probability; unknown is a violation."""
    joined = logs.where("metric_code = 'mineral_weight'").join(metrics, ["dataset_revision_id", "metric_key"])
    return violation(joined.where(~F.col("is_probability").eqNullSafe(F.lit(False))), "weight is no probability", ["log_id"], F.col("metric_key"))


def usable_spectra(logs: DataFrame, bindings: DataFrame) -> DataFrame:
    """Q13: spectra offered per sample have a confirmed layout and a verified binding."""
    bound = bindings.where("status = 'verified' and axis_id is not null").select("log_id").distinct().withColumn("_b", F.lit(True))
    offered = logs.where("log_kind = 'spectral' and per_sample_publication_allowed").join(bound, "log_id", "left")
    bad = offered.where(~F.col("array_layout_status").eqNullSafe(F.lit("verified_sample_major")) | F.col("_b").isNull())
    return violation(bad, "usable spectra", ["log_id"], F.coalesce("array_layout_status", F.lit("none")))


def collar_range(collars: DataFrame, *, key: Sequence[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Q14: a collar is on the globe; a missing one is allowed."""
    y, x = F.col(lat), F.col(lon)
    bad = collars.where((y.isNotNull() | x.isNotNull()) & ~F.coalesce(y.between(-90, 90) & x.between(-180, 180), F.lit(False)))
    return violation(bad, "collar range", key, F.concat_ws(",", y.cast("string"), x.cast("string")))


def foreign_keys(tables: Mapping[str, DataFrame], keys: Sequence[tuple[str, Sequence[str], str, Sequence[str]]]) -> DataFrame:
    """Q15: (source, columns, target, columns) with simple matching: rows with a null part are exempt."""
    found = []
    for source, columns, target, targets in keys:
        # distinct keys first: a heavy key reaches the join as one row
        child = tables[source].dropna(subset=list(columns)).select(*columns).distinct()
        parent = tables[target].select(*[F.col(t).alias(c) for t, c in zip(targets, columns)])
        orphans = child.join(parent, list(columns), "left_anti")
        found.append(violation(orphans, f"{source} -> {target}", list(columns), "no parent"))
    return all_of(found)


def image_regions(regions: DataFrame, frames: DataFrame) -> DataFrame:
    """Q16: regions stay inside their frame and do not overlap; of what a region meets, the number and the smallest."""
    f = frames.select("image_frame_id", F.col("width_px").alias("_w"), F.col("height_px").alias("_h"))
    joined = regions.join(f, "image_frame_id")
    outside = joined.where((F.col("x") + F.col("width") > F.col("_w")) | (F.col("y") + F.col("height") > F.col("_h")))
    crossing = rectangle_overlaps(regions, frame=["image_frame_id"], ident="region_id")
    return violation(outside, "region inside frame", ["region_id"], "exceeds the frame").unionByName(
        violation(crossing, "regions apart", ["region_id"], F.concat_ws(" ", F.lit("overlaps"), F.col("overlaps").cast("string"), F.lit("first"), F.col("witness").cast("string")))
    )


def covered_once(samples: DataFrame, mappings: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Q16: every sample is shown by exactly one image mapping."""
    bad = coverage_violations(samples, mappings, key=key, lo="sample_no_from", hi="sample_no_to")
    return violation(bad, "covered once", [*key, "sample_no"], F.col("covers"))


def spectral_extent(arrays: DataFrame, assets: DataFrame) -> DataFrame:
    """Q17: bytes of a spectral file are offset plus samples times stride."""
    joined = arrays.join(assets.select("asset_id", "byte_size"), "asset_id")
    bad = joined.where(F.col("byte_size") != F.col("data_offset_bytes") + F.col("sample_count") * F.col("sample_stride_bytes"))
    return violation(bad, "spectral extent", ["spectral_array_id"], F.col("byte_size"))


def spectral_blocks(blocks: DataFrame, arrays: DataFrame) -> DataFrame:
    """Q17: blocks lie at the bytes of their rows and do not overlap."""
    a = arrays.select("spectral_array_id", "sample_count", "sample_stride_bytes", "data_offset_bytes")
    joined = blocks.join(a, "spectral_array_id")
    rows = F.col("source_row_to_exclusive") - F.col("source_row_from")
    bad = joined.where(
        (F.col("source_row_to_exclusive") > F.col("sample_count"))
        | (F.col("byte_offset") != F.col("data_offset_bytes") + F.col("source_row_from") * F.col("sample_stride_bytes"))
        | (F.col("byte_length") != rows * F.col("sample_stride_bytes"))
    )
    crossing = self_overlaps(
        blocks, key=["spectral_array_id"], lo="source_row_from", hi="source_row_to_exclusive", bounds="half_open",
        block=F.floor(F.col("source_row_from") / 1_000_000),
    )
    key = ["spectral_array_id", "source_row_from"]
    return violation(bad, "spectral block", key, "wrong byte range").unionByName(violation(crossing, "spectral block", key, "overlaps an earlier block"))


def spectral_maps(maps: DataFrame) -> DataFrame:
    """Q17: a source row and a sample are mapped at most once per array."""
    rows = self_overlaps(maps, key=["spectral_array_id"], lo="source_row_from", hi="source_row_to")
    samples = self_overlaps(maps, key=["spectral_array_id", "axis_id"], lo="sample_no_from", hi="sample_no_to")
    key = ["spectral_array_id", "source_row_from"]
    return violation(rows, "spectral map", key, "source rows mapped twice").unionByName(violation(samples, "spectral map", key, "samples mapped twice"))


def composite_windows(parts: DataFrame, samples: DataFrame) -> DataFrame:
    """Q18: sample bounds of a part match its depth window; parts follow each other and do not overlap."""
    from stratalog.operators.release import window_samples

    seen = window_samples(parts, samples).select(
        "composite_id", "sequence_no", F.col("first_sample").alias("_a"), F.col("last_sample").alias("_b"), F.col("n").alias("_n")
    )
    joined = parts.join(seen, ["composite_id", "sequence_no"], "left")
    chosen = F.col("selection_status") == "selected"
    n = F.coalesce(F.col("_n"), F.lit(0))
    wrong = (
        ~F.col("_a").eqNullSafe(F.col("sample_no_from"))
        | ~F.col("_b").eqNullSafe(F.col("sample_no_to"))
        | ((n > 0) != chosen)
        | ((n > 0) & (n != F.col("_b") - F.col("_a") + 1))
    )
    kept = parts.where(chosen)
    order = ordered_scan(
        kept, ["composite_id"], ["selection_from_md_m", "sequence_no"],
        {"_end": lag("selection_to_md_m"), "_closed": lag("upper_inclusive")}, block=F.floor(F.col("selection_from_md_m") / 1000),
    )
    crossing = order.where((F.col("selection_from_md_m") < F.col("_end")) | ((F.col("selection_from_md_m") == F.col("_end")) & F.col("_closed")))
    key = ["composite_id", "sequence_no"]
    return violation(joined.where(wrong), "composite window", key, "samples differ from the window").unionByName(
        violation(crossing, "composite window", key, "overlaps the previous part")
    )


def payload_rules(profiles: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Q19: payload results as issue rows (code, scope, severity, detail).

    ``profiles`` has kind, sha256, expected_sha256, non_finite_count, declared_channels and channels.
    """
    issues = F.array(
        F.when(~F.col("sha256").eqNullSafe(F.col("expected_sha256")), F.struct(F.lit("PAYLOAD_INTEGRITY_FAILURE").alias("code"), F.lit("error").alias("severity"), F.lit("hash differs from the manifest").alias("detail"))),
        F.when(F.coalesce("non_finite_count", F.lit(0)) > 0, F.struct(F.lit("PAYLOAD_INTEGRITY_FAILURE").alias("code"), F.lit("error").alias("severity"), F.lit("non-finite values").alias("detail"))),
        F.when((F.col("kind") == "profile") & ~F.col("declared_channels").eqNullSafe(F.col("channels")), F.struct(F.lit("PROFILE_CHANNEL_COUNT_CONFLICT").alias("code"), F.lit("warning").alias("severity"), F.lit("declared and observed channels differ").alias("detail"))),
        F.when(F.col("kind") == "spectral", F.struct(F.lit("SPECTRAL_MATRIX_ORDER_UNCONFIRMED").alias("code"), F.lit("warning").alias("severity"), F.lit("row order is not declared by the source").alias("detail"))),
    )
    scope = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    rows = explode_present(profiles, issues, "i").withColumn("scope", scope)
    return rows.select("i.code", "scope", "i.severity", "i.detail")


def range_read(source: DataFrame, stored: DataFrame, *, at: str, start, end, columns: Sequence[str]) -> DataFrame:
    """Q21: a depth-range read returns the source's rows, repeated depths included. Surplus rows are returned."""
    from stratalog.operators.relations import multiset_difference

    inside = lambda df: df.where(F.col(at).between(start, end)).select(*columns)
    return multiset_difference(inside(source), inside(stored))


def package_identity(packages: DataFrame) -> DataFrame:
    """Q22: a raw package names its own hole, is complete and has distinct, valid datasets.

    ``packages``: hole_id (folder), source_hole_id, package_hole_id, status, error_count, dataset_count, distinct_datasets, missing_documents.
    """
    findings = F.array(
        F.when(F.coalesce(F.col("source_hole_id"), F.lit("")) == "", "no borehole id"),
        F.when(F.col("source_hole_id") != F.col("hole_id"), "borehole id differs from the folder"),
        F.when(~F.col("package_hole_id").eqNullSafe(F.col("hole_id")), "package id differs from the folder"),
        F.when(~F.coalesce(F.col("status").isin("complete", "complete_with_warnings"), F.lit(False)), "package incomplete"),
        F.when(F.coalesce("error_count", F.lit(0)) > 0, "package records errors"),
        F.when(F.coalesce("dataset_count", F.lit(0)) == 0, "no datasets"),
        F.when(F.col("distinct_datasets") < F.col("dataset_count"), "dataset listed twice"),
        F.when(F.coalesce("missing_documents", F.lit(0)) > 0, "documents missing or of wrong type"),
    )
    bad = explode_present(packages, findings, "_f")
    return violation(bad, "package identity", ["hole_id"], F.col("_f"))


def loaded_equals_prepared(prepared: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Q23: every prepared table equals the loaded one, field by field."""
    found = []
    for name, key in keys.items():
        columns = [c for c in prepared[name].columns if c not in key]
        diff = table_difference(prepared[name], loaded[name], key=key, columns=columns)
        found.append(violation(diff, f"loaded {name}", list(key), F.col("difference")))
    return all_of(found)


def report_chain(steps: DataFrame, artefacts: DataFrame | None = None, *, key: Sequence[str] = ("hole_id",)) -> DataFrame:
    """Q26: each step passed, shares the first step's version and follows its predecessor; artefact hashes are unchanged."""
    first = steps.groupBy(*key).agg(F.min_by("version", "step").alias("_v"))
    joined = ordered_scan(steps, key, ["step"], {"_prev": lag("step")}).join(first, list(key))
    passed = F.col("status").isin("passed", "passed_with_issues")
    problem = (
        F.when(~F.coalesce(passed, F.lit(False)), "not passed")
        .when(F.col("version") != F.col("_v"), "versions mixed")
        .when(F.col("_prev").isNotNull() & (F.col("step") != F.col("_prev") + 1), "step missing")
        .when(F.col("_prev").isNotNull() & ~F.col("previous_step").eqNullSafe(F.col("_prev")), "predecessor differs")
    )
    result = violation(joined.withColumn("_p", problem).where("_p is not null"), "report chain", [*key, "step"], F.col("_p"))
    if artefacts is not None:
        changed = artefacts.where(~F.col("sha256").eqNullSafe(F.col("expected_sha256")))
        result = result.unionByName(violation(changed, "report chain", [*key, "path"], "artefact changed"))
    return result


def reference_positions(axes: DataFrame, sections: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Q27: samples to compare: first, first section's edge, middle, the block edge 4095 and the last, each with its successor."""
    edge = sections.groupBy(*key).agg(F.min_by("sample_no_to", "ordinal").alias("_edge"))
    n = F.col("sample_count")
    starts = F.array(
        F.lit(0).cast("long"), F.col("_edge").cast("long"), F.greatest(F.floor(n / 2) - 1, F.lit(0)), F.greatest(n - 2, F.lit(0)).cast("long"),
        F.greatest(F.least(F.lit(4095), n - 2), F.lit(0)).cast("long"),
    )
    both = F.flatten(F.transform(starts, lambda s: F.array(s, F.least(s + 1, n.cast("long") - 1))))
    return axes.join(edge, list(key)).select(*key, F.explode(F.array_distinct(both)).alias("sample_no"))


def reference_spectra(reference: DataFrame, stored: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Q27: reference spectra equal the stored ones bit by bit."""
    both = reference.select(*key, F.col("values").alias("_r")).join(stored.select(*key, F.col("values").alias("_s")), list(key), "left")
    bad = both.where(F.col("_s").isNull() | ~equal_bits("_r", "_s"))
    return violation(bad, "reference spectrum", key, F.when(F.col("_s").isNull(), "not stored").otherwise("differs"))


def unavailable_profiles(manifest: DataFrame, files: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Q25: a profile stated unavailable has no hash, bytes, records or file."""
    there = files.select(*key, F.col("path").alias("file")).distinct().withColumn("_there", F.lit(True))
    joined = manifest.where("status = 'unavailable'").join(there, [*key, "file"], "left")
    # a missing zero is as contradictory as a wrong one: the source must say 0
    bad = joined.where(
        F.col("_there").isNotNull() | (F.coalesce("sha256", F.lit("")) != "") | ~F.col("nbytes").eqNullSafe(F.lit(0)) | ~F.col("records").eqNullSafe(F.lit(0))
    )
    return violation(bad, "unavailable profile", [*key, "log_id"], "contradicting payload evidence")
