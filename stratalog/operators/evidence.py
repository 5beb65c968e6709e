"""The evidence columns that failed holes are routed by, built from their source tables.

Every table is keyed by ``hole_id``; what is compared is joined per sample, image or
log and reduced map-side to a few counts per hole, so no hole is gathered anywhere.
``routing.case_evidence`` and ``routing.assign_case`` read the result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.functions.numbers import decimal_close, same_float32, spectral_region
from stratalog.operators.profiles import depth_resets

# Fixed values - names of logs and words of messages that the cases go by
SECTION_LOG, REFERENCE_LOG = "virtual_section", "prof_min"
INTERVAL_LOGS = ["Tray", "Section"]
MEMBERSHIP_MESSAGES = ["SpectralLogCollection", "Profile membership ambiguous"]
PROFILE_MESSAGES = ["Profile positive minima", "Profile references differ"]

KEY = ["hole_id"]


def _says(message: str, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.coalesce(F.col(message), F.lit("")).contains(phrase)
    return found


def _number(value: str) -> Column:
    """The value as a double, null for an empty text and the word null."""
    text = F.col(value)
    return F.when(~text.isin("", "null"), text.try_cast("double"))


def sample_sections(sections: DataFrame) -> DataFrame:
    """hole_id, sample_no, label (number of the section in the hole), place (number in its tray) of every sample."""
    local = W.partitionBy("hole_id", "tray_no").orderBy("lo")
    numbered = sections.withColumn("place", F.row_number().over(local))
    return numbered.select("hole_id", F.explode(F.sequence("lo", "hi")).alias("sample_no"), F.col("section_no").alias("label"), "place")


def section_numbering(values: DataFrame, samples: DataFrame) -> DataFrame:
    """virtual_section per hole: which numbering its logs follow; of logs that follow different ones, all that occur.

    'equal' (as the sections), 'tray_local' (from one in every tray), 'nulls' (as the
    sections where it is not null), 'other'.
    """
    logs = values.where(F.col("log_name") == SECTION_LOG).select("hole_id", "log_id", "sample_no", _number("value").alias("v"), F.col("value").isin("", "null").alias("absent"))
    n = samples.groupBy("hole_id").agg(F.count(F.lit(1)).alias("n"))
    met = logs.join(samples, ["hole_id", "sample_no"], "left")
    per_log = met.groupBy("hole_id", "log_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("v").eqNullSafe(F.col("label").cast("double"))).alias("off_label"),
        F.count_if(~F.col("v").eqNullSafe(F.col("place").cast("double"))).alias("off_place"),
        F.count_if(F.col("v").isNotNull() & ~F.col("v").eqNullSafe(F.col("label").cast("double"))).alias("wrong"),
        F.count_if(F.col("v").isNull() & ~F.coalesce("absent", F.lit(False))).alias("unread"),
        F.count("v").alias("present"),
    )
    whole = F.col("rows") == F.col("n")
    kind = (
        F.when(whole & (F.col("off_label") == 0), "equal")
        .when(whole & (F.col("off_place") == 0), "tray_local")
        .when(whole & (F.col("wrong") == 0) & (F.col("unread") == 0) & (F.col("present") > 0), "nulls")
        .otherwise("other")
    )
    kinds = per_log.join(n, "hole_id").select("hole_id", kind.alias("kind"))
    odd = kinds.where("kind <> 'equal'").groupBy("hole_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("virtual_section"))
    return odd


def profile_references(values: DataFrame, samples: DataFrame, minima: DataFrame) -> DataFrame:
    """profile_nulls, profile_reference and matching (all finite references are the profiles' minima at float32)."""
    logs = values.where(F.col("log_name") == REFERENCE_LOG).select("hole_id", "log_id", "sample_no", _number("value").alias("v"), F.col("value").isin("", "null").alias("absent"))
    n = samples.groupBy("hole_id").agg(F.count(F.lit(1)).alias("n"))
    endless = (F.abs("v") == float("inf")) | F.isnan("v") | (F.col("v").isNull() & ~F.coalesce("absent", F.lit(False)))
    met = logs.join(minima.select("hole_id", "sample_no", "minimum"), ["hole_id", "sample_no"], "left")
    differs = F.col("v").isNotNull() & ~F.coalesce(same_float32("v", "minimum"), F.lit(False))
    per_log = met.groupBy("hole_id", "log_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(endless, F.lit(False))).alias("odd"), F.count("v").alias("present"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(differs).alias("differing")
    )
    valid = (F.col("rows") == F.col("n")) & (F.col("odd") == 0) & (F.col("present") > 0)
    judged = per_log.join(n, "hole_id").withColumn("valid", valid)
    return judged.groupBy("hole_id").agg(
        F.sum(F.when(F.col("valid"), F.col("nulls")).otherwise(0)).alias("profile_nulls"),
        F.when(F.bool_and("valid"), "ok").otherwise("invalid").alias("profile_reference"),
        (F.bool_and("valid") & (F.sum("differing") == 0)).alias("matching"),
    )


def interval_aliases(logs: DataFrame) -> DataFrame:
    """interval_aliases per hole: whether all logs of an interval log's name have the digest of the dataset's own."""
    named = logs.where(F.col("log_name").isin(INTERVAL_LOGS))
    per_name = named.groupBy("hole_id", "log_name").agg(F.count(F.lit(1)).alias("n"), F.min("sha256").alias("least"), F.max("sha256").alias("most"), F.count("sha256").alias("known"))
    several = per_name.where("n > 1").groupBy("hole_id")
    return several.agg(F.when(F.bool_and((F.col("least") == F.col("most")) & (F.col("known") == F.col("n"))), "identical").otherwise("different").alias("interval_aliases"))


def image_log_agreement(images: DataFrame, content: list[str]) -> DataFrame:
    """image_logs per hole with several image logs: 'identical' if every ordinal has the same content in all of them.

    A log that is shorter, shifted or repeats an ordinal differs. Contents are compared
    per ordinal, so logs of any length take no list.
    """
    logs = images.groupBy("hole_id").agg(F.count_distinct("log_id").alias("logs")).where("logs > 1")
    row = F.struct(F.xxhash64(*content), F.unhex(F.md5(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))))
    # a digest per image is moved once, to the others of its ordinal; from there on there are counts only
    dealt = images.select("hole_id", "sample_no", "log_id", row.alias("row")).repartition("hole_id", "sample_no")
    per_ordinal = dealt.groupBy("hole_id", "sample_no").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("log_id").alias("in_logs"), (F.min("row") == F.max("row")).alias("alike"))
    ends = [f(c).alias(f"{name}_{c}") for c in ("rows", "in_logs") for name, f in (("least", F.min), ("most", F.max))]
    found = per_ordinal.groupBy("hole_id").agg(*ends, F.bool_and("alike").alias("alike")).join(logs, "hole_id")
    same = F.col("alike")
    for c in ("least_rows", "most_rows", "least_in_logs", "most_in_logs"):
        same = same & (F.col(c) == F.col("logs"))
    return found.select("hole_id", F.when(same, "identical").otherwise("different").alias("image_logs"))


def image_bounds(images: DataFrame, trays: DataFrame, positions: DataFrame) -> DataFrame:
    """float32_bounds and wide_bounds: images whose depths are the tray's only at float32, or not at all."""
    depth = positions.select("hole_id", "sample_no", "depth")
    ends = trays.select("hole_id", F.col("tray_no").alias("ordinal"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    at_lo = depth.toDF("hole_id", "_lo", "top")
    at_hi = depth.toDF("hole_id", "_hi", "bottom")
    bounded = ends.join(at_lo, ["hole_id", "_lo"]).join(at_hi, ["hole_id", "_hi"]).select("hole_id", F.col("ordinal").alias("sample_no"), "top", "bottom")
    met = images.join(bounded, ["hole_id", "sample_no"], "left")
    close = decimal_close("depth_from", "top") & decimal_close("depth_to", "bottom")
    single = same_float32("depth_from", "top") & same_float32("depth_to", "bottom")
    close, single = F.coalesce(close, F.lit(False)), F.coalesce(single, F.lit(False))
    return met.groupBy("hole_id").agg(F.count_if(~close & single).alias("float32_bounds"), F.count_if(~close & ~single).alias("wide_bounds"))


def reset_evidence(positions: DataFrame, trays: DataFrame, sections: DataFrame, reviewed: DataFrame) -> DataFrame:
    """resets per hole whose depth falls: 'reviewed' if just the reviewed samples, all of them starts of a tray and a section."""
    found = depth_resets(positions.select("hole_id", "sample_no", "depth"), log=KEY, order="sample_no", depth="depth").select("hole_id", "sample_no", F.lit(True).alias("found"))
    starts = trays.select("hole_id", F.col("lo").alias("sample_no")).join(sections.select("hole_id", F.col("lo").alias("sample_no")), ["hole_id", "sample_no"]).distinct().withColumn("start", F.lit(True))
    known = reviewed.select("hole_id", "sample_no").distinct().withColumn("known", F.lit(True))
    both = found.join(known, ["hole_id", "sample_no"], "full").join(starts, ["hole_id", "sample_no"], "left")
    good = F.coalesce(F.col("found") & F.col("known") & F.col("start"), F.lit(False))
    return both.groupBy("hole_id").agg(F.bool_or(F.col("found")).alias("any"), F.when(F.bool_and(good), "reviewed").otherwise("other").alias("resets")).where("any").drop("any")


def unavailable_profiles(profiles: DataFrame) -> DataFrame:
    """unavailable_profile per hole: 'contradicting' if one that is said to be unavailable has content."""
    has = F.coalesce(F.length("sha256") > 0, F.lit(False)) | ~F.col("nbytes").eqNullSafe(F.lit(0)) | ~F.col("records").eqNullSafe(F.lit(0)) | F.coalesce("file_there", F.lit(False))
    said = profiles.where("status = 'unavailable'")
    return said.groupBy("hole_id").agg(F.when(F.bool_or(has), "contradicting").otherwise("clean").alias("unavailable_profile"))


def hole_evidence(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per failed hole with all columns that ``routing.case_evidence`` and ``assign_case`` read.

    ``tables``: holes (plan, has_identity_file), datasets (dataset_id, samples), sections
    (section_no, tray_no, lo, hi), trays (tray_no, lo, hi), logs (log_id, log_name, sha256),
    values (log_id, log_name, sample_no, value), text_rows (log_id, fields), images (log_id,
    dataset_id, sample_no, depth_from, depth_to, start_value, end_value, sha256), positions
    (sample_no, depth), reviewed_resets (sample_no), profiles (log_id, status, sha256, nbytes,
    records, file_there), minima (sample_no, minimum), spectra (log_id, wavelengths, unit),
    failures (message, unexplained_payload_errors, applied_cases); all with hole_id.
    """
    t = tables
    samples = sample_sections(t["sections"])
    counts = t["datasets"].groupBy("hole_id").agg(F.count(F.lit(1)).alias("dataset_count"), F.count_distinct("samples").alias("distinct_sample_counts"))
    broken = t["text_rows"].groupBy("hole_id", "log_id").agg(F.bool_or(F.coalesce(F.size("fields") != 3, F.lit(True))).alias("broken"))
    texts = broken.groupBy("hole_id").agg(F.count_if("broken").alias("literal_text_errors"))
    known = spectral_region("wavelengths", "unit").isNotNull()
    axes = t["spectra"].groupBy("hole_id").agg(F.count_if(~known).alias("unknown_axes"))
    content = ["dataset_id", "depth_from", "depth_to", "start_value", "end_value", "sha256"]
    parts = [
        counts,
        section_numbering(t["values"], samples),
        profile_references(t["values"], samples, t["minima"]),
        interval_aliases(t["logs"]),
        image_log_agreement(t["images"], content),
        image_bounds(t["images"], t["trays"], t["positions"]),
        reset_evidence(t["positions"], t["trays"], t["sections"], t["reviewed_resets"]),
        unavailable_profiles(t["profiles"]),
        texts,
        axes,
        t["failures"].select("hole_id", "message", "unexplained_payload_errors", "applied_cases"),
    ]
    rows = t["holes"].select("hole_id", "plan", "has_identity_file")
    for part in parts:
        rows = rows.join(part, "hole_id", "left")
    absent = {
        "dataset_count": 0, "distinct_sample_counts": 0, "virtual_section": "equal", "profile_nulls": 0, "profile_reference": "ok", "interval_aliases": "none",
        "image_logs": "single", "float32_bounds": 0, "wide_bounds": 0, "resets": "none", "unavailable_profile": "none", "literal_text_errors": 0, "unknown_axes": 0,
    }
    asked = _says("message", PROFILE_MESSAGES)
    compared = F.when(~asked, "unasked").when(F.coalesce("matching", F.lit(False)), "equal").otherwise("different")
    return rows.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in absent.items()}).withColumns({"membership_failure": _says("message", MEMBERSHIP_MESSAGES), "profile_float32": compared}).drop("matching")
