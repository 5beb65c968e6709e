"""Routing of holes by evidence, dataset selection and per-hole isolation of failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import fixed
from stratalog.functions.geo import great_circle_km
from stratalog.functions.text import decode_path_name, file_name
from stratalog.operators.neighbours import within_radius
from stratalog.operators.ordered import number, ordered_scan
from stratalog.operators.relations import set_difference

# Fixed values - reviewed cases, in the order in which they take precedence
FIRST_CASES = ["13", "12", "11"]
CUTTINGS = r"(?i)(?:^|[\s_()-])cuttings\d*(?:$|[\s_()-])"
UNFIXABLE = ["ModuleNotFoundError", "PermissionError", "No space left", "Membership response content changed"]


def package_route(holes: DataFrame) -> DataFrame:
    """status and route of each checked hole from its error, warning and dataset counts."""
    errors, warnings = F.coalesce("errors", F.lit(0)) > 0, F.coalesce("warnings", F.lit(0)) > 0
    return holes.withColumns(
        {
            "status": F.when(errors, "error").when(warnings, "warning").otherwise("passed"),
            "route": F.when(errors | warnings, "attention").when(F.col("dataset_count") > 1, "multi").otherwise("single"),
        }
    )


def route_totals(routed: DataFrame) -> DataFrame:
    """Holes and datasets per route; the member list is the routed table itself, filtered."""
    return routed.groupBy("route").agg(
        F.count(F.lit(1)).alias("holes"), F.sum(F.coalesce("dataset_count", F.lit(0))).alias("datasets"),
        F.count_if(F.col("dataset_count").isNull()).alias("unknown_dataset_count"),
    )


def selection_difference(selected: DataFrame, routed: DataFrame, route: str) -> DataFrame:
    """Holes by which a selection differs from a completed route group; empty means equal."""
    return set_difference(selected, routed.where(F.col("route") == route), ["hole_id"], "not in group", "not selected")


def case_evidence(e: DataFrame) -> DataFrame:
    """``cases`` and ``unresolved`` of failed holes from their evidence columns.

    One row per hole: plan ('12', '13' or null), hole_id, has_identity_file, dataset_count,
    distinct_sample_counts, membership_failure, virtual_section ('equal', 'tray_local', 'nulls', 'other', joined by + where logs differ),
    literal_text_errors, profile_nulls, profile_reference ('ok', 'invalid'), interval_aliases ('none', 'identical', 'different'),
    image_logs ('single', 'identical', 'different'), float32_bounds, wide_bounds, resets ('none', 'reviewed', 'other'),
    unavailable_profile ('none', 'clean', 'contradicting'), profile_float32 ('unasked', 'equal', 'different'), unknown_axes.
    """
    planned = F.col("plan").isNotNull()
    multi = F.col("dataset_count") != 1
    single = ~planned & ~multi
    odd_name = ~F.col("hole_id").rlike(r"^[A-Za-z0-9_-]+$") | F.coalesce("has_identity_file", F.lit(False))
    multi_known = (F.col("distinct_sample_counts") < F.col("dataset_count")) | F.coalesce("membership_failure", F.lit(False))
    on = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    cases = F.array(
        F.col("plan"),
        on(~planned & odd_name, "01"),
        on(single & F.col("virtual_section").contains("tray_local"), "02"),
        on(single & (F.col("interval_aliases") == "identical"), "03"),
        on(single & (F.col("image_logs") == "identical"), "04"),
        on(single & (F.col("virtual_section").contains("nulls") | ((F.col("profile_nulls") > 0) & (F.col("profile_reference") != "invalid"))), "05"),
        on(single & ((F.col("float32_bounds") > 0) | (F.col("profile_float32") == "equal")), "06"),
        on(single & (F.col("resets") == "reviewed"), "07"),
        on(single & (F.col("literal_text_errors") > 0), "08"),
        on(single & (F.col("unknown_axes") > 0), "09"),
        on(single & (F.col("unavailable_profile") == "clean"), "10"),
        on(~planned & multi & multi_known, "11"),
    )
    unresolved = F.array(
        on(~planned & multi & ~multi_known, "source membership needs a diagnosis"),
        on(single & F.col("virtual_section").contains("other"), "unrecognised section numbering"),
        on(single & (F.col("profile_reference") == "invalid"), "invalid profile reference"),
        on(single & (F.col("interval_aliases") == "different"), "interval logs of one name differ"),
        on(single & (F.col("image_logs") == "different"), "thumbnail logs differ"),
        on(single & (F.col("wide_bounds") > 0), "image bounds differ"),
        on(single & (F.col("resets") == "other"), "unreviewed depth reset"),
        on(single & (F.col("unavailable_profile") == "contradicting"), "contradicting profile evidence"),
        on(single & (F.col("profile_float32") == "different"), "profile reference differs at float32"),
    )
    return e.withColumns(
        {"cases": F.array_sort(F.array_distinct(F.array_compact(cases))), "unresolved": F.array_compact(unresolved)}
    )


def assign_case(found: DataFrame) -> DataFrame:
    """Status and primary case: held back while anything is unexplained.

    Reads message, unexplained_payload_errors and applied_cases besides ``cases`` and ``unresolved``.
    """
    cases, message = F.col("cases"), F.coalesce("message", F.lit(""))
    routed_input = F.arrays_overlap(cases, F.array(F.lit("12"), F.lit("13")))
    blocked = F.lit(False)
    for text in UNFIXABLE:
        blocked = blocked | message.contains(text)
    blocked = blocked | (~routed_input & message.contains("Missing source membership evidence"))
    repeated = F.when(
        F.size(F.coalesce("applied_cases", F.array().cast("array<string>"))) > 0, F.size(F.array_except(cases, F.col("applied_cases"))) == 0
    ).otherwise(F.lit(False))
    more = F.array(
        F.when(F.coalesce("unexplained_payload_errors", F.lit(0)) > 0, "unresolved payload failure"),
        F.when(blocked, "environment or missing evidence"),
        F.when(F.size(cases) == 0, "no supported rule explains this failure"),
        F.when(repeated, "the same rules already failed"),
    )
    result = found.withColumn("unresolved", F.concat("unresolved", F.array_compact(more)))
    rest = F.filter(cases, lambda c: c != "01")
    primary = F.lit(None).cast("string")
    for code in reversed(FIRST_CASES):
        primary = F.when(F.array_contains(cases, code), F.lit(code)).otherwise(primary)
    primary = F.coalesce(primary, F.get(rest, F.lit(0)), F.lit("01"))
    held = F.size("unresolved") > 0
    return result.withColumns(
        {"status": F.when(held, "needs_review").otherwise("routed"), "assigned_case": F.when(~held, primary)}
    )


def core_datasets(datasets: DataFrame) -> DataFrame:
    """Datasets of holes that hold cuttings, with ``kept`` and ``problem``.

    Cuttings are told by name; of the others at most one may remain and it must
    be named as the hole.
    """
    named = datasets.withColumn("_cut", F.coalesce(F.col("dataset_name").rlike(CUTTINGS), F.lit(False)))
    per_hole = named.groupBy("hole_id").agg(
        F.count_if("_cut").alias("_cuttings"),
        F.count_if(~F.col("_cut")).alias("_rest"),
        F.bool_and(F.col("_cut") | (F.lower("dataset_name") == F.lower(decode_path_name("hole_id")))).alias("_own"),
    )
    joined = named.join(per_hole.where("_cuttings > 0"), "hole_id")
    problem = F.when((F.col("_rest") > 1) | ~F.coalesce(F.col("_own"), F.lit(False)), "the remaining datasets need review")
    return joined.select("hole_id", "dataset_id", "dataset_name", (~F.col("_cut")).alias("kept"), problem.alias("problem"))


def split_holes(datasets: DataFrame, reviewed: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """One hole per dataset for reviewed same-name holes, with its own coordinates.

    ``reviewed``: hole_id, dataset_id, project, label and optional override_x, override_y.
    Attributes shared by the old hole are left null; ``problem`` names what does not fit.
    """
    plan = reviewed.select("hole_id", "dataset_id", F.col("project").alias("_project"), "label", "override_x", "override_y")
    affected = datasets.join(reviewed.select("hole_id").distinct(), "hole_id", "left_semi")
    joined = affected.join(plan, ["hole_id", "dataset_id"], "full")
    x = F.coalesce("override_x", F.col("longitude").try_cast("double"))
    y = F.coalesce("override_y", F.col("latitude").try_cast("double"))
    far = lambda a, b: F.abs(F.col(a).try_cast("double") - b) > tolerance
    problem = (
        F.when(F.col("label").isNull() | F.col("dataset_name").isNull(), "membership changed")
        .when(~F.coalesce("project", F.lit("")).eqNullSafe(F.coalesce("_project", F.lit(""))), "project differs")
        .when(x.isNull() | y.isNull() | ~x.between(-180, 180) | ~y.between(-90, 90), "coordinates missing or invalid")
        .when(F.coalesce(far("longitude", x), F.lit(False)) | F.coalesce(far("latitude", y), F.lit(False)), "override inconsistent with the site")
    )
    return joined.select(
        "hole_id", "dataset_id", file_name(F.concat_ws("-", decode_path_name("hole_id"), "label")).alias("split_hole"),
        F.nullif(F.col("project"), F.lit("")).alias("project"), x.alias("x"), y.alias("y"), problem.alias("problem"),
    )


def own_datasets(datasets: DataFrame, holes: DataFrame, km: float = fixed.SAME_HOLE_KM) -> DataFrame:
    """Datasets that are the hole's own.

    Those named after the hole and those within ``km`` of a named one's collar;
    without a named one the only dataset, else those near the hole's collar.
    Collars are compared within grid cells of their hole, never all with all.
    """
    named = datasets.where(F.col("dataset_name") == F.col("hole_id"))
    sizes = datasets.groupBy("hole_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("dataset_name") == F.col("hole_id")).alias("_named")
    )
    anchor = lambda df: df.select("hole_id", F.col("latitude").alias("at_lat"), F.col("longitude").alias("at_lon")).where("at_lat is not null")
    anchors, fallback = anchor(named).distinct(), anchor(holes)
    fallback = fallback.join(sizes.where("_named = 0").select("hole_id"), "hole_id", "left_semi")
    collars = datasets.select("hole_id", "dataset_id", "latitude", "longitude").where("latitude is not null and longitude is not null")
    found = within_radius(anchors.unionByName(fallback), collars, km, radius=fixed.EARTH_RADIUS_KM_ROUND, key=["hole_id"])
    near = found.select("hole_id", "dataset_id").distinct()
    joined = datasets.join(sizes, "hole_id").join(near.withColumn("_near", F.lit(True)), ["hole_id", "dataset_id"], "left")
    only = (F.col("_named") == 0) & (F.col("_n") == 1)
    own = (F.col("dataset_name") == F.col("hole_id")) | only | F.coalesce("_near", F.lit(False))
    return joined.where(own).select(*datasets.columns)


def choose_dataset(datasets: DataFrame, collars: DataFrame, km: float = fixed.SAME_HOLE_KM) -> DataFrame:
    """Datasets ranked per hole (``choice`` 1 is taken): at the collar, then of unknown place, then nearest
    elsewhere; among equals the longest depth range, then source order."""
    joined = datasets.join(collars.select("hole_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")), "hole_id", "left")
    gap = great_circle_km("latitude", "longitude", "_lat", "_lon", fixed.EARTH_RADIUS_KM_ROUND)
    place = F.when(gap.isNull(), 1).when(gap <= km, 0).otherwise(2)
    keyed = joined.withColumns(
        {
            "_place": place,
            "_far": F.when(place == 2, gap).otherwise(F.lit(0.0)),
            "_span": -F.coalesce(F.col("depth_to_m") - F.col("depth_from_m"), F.lit(0.0)),
        }
    )
    ranked = ordered_scan(keyed, ["hole_id"], ["_place", "_far", "_span", "position"], {"choice": number()})
    words = F.element_at(F.array(F.lit("at collar"), F.lit("unknown"), F.lit("elsewhere")), F.col("_place") + 1)
    return ranked.withColumn("place", words).select(*datasets.columns, "place", "choice")


def isolate(holes: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passing holes, status per hole): one bad hole is recorded, the rest proceed.

    ``violations``: hole_id, rule, detail. The status row names the first problem and counts all.
    """
    problems = violations.groupBy("hole_id").agg(
        F.count(F.lit(1)).alias("problems"), F.min(F.struct("rule", "detail")).alias("_first")
    )
    status = holes.join(problems, "hole_id", "left").select(
        "hole_id", F.when(F.col("problems").isNull(), "passed").otherwise("failed").alias("status"),
        F.coalesce("problems", F.lit(0)).alias("problems"), F.concat_ws(": ", "_first.rule", "_first.detail").alias("first_problem"),
    )
    return holes.join(problems, "hole_id", "left_anti"), status


def retry_plan(attempts: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Failed holes to rerun with their combined rules: only where the diagnosis adds a rule.

    ``attempts``: hole_id, attempt, status, cases; ``diagnoses``: hole_id, status, cases.
    """
    last = attempts.groupBy("hole_id").agg(F.max_by(F.struct("status", "cases"), "attempt").alias("_l"))
    open_ = last.where("_l.status = 'failed'").select("hole_id", F.col("_l.cases").alias("_done"))
    joined = open_.join(diagnoses.where("status = 'routed'").select("hole_id", "cases"), "hole_id")
    fresh = F.array_except("cases", F.coalesce("_done", F.array().cast("array<string>")))
    return joined.where(F.size(fresh) > 0).select("hole_id", fresh.alias("new_cases"), F.array_sort(F.array_union("_done", "cases")).alias("cases"))


def eligible(selected: DataFrame, diagnoses: DataFrame, case: str) -> DataFrame:
    """Selected holes that may not be processed under a case, with the reason."""
    counted = selected.groupBy("hole_id").agg(F.count(F.lit(1)).alias("_n"))
    d = diagnoses.groupBy("hole_id").agg(
        F.max_by(F.struct("status", "assigned_case", "failure_status"), "status").alias("_d"), F.count(F.lit(1)).alias("_rows")
    )
    joined = counted.join(d, "hole_id", "left")
    problem = (
        F.when(F.col("_n") > 1, "selected twice")
        .when(F.col("_rows").isNull(), "not diagnosed")
        .when(F.col("_rows") > 1, "diagnosed twice")
        .when(F.col("_d.failure_status") != "failed", "has not failed")
        .when(~F.col("_d.status").eqNullSafe(F.lit("routed")), "not routed")
        .when(~F.col("_d.assigned_case").eqNullSafe(F.lit(case)), "assigned to another case")
    )
    return joined.withColumn("problem", problem).where("problem is not null").select("hole_id", "problem")


def present_outputs(states: DataFrame, outputs: DataFrame, expected: Sequence[str]) -> DataFrame:
    """States of complete holes for which every expected output exists."""
    have = outputs.where(F.col("folder").isin(list(expected))).groupBy("hole_id").agg(F.count_distinct("folder").alias("_n"))
    return states.where("status = 'complete'").join(have.where(F.col("_n") == len(expected)), "hole_id").drop("_n")


def has_any(ids: Sequence[str], column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isin(list(ids))
