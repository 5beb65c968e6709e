"""Joins between catalogues: reconciliation, lookups with fallback, membership, conflicts and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.arrays import explode_present
from stratalog.functions.geo import great_circle_km
from stratalog.functions.text import fold_name
from stratalog.session import settle_table


def release_catalogue(active: DataFrame, members: DataFrame, revisions: DataFrame, boreholes: DataFrame, collars: DataFrame, axes: DataFrame) -> DataFrame:
    """Holes of the active release; more than one active release is an error."""
    two = active.select("release_id").distinct().limit(2).collect()
    if len(two) > 1:
        raise ValueError("two releases are active: " + ", ".join(sorted(str(r["release_id"]) for r in two)))
    current = members.where(F.col("release_id").isin([r["release_id"] for r in two])) if two else members.where(F.lit(False))
    joined = (
        current.join(revisions, "dataset_revision_id")
        .join(boreholes, "borehole_id")
        .join(collars, "borehole_revision_id")
        .join(axes, "dataset_revision_id")
    )
    return joined.select(
        "hole_id", "dataset_revision_id", "axis_id",
        F.coalesce("project_name", "source_project_name", F.lit("")).alias("project"),
        "latitude", "longitude",
        F.col("depth_min_m").alias("scan_from_m"), F.col("depth_max_m").alias("scan_to_m"),
        F.coalesce("instrument_name", F.lit("")).alias("instrument"),
    )


def log_catalogue(logs: DataFrame, bindings: DataFrame, interpretations: DataFrame, streams: DataFrame, metrics: DataFrame) -> DataFrame:
    """Logs with binding, interpretation, spectral region and metric facts; every log stays."""
    return (
        logs.join(bindings.select("log_id", "axis_id", F.col("status").alias("binding_status")), "log_id", "left")
        .join(interpretations, "interpretation_set_id", "left")
        .join(streams.select("spectral_stream_id", F.col("region_code").alias("spectral_region")), "spectral_stream_id", "left")
        .join(metrics.select("dataset_revision_id", "metric_key", "is_probability"), ["dataset_revision_id", "metric_key"], "left")
    )


def reconcile(manifest: DataFrame, listing: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Manifest entries (status, nbytes) against listed files (size): one finding per disagreement.

    Duplicated manifest paths are folded before the join.
    """
    entries = manifest.groupBy(*key).agg(
        F.count_if(F.col("status") == "complete").alias("_complete"),
        F.max(F.when(F.col("status") == "complete", F.col("nbytes"))).alias("_nbytes"),
        F.count_if(F.col("status").isin("unavailable", "metadata_only")).alias("_absent"),
        F.count_if(~F.coalesce(F.col("status").isin("complete", "unavailable", "metadata_only"), F.lit(False))).alias("_incomplete"),
    )
    files = listing.select(*key, F.col("size").alias("_size"))
    both = entries.join(files, list(key), "full")
    provided = F.coalesce(F.col("_complete"), F.lit(0)) > 0
    there = F.col("_size").isNotNull()
    path = F.col(key[-1])
    findings = F.array(
        F.when(provided & ~there, "missing"),
        F.when(F.col("_complete") > 1, "listed more than once"),
        F.when(provided & (F.col("_size") == 0), "empty file"),
        F.when(provided & (F.col("_size") > 0) & ~F.col("_size").eqNullSafe(F.col("_nbytes")), "size differs"),
        F.when(~provided & (F.coalesce("_absent", F.lit(0)) > 0) & there, "marked absent but present"),
        F.when(F.coalesce("_incomplete", F.lit(0)) > 0, "incomplete record"),
        F.when(~provided & (F.coalesce("_absent", F.lit(0)) == 0) & there, F.when(path.endswith(".part"), "partial download").otherwise("unlisted file")),
    )
    return explode_present(both, findings, "finding").select(*key, "finding")


def resolve_places(holes: DataFrame, collars: DataFrame) -> DataFrame:
    """Hole geometry from the hole table, gaps filled from collars by folded name, then by folded id.

    ``filled`` lists what came from elsewhere; a missing dip means vertical.
    """
    fields = ["lon", "lat", "elevation", "total"]
    base = holes.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("hole_id")))
    keyed = collars.withColumn("_key", fold_name("name")).where("_key <> ''")
    firsts = keyed.groupBy("_key").agg(F.min_by(F.struct(*fields, "dip", "azimuth"), F.col("position")).alias("_c"))
    by_name = firsts.select(F.col("_key").alias("_nk"), F.col("_c").alias("_cn"))
    by_id = firsts.select(F.col("_key").alias("_ik"), F.col("_c").alias("_ci"))
    joined = base.join(by_name, fold_name("name") == F.col("_nk"), "left").join(by_id, fold_name("hole_id") == F.col("_ik"), "left")
    joined = joined.withColumn("_c", F.coalesce("_cn", "_ci"))
    taken = [F.when(F.col(f).isNull() & F.col(f"_c.{f}").isNotNull(), F.lit(f)) for f in fields]
    vertical = F.when(F.col("_c.dip").isNull(), F.lit("dip=vertical"))
    return joined.select(
        "hole_id", "name",
        *[F.coalesce(F.col(f), F.col(f"_c.{f}")).alias(f) for f in fields],
        F.coalesce("_c.dip", F.lit(-90.0)).alias("dip"),
        F.coalesce("_c.azimuth", F.lit(0.0)).alias("azimuth"),
        F.array_compact(F.array(*taken, vertical)).alias("filled"),
    )


def with_fallback(df: DataFrame, first: DataFrame, second: DataFrame, *, on: Sequence[str], columns: Sequence[str], whole: Sequence[str] = ()) -> DataFrame:
    """Columns looked up in ``first``; in ``second`` where ``first`` has nothing for the row.

    With ``whole`` the fallback applies only to groups for which ``first`` has no row at all.
    """
    a = first.select(*on, F.struct(*columns).alias("_a"))
    b = second.select(*on, F.struct(*columns).alias("_b"))
    joined = df.join(a, list(on), "left").join(b, list(on), "left")
    if whole:
        known = first.select(*whole).distinct().withColumn("_known", F.lit(True))
        joined = joined.join(known, list(whole), "left")
        chosen = F.when(F.col("_known"), F.col("_a")).otherwise(F.col("_b"))
    else:
        chosen = F.coalesce("_a", "_b")
    return joined.withColumn("_x", chosen).select(*df.columns, *[F.col(f"_x.{c}").alias(c) for c in columns])


def membership(local: DataFrame, official: DataFrame, *, log: str = "log_id", dataset: str = "dataset_id", kind: str = "kind") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assigned, only_official, shared): local logs with their dataset, official logs not held, logs claimed twice."""
    assigned = official.join(local.select(kind, log), [kind, log])
    extra = official.join(local.select(kind, log), [kind, log], "left_anti")
    twice = assigned.groupBy(kind, log).agg(F.count_distinct(dataset).alias("datasets")).where("datasets > 1")
    return assigned, extra, twice


def unassigned(local: DataFrame, official: DataFrame, *, log: str = "log_id", kind: str = "kind") -> DataFrame:
    return local.join(official.select(kind, log), [kind, log], "left_anti")


def match_profiles(minima: DataFrame, references: DataFrame, *, hole: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """Profiles matched to datasets by all their values.

    ``minima``: hole, profile_id, sample_no, positive_min; ``references``: hole,
    dataset_id, log_id, sample_no, value. A pair matches when both have the same
    length and every sample agrees; a dataset counts when exactly one profile
    matches all its references.
    """
    # logs first: two logs can only agree everywhere if their lengths are equal and their sums are close
    facts = lambda df, ident, value: df.groupBy(*hole, *ident).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("_t"))
    reach = F.col("n") * tolerance * 1.01 + 1e-6
    place = F.floor(F.col("_t") / reach)
    left = facts(minima, ["profile_id"], "positive_min").withColumn("_b", place)
    right = facts(references, ["dataset_id", "log_id"], "value").withColumn("_b", F.explode(F.sequence(place - 1, place + 1)))
    right = right.withColumnRenamed("_t", "_u")
    candidates = left.join(right, [*hole, "n", "_b"]).where(F.abs(F.col("_t") - F.col("_u")) <= reach)
    candidates = candidates.select(*hole, "n", "profile_id", "dataset_id", "log_id")
    pairs = candidates.join(minima, [*hole, "profile_id"]).join(references, [*hole, "dataset_id", "log_id", "sample_no"])
    close = F.abs(F.col("positive_min") - F.col("value")) <= tolerance
    agreed = pairs.groupBy(*hole, "n", "profile_id", "dataset_id", "log_id").agg(F.count_if(close).alias("matched"))
    per_dataset = agreed.groupBy(*hole, "profile_id", "dataset_id").agg(
        F.bool_and(F.col("matched") == F.col("n")).alias("_all"), F.count(F.lit(1)).alias("_logs")
    )
    wanted = references.groupBy(*hole, "dataset_id").agg(F.count_distinct("log_id").alias("_wanted"))
    full = per_dataset.join(wanted, [*hole, "dataset_id"]).where("_all and _logs = _wanted")
    found = full.groupBy(*hole, "dataset_id").agg(F.count(F.lit(1)).alias("matches"), F.min("profile_id").alias("profile_id"))
    return wanted.select(*hole, "dataset_id").join(found, [*hole, "dataset_id"], "left").select(
        *hole, "dataset_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("profile_id")).alias("profile_id")
    )


def unique_by_count(logs: DataFrame, datasets: DataFrame, *, hole: Sequence[str]) -> DataFrame:
    """Log of each dataset with the dataset's sample count, when the count is unique on both sides."""
    d = datasets.groupBy(*hole, "sample_count").agg(F.count(F.lit(1)).alias("_d"), F.min("dataset_id").alias("dataset_id"))
    g = logs.groupBy(*hole, "sample_count").agg(F.count(F.lit(1)).alias("_l"), F.min("log_id").alias("log_id"))
    return d.where("_d = 1").join(g.where("_l = 1"), [*hole, "sample_count"]).select(*hole, "dataset_id", "log_id", "sample_count")


def payload_files(logs: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """File of each log: the manifest's entry, else the only finished file whose name starts with the log id."""
    listed = manifest.where("file is not null").groupBy("log_id").agg(F.min("file").alias("_listed"))
    present = files.select(F.col("path").alias("_listed")).distinct()
    named = files.where(~F.col("path").rlike(r"\.(part|tmp)$"))
    named = named.select(F.col("path"), F.substring_index(F.element_at(F.split("path", "/"), -1), "_", 1).alias("log_id"))
    lone = named.groupBy("log_id").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_only")).where("_n = 1").drop("_n")
    joined = logs.join(listed.join(present, "_listed"), "log_id", "left").join(lone, "log_id", "left")
    return joined.withColumn("path", F.coalesce("_listed", "_only")).drop("_listed", "_only")


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def project_tables(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], members: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table cut to the rows of one dataset: (table, key columns) by name, and the members by key columns joined with a comma.

    A table whose key has no members is kept empty; every table keeps all its columns.
    """
    kept = {}
    for name, (df, on) in tables.items():
        keys = members.get(",".join(on))
        kept[name] = df.where(F.lit(False)) if keys is None else semi(df, keys, on)
    return kept


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def table_difference(a: DataFrame, b: DataFrame, *, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that are missing on one side or differ in any column, null-safe; key columns and ``difference``."""
    left = a.select(*key, F.struct(*columns).alias("_l"))
    right = b.select(*key, F.struct(*columns).alias("_r"))
    both = left.join(right, list(key), "full")
    what = (
        F.when(F.col("_r").isNull(), "only left")
        .when(F.col("_l").isNull(), "only right")
        .when(~F.col("_l").eqNullSafe(F.col("_r")), "differs")
    )
    return both.withColumn("difference", what).where("difference is not null").select(*key, "difference")


def conflicts(target: DataFrame, incoming: DataFrame, *, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys on both sides with different content."""
    return table_difference(target, incoming, key=key, columns=columns).where("difference = 'differs'").select(*key)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with their surplus in ``a`` (positive) or ``b`` (negative); empty means equal as multisets.

    One grouped pass over both tables with map-side counts, instead of two differences.
    """
    columns = a.columns
    tagged = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    return tagged.groupBy(*columns).agg(F.sum("_s").alias("surplus")).where("surplus <> 0")


def set_difference(a: DataFrame, b: DataFrame, on: Sequence[str], left: str = "missing", right: str = "unlisted") -> DataFrame:
    """Keys only in ``a`` (``left``) and only in ``b`` (``right``)."""
    tagged = a.select(*on, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*on, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sides = tagged.groupBy(*on).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_a <> _b")
    return sides.select(*on, F.when(F.col("_a") == 1, left).otherwise(right).alias("side"))


def override_members(base: DataFrame, incoming: DataFrame, *, member: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """(members, replacements): base members with the incoming ones in their place."""
    kept = base.join(incoming.select(member), member, "left_anti")
    members = kept.select(member, revision).unionByName(incoming.select(member, revision))
    new = incoming.select(member, F.col(revision).alias("incoming_revision"))
    old = base.select(member, F.col(revision).alias("previous_revision"))
    return members, old.join(new, member).where("previous_revision <> incoming_revision")


def parent_chain(nodes: DataFrame, *, ident: str, parent: str) -> DataFrame:
    """Level of every node below its root; null where the chain is broken or cyclic.

    Pointer doubling: every round each node looks twice as far up, so a chain
    of length n takes log2(n) joins, not n, and only open nodes take part in one.
    Nothing is broadcast: the files of a round are small for their rows.
    """
    known = nodes.select(ident, parent)
    exists = nodes.select(F.col(ident).alias(parent), F.lit(True).alias("_known"))
    state = known.join(exists.hint("merge"), parent, "left").select(
        ident,
        F.when(F.col("_known"), F.col(parent)).alias("up"),
        F.when(F.col("_known"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("level"),
        F.when(F.col(parent).isNull(), "root").when(F.col("_known").isNull(), "broken").otherwise("open").alias("end"),
    )
    total = nodes.count()
    reach = 1
    while True:
        state = settle_table(state, "chain")
        if state.where("end = 'open'").isEmpty() or reach > 2 * total:
            break
        step = state.select(F.col(ident).alias("up"), F.col("up").alias("_up"), F.col("level").alias("_lv"), F.col("end").alias("_end"))
        moved = state.where("end = 'open'").join(step.hint("merge"), "up", "left").select(
            ident, F.col("_up").alias("up"), (F.col("level") + F.col("_lv")).alias("level"), F.col("_end").alias("end")
        )
        state = state.where("end <> 'open'").select(ident, F.lit(None).cast(state.schema["up"].dataType).alias("up"), "level", "end").unionByName(moved)
        reach *= 2
    return state.select(ident, F.when(F.col("end") == "root", F.col("level")).alias("level"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, absent columns as null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def hole_distance(holes: DataFrame, a, b, *, hole: str = "hole_id") -> DataFrame:
    """One row with the distance of two named holes; no row if one is unknown."""
    pick = lambda value, c: F.max(F.when(F.col(hole) == value, F.col(c)))
    pair = holes.where(F.col(hole).isin(a, b)).agg(
        pick(a, "latitude").alias("alat"), pick(a, "longitude").alias("alon"),
        pick(b, "latitude").alias("blat"), pick(b, "longitude").alias("blon"),
    )
    known, kind = pair.where("alat is not null and blat is not null"), dict(holes.dtypes)[hole]
    return known.select(F.lit(a).cast(kind).alias("a"), F.lit(b).cast(kind).alias("b"), great_circle_km("alat", "alon", "blat", "blon").alias("distance_km"))


def upsert(current: DataFrame, incoming: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Current rows with incoming ones in place of equal keys."""
    return incoming.unionByName(current.join(incoming.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def remap(df: DataFrame, ids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ids replaced through a map table (old, new); ids without entry stay."""
    small = ids.select("old", "new")
    for c in columns:
        lookup = small.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        df = df.join(lookup, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return df


def factor_shared(records: DataFrame, *, by: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(header, rest): columns that are constant and complete within a group move to one header row of it."""
    flags = {}
    for c in columns:
        flags[f"_u_{c}"] = (F.min(c).eqNullSafe(F.max(c))) & (F.count(c) == F.count(F.lit(1)))
        flags[f"_v_{c}"] = F.min(c)
    stats = records.groupBy(*by).agg(*[v.alias(k) for k, v in flags.items()])
    header = stats.select(*by, *[F.when(F.col(f"_u_{c}"), F.col(f"_v_{c}")).alias(c) for c in columns])
    shared = stats.select(*by, *[f"_u_{c}" for c in columns])
    rest = records.join(shared, list(by)).withColumns({c: F.when(~F.col(f"_u_{c}"), F.col(c)) for c in columns})
    return header, rest.drop(*[f"_u_{c}" for c in columns])


def unfactor_shared(header: DataFrame, rest: DataFrame, *, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Inverse of ``factor_shared``."""
    h = header.select(*by, *[F.col(c).alias(f"_h_{c}") for c in columns])
    return rest.join(h, list(by)).withColumns({c: F.coalesce(f"_h_{c}", c) for c in columns}).drop(*[f"_h_{c}" for c in columns])
