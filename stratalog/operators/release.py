"""Versioned publication: release identity, validation, pointer switch, succession and clean-up candidates."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.hashing import canonical, ordered_digest, stable_id
from stratalog.operators.intervals import covering
from stratalog.operators.ordered import lag, lead, number, ordered_scan
from stratalog.operators.relations import conflicts, override_members, set_difference


def release_identity(members: DataFrame, *, prefix: str, metadata: str = "", by: Sequence[str] = ()) -> DataFrame:
    """Release id and manifest digest from the members sorted by dataset, and further metadata."""
    placed = ordered_scan(members.select(*by, "dataset_id", "dataset_revision_id"), by, ["dataset_id"], {"_no": number()})
    placed = placed.withColumn("_no", F.col("_no") - 1)
    digests = ordered_digest(placed, by, "_no", ["dataset_id", "dataset_revision_id"])
    whole = F.sha2(F.concat_ws("|", F.col("digest"), F.lit(metadata)), 256)
    return digests.select(*by, "n", whole.alias("manifest_sha256")).withColumn("release_id", stable_id(prefix, "manifest_sha256"))


def unvalidated(members: DataFrame, validations: DataFrame) -> DataFrame:
    """Members without a passed validation of exactly their content."""
    v = validations.select("dataset_revision_id", F.col("input_digest").alias("_d"), F.col("status").alias("_s"))
    joined = members.join(v, "dataset_revision_id", "left")
    problem = (
        F.when(F.col("_s").isNull(), "not validated").when(F.col("_s") != "passed", "validation failed").when(~F.col("_d").eqNullSafe(F.col("input_digest")), "content changed since validation")
    )
    return joined.withColumn("problem", problem).where("problem is not null").select("dataset_id", "dataset_revision_id", "problem")


def unready(members: DataFrame, validations: DataFrame, assets: DataFrame, locations: DataFrame) -> DataFrame:
    """Members that are not validated or have an asset without a verified copy."""
    verified = locations.where("access_status = 'verified_remote'").select("asset_id", F.col("verified_sha256").alias("sha256"))
    missing = assets.join(verified, ["asset_id", "sha256"], "left_anti").select("dataset_revision_id").distinct()
    stuck = members.join(missing, "dataset_revision_id", "left_semi")
    return unvalidated(members, validations).unionByName(stuck.select("dataset_id", "dataset_revision_id", F.lit("asset not located").alias("problem")))


POINTER = "release_id string, previous string, seq long, writer string"


def active_release(spark: SparkSession, root: str) -> DataFrame:
    """The current pointer row (none before the first publication)."""
    try:
        pointers = spark.read.schema(POINTER).json(f"{root}/pointer/seq_*.json")
    except Exception as error:  # no pointer has been written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], POINTER)
    return pointers.orderBy(F.desc("seq")).limit(1)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` with ``text``, whole or not at all; False if it is there already.

    The text is written beside it and then given its name in one step that does not
    replace: a hard link on a local disk, a rename elsewhere, which HDFS refuses where
    the name is taken. A store without such a rename needs one that has (or a lock).
    """
    jvm = spark.sparkContext._jvm
    final = jvm.org.apache.hadoop.fs.Path(path)
    store = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(final.getParent())
    if store.getUri().getScheme() == "file":
        place = final.toUri().getPath()
        beside = f"{os.path.dirname(place)}/.{uuid.uuid4().hex}"
        with open(beside, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(beside, place)
        except FileExistsError:
            return False
        finally:
            os.unlink(beside)
        return True
    beside = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
    stream = store.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if store.rename(beside, final):
        return True
    store.delete(beside, False)
    return False


def publish(spark: SparkSession, root: str, members: DataFrame, validations: DataFrame, release_id: str, expected_previous: str | None) -> bool:
    """Write an immutable release and switch the pointer to it; False if it is active already.

    The pointer is a numbered object that is created once and whole, so of writers that
    saw the same predecessor exactly one wins and the others raise. The release itself is
    complete before the pointer is touched, and the pointer is read back after it.
    """
    problems = unvalidated(members, validations)
    if not problems.isEmpty():
        raise ValueError("release has members without a passed validation")
    if members.isEmpty():
        raise ValueError("a release needs members")
    current = active_release(spark, root).first()
    active = current["release_id"] if current else None
    if active == release_id:
        return False
    if active != expected_previous:
        raise ValueError("the active release has changed")
    path = f"{root}/members/release_id={release_id}"
    try:
        members.write.mode("errorifexists").parquet(path)
    except Exception as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
        stored = spark.read.parquet(path)
        if not set_difference(stored, members, ["dataset_id", "dataset_revision_id"]).isEmpty():
            raise ValueError("a release of this id with other members exists") from error
    seq = (current["seq"] if current else 0) + 1
    writer = uuid.uuid4().hex
    pointer = json.dumps({"release_id": release_id, "previous": active, "seq": seq, "writer": writer})
    if not create_once(spark, f"{root}/pointer/seq_{seq:09d}.json", pointer):
        raise ValueError("the active release has changed")
    written = spark.read.schema(POINTER).json(f"{root}/pointer/seq_{seq:09d}.json").first()
    if written is None or written["writer"] != writer:
        raise ValueError("the pointer is not the one that was written")
    return True


def release_members(spark: SparkSession, root: str) -> DataFrame:
    """Members of the active release; the pointer value prunes the scan to one partition."""
    current = active_release(spark, root).first()
    if current is None:
        raise ValueError("nothing has been published")
    return spark.read.option("basePath", f"{root}/members").parquet(f"{root}/members/release_id={current['release_id']}")


def plan_load(existing: DataFrame, incoming: DataFrame, *, ident: str = "dataset_revision_id", digest: str = "input_digest") -> DataFrame:
    """Per incoming revision: load, skip (same content is there) or conflict."""
    known = existing.select(ident, F.col(digest).alias("_d"))
    joined = incoming.select(ident, digest).join(known, ident, "left")
    action = F.when(F.col("_d").isNull(), "load").when(F.col("_d") == F.col(digest), "skip").otherwise("conflict")
    return joined.select(ident, action.alias("action"))


def reusable(prepared: DataFrame, current: DataFrame, *, hole: str = "hole_id") -> DataFrame:
    """Holes whose prepared outputs still match all current hashes; ``changed`` counts the others."""
    both = prepared.select(hole, "path", F.col("sha256").alias("_p")).join(current.select(hole, "path", F.col("sha256").alias("_c")), [hole, "path"], "full")
    stats = both.groupBy(hole).agg(F.count_if(~F.col("_p").eqNullSafe(F.col("_c"))).alias("changed"))
    return stats.withColumn("reusable", F.col("changed") == 0)


def insert_missing(target: DataFrame, incoming: DataFrame, *, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): nothing may be appended while there are conflicts."""
    columns = [c for c in incoming.columns if c not in key]
    clash = conflicts(target, incoming, key=key, columns=columns)
    return incoming.join(target.select(*key), list(key), "left_anti"), clash


def accumulate(base: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    return override_members(base, incoming, member="dataset_id", revision="dataset_revision_id")


def carry_segments(members: DataFrame, segments: DataFrame, axes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments of the new release, holes without any).

    A hole keeps the latest accepted segments whose revisions are exactly its
    members; a hole with one member and no such segments shows its full range.

    ``members``: borehole_id, dataset_id, dataset_revision_id; ``segments``: source_no (later wins),
    borehole_id, sequence_no and part columns; ``axes``: dataset_revision_id, axis_id, sample_count, depth range.
    """
    signature = lambda df, by: df.groupBy(*by).agg(
        F.count_distinct("dataset_revision_id").alias("_n"),
        # engine-side set signature: equal sets give equal sums whatever their order
        F.sum(F.conv(F.substring(F.md5("dataset_revision_id"), 1, 12), 16, 10).cast("decimal(20,0)")).alias("_s"),
    )
    distinct_members = members.select("borehole_id", "dataset_revision_id").distinct()
    wanted = signature(distinct_members, ["borehole_id"])
    offered = signature(segments.select("source_no", "borehole_id", "dataset_revision_id").distinct(), ["source_no", "borehole_id"])
    candidates = offered.join(wanted, ["borehole_id", "_n", "_s"]).select("source_no", "borehole_id")
    # the signature only narrows: every part of a candidate must be a member
    strangers = segments.join(candidates, ["source_no", "borehole_id"], "left_semi").join(
        distinct_members, ["borehole_id", "dataset_revision_id"], "left_anti"
    ).select("source_no", "borehole_id").distinct()
    match = candidates.join(strangers, ["source_no", "borehole_id"], "left_anti").groupBy("borehole_id").agg(F.max("source_no").alias("source_no"))
    kept = segments.join(match, ["borehole_id", "source_no"], "left_semi")
    rest = wanted.join(match, "borehole_id", "left_anti")
    lone = members.join(rest.where("_n = 1"), "borehole_id").join(axes, "dataset_revision_id")
    default = lone.select(
        F.lit(None).cast("int").alias("source_no"), "borehole_id", F.lit(0).alias("sequence_no"), "dataset_id", "dataset_revision_id", "axis_id",
        F.col("depth_min_m").alias("selection_from_md_m"), F.col("depth_max_m").alias("selection_to_md_m"), F.lit(True).alias("upper_inclusive"),
        F.lit(0).cast("long").alias("sample_no_from"), (F.col("sample_count") - 1).alias("sample_no_to"), F.lit("selected").alias("selection_status"),
    )
    return kept.select(*default.columns).unionByName(default), rest.where("_n > 1").select("borehole_id")


def revision_identity(rows: DataFrame, *, prefix: str, by: Sequence[str], position: str, columns: Sequence[str]) -> DataFrame:
    """Content digest and deterministic id per dataset over projected rows."""
    digests = ordered_digest(rows, by, position, columns)
    return digests.withColumn("revision_id", stable_id(prefix, *by, "digest"))


def final_selection(known: DataFrame, chosen: DataFrame, omitted: DataFrame) -> DataFrame:
    """Disagreements of an explicit final selection: unknown choices, members neither chosen nor listed as omitted, idle omissions."""
    side = lambda df, c: df.select("dataset_id").distinct().withColumn(c, F.lit(True))
    joined = side(known, "k").join(side(chosen, "c"), "dataset_id", "full").join(side(omitted, "o"), "dataset_id", "full")
    k, c, o = (F.coalesce(x, F.lit(False)) for x in ("k", "c", "o"))
    problem = (
        F.when(c & ~k, "unknown dataset").when(k & ~c & ~o, "left out without saying so").when(o & ~(k & ~c), "listed as omitted but not omitted")
    )
    repeated = chosen.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dataset_id", F.lit("chosen twice").alias("problem"))
    return joined.withColumn("problem", problem).where("problem is not null").select("dataset_id", "problem").unionByName(repeated)


def batch_scope(release: DataFrame, batch: DataFrame) -> DataFrame:
    """Datasets by which a batch differs from all datasets of its holes in the release."""
    own = release.join(batch.select("hole_id").distinct(), "hole_id", "left_semi")
    return set_difference(own, batch, ["hole_id", "dataset_id"], "missing from batch", "not in release")


def collapse_assets(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per content, contents that disagree on size or media type)."""
    folded = assets.groupBy("sha256").agg(
        F.min("asset_id").alias("asset_id"), F.count(F.lit(1)).alias("copies"), F.min("byte_size").alias("byte_size"), F.max("byte_size").alias("_b"),
        F.min("media_type").alias("media_type"), F.max("media_type").alias("_m"),
    )
    clash = (F.col("byte_size") != F.col("_b")) | (F.col("media_type") != F.col("_m"))
    return folded.where(~clash).drop("_b", "_m"), folded.where(clash).select("sha256", "copies")


def acceptance_problems(wanted: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Two acceptance stages: each covers every dataset once with the same digest and has passed.

    All three: dataset_id, input_digest; the stages also status, and the first report_id.
    """
    twice = first.groupBy("dataset_id").agg(F.count_distinct("report_id").alias("n")).where("n > 1").select("dataset_id", F.lit("in two first-stage reports").alias("problem"))
    found = [twice]
    for stage, name in ((first, "first stage"), (second, "second stage")):
        s = stage.select("dataset_id", F.col("input_digest").alias("_d"), F.col("status").alias("_s"))
        joined = wanted.select("dataset_id", "input_digest").join(s, "dataset_id", "full")
        problem = (
            F.when(F.col("_s").isNull(), f"not in {name}").when(F.col("input_digest").isNull(), f"only in {name}")
            .when(F.col("_d") != F.col("input_digest"), f"content differs in {name}").when(F.col("_s") != "passed", f"failed in {name}")
        )
        found.append(joined.withColumn("problem", problem).where("problem is not null").select("dataset_id", "problem"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def display_identity(parts: DataFrame, *, hole: str = "borehole_id", volatile: Sequence[str] = ("release_id", "composite_id", "predecessor_relation_id", "source_no")) -> DataFrame:
    """Digest of each hole's display definition without ids that change from release to release."""
    columns = sorted(c for c in parts.columns if c not in volatile)
    return ordered_digest(parts, [hole], "sequence_no", columns)


def removable_assets(assets: DataFrame, references: DataFrame, batches: DataFrame, *, include_raw: bool = False) -> DataFrame:
    """Kind of each file from its asset roles, and why it is kept; null ``kept_because`` means removable.

    ``assets``: object_key, role; ``references``: object_key, batch_id; ``batches``: batch_id, complete.
    """
    has = lambda role: F.bool_or(F.col("role") == role)
    kinds = assets.groupBy("object_key").agg(has("evidence").alias("_e"), has("raw").alias("_r"), F.bool_and(F.col("role") == "canonical").alias("_c"))
    kind = F.when(F.col("_e"), "evidence").when(F.col("_r"), "raw").when(F.col("_c"), "canonical").otherwise("unknown")
    open_batches = references.join(batches.where("not complete").select("batch_id"), "batch_id", "left_semi")
    used = open_batches.select("object_key").distinct().withColumn("_used", F.lit(True))
    joined = kinds.select("object_key", kind.alias("kind")).join(used, "object_key", "left")
    reason = (
        F.when(F.col("_used"), "referenced by an incomplete batch")
        .when(F.col("kind").isin("evidence", "unknown"), "evidence or unknown kind")
        .when((F.col("kind") == "raw") & F.lit(not include_raw), "raw source")
    )
    return joined.select("object_key", "kind", reason.alias("kept_because"))


def succession(axes: DataFrame, *, hole: Sequence[str], order: Sequence[str], lo: str = "depth_min_m", hi: str = "depth_max_m") -> DataFrame:
    """Depth window of each dataset: cut at the first depth of its successor.

    The upper bound belongs to the window when the dataset ends before the cut.
    """
    scanned = ordered_scan(axes, hole, order, {"sequence_no": number(), "_cut": lead(lo), "_before": lag(lo)})
    cut = F.col("_cut")
    return scanned.withColumns(
        {
            "sequence_no": F.col("sequence_no") - 1,
            "selection_from_md_m": F.col(lo),
            "selection_to_md_m": F.least(F.col(hi), cut),
            "upper_inclusive": F.coalesce(F.col(hi) < cut, F.lit(True)),
            "order_broken": F.coalesce(F.col("_before") > F.col(lo), F.lit(False)),
        }
    ).drop("_cut", "_before")


def window_samples(parts: DataFrame, samples: DataFrame, *, axis: str = "axis_id", depth: str = "md_m", key: Sequence[str] = ("composite_id", "sequence_no")) -> DataFrame:
    """Count and first and last sample number inside each part's depth window."""
    p = parts.select(*key, axis, F.col("selection_from_md_m").alias("_f"), F.col("selection_to_md_m").alias("_t"), "upper_inclusive")
    found = covering(samples.select(axis, "sample_no", depth), p, key=[axis], at=depth, lo="_f", hi="_t")
    inside = found.where((F.col(depth) < F.col("_t")) | F.col("upper_inclusive"))
    stats = inside.groupBy(*key).agg(F.min("sample_no").alias("first_sample"), F.max("sample_no").alias("last_sample"), F.count(F.lit(1)).alias("n"))
    return parts.select(*key).join(stats, list(key), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def selected_parts(parts: DataFrame, samples: DataFrame, **names) -> DataFrame:
    """Parts with their sample range; fully superseded where no sample is left."""
    key = list(names.get("key", ("composite_id", "sequence_no")))
    stats = window_samples(parts, samples, **names)
    joined = parts.join(stats, key)
    return joined.select(
        *parts.columns, F.col("first_sample").alias("sample_no_from"), F.col("last_sample").alias("sample_no_to"),
        F.when(F.col("n") > 0, "selected").otherwise("fully_superseded").alias("selection_status"),
    )


def composite_samples(parts: DataFrame, samples: DataFrame, *, axis: str = "axis_id") -> DataFrame:
    """Samples shown by the selected parts of each composite."""
    p = parts.where("selection_status = 'selected'").select(
        "composite_id", "sequence_no", "dataset_revision_id", axis, F.col("sample_no_from").alias("_f"), F.col("sample_no_to").alias("_t")
    )
    return covering(samples, p, key=[axis], at="sample_no", lo="_f", hi="_t").drop("_f", "_t")


def row_digest(*columns: str | Column) -> Column:
    return F.sha2(canonical(*columns), 256)
