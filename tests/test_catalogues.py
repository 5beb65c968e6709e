"""Alignment, relations, quality rules, routing, publication and geometry on small fixtures, accepted and rejected."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from stratalog.operators import align, geometry, paging, profiles, quality, relations, release, routing


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


# ---------------------------------------------------------------- alignment


@pytest.mark.parametrize("heavy", ["1", "100"])
def test_repeated_depths_stay_separate_samples(spark, heavy):
    spark.conf.set("stratalog.groupRows", heavy)
    axis = table(spark, [(0, 62.5, 62.5), (1, 62.5, 62.5), (2, 63.0, 63.0)], "sample_no long, start double, end double")
    log = table(spark, [(0, 62.5, 62.5, "first"), (1, 63.0, 63.0, "last"), (2, 62.5, 62.5, "second"), (3, 62.5, 62.5, "third"), (4, 99.0, 99.0, "off")], "source_row long, start double, end double, v string")
    aligned, unmatched = align.align_to_axis(log, axis, on=["start", "end"], log_order=["source_row"], axis_order=["sample_no"])
    assert rows(aligned, "sample_no", "v") == [(0, "first"), (1, "second"), (2, "last")]
    assert rows(unmatched, "v") == [("off",), ("third",)]
    spark.conf.unset("stratalog.groupRows")


def test_axis_election(spark):
    d = table(spark, [("h", "l1", 5, "x"), ("h", "l2", 9, "y"), ("h", "l3", 9, "z"), ("h", "l4", 9, "z"), ("g", "a", 3, "p"), ("g", "b", 4, "q"), ("g", "c", 0, "r")], "hole string, log string, n long, digest string")
    assert rows(align.elect_axis(d, hole=["hole"], log="log"), "hole", "n", "log") == [("g", 4, "b"), ("h", 9, "l3")]


def test_collapsed_copies_and_suffixes(spark):
    logs = table(spark, [("h", "A", "SNR", 0, 5), ("h", "B", "snr ", 1, 5), ("h", "A", "other", 2, 5), ("h", "C", "x", 3, 0), ("h", "D", None, 4, 1)], "hole string, content string, name string, position int, filled int")
    found = align.collapse_duplicates(logs, key=["hole"], content="content", name="name", position="position", filled="filled")
    assert rows(found, "content", "column_name", "duplicates") == [("A", "SNR (1)", 1), ("B", "snr (2)", 0), ("D", "Measurement", 0)]


def test_float32_bounds_only_where_allowed(spark):
    trays = table(spark, [("h", 0, 10.0, 16777217.0)], "hole string, ordinal long, depth_from_m double, depth_to_m double")
    images = table(spark, [("h", 0, 10.0, 16777216.0), ("h", 1, 0.0, 1.0)], "hole string, ordinal long, depth_from_m double, depth_to_m double")
    strict = {r.ordinal: r.basis for r in align.image_depth_check(images, trays, key=["hole"]).collect()}
    loose = {r.ordinal: r.basis for r in align.image_depth_check(images, trays, key=["hole"], allow_float32=True).collect()}
    assert strict == {0: "depth bounds differ", 1: "no tray with this ordinal"} and loose[0] == "float32"


def test_minima_and_aliases(spark):
    minima = table(spark, [("h", 0, 1.0), ("h", 1, 2.0), ("g", 0, 1.0)], "hole string, sample_no long, positive_min double")
    reference = table(spark, [("h", 0, 1.00005), ("h", 1, None), ("g", 0, 1.1)], "hole string, sample_no long, value double")
    assert rows(align.minima_check(minima, reference, key=["hole"]), "hole", "compared", "passed") == [("g", 1, False), ("h", 1, True)]
    logs = table(spark, [("h", "Tray", "a"), ("h", "Tray", "a"), ("h", "Section", "b"), ("h", "Section", "c"), ("h", "one", "x")], "hole string, name string, digest string")
    assert rows(align.duplicate_alias_check(logs, key=["hole"], name="name", digest="digest"), "name", "identical") == [("Section", False), ("Tray", True)]


def test_position_logs(spark):
    pos = table(spark, [("h", i, i + 1) for i in range(3)], "hole string, sample_no long, tray_sample_no long")
    def check(values, **kw):
        v = table(spark, [("h", i, "L", x) for i, x in enumerate(values)], "hole string, sample_no long, log string, value string")
        return align.position_log_check(v, pos, key=["hole"], log="log", value="value", expected="tray_sample_no", **kw).first().passed
    assert check(["1", "2", "3"]) and not check(["1", "2", "4"]) and not check(["1", "null", "3"])
    assert check(["1", "null", "3"], nulls_allowed=True) and not check(["1", "null", "4"], nulls_allowed=True)
    assert not check(["null", "", "NaN"], nulls_allowed=True) and not check(["1", "inf", "3"], nulls_allowed=True)


# ---------------------------------------------------------------- relations


def test_differences_are_null_safe(spark):
    a = table(spark, [(1, "x", None), (2, None, 1), (3, "z", 1)], "k int, s string, n int")
    b = table(spark, [(1, "x", None), (2, None, 2), (4, "z", 1)], "k int, s string, n int")
    assert rows(relations.table_difference(a, b, key=["k"], columns=["s", "n"])) == [(2, "differs"), (3, "only left"), (4, "only right")]
    twice = a.unionByName(a.where("k = 1"))
    assert rows(relations.multiset_difference(twice, a), "k", "surplus") == [(1, 1)]
    assert relations.multiset_difference(a, a.repartition(5)).isEmpty()


def test_reconciliation(spark):
    m = table(spark, [("h", "a", "complete", 3), ("h", "b", "complete", 3), ("h", "c", "complete", 3), ("h", "c", "complete", 3), ("h", "d", "unavailable", None), ("h", "e", "metadata_only", None), ("h", "f", None, 1), ("h", "z", "complete", 0)], "hole string, path string, status string, nbytes long")
    f = table(spark, [("h", "a", 3), ("h", "c", 4), ("h", "d", 1), ("h", "x.part", 1), ("h", "y", 1), ("h", "z", 0)], "hole string, path string, size long")
    assert rows(relations.reconcile(m, f, key=["hole", "path"]), "path", "finding") == [
        ("b", "missing"), ("c", "listed more than once"), ("c", "size differs"), ("d", "marked absent but present"), ("f", "incomplete record"), ("x.part", "partial download"), ("y", "unlisted file"), ("z", "empty file"),
    ]


def test_parent_chain_levels_breaks_and_cycles(spark):
    data = [(0, None)] + [(i, i - 1) for i in range(1, 20)] + [(50, 51), (51, 52), (52, 50), (60, 99), (61, 60)]
    found = {r.id: r.level for r in relations.parent_chain(table(spark, data, "id long, up_id long"), ident="id", parent="up_id").collect()}
    assert [found[i] for i in range(20)] == list(range(20)) and all(found[i] is None for i in (50, 51, 52, 60, 61))


def test_shared_fields_round_trip(spark):
    df = table(spark, [("d", 1, "a", None), ("d", 2, "a", "x"), ("e", 3, "b", "y")], "g string, i int, s string, t string")
    header, rest = relations.factor_shared(df, by=["g"], columns=["s", "t"])
    assert rows(header) == [("d", "a", None), ("e", "b", "y")]
    assert rows(relations.unfactor_shared(header, rest, by=["g"], columns=["s", "t"]), "g", "i", "s", "t") == rows(df)


def test_membership_and_files(spark):
    local = table(spark, [("scalar", "1"), ("scalar", "2"), ("scalar", "9")], "kind string, log_id string")
    official = table(spark, [("d", "scalar", "1"), ("e", "scalar", "1"), ("d", "scalar", "2"), ("d", "scalar", "7")], "dataset_id string, kind string, log_id string")
    assigned, extra, twice = relations.membership(local, official)
    assert (assigned.count(), rows(extra, "log_id"), rows(twice, "log_id"), rows(relations.unassigned(local, official), "log_id")) == (3, [("7",)], [("1",)], [("9",)])


def test_profile_matching_needs_all_values(spark):
    m = table(spark, [("h", p, s, v) for p, vs in (("p", [1.0, 2.0]), ("q", [1.0, 9.0]), ("r", [1.0])) for s, v in enumerate(vs)], "hole string, profile_id string, sample_no long, positive_min double")
    r = table(spark, [("h", d, "l", s, v) for d, vs in (("d", [1.00005, 2.0]), ("e", [5.0, 5.0])) for s, v in enumerate(vs)], "hole string, dataset_id string, log_id string, sample_no long, value double")
    assert rows(relations.match_profiles(m, r, hole=["hole"])) == [("h", "d", 1, "p"), ("h", "e", 0, None)]


def test_pages(spark):
    df = spark.range(10)
    page = paging.page_after(df, key="id", after=4, limit=3)
    assert rows(page) == [(5, 7), (6, 7), (7, 7)]
    assert rows(paging.page_after(df, key="id", after=6, limit=3)) == [(7, None), (8, None), (9, None)]
    assert rows(paging.page_offset(df, order=["id"], offset=8, limit=2)) == [(8, None), (9, None)]
    with pytest.raises(ValueError):
        paging.in_box(df, 10, 0, 5, 1)


def test_odd_sized_medians_and_samples(spark):
    df = table(spark, [("h", v, i) for i, v in enumerate([4.0, 1.0, 3.0, 2.0])], "hole string, v double, i int")
    assert profiles.upper_median(df, by=["hole"], value="v", tie=["i"]).first().upper_median == 3.0
    s = table(spark, [("h", i, "A" if i in (1, 7) else None) for i in range(9)] + [("g", 0, None), ("g", 1, None)], "hole string, sample_no long, call string")
    assert rows(profiles.informative_sample(s, key=["hole"], label="call")) == [("g", 1), ("h", 7)]
    assert rows(profiles.spread_sample(s, key=["hole"], label="call")) == [("g", 1), ("h", 1)]


# ---------------------------------------------------------------- quality


def problems(df):
    return sorted(r.key + ":" + r.detail for r in df.collect())


def test_composites(spark):
    samples = table(spark, [("a", i, float(i)) for i in range(10)] + [("b", i, 5.0 + i) for i in range(10)], "axis_id string, sample_no long, md_m double")
    axes = table(spark, [("h", "a", 0.0, 9.0), ("h", "b", 5.0, 14.0)], "hole string, axis_id string, depth_min_m double, depth_max_m double")
    parts = release.succession(axes, hole=["hole"], order=["depth_min_m"]).withColumn("composite_id", F.col("hole"))
    chosen = release.selected_parts(parts.select("composite_id", "sequence_no", "axis_id", "selection_from_md_m", "selection_to_md_m", "upper_inclusive"), samples)
    assert rows(chosen, "sequence_no", "selection_to_md_m", "upper_inclusive", "sample_no_from", "sample_no_to") == [(0, 5.0, False, 0, 4), (1, 14.0, True, 0, 9)]
    assert quality.composite_windows(chosen, samples).isEmpty()
    wide = chosen.withColumn("upper_inclusive", F.lit(True))
    assert len(problems(quality.composite_windows(wide, samples))) == 2
    shown = release.composite_samples(chosen.withColumn("dataset_revision_id", F.lit("r")), samples)
    assert shown.count() == 15


def test_chain_of_reports(spark):
    good = [("h", 1, "passed", "v", None), ("h", 2, "passed_with_issues", "v", 1), ("h", 3, "passed", "v", 2)]
    schema = "hole_id string, step int, status string, version string, previous_step int"
    assert quality.report_chain(table(spark, good, schema)).isEmpty()
    bad = [good[0], ("h", 2, "failed", "v", 1), ("h", 4, "passed", "v", 2), ("h", 5, "passed", "w", 4), ("h", 6, "passed", "v", 3)]
    assert problems(quality.report_chain(table(spark, bad, schema))) == ["h/2:not passed", "h/4:step missing", "h/5:versions mixed", "h/6:predecessor differs"]


def test_unavailable_profiles(spark):
    files = table(spark, [("h", "there")], "hole_id string, path string")
    m = table(spark, [("h", "ok", "unavailable", "f", None, 0, 0), ("h", "file", "unavailable", "there", None, 0, 0), ("h", "hash", "unavailable", "f", "x", 0, 0), ("h", "none", "unavailable", "f", None, None, 0), ("h", "done", "complete", "there", "x", 5, 5)], "hole_id string, log_id string, status string, file string, sha256 string, nbytes long, records long")
    assert rows(quality.unavailable_profiles(m, files, key=["hole_id"]), "key") == [("h/file",), ("h/hash",), ("h/none",)]


def test_collars_keys_and_identity(spark):
    c = table(spark, [("a", -30.0, 120.0), ("b", None, None), ("c", 91.0, 0.0), ("d", 10.0, None)], "h string, latitude double, longitude double")
    assert rows(quality.collar_range(c, key=["h"]), "key") == [("c",), ("d",)]
    tables = {"s": table(spark, [(1,), (None,), (7,), (7,)], "p int"), "t": table(spark, [(1,)], "id int")}
    assert rows(quality.foreign_keys(tables, [("s", ["p"], "t", ["id"])]), "key") == [("7",)]
    assert quality.exact_columns(tables["t"], ["id", "x"]) == ["x"]


def test_spectral_maps_may_not_be_ambiguous(spark):
    schema = "spectral_array_id string, axis_id string, source_row_from long, source_row_to long, sample_no_from long, sample_no_to long"
    assert quality.spectral_maps(table(spark, [("a", "x", 0, 4, 0, 4), ("a", "x", 5, 9, 5, 9)], schema)).isEmpty()
    assert quality.spectral_maps(table(spark, [("a", "x", 0, 4, 0, 4), ("a", "x", 4, 9, 5, 10)], schema)).count() == 1
    assert quality.spectral_maps(table(spark, [("a", "x", 0, 4, 0, 4), ("a", "x", 5, 9, 4, 8)], schema)).count() == 1


# ---------------------------------------------------------------- routing


def test_cuttings(spark):
    d = table(spark, [("a", "1", "a"), ("a", "2", "a_cuttings"), ("b", "3", "b Cuttings2"), ("c", "4", "c"), ("c", "5", "c2"), ("c", "6", "c-cuttings"), ("e", "7", "ecuttings")], "hole_id string, dataset_id string, dataset_name string")
    assert rows(routing.core_datasets(d), "dataset_id", "kept", "problem") == [
        ("1", True, None), ("2", False, None), ("3", False, None), ("4", True, "the remaining datasets need review"), ("5", True, "the remaining datasets need review"), ("6", False, "the remaining datasets need review"),
    ]


def test_splits(spark):
    d = table(spark, [("h", "1", "n", "p", "-30", "120"), ("h", "2", "n", "q", "", "120"), ("g", "3", "n", "p", "1", "1")], "hole_id string, dataset_id string, dataset_name string, project string, latitude string, longitude string")
    r = table(spark, [("h", "1", "p", "P", None, None), ("h", "2", "q", "Q", None, None), ("h", "9", "z", "Z", None, None)], "hole_id string, dataset_id string, project string, label string, override_x double, override_y double")
    assert rows(routing.split_holes(d, r), "dataset_id", "split_hole", "problem") == [("1", "h-P", None), ("2", "h-Q", "coordinates missing or invalid"), ("9", "h-Z", "membership changed")]


def test_own_datasets_and_choice(spark):
    d = table(
        spark, [("h", "1", "h", -30.0, 120.0, 0, 0.0, 5.0), ("h", "2", "h_chips", -30.001, 120.0, 1, 0.0, 9.0), ("h", "3", "h_far", -31.0, 120.0, 2, 0.0, 99.0), ("g", "4", "x", None, None, 0, 0.0, 1.0), ("f", "5", "x", -20.0, 110.0, 0, 0.0, 1.0), ("f", "6", "y", None, None, 1, 0.0, 50.0)],
        "hole_id string, dataset_id string, dataset_name string, latitude double, longitude double, position int, depth_from_m double, depth_to_m double",
    )
    holes = table(spark, [("h", -30.0, 120.0), ("g", 0.5, 0.5), ("f", -20.0, 110.0)], "hole_id string, latitude double, longitude double")
    assert rows(routing.own_datasets(d, holes), "dataset_id") == [("1",), ("2",), ("4",), ("5",)]
    assert rows(routing.choose_dataset(d, holes).where("choice = 1"), "hole_id", "dataset_id", "place") == [("f", "5", "at collar"), ("g", "4", "unknown"), ("h", "2", "at collar")]


def test_retries_stop_without_a_new_rule(spark):
    a = table(spark, [("h", 1, "failed", ["02"]), ("h", 2, "failed", ["02", "05"]), ("g", 1, "failed", []), ("f", 1, "failed", []), ("f", 2, "passed", ["02"])], "hole_id string, attempt int, status string, cases array<string>")
    d = table(spark, [("h", "routed", ["05"]), ("g", "routed", ["02"]), ("f", "routed", ["02"])], "hole_id string, status string, cases array<string>")
    assert rows(routing.retry_plan(a, d), "hole_id") == [("g",)]


# ---------------------------------------------------------------- publication


def test_publication(spark, tmp_path):
    root = str(tmp_path / "release")
    members = table(spark, [("a", "r1", "d1"), ("b", "r2", "d2")], "dataset_id string, dataset_revision_id string, input_digest string")
    checks = members.select("dataset_revision_id", "input_digest", F.lit("passed").alias("status"))
    assert release.active_release(spark, root).count() == 0
    with pytest.raises(ValueError):
        release.publish(spark, root, members, checks.where("input_digest = 'd1'"), "one", None)
    assert release.publish(spark, root, members, checks, "one", None)
    assert not release.publish(spark, root, members, checks, "one", None)
    with pytest.raises(ValueError):
        release.publish(spark, root, members, checks, "two", "zero")
    assert release.publish(spark, root, members.where("dataset_id = 'a'"), checks, "two", "one")
    assert rows(release.release_members(spark, root), "dataset_id") == [("a",)]
    with pytest.raises(ValueError):
        release.publish(spark, root, members.where("dataset_id = 'b'"), checks, "one", "two")
    a = release.release_identity(members, prefix="p").first()
    assert a == release.release_identity(members.orderBy(F.desc("dataset_id")), prefix="p").first()
    assert a.release_id != release.release_identity(members, prefix="p", metadata="m").first().release_id


def test_segments_are_carried_only_for_the_same_members(spark):
    schema = "borehole_id string, dataset_id string, dataset_revision_id string"
    members = table(spark, [("h", "a", "r1"), ("h", "b", "r2"), ("g", "c", "r3"), ("f", "d", "r4"), ("f", "e", "r5")], schema)
    part = lambda src, hole, seq, ds, rev: (src, hole, seq, ds, rev, "x", 0.0, 1.0, True, 0, 1, "selected")
    segments = table(
        spark, [part(1, "h", 0, "a", "r1"), part(1, "h", 1, "b", "r2"), part(2, "h", 0, "a", "r1"), part(2, "h", 1, "b", "old"), part(1, "f", 0, "d", "r4")],
        "source_no int, borehole_id string, sequence_no int, dataset_id string, dataset_revision_id string, axis_id string, selection_from_md_m double, selection_to_md_m double, upper_inclusive boolean, sample_no_from long, sample_no_to long, selection_status string",
    )
    axes = table(spark, [(f"r{i}", f"ax{i}", 10, 0.0, 9.0) for i in range(1, 6)], "dataset_revision_id string, axis_id string, sample_count long, depth_min_m double, depth_max_m double")
    found, missing = release.carry_segments(members, segments, axes)
    assert rows(found, "borehole_id", "source_no", "dataset_id", "sample_no_to") == [("g", None, "c", 9), ("h", 1, "a", 1), ("h", 1, "b", 1)]
    assert rows(missing) == [("f",)]


def test_assets_to_remove(spark):
    a = table(spark, [("k1", "canonical"), ("k2", "raw"), ("k2", "evidence"), ("k3", "raw"), ("k4", "canonical"), ("k5", "canonical"), ("k5", "odd")], "object_key string, role string")
    refs = table(spark, [("k4", "open"), ("k1", "done")], "object_key string, batch_id string")
    batches = table(spark, [("open", False), ("done", True)], "batch_id string, complete boolean")
    assert rows(release.removable_assets(a, refs, batches).where("kept_because is null"), "object_key") == [("k1",)]
    assert rows(release.removable_assets(a, refs, batches, include_raw=True).where("kept_because is null"), "object_key") == [("k1",), ("k3",)]


# ---------------------------------------------------------------- geometry


@pytest.mark.parametrize("heavy", ["2", "1000"])
def test_sheets(spark, heavy):
    spark.conf.set("stratalog.groupRows", heavy)
    heights = [400, 500, 200, 900, 100, 1500, 10, 990, 1]
    df = table(spark, [("h", i, h) for i, h in enumerate(heights)] + [("g", 0, 5)], "hole_id string, row_no int, height_px long")
    found = geometry.pack_sheets(df, hole=["hole_id"], order=["row_no"], height="height_px", limit=1000).where("hole_id = 'h'").orderBy("row_no").collect()
    spark.conf.unset("stratalog.groupRows")
    assert [r.sheet_index for r in found] == [0, 0, 1, 2, 2, 3, 4, 4, 5]
    assert [r.y_from_px for r in found] == [0, 400, 0, 0, 900, 0, 0, 10, 0]


def test_row_depths_and_provenance(spark):
    df = table(spark, [("t", 0, 100), ("t", 1, 300)], "tray string, row_no int, len int").withColumns({"depth_from": F.lit(10.0), "depth_to": F.lit(14.0)})
    assert rows(geometry.row_depths(df, tray=["tray"], order="row_no", length="len"), "depth_from_m", "depth_to_m") == [(10.0, 11.0), (11.0, 14.0)]
    holes = table(spark, [("BH01", -33.0, 115.0)], "hole_id string, latitude double, longitude double")
    src = table(spark, [("BH01", "BH01", None, None), ("BH01", "b", -33.0, 115.001), ("BH01", "c", -22.0, 115.0), ("BH01", "d", None, 1.0)], "hole_id string, dataset_name string, collar_lat double, collar_lon double")
    assert rows(geometry.photo_provenance(holes, src), "dataset_name", "verdict") == [("BH01", "named"), ("b", "near"), ("c", "elsewhere"), ("d", "no collar")]


def test_a_parent_chain_is_not_broadcast(spark, monkeypatch):
    plans, settle = [], relations.settle_table
    monkeypatch.setattr(relations, "settle_table", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df, label))[1])
    nodes = spark.range(1, 40).selectExpr("id", "case when id > 1 then id div 2 end up_id")
    found = {r.id: r.level for r in relations.parent_chain(nodes, ident="id", parent="up_id").collect()}
    assert found == {i: i.bit_length() - 1 for i in range(1, 40)}
    assert len(plans) > 2 and not any("Broadcast" in plan for plan in plans)
