import random

import numpy as np
import pytest
from llm_helpers import awkward, components, documents, prose, shingle_set, small_batches, words
from stratalog.llm import lsh_forest


def edited(text, seed, share):
    draw, w = random.Random(seed), words(text)
    for _ in range(max(1, int(len(w) * share))):
        w[draw.randrange(len(w))] = prose(draw.random(), 1)
    return " ".join(w)


def corpus():
    rows = [(i, prose(i, 40 + i)) for i in range(60)]
    rows += [(100 + i, edited(prose(i, 40 + i), i, 0.02)) for i in range(60)]
    # copies that differ from one original in different places, some of them not alike among themselves
    base = prose(900, 220)
    rows += [(500, base)] + [(501 + i, edited(base, i, 0.022)) for i in range(120)]
    rows += [(700 + i, prose(50, 90)) for i in range(30)]
    return rows


def brute(rows, n, similar):
    sets = {i: shingle_set(t, n) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
    return sets, components(sets, edges)


@pytest.mark.parametrize("n,batch", [(4, 10_000), (5, 40)])
def test_against_all_pairs(spark, monkeypatch, n, batch):
    # small batches: a task's rows come in many pieces
    monkeypatch.setattr(lsh_forest, "HELD_ROWS", 5 * batch)
    rows = corpus()
    sets, component = brute(rows, n, 80)
    with small_batches(spark, batch):
        found = {r.doc_id: r for r in lsh_forest.near_duplicates(documents(spark, rows), n=n).collect()}
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in found.items()} == component
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())
    left = lsh_forest.one_of_each(documents(spark, rows), n=n)
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for c in component.values()})


def test_a_crowded_region_of_unlike_sets(spark):
    rows = [(i, f"w{i % 40} " + "same words come over and over again " * 2 + f"t{i}") for i in range(80)]
    sets, component = brute(rows, 4, 80)
    found = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(documents(spark, rows), n=4).collect()}
    assert found == component


def replaced(text, places, mark):
    w = words(text)
    for at in places:
        w[at] = f"{mark}{at}"
    return " ".join(w)


def test_copies_of_a_copy_in_a_crowded_region(spark):
    """``near`` differs from ``base`` in one word and mostly stands in its regions; its own copies are alike with it alone."""
    base, draw = prose(901, 220), random.Random(5)
    near = replaced(base, [5], "n")
    rows = [(1, base), (2, near)] + [(10 + i, replaced(base, draw.sample(range(10, 210, 5), 4), f"c{i}x")) for i in range(1500)]
    ends = {5000 + i: replaced(near, draw.sample(range(12, 210, 5), 4), f"d{i}x") for i in range(400)}
    a, b = shingle_set(base, 5), shingle_set(near, 5)
    for c in (shingle_set(t, 5) for t in ends.values()):
        assert 100 * len(b & c) >= 80 * len(b | c) and 100 * len(a & c) < 80 * len(a | c)
    found = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(documents(spark, [*rows, *ends.items()])).collect()}
    assert [i for i in ends if found[i] != 1] == []


def test_awkward_and_empty(spark):
    df = documents(spark, awkward(spark))
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(df, n=4).collect()), key=str)
    assert found == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 29997, 4, True), (5, 29998, 4, False), (6, 117, 6, True), (6, 117, 6, True), (7, 117, 6, False), (8, 1, 8, True), (9, 1, 8, False), (10, 1, 10, True), (None, 87, None, True), (None, 87, None, True)],
        key=str,
    )
    left = lsh_forest.one_of_each(df, n=4)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 2, 3, 4, 6, 8, 10, None, None], key=str)
    assert lsh_forest.near_duplicates(df.where("false")).count() == 0 and lsh_forest.one_of_each(df.where("false")).count() == 0


def test_what_shares_no_region_is_found(spark, monkeypatch):
    """One order misses most pairs: the rarest members find them."""
    monkeypatch.setattr(lsh_forest, "TREES", 1)
    rows = corpus()
    _, component = brute(rows, 4, 80)
    found = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(documents(spark, rows), n=4).collect()}
    assert found == component


def test_copies_whose_original_is_missing(spark):
    """No member of the crowd is alike to many; links are the pairs at 80 and above, exactly."""
    base, draw, rows = words(prose(902, 150)), random.Random(9), []
    for i in range(160):
        w = list(base)
        for at in sorted(draw.sample(range(0, 150, 4), 3 + i % 3)):
            w[at] = f"e{i}x{at}"
        rows.append((i, " ".join(w)))
    sets, component = brute(rows, 4, 80)
    assert 5 < len(set(component.values())) < 155
    found = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(documents(spark, rows), n=4).collect()}
    assert found == component


def rarest_rows(spark, members):
    """What ``across_components`` is given, of sets that are linked with nothing yet."""
    often, rows = np.zeros(lsh_forest.COUNTERS, np.uint32), []
    for key, values in enumerate(members):
        values, counts = np.unique(np.array(values, np.uint64)), np.array([len(set(values))])
        first, _ = lsh_forest.rarest(values, counts, often, 80)
        digest = lsh_forest.set_digests(values, counts, lsh_forest.DIGEST)[0]
        rows.append((key, len(values), digest.tolist(), first.view(np.int64).tolist()))
    sets = spark.createDataFrame(rows, "key long, size long, digest array<long>, rarest array<long>")
    return sets, spark.createDataFrame([], "node long, component long")


def test_sets_that_share_a_late_value_only_are_no_candidates(spark):
    """Digests of large sets are alike; where the first value in common stands tells that too few can follow."""
    sets, labelled = rarest_rows(spark, [[*range(1000 * k, 1000 * k + 580), 10**6, *range(10**7 + 3000 * k, 10**7 + 3000 * k + 2419)] for k in range(30)])
    assert lsh_forest.across_components(sets, labelled, 80).count() == 0


def test_a_pair_is_made_few_times_however_much_it_shares(spark):
    shared, draw = list(range(2000)), random.Random(4)
    members = []
    for k in range(12):
        members += [[*shared[k * 150 :], *range(10**6 * (k + 1), 10**6 * (k + 1) + 300)], [*shared[k * 150 :], *draw.sample(range(10**8, 10**9), 100)]]
    sets, labelled = rarest_rows(spark, members)
    made = [(r.a, r.b) for r in lsh_forest.candidates(sets, labelled, 80).collect()]
    similar = {(a, b) for a in range(24) for b in range(a + 1, 24) if 100 * len({*members[a]} & {*members[b]}) >= 80 * len({*members[a]} | {*members[b]})}
    assert similar and similar <= set(made)
    # values of the same holders count once
    assert len(made) <= 24 * len(set(made))
