import collections

import duckdb
import pytest
from llm_helpers import awkward, documents, prose, words
from stratalog.llm import mixing
from stratalog.llm.queries import MIX_SQL
from pyspark.sql import functions as F


def sized(df):
    return df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))


def targets(sizes):
    """The rule as told: share by weight, cut at three times, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    got, free, left = {s: 0.0 for s in names}, set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            got[s] += left * weight[s] / total
        left = sum(max(0, got[s] - 3 * sizes[s]) for s in free)
        capped = {s for s in free if got[s] >= 3 * sizes[s]}
        for s in capped:
            got[s] = 3.0 * sizes[s]
        free -= capped
    return got


ROWS = [(i, prose(i, i * 37 % 211), f"s{i % 7}") for i in range(600)] + [(1000 + i, prose(i, 20), None) for i in range(10)] + [(2000, prose(4, 4000), "big"), (2001, "", "zero"), (2002, None, "zero")]


def test_targets_and_taken_words(spark):
    found = mixing.copies(sized(documents(spark, ROWS, clashes=False))).collect()
    sizes = collections.Counter()
    for i, text, source in ROWS:
        sizes[source] += len(words(text))
    expected = targets(sizes)
    assert len(found) == len(ROWS)
    taken, longest = collections.Counter(), collections.Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 2 * longest[s]


def test_same_draw_by_blocks_and_by_sql(spark, small_groups):
    df = documents(spark, ROWS, clashes=False)
    mine = {(r.doc_id, r.source): r.copies for r in mixing.copies(sized(df)).collect()}
    table = df.toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", table)
    rows = con.execute(MIX_SQL).fetchall()
    assert {r[0]: r[4] for r in rows} == {i: mine[(i, s)] * len(words(t)) for i, t, s in ROWS}


def test_awkward_documents_keep_all_columns(spark):
    rows = awkward(spark)
    df = documents(spark, rows)
    out = mixing.mix(df)
    assert out.columns == df.columns
    have = collections.Counter((r.doc_id, r.source) for r in out.collect())
    wanted = collections.Counter()
    for r in mixing.copies(sized(df)).collect():
        wanted[(r.doc_id, r.source)] += r.copies
    assert have == +wanted
    assert all(words(t) for t in out.toPandas().text)
    assert mixing.mix(df.where("false")).count() == 0


@pytest.mark.parametrize("blocks", [False, True])
def test_repeated_rows_meet_the_target(spark, blocks, request):
    """Half of all rows share an id and a size; their copies are drawn one by one."""
    if blocks:
        request.getfixturevalue("small_groups")
    rows = [(7, prose(9, 100), "a")] * 500 + [(None, prose(8, 100), "a")] * 500 + [(1 + i, prose(i, 30 + i % 5), "b") for i in range(800)]
    df = documents(spark, rows)
    found = mixing.copies(sized(df)).collect()
    mixed = mixing.mix(df).collect()
    for source in "ab":
        target = next(r.target for r in found if r.source == source)
        assert abs(sum(r.copies * r.size for r in found if r.source == source) - target) <= 100
        assert abs(sum(len(words(r.text)) for r in mixed if r.source == source) - target) <= 100
    con = duckdb.connect()
    con.register("documents", documents(spark, rows, clashes=False).toArrow())
    have = collections.Counter((r.doc_id, r.size, r.copies * r.size) for r in found)
    assert have == collections.Counter((r[0], r[1], r[4]) for r in con.execute(MIX_SQL).fetchall())
