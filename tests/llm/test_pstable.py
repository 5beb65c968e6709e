import math

import numpy as np
import pytest
from llm_helpers import CLASHES, small_batches
from llm_helpers import components as brute
from stratalog.llm import pstable
from pyspark.sql import functions as F


def vectors(seed=1, n=300, d=24):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, d))
    near = base[:60] + 0.2 * draw.standard_normal((60, d))
    star = base[0] + 0.25 * draw.standard_normal((90, d))
    return np.concatenate([base, near, star, 3.5 * base[5:8], -base[9:10]]).astype(np.float32)


def expected(rows):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows}
    ids, m = list(unit), np.array(list(unit.values()))
    c = m @ m.T
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(len(ids)) if i != j and c[i, j] >= 0.9]
    links = {i: sum(1 for a, _ in pairs if a == i) for i in ids}
    return links, brute(ids, pairs), c


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, block):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    links, component, _ = expected(rows)
    with small_batches(spark, 13 if block == 16 else 10_000):
        found = {r.vec_id: r for r in pstable.near_duplicates(df, block=block).collect()}
    assert set(found) == set(links)
    have, want = sum(r.n_links for r in found.values()), sum(links.values())
    assert have <= want and have / want > 0.98
    assert all(found[i].n_links <= links[i] for i in links)
    assert sum(found[i].component_id == component[i] for i in links) / len(links) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_what_cannot_link(spark):
    good = [1.0, 2.0, 3.0]
    rows = [(1, good), (2, good), (2, good), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, math.nan, 3.0]), (8, [math.inf, 2.0, 3.0]), (9, [1.0, 2.0]), (None, good), (10, [2e300, 4e300, 6e300]), (11, [1e-320, 2e-320, 3e-320]), (12, good), (12, [3.0, 2.0, 1.0])]
    out = pstable.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()]
    assert len(found) == 15 and sum(r == (2, 5, 1, False) for r in found) == 2  # a repeated row is a vector of its own
    by = {r[0]: r for r in found if r[0] != 12}
    assert by[1] == (1, 5, 1, True) and by[10] == (10, 5, 1, False) and by[11][2] == 1
    assert sorted(r for r in found if r[0] == 12) == [(12, 0, 12, True), (12, 5, 1, False)]
    for i in (3, 4, 5, 6, 7, 8, 9):
        assert by[i] == (i, 0, i, True)
    assert by[None] == (None, 0, None, True)
    assert pstable.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_many_copies_are_dealt_once(spark):
    """What is hashed and compared does not grow with the copies of a vector."""
    draw = np.random.default_rng(6)
    base = draw.standard_normal((40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (base[3] * 2.0 ** (i % 3)).tolist()) for i in range(3000)] + [(9000, (base[3] + 0.05 * draw.standard_normal(16)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in pstable.near_duplicates(df, block=16).collect()}
    near = {i for i, v in rows if np.dot(v, base[3]) / np.linalg.norm(v) / np.linalg.norm(base[3]) >= 0.9}
    assert near == {3, 9000, *range(100, 3100)}
    assert all(found[i].n_links == 3001 and found[i].component_id == 3 for i in near)
    keyed = pstable._keyed(df.select("vec_id", F.col("embedding").alias("v")))
    classes = keyed.groupBy("key", "check").agg(F.count("*").alias("copies"), F.any_value("v").alias("v"))
    hashed = pstable._hashed(classes.select(F.monotonically_increasing_id().alias("vec_id"), "copies", "v"))
    assert pstable._dealt(hashed, 16).count() <= 2 * 41 * pstable.TABLES
