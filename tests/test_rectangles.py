import random

import pytest

from stratalog.operators.intervals import rectangle_overlaps, rectangle_pairs

SCHEMA = "frame long, id long, x int, y int, width int, height int"


def brute(rows):
    out = []
    for f, i, x, y, w, h in rows:
        met = [b[1] for b in rows if b[0] == f and b[1] != i and x < b[2] + b[4] and b[2] < x + w and y < b[3] + b[5] and b[3] < y + h]
        if met:
            out.append((f, i, len(met), min(met)))
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in rectangle_overlaps(df, frame=["frame"], ident="id", **more).collect())


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_against_all_pairs(spark, cell_rows):
    draw = random.Random(3)
    rows = [(draw.randrange(4), i, draw.randrange(60), draw.randrange(400), draw.choice([0, 1, 5, 20, 60]), draw.choice([0, 1, 10, 30, 390])) for i in range(300)]
    rows += [(1, 900 + i, 10, 10, 5, 5) for i in range(6)] + [(9, 990, 0, 0, 10, 10), (9, 991, 10, 0, 10, 10), (8, 992, 5, 5, 0, 0), (8, 993, 5, 5, 0, 0)]
    assert found(spark.createDataFrame(rows, SCHEMA), cell_rows=cell_rows) == brute(rows)


def test_output_of_equal_regions_is_linear(spark):
    n = 100_000
    df = spark.range(n).selectExpr("0L frame", "id", "3 x", "4 y", "10 width", "20 height")
    out = rectangle_overlaps(df, frame=["frame"], ident="id")
    assert out.selectExpr("count(*)", "min(overlaps)", "max(overlaps)", "max(witness)", "sum(witness)").first() == (n, n - 1, n - 1, 1, 1)


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_every_pair_comes_once(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(4), i, draw.randrange(60), draw.randrange(400), draw.choice([0, 1, 5, 20, 60]), draw.choice([0, 1, 10, 30, 390])) for i in range(300)]
    rows += [(1, 900 + i, 10, 10, 5, 5) for i in range(6)]
    wanted = [(f, i, b[1]) for f, i, x, y, w, h in rows for b in rows if b[0] == f and i < b[1] and x < b[2] + b[4] and b[2] < x + w and y < b[3] + b[5] and b[3] < y + h]
    pairs = rectangle_pairs(spark.createDataFrame(rows, SCHEMA), frame=["frame"], ident="id")
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(wanted)


def test_the_query_gives_the_pairs(spark, tmp_path):
    from stratalog.plans.relation_queries import overlapping_rectangles

    spark.createDataFrame([(50, 1), (100, 1), (150, 1), (51, 2)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    found = overlapping_rectangles(spark, str(tmp_path))
    assert found.columns == ["f", "a", "b"] and found.collect() == []
    spark.createDataFrame([(400, 1), (800, 1), (400, 2)], "o_orderkey long, o_custkey long").write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    assert [tuple(r) for r in overlapping_rectangles(spark, str(tmp_path)).collect()] == [(1, 400, 800)]
