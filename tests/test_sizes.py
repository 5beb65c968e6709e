"""What is moved, and how much a task gets, as tables grow."""

from conftest import rows
from stratalog import session
from stratalog.operators import evidence
from stratalog.plans import quality_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def order_lines(spark, folder, lines, parts=()):
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(list(parts), "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_pairs_are_dealt_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    lines = [(order, 1 + order % 7) for order in range(200)] * 2 + [(None, 7), (5, None)]
    folder = order_lines(spark, tmp_path, lines, [(p, p) for p in range(1, 8)])
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    found = quality_queries.asset_problems(spark, folder)
    assert "hashpartitioning(log_id#" in plan(found) and ", 9), REPARTITION_BY_NUM" in plan(found)
    odd = [r[1:] for r in rows(found) if r[0] == "asset relation"]
    assert odd == sorted([(str(order), "7") for order in range(200) if order % 7 == 6] + [("", "7"), ("5", None)], key=str)
    assert [r for r in rows(found) if r[0] == "location identity"] == [("location identity", "1", "h2")]


def test_trays_move_no_sample(spark, tmp_path):
    folder = order_lines(spark, tmp_path, [(order, 1) for order, n in ((11, 1), (14, 3), (15, 4), (26, 7)) for _ in range(n)])
    trays = quality_queries.case_sources(spark, folder)["trays"]
    assert "Exchange" not in plan(trays)
    assert rows(trays) == sorted(
        [("11", 0, 0, 0), ("14", 0, 0, 2), ("15", 0, 0, 2), ("15", 1, 3, 3), ("26", 0, 0, 2), ("26", 1, 3, 5), ("26", 2, 6, 6)], key=str
    )


def test_image_digests_are_moved_once(spark):
    def hole(name, *images):
        return [(name, log, at, content) for log, at, content in images]

    images = [
        *hole("same", ("a", 0, "x"), ("b", 0, "x"), ("a", 1, None), ("b", 1, None)), *hole("content", ("a", 0, "x"), ("b", 0, "y")),
        *hole("shorter", ("a", 0, "x"), ("b", 0, "x"), ("a", 1, "x")), *hole("repeated", ("a", 0, "x"), ("a", 0, "x"), ("b", 0, "x")),
        *hole("twice", ("a", 0, "x"), ("a", 0, "x")), *hole("unnamed", (None, 0, "x"), ("a", 0, "x"), ("b", 0, "x")), *hole(None, ("a", 0, "x"), ("b", 0, "x")),
    ]
    df = spark.createDataFrame(images, "hole_id string, log_id string, sample_no int, sha256 string")
    found = evidence.image_log_agreement(df, ["sha256"])
    assert rows(found) == [(n, "identical" if n == "same" else "different") for n in ("content", "repeated", "same", "shorter", "unnamed")]
    # the images by ordinal, the counts by hole, and the logs of a hole
    assert plan(found).count("Exchange hashpartitioning(hole_id#") == 4
