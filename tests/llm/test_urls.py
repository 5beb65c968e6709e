import random

import pytest
from stratalog.llm import urls
from stratalog.llm.queries import URL_RULES
from pyspark.sql import functions as F

CASES = [
    ("http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/?q=/fr/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/1#top", "a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("x://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, None),
    ("http://example.com?u=://b.net/es/", "example.com", "", None, None),
    ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
    ("http://b.net/en/1", "b.net", "/en/1", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http://ÉÀ.org/\n/fr", "ÉÀ.org".replace("ÉÀ", "ÉÀ"), "/\n/fr", None, None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, url string")
    parsed = df.select("id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    rule, verdict = urls.longest_rule(F.col("host"), F.col("path"), URL_RULES)
    for r in parsed.select("*", rule.alias("rule"), verdict.alias("verdict")).collect():
        assert (r.host, r.path, r.rule, r.verdict) == CASES[r.id][1:]


def labelled(spark, n, seed):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        bad = draw.random() < 0.4
        host = "".join(draw.choices("abcdefgh", k=6)) + draw.choice([".org", ".net"])
        rows.append((host, f"/{draw.choice(['casino', 'win-now', 'xxx']) if bad else draw.choice(['news', 'docs', 'wiki'])}/{draw.randint(1, 99999)}", int(bad), "x", "y"))
    return spark.createDataFrame(rows, "host string, path string, label int, block_probability string, text string")


def test_held_out_accuracy_and_same_model_again(spark):
    model = urls.train(labelled(spark, 1500, 1))
    again = urls.train(labelled(spark, 1500, 1).repartition(7))
    assert (model.weights == again.weights).all() and model.intercept == again.intercept
    out = urls.score(labelled(spark, 800, 2), model)
    assert out.columns == ["host", "path", "label", "text", "block_probability"]
    rows = out.collect()
    assert sum((r.block_probability >= 0.5) == bool(r.label) for r in rows) / len(rows) > 0.97


@pytest.mark.parametrize("keep,blocked", [("false", False), ("label = 1", True), ("label = 0", False), ("label is null", False)])
def test_one_sided_tables(spark, keep, blocked):
    table = labelled(spark, 60, 3)
    model = urls.train(table.where(keep))
    rows = urls.score(table.unionByName(spark.createDataFrame([(None, None, 0, "x", "y")], table.schema)), model).collect()
    assert len(rows) == 61 and {r.block_probability >= 0.5 for r in rows} == {blocked}
    assert urls.score(table.where("false"), model).count() == 0


def test_long_urls_and_repeated_rows(spark):
    model = urls.train(labelled(spark, 300, 4))
    df = spark.createDataFrame([("a.org", "/" + "x" * 200_000)] * 3 + [("", "")], "host string, path string")
    rows = urls.score(df, model).collect()
    assert len(rows) == 4 and len({r.block_probability for r in rows}) == 2
