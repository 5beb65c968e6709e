"""Awkward documents that every operator is to take."""

import contextlib
import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyzéñ", k=draw.randint(2, 9))) for _ in range(n))


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, n):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


#: Names that the operators use for columns of their own.
CLASHES = ["key", "value", "part", "own", "slot", "size", "bucket", "_id", "region", "label", "n_words", "token_ids", "decoded", "copies", "__text", "__id"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)


def documents(spark, rows, clashes=True):
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s", *(["x"] * len(CLASHES))) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    return df if clashes else df.select("doc_id", "text", "source")


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "b"), (5, long + " end", "b"), (6, prose(2, 120), "c"), (6, prose(2, 120), "c"), (7, prose(2, 120), None), (None, prose(3, 90), "c"), (None, prose(3, 90), "c"), (8, "one two", "c"), (9, "One  two", "c"), (10, "wordwithoutspaces" * 4000, "a")]


@contextlib.contextmanager
def small_batches(spark, rows):
    """Arrow batches of at most ``rows`` rows, so that what a task keeps between batches is used."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key)


def components(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
