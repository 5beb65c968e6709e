import random

import numpy as np
import pyarrow as pa
from llm_helpers import components as brute
from llm_helpers import prose, shingle_set, words
from stratalog.llm.components import components
from stratalog.llm.words import Words, distinct_sets, shingles, text_slices


def test_words_are_cut_at_the_given_bytes_only():
    texts = ["a b\tc\n\x0bd\x0c\re", None, "", " x y z", "  lead", "trail  ", "nextrow"]
    for size in (1, 8, 1 << 20):
        found = []
        for lo, hi, data, offsets in text_slices(pa.array(texts), size):
            w = Words(data, offsets)
            spans = [data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
            found += [spans[f : f + n] for f, n in zip(w.first, w.counts)]
        assert found == [words(t) for t in texts]


def test_sets_of_shingles_have_the_right_size():
    texts = [prose(1, 50), "a b", "a b", "B A", "", None, "x x x x x x x", prose(1, 50).upper()]
    for n in (2, 3, 4, 5):
        sizes, sets = [], []
        for _, _, data, offsets in text_slices(pa.array(texts), 64):
            w = Words(data, offsets)
            values, counts = distinct_sets(*shingles(w.hashes(lower=True), w.first, w.counts, n, short=True))
            sizes += counts.tolist()
            sets += [set(x.tolist()) for x in np.split(values, np.cumsum(counts)[:-1])]
        expected = [shingle_set(t, n) for t in texts]
        assert sizes == [len(s) for s in expected]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(sets[i] & sets[j]) == len(expected[i] & expected[j])


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1000, i) for i in range(1001, 1060)] + [(7, 7), (5, 3), (3, 5)]
    edges += [(draw.randint(2000, 2100), draw.randint(2000, 2100)) for _ in range(70)]
    edges += [(-(2**63) + 5, 2**63 - 1)]
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    ids = {x for a, b in edges if a != b for x in (a, b)}
    assert dict(components(df).collect()) == brute(ids, [e for e in edges if e[0] != e[1]])
    assert components(df.where("false")).count() == 0
