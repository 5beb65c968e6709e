import collections
import os
import random

import corpus_pipeline
import pytest
from llm_helpers import prose, shingle_set, words
from stratalog.session import scratch

import __spark_entry__ as entry_points

NAMES = ["op1_substring_dedup", "op2_warc_packages", "op3_minhash_near_dedup", "op4_embedding_near_dedup", "op5_byte_level_bpe", "op6_training_order_shards", "op7_url_filters", "op8_quality_rules", "op9_source_mixing", "op10_chat_formatting", "pipeline"]


def test_all_are_registered():
    assert set(NAMES) <= set(entry_points.queries())


def test_stages_on_planted_documents(spark):
    vocabulary = words(prose(0, 40))
    text = lambda seed, n: " ".join(random.Random(str(seed)).choices(vocabulary, k=n))
    clean = [(i, text(i, 120 + i % 50), "en", f"s{i % 3}") for i in range(300)]
    passage = text("passage", 60)
    planted = [(1200 + i, f"{text(('p', i), 80)} {passage} {text(('q', i), 80)}", "en", "s1") for i in range(4)]
    copies = [(1300 + i, text(5, 125), "en", "s2") for i in range(6)]
    junk = [(1400 + i, " ".join(w.upper() + "!!" for w in words(text(("j", i), 90))), "en", "s0") for i in range(20)] + [(1450, None, None, None), (1451, "too short", "en", "s0"), (None, text("null", 100), "en", "s0")]
    rows = [(*r, len(r[1] or ""), "x") for r in [*clean, *planted, *copies, *junk]]
    folder = scratch(spark, "pipeline-test")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in [*range(200), *range(1300, 1306)]] + [(1400, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = stage(spark, docs, folder)
        out.write.parquet(place := f"{folder}/{name}")
        docs = spark.read.parquet(place)
        kept[name] = docs.collect()
        if name != "byte_level_bpe":
            assert docs.columns == columns
    ids = {name: collections.Counter(r.doc_id for r in rows) for name, rows in kept.items()}
    assert set(ids["quality_rules"]) == {*range(300), *range(1200, 1204), *range(1300, 1306), None}
    assert set(ids["minhash_near_dedup"]) == {*range(300), *range(1200, 1204), None}
    cut = {r.doc_id: r for r in kept["substring_dedup"]}
    assert set(cut) == set(ids["minhash_near_dedup"])
    inner = " ".join(words(passage)[5:55])
    assert [inner in cut[i].text for i in range(1200, 1204)] == [True, False, False, False]
    assert all(r.n_chars == len(r.text) for r in cut.values())
    assert all(cut[i].text == t for i, t, *_ in clean)
    assert set(ids["source_mixing"]) <= set(cut) and max(ids["source_mixing"].values()) <= 3
    assert ids["byte_level_bpe"] == ids["source_mixing"]
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, run.select("doc_id", "n_tokens", "decoded_sha256").collect())) == sorted(str(r) for r in docs.select("doc_id", "n_tokens", "decoded_sha256").collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_near_dedup_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    from test_lsh_forest import brute

    sets, component = brute(docs, 4, 80)
    found = {r.doc_id: r for r in entry_points.queries()["op3_minhash_near_dedup"](spark, folder).collect()}
    assert {i: r.component_id for i, r in found.items()} == component
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert shingle_set("a b", 4) == {("a", "b")}
