import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import awkward, documents, prose, words
from stratalog.llm import quality_rules as q
from stratalog.llm.words import Words, text_slices


def brute(text):
    w = words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many, covered, seen, repeats = Counter(tri), set(), set(), 0
    for i, t in enumerate(tri):
        if many[t] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if words(line):
            repeats += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), repeats, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab \n\t#<é漢"), max_size=60)), max_size=8), st.sampled_from([1, 16, 1 << 20]))
def test_statistics(texts, size):
    found = []
    for lo, hi, data, offsets in text_slices(pa.array(texts, pa.string()), size):
        stats = q.base_statistics(data, offsets, Words(data, offsets))
        found += list(zip(*(stats[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert found == [brute(t) for t in texts]


def corpus(spark):
    vocabulary = words(prose(0, 300))
    draw = random.Random(7)
    good = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(60, 300)))) for i in range(120)]
    junk = [(200 + i, " ".join(w.upper() + "!!" for w in draw.choices(vocabulary, k=90))) for i in range(40)]
    return documents(spark, [*good, *junk]), documents(spark, [(i, None) for i in range(80)])


def test_judge_separates_and_follows_the_written_formula(spark):
    df, trusted = corpus(spark)
    model = q.fit(df, trusted)
    rows = q.judge(df, model).collect()
    assert "key" in rows[0].asDict() and len(rows) == 160
    scores = {r.doc_id: r.score for r in rows}
    assert min(scores[i] for i in range(120)) > max(scores[200 + i] for i in range(40))
    # one score from its definition
    grams = Counter()
    text = next(r.text for r in rows if r.doc_id == 3)
    for _, _, data, offsets in text_slices(pa.array([text])):
        grams.update(q._buckets(Words(data, offsets))[0].tolist())
    n, total = sum(grams.values()), 0.0
    for b, c in grams.items():
        t = (model.target[b] - c + q.PRIOR) / (model.target.sum() - n + q.PRIOR * q.BUCKETS)
        r = (model.corpus[b] - c + q.PRIOR) / (model.corpus.sum() - n + q.PRIOR * q.BUCKETS)
        total += c * np.log(t / r)
    assert abs(scores[3] - total / n) < 1e-8
    for r in rows:
        assert r.kept == (not r.base_failed and r.score >= model.threshold)


def test_verdicts_do_not_depend_on_partitions(spark):
    df, trusted = corpus(spark)
    one = {r.doc_id: r.score for r in q.judge(df, q.fit(df, trusted)).collect()}
    df = df.repartition(9)
    assert {r.doc_id: r.score for r in q.judge(df, q.fit(df, trusted)).collect()} == one


def test_awkward_and_empty(spark):
    rows = awkward(spark)
    df = documents(spark, rows)
    model = q.fit(df, df.where("doc_id in (4, 6)"))
    out = q.judge(df, model)
    assert sorted(map(str, ((r.doc_id, r.n_words) for r in out.collect()))) == sorted(str((i, len(words(t)))) for i, t, _ in rows)
    kept = q.passing(df, model)
    assert kept.columns == df.columns and kept.where("text is null or trim(text) = ''").count() == 0
    nothing = q.fit(df.where("false"), df.where("false"))
    assert q.judge(df.where("false"), nothing).count() == 0
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in q.judge(df, nothing).collect())


def test_the_target_is_fitted_on_every_trusted_document(spark):
    ids = spark.range(20_500).selectExpr("id doc_id", "concat('alpha w', id % 7) text")
    model = q.fit(ids, ids)
    assert model.target.sum() == model.corpus.sum() == 3 * 20_500
    rows = q.judge(ids.where("doc_id < 9"), model)
    assert rows.count() == 9 and not {"id", "as_trusted", "trusted_id"} & set(rows.columns)


def test_no_text_is_moved_to_find_the_trusted(spark):
    df, _ = corpus(spark)
    trusted = spark.range(2_000_000).selectExpr("id doc_id").where("doc_id < 80 or doc_id > 1000")
    kept = q.passing(df, q.fit(df, trusted))
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()


def test_ids_that_pass_the_filter_by_chance_are_not_trusted(spark, monkeypatch):
    df, trusted = corpus(spark)
    df = df.unionByName(documents(spark, [(None, prose(1, 90)), (3, prose(2, 90))]))
    model = q.fit(df, trusted)
    rows = sorted(map(str, q.judge(df, model).collect()))
    monkeypatch.setattr(q, "FILTER_BITS", 64)
    crowded = q.fit(df, trusted.selectExpr("int(doc_id) doc_id"))
    assert len(crowded.passes) == 1 and (crowded.target == model.target).all() and crowded.threshold == model.threshold
    assert sorted(map(str, q.judge(df, crowded).collect())) == rows
