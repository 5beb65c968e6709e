import random
import re

import pytest
from llm_helpers import CLASHES, LOWER, awkward, documents
from stratalog.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    wanted = set()
    for item, text in items:
        w = words(text)
        size = min(len(w), window)
        wanted |= {(item, tuple(w[i : i + size])) for i in range(len(w) - size + 1) if size}
    out = []
    for doc, text in docs:
        w, hit, owners = words(text), set(), set()
        for item, run in wanted:
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit |= set(range(i, i + len(run)))
                    owners |= {str(item)} if item is not None else set()
        spans = [(i, next(j for j in range(i, len(w) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((doc, len(w), len(hit), sorted(owners), spans))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), [(s.first_word, s.end_word) for s in r.spans]) for r in df.collect()), key=str)


def corpus():
    draw = random.Random(4)
    bank = ["alpha", "beta", "gamma", "délta", "42", "x1", "zeta", "eta"]
    items = [(i, " ".join(draw.choices(bank, k=draw.choice([1, 2, 3, 4, 5, 6, 9, 10, 11, 14, 25])))) for i in range(40)]
    items += [(3, items[5][1]), (90, "Alpha-BETA, gamma; délta! 42 x1 zeta eta alpha beta"), (91, "alpha beta gamma délta 42 x1 zeta eta alpha beta"), (92, None), (93, ""), (94, "?!"), (None, "eta eta eta eta eta eta"), (95, "nowhere to be seen in any of these texts at all today")]
    docs = [(i, ". ".join(draw.choices(bank, k=draw.choice([0, 1, 3, 8, 20, 60])))) for i in range(120)]
    docs += [(200 + i, " ".join(draw.choices(["q", "r", "s"], k=7)) + " " + (items[i % 40][1] or "").upper() + "\tt u " + " ".join(words(items[(i * 7) % 40][1])[:9])) for i in range(60)]
    docs += [(300, "eta " * 3000), (301, None), (302, ""), (303, "\x00alpha\x7fbeta")]
    return docs, items


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_against_brute_force(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(decontamination, "TOGETHER", 50)
    docs, items = corpus()
    rows = documents(spark, docs)
    bench = spark.createDataFrame([(i, t, *["x"] * 6) for i, t in items], "item_id long, text string, words string, token string, n string, place string, size string, doc_id string")
    assert found(decontamination.contaminated(rows, bench, most_bytes=most_bytes)) == brute(docs, items)


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_awkward_and_empty(spark, most_bytes):
    rows = awkward(spark)
    docs = [(r[0], r[1]) for r in rows]
    items = [(1, "one TWO"), (2, "one"), (2, "two"), (3, docs[5][1][200:400]), (3, docs[3][1][5000:5400]), (4, "wordwithoutspaces" * 4000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, rows)
    assert len(CLASHES) and found(decontamination.contaminated(df, bench, most_bytes=most_bytes)) == brute(docs, items)
    assert found(decontamination.contaminated(df, bench.where("false"), most_bytes=most_bytes)) == brute(docs, [])
    assert decontamination.contaminated(df.where("false"), bench, most_bytes=most_bytes).count() == 0
    assert found(decontamination.contaminated(df, bench.where("item_id = 9"), most_bytes=most_bytes)) == brute(docs, [])
