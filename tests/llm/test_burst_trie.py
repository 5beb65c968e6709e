import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T
from stratalog.llm import burst_trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        for d in range(len(node) + 1):
            below[node[:d]] += (len(found) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not children[node]
    rows = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(convs[c]) == len(node))
        rows.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), children[node], leaves[node], below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def found(nodes):
    return sorted((tuple(r) for r in nodes.select(*FIELDS).collect()), key=str)


def corpus(seed, n=60, most=9):
    draw, rows = random.Random(seed), []
    for c in range(n):
        path = ["a", "a", "b", "a"][: draw.randrange(5)] + draw.choices("abé", k=draw.randrange(most))
        rows += [(c, t, "user" if t % 2 else "assistant", x * (1 + t % 3)) for t, x in enumerate(path)]
    return rows


@pytest.mark.parametrize("segment,container", [(4096, 1 << 20), (4096, 60), (3, 1 << 20), (3, 45), (1, 1)])
def test_against_all_prefixes(spark, segment, container):
    rows = corpus(5)
    # many copies of one, and two long ones that share all but the end
    rows += [(1000 + c, t, "user", "same") for c in range(20) for t in range(3)]
    rows += [(2000 + c, t, "user", f"long{t}" if t < 13 or not c else "end") for c in range(3) for t in range(13 + 3 * (c > 0))]
    own = sequences(rows)
    turns = burst_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    lengths = turns.groupBy("conv_id").agg({"place": "max"}).toDF("conv_id", "length").unionByName(spark.createDataFrame([(-5, 0), (-70, 0)], "conv_id long, length long"))
    own |= {-5: [], -70: []}
    assert found(burst_trie.trie(turns, lengths, segment=segment, container_bytes=container)) == brute(own)


@pytest.mark.parametrize("small", [False, True])
def test_shared_openings(spark, small, request):
    if small:
        request.getfixturevalue("small_groups")
    draw, rows = random.Random(8), corpus(6)
    rows += [(c, t, "user", draw.choice("xyz")) for c in (100, 117, 150, 199, 203, 250, 311, -1, -100, -140) for t in range(draw.randrange(1, 9))]
    rows += [(400, None, None, None), (401, 2, None, "t"), (401, None, "user", "t"), (401, 2, "a", "b"), (401, 2, "a", "a"), (401, 2, "a", "a"), (None, 0, "user", "lost"), (402, 0, "", "")]
    own = sequences(rows)
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], T.StructType([*SCHEMA.fields, T.StructField("place", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("head", T.StringType())]))
    turns, lengths = burst_trie.with_shared_openings(burst_trie.numbered_turns(df))
    # truncated division, as in SQL
    bases = {c: int(c / 100) * 100 for c in own}
    convs = {c: own.get(bases[c], [])[: zlib.crc32(str(c).encode()) % 6] + t[zlib.crc32(str(c).encode()) % 6 :] for c, t in own.items()}
    assert any(not t for t in convs.values())
    assert found(burst_trie.trie(turns, lengths, container_bytes=100)) == brute(convs)


def test_digest_of_many_ends(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("'k' ending", "id * 3 conv_id").unionAll(spark.sql("SELECT 'm' ending, CAST(-4 AS LONG) conv_id"))
    got = {r.ending: r.ends_sha256 for r in burst_trie.ordered_digests(rows, block_bytes=64).collect()}
    assert got == {"k": hashlib.sha256(",".join(str(3 * i) for i in range(5000)).encode()).hexdigest(), "m": hashlib.sha256(b"-4").hexdigest()}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert burst_trie.trie(*burst_trie.with_shared_openings(burst_trie.numbered_turns(df))).count() == 0
