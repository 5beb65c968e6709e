import numpy as np
import pytest
from llm_helpers import awkward, documents, prose
from stratalog.llm import bpe, shards
from stratalog.session import scratch


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 255, 256, 257, 5000])
@pytest.mark.parametrize("key", [0, 1, 2**63 + 5])
def test_slots_are_a_permutation(n, key):
    found = shards.slots(np.arange(n), n, key)
    assert sorted(found.tolist()) == list(range(n))
    if n > 200:
        assert (found != shards.slots(np.arange(n), n, key + 1)).mean() > 0.9
        assert (found != np.arange(n)).mean() > 0.9


def stream_of(rows):
    encoder = bpe.encoding(bpe.RANKS, bpe.public_tokenizers.PATTERN)
    return {i: [*encoder.encode_ordinary(t or ""), shards.END_ID] for i, t in rows}


def test_every_token_is_written_once_and_readable_from_any_slot(spark):
    rows = [(i, prose(i, i % 300)) for i in range(150)] + [(900, prose(5, 9000)), (901, None), (902, "")]
    df = documents(spark, rows).repartition(5)
    folder = scratch(spark, "shard-test")
    manifest = shards.write_shards(df, folder, sequence=64, per_shard=16)
    made = manifest.collect()
    n = len(made)
    assert sorted(r.slot for r in made) == list(range(n))
    assert all(r.shard == r.slot // 16 and r.offset == r.slot % 16 * shards.stride(64) for r in made)
    read = {r.slot: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in shards.read_shards(manifest, 64, 16).collect()}
    assert {r.slot: r.n_tokens for r in made} == {s: len(t) for s, t in read.items()}
    # the documents of a sequence are those of its tokens
    streams = stream_of(rows)
    total = sum(map(len, streams.values()))
    assert sum(map(len, read.values())) == total
    assert {i for r in made for i in r.doc_ids} == set(streams)
    text = {i: ",".join(map(str, t)) for i, t in streams.items()}
    for r in made:
        if len(r.doc_ids) > 2:
            inner = ",".join(",".join(map(str, streams[i])) for i in r.doc_ids[1:-1])
            assert inner in ",".join(map(str, read[r.slot]))
        assert all(i in text for i in r.doc_ids)
    late = {r.slot: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in shards.read_shards(manifest, 64, 16, start=37).collect()}
    assert late == {s: t for s, t in read.items() if s >= 37}


def test_awkward_and_empty(spark):
    rows = awkward(spark)
    df = documents(spark, rows)
    manifest = shards.write_shards(df, scratch(spark, "shard-test"), sequence=128, per_shard=1000)
    encoder = bpe.encoding(bpe.RANKS, bpe.public_tokenizers.PATTERN)
    assert manifest.selectExpr("sum(n_tokens)").first()[0] == sum(len(encoder.encode_ordinary(t or "")) + 1 for _, t, _ in rows)
    empty = shards.write_shards(df.where("false"), scratch(spark, "shard-test"))
    assert empty.count() == 0 and shards.read_shards(empty).count() == 0


def test_bytes_of_every_shard(spark, monkeypatch):
    """The files are, byte for byte, the packed sequences of the one input partition at their slots."""
    monkeypatch.setattr(shards, "SHARDS_A_TASK", 3)
    rows = [(i, prose(i, 5 + i % 90)) for i in range(120)]
    manifest = shards.write_shards(documents(spark, rows).coalesce(1).sortWithinPartitions("doc_id"), scratch(spark, "shard-test"), sequence=32, per_shard=7, key=9)
    stream = [t for tokens in stream_of(rows).values() for t in tokens]
    pieces = [stream[i : i + 32] for i in range(0, len(stream), 32)]
    place = shards.slots(np.arange(len(pieces)), len(pieces), 9)
    size = shards.stride(32)
    expected = bytearray(size * len(pieces))
    for slot, piece in zip(place.tolist(), pieces):
        packed = np.array(piece + [shards.END_ID] * (32 - len(piece)), "<u2").tobytes()
        expected[slot * size : (slot + 1) * size] = len(piece).to_bytes(4, "little") + packed
    paths = {r.shard: r.path for r in manifest.select("shard", "path").distinct().collect()}
    assert sorted(paths) == list(range(-(-len(pieces) // 7)))
    assert b"".join(open(paths[s].removeprefix("file:"), "rb").read() for s in sorted(paths)) == bytes(expected)
