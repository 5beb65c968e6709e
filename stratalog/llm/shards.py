"""Training-order materialisation: every sequence at its own global slot.

1. Tasks encode their documents, end each with ``END_ID`` and cut the stream into
   sequences of ``SEQUENCE`` ids; the last of a task may be shorter. They are
   written once, with the task's number and a running number.
2. Counts per task give each sequence a dense number below N. A keyed Feistel
   network over the next even power of two, walked along its cycle until the value
   is below N, turns the number into its slot: a permutation of 0 .. N - 1.
3. Sequences are range-partitioned by shard (slot div ``PER_SHARD``), sorted, and
   written as fixed-stride records: a 4-byte count, then ``SEQUENCE`` little-endian
   16-bit ids, padded with ``END_ID``. A slot's place is arithmetic, so a reader
   goes on from any slot.

Shards are written under a temporary name and moved to their own, so a repeated
task replaces like with like. Token rows are zstd-compressed for the shuffle.

Defined results: a null or empty text gives its end id only; an empty table gives no
shard; repeated rows give their sequences as often; null ids of documents stay null;
further columns are ignored. Ids must be below 65,536.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.llm import bpe
from stratalog.llm.words import mixed
from stratalog.session import scratch, settle_table

SEQUENCE, PER_SHARD, END_ID = 8192, 2048, 50256
#: Shards in a row that one task writes at most, beyond the number of shuffle partitions.
SHARDS_A_TASK = 32
ROUNDS = 6
KEY = 0x5EED


def slots(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each number below ``n``: a keyed permutation of 0 .. n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(ROUNDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))
    out = numbers.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        value = out[walking]
        left, right = value >> shift, value & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[walking] = (left << shift) | right
        walking = out >= np.uint64(n)
    return out.astype(np.int64)


def stride(sequence: int) -> int:
    return 4 + 2 * sequence


def sequences(df: DataFrame, text: str, doc: str, sequence: int, rank_file: str) -> DataFrame:
    """part, number (running within the part), n_tokens, ids (16-bit, little-endian), doc_ids."""
    source = df.select(df[doc].alias("doc_id"), df[text].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder, part, number = bpe.encoding(rank_file, public_tokenizers.PATTERN), TaskContext.get().partitionId(), 0
        tokens, owners, held, doc_type = [], [], 0, pa.int64()

        def cut(final: bool):
            """Sequences of what is held; the rest stays."""
            nonlocal tokens, owners, held, number
            stream = np.concatenate(tokens) if tokens else np.zeros(0, np.uint16)
            ends = np.cumsum([len(t) for t in tokens])
            whole = len(stream) // sequence
            n = whole + (1 if final and len(stream) % sequence else 0)
            at = np.arange(n) * sequence
            upto = np.minimum(at + sequence, len(stream))
            first, last = np.searchsorted(ends, at, "right"), np.searchsorted(ends, upto - 1, "right")
            arrays = [
                pa.array(np.full(n, part, np.int32)),
                pa.array(np.arange(number, number + n)),
                pa.array((upto - at).astype(np.int32)),
                pa.array([stream[a:b].tobytes() for a, b in zip(at, upto)], pa.binary()),
                pa.array([owners[a : b + 1] for a, b in zip(first, last)], pa.list_(doc_type)),
            ]
            number += n
            rest = stream[n * sequence :]
            if len(rest):
                k = int(np.searchsorted(ends, n * sequence, "right"))
                lengths = np.diff(np.concatenate([[n * sequence], ends[k:]]))
                tokens, owners = np.split(rest, np.cumsum(lengths)[:-1]), owners[k:]
            else:
                tokens, owners = [], []
            held = len(rest)
            return pa.RecordBatch.from_arrays(arrays, names=["part", "number", "n_tokens", "ids", "doc_ids"])

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for owner, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = bpe.encode_text(encoder, value.as_py())
                tokens.append(np.append(found, END_ID).astype("<u2"))
                owners.append(owner)
                held += len(found) + 1
                if held >= 64 * sequence:
                    yield cut(False)
        yield cut(True)

    return source.mapInArrow(run, f"part int, number bigint, n_tokens int, ids binary, doc_ids array<{kind}>")


def write_shards(df: DataFrame, folder: str, text: str = "text", doc: str = "doc_id", *, sequence: int = SEQUENCE, per_shard: int = PER_SHARD, key: int = KEY, rank_file: str = bpe.RANKS) -> DataFrame:
    """Write all shards below ``folder``; gives a row per sequence: slot, shard, path, offset, n_tokens, doc_ids."""
    spark = df.sparkSession
    place = scratch(spark, "sequences")
    made = sequences(df, text, doc, sequence, rank_file)
    made.write.option("compression", "zstd").parquet(place)
    made = spark.read.schema(made.schema).parquet(place)
    counts = made.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle_table(counts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n"), "sequence-offsets")
    n = int(offsets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(slots(number.to_numpy(), n, key))

    @F.pandas_udf("binary")
    def packed(ids: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=3)
        return ids.map(lambda x: pack.compress(bytes(x)))

    numbered = made.join(offsets, made["part"] == offsets["_part"]).withColumn("slot", slot_of(F.col("start") + F.col("number")))
    rows = numbered.select(F.expr(f"slot div {per_shard}").alias("shard"), "slot", "n_tokens", packed("ids").alias("ids"), "doc_ids")
    shards = max(1, -(-n // per_shard))
    # a task writes up to SHARDS_A_TASK shards that follow one another
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tasks = min(shards, max(shuffle, -(-shards // SHARDS_A_TASK)))
    ordered = rows.repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "slot")
    kind = made.schema["doc_ids"].dataType.simpleString()

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        unpack, shard, sink, temporary, target = zstandard.ZstdDecompressor(), None, None, None, None

        def close():
            if sink is not None:
                sink.close()
                store.move(temporary, target)

        for batch in batches:
            paths, offsets = [], []
            for own, slot, count, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if own != shard:
                    close()
                    shard, name = own, f"shard-{own:08d}.bin"
                    target, temporary = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temporary)
                raw = unpack.decompress(ids, max_output_size=2 * sequence)
                sink.write(count.to_bytes(4, "little") + raw + END_ID.to_bytes(2, "little") * (sequence - count))
                paths.append(f"{folder.rstrip('/')}/shard-{own:08d}.bin")
                offsets.append((slot - own * per_shard) * stride(sequence))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(paths, pa.string()), pa.array(offsets, pa.int64()), batch.column(2), batch.column(4)], names=["slot", "shard", "path", "offset", "n_tokens", "doc_ids"])
        close()

    return settle_table(ordered.mapInArrow(run, f"slot bigint, shard bigint, path string, offset bigint, n_tokens int, doc_ids {kind}"), "shard-manifest")


def read_shards(shards: DataFrame, sequence: int = SEQUENCE, per_shard: int = PER_SHARD, start: int = 0) -> DataFrame:
    """Sequences of the shards (shard, path), from slot ``start`` on: slot, n_tokens, ids. Each shard is read in order."""
    wanted = shards.where(F.col("shard") >= start // per_shard).select("shard", "path").distinct()
    step = stride(sequence)

    def run(batches):
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as source:
                    slot = max(start, shard * per_shard)
                    source.seek((slot - shard * per_shard) * step)
                    while block := source.read(64 * step):
                        counts = [int.from_bytes(block[k : k + 4], "little") for k in range(0, len(block), step)]
                        ids = [block[k + 4 : k + 4 + 2 * c] for k, c in zip(range(0, len(block), step), counts)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slot, slot + len(counts))), pa.array(counts, pa.int32()), pa.array(ids, pa.binary())], names=["slot", "n_tokens", "ids"])
                        slot += len(counts)

    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return wanted.repartition(parts, "shard").mapInArrow(run, "slot bigint, n_tokens int, ids binary")
