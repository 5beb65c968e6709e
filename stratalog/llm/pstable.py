"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to length 1. A table hashes a vector with ``FUNCTIONS``
projections on Gaussian directions, each shifted and cut into steps of ``WIDTH``;
vectors with equal steps share a bucket. Every pair that shares a bucket of any of
the ``TABLES`` tables gets its exact cosine in double precision. A vector carries its
buckets of all tables, so a pair is counted in the first table it shares and in no
other. Only a count and the root of its local component leave a task per vector and
block, never lists of pairs.

Vectors of one direction (equal unit vectors, told by two 64-bit digests) are one class
from the start, with a count; hashing, buckets and comparisons know classes only, so a
vector that comes a million times costs no more than one.

A bucket with more than ``BLOCK`` classes is dealt as blocks to groups of two blocks
each, so that no task holds more than two blocks at once and a crowded bucket is
spread over as many tasks as it needs.

At cosine 0.9 a pair shares no bucket with probability (1 - p^FUNCTIONS)^TABLES,
p = 0.82: 8 in 1,000; at 0.92, 2 in 1,000; at 0.95, below 1 in 10,000.

Defined results: vectors that are null, zero or hold null or non-finite components
link with nothing; vectors of different lengths do not link; rows without an id
link with nothing and their component is null. Every row is a vector of its own: rows
that repeat id or vector are returned as often as they come, and link with each other
like any others; empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.components import components
from stratalog.llm.words import mixed
from stratalog.session import settle_table

TABLES, FUNCTIONS, WIDTH = 32, 10, 2.0
LEAST_COSINE = 0.9
BLOCK = 1024
SEED = 41


def _directions(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([SEED, dimension])
    return draw.standard_normal((dimension, TABLES * FUNCTIONS)), draw.uniform(0, WIDTH, TABLES * FUNCTIONS)


def buckets(unit: np.ndarray) -> np.ndarray:
    """int32 bucket of each vector (rows, all of one length) in each table."""
    directions, shifts = _directions(unit.shape[1])
    steps = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, FUNCTIONS)
    h = np.broadcast_to(np.arange(TABLES, dtype=np.uint64) + np.uint64(TABLES * unit.shape[1]), (len(unit), TABLES)).copy()
    for k in range(FUNCTIONS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + steps[:, :, k])
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _units(lists: pa.Array):
    """(rows, unit vectors) of each vector length of a batch of complete vectors."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        vectors = values[starts[rows][:, None] + np.arange(d)]
        vectors = vectors / np.abs(vectors).max(1, keepdims=True)
        yield rows, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _keyed(usable: DataFrame) -> DataFrame:
    """vec_id, v, key and check (digests of the unit vector)."""
    kinds = {f.name: f.dataType.simpleString() for f in usable.schema.fields}

    def run(batches):
        for batch in batches:
            key, check = (np.zeros(batch.num_rows, np.uint64) for _ in range(2))
            for rows, unit in _units(batch.column(1)):
                bits = (unit + 0.0).view(np.uint64)  # -0.0 is 0.0
                one, two = np.full(len(rows), unit.shape[1], np.uint64), np.full(len(rows), 7, np.uint64)
                for k in range(unit.shape[1]):
                    one = mixed(one * np.uint64(0x9E3779B97F4A7C15) + bits[:, k])
                    two = mixed((two ^ bits[:, k]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))
                key[rows], check[rows] = one, two
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key.view(np.int64)), pa.array(check.view(np.int64))], names=["vec_id", "v", "key", "check"])

    return usable.mapInArrow(run, f"vec_id {kinds['vec_id']}, v {kinds['v']}, key bigint, check bigint")


def _hashed(classes: DataFrame) -> DataFrame:
    """vec_id (of the class), copies, v, hashes (one bucket per table)."""
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, TABLES), np.int32)
            for rows, unit in _units(batch.column(2)):
                out[rows] = buckets(unit)
            hashes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TABLES), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], names=["vec_id", "copies", "v", "hashes"])

    return classes.mapInArrow(run, f"vec_id bigint, copies bigint, v {kinds['v']}, hashes array<int>")


def _dealt(hashed: DataFrame, block: int) -> DataFrame:
    """One row per table, group and vector; crowded buckets go to pairs of blocks."""
    at = hashed.select("vec_id", "copies", "v", "hashes", F.posexplode("hashes").alias("t", "bucket"))
    sizes = hashed.select(F.posexplode("hashes").alias("t", "bucket")).groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("size"))
    crowded = settle_table(sizes.where(F.col("size") > block), "crowded-buckets")
    blocks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("vec_id", "bucket"), blocks.cast("long")).cast("int")
    placed = at.join(crowded, ["t", "bucket"], "left").select("vec_id", "copies", "v", "hashes", "t", "bucket", blocks.alias("blocks"), own.alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("vec_id", "copies", "v", "hashes", "t", "bucket", "own", other)
    return spread.select("vec_id", "copies", "v", "hashes", "t", "bucket", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _links(ids, unit, hashes, t: int, own, lo: int, hi: int, least: float):
    """Positions (i, j), i < j, of linked pairs that this group is to count."""
    first = np.flatnonzero(own == lo)
    second = first if lo == hi else np.flatnonzero(own == hi)
    found_i, found_j = [], []
    for start in range(0, len(first), 512):
        a = first[start : start + 512]
        for other in range(start if lo == hi else 0, len(second), 512):
            b = second[other : other + 512]
            near = unit[a] @ unit[b].T >= least - 1e-9
            i, j = np.nonzero(near)
            i, j = a[i], b[j]
            keep = (i < j) if lo == hi else np.ones(len(i), bool)
            keep &= ids[i] != ids[j]
            i, j = i[keep], j[keep]
            earlier = (hashes[i, :t] == hashes[j, :t]).any(1) if t else np.zeros(len(i), bool)
            i, j = i[~earlier], j[~earlier]
            exact = np.einsum("nd,nd->n", unit[i], unit[j]) >= least
            found_i.append(i[exact])
            found_j.append(j[exact])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def partial_links(dealt: DataFrame, least: float) -> DataFrame:
    """Per group and linked class: vec_id, n (vectors of the partners counted here) and root (one vector of those it reaches here)."""
    ordered = dealt.repartition("t", "bucket", "lo", "hi").sortWithinPartitions("t", "bucket", "lo", "hi", "own", "vec_id")
    kind = dealt.schema["vec_id"].dataType.simpleString()

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(c).to_numpy() for c in ("t", "bucket", "lo", "hi")]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(edge):
                yield from _groups(held.slice(0, edge[-1]), np.concatenate([[0], edge]), least)
                held = held.slice(edge[-1])
        if held is not None and held.num_rows:
            yield from _groups(held, np.array([0, held.num_rows]), least)

    return ordered.mapInArrow(run, f"vec_id {kind}, n bigint, root {kind}")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first position that each of ``n`` reaches over the pairs."""
    roots = np.arange(n)
    while True:
        least, new = np.minimum(roots[i], roots[j]), roots.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, roots):
            return roots
        roots = new


def _groups(table: pa.Table, edges: np.ndarray, least: float):
    table = table.combine_chunks()
    kind = table.schema.field("vec_id").type
    ids, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
    lists = table.column("v").combine_chunks()
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(float), lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    hashes = table.column("hashes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, TABLES)
    t, own, lo, hi = (table.column(c).to_numpy() for c in ("t", "own", "lo", "hi"))
    out_id, out_n, out_root = [], [], []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a < 2:
            continue
        vectors = values[starts[a] : starts[a] + (b - a) * sizes[a]].reshape(b - a, sizes[a])
        vectors = vectors / np.abs(vectors).max(1, keepdims=True)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        i, j = _links(ids[a:b], unit, hashes[a:b], t[a], own[a:b], lo[a], hi[a], least)
        if not len(i):
            continue
        who, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        n = np.zeros(len(who), np.int64)
        np.add.at(n, place, copies[a + np.concatenate([j, i])])
        out_id.append(ids[a + who])
        out_n.append(n)
        out_root.append(ids[a + _roots(b - a, i, j)[who]])
    if out_id:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id), kind), pa.array(np.concatenate(out_n).astype(np.int64)), pa.array(np.concatenate(out_root), kind)], names=["vec_id", "n", "root"])


def near_duplicates(df: DataFrame, vector: str = "embedding", vec: str = "vec_id", least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id (smallest id reachable, itself included), kept."""
    rows = df.select(df[vec].alias("vec_id"), df[vector].alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    complete = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False))
    keyed = _keyed(rows.where(complete))
    classes = keyed.groupBy("key", "check").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.any_value("v").alias("v"))
    # numbered once, by the written rows
    classes = settle_table(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    hashed = settle_table(_hashed(classes.select(F.col("class").alias("vec_id"), "copies", "v")), "vector-buckets")
    found = settle_table(partial_links(_dealt(hashed, block), least), "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("others")).withColumnRenamed("vec_id", "class")
    labelled = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    placed = classes.select("class", "key", "check", "copies", "first_id").join(counts, "class", "left").join(labelled, "class", "left")
    placed = settle_table(placed.withColumn("component", F.coalesce("component", "class")), "vector-components")
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = placed.join(smallest, "component").select("key", "check", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = keyed.select("vec_id", "key", "check").join(of_class, ["key", "check"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(complete, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
