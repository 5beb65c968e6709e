"""MinHash near-duplicates by an LSH forest: sorted signature orders, neighbours by common prefix.

1. Each text becomes its set of distinct word shingles (64-bit hashes) and a
   signature of ``TREES * DEPTH`` 16-bit min-hash values. Texts with equal sets
   form one class, found by two digests of the set; from here on there are
   classes only, and a copied text costs no more than one.
2. A tree's label is its own ``DEPTH`` values followed by those of the next tree.
   All labels are range-partitioned and sorted; a class is compared with the
   ``NEAR`` classes that follow it in the same region, that is while the common
   prefix is at least ``DEPTH`` values long. As the order goes on by the deeper
   values, a crowded region is divided as deep as it needs, and the longest
   common prefixes stand next to each other. Partition edges are joined on.
3. Of every region, the class that is central (whose regions are the largest, over
   all trees) is compared with each member, so copies that differ from one original
   in different places are found though they are not alike among themselves.
4. Comparisons with central classes are confirmed first, on full sets. Of the
   remaining candidates only those that would join two components are confirmed.
5. In regions of up to ``CROWD`` classes, members that the central class does not reach
   are compared with all others, but for those of one component and those whose sketches
   (four bits of each min-hash value) differ in more values than similar sets do by four
   and a half standard deviations; the sketches are looked at inside the join, so what
   does not fit is never a row.
6. What shares no region, or stands apart in a crowded one, is found without chance: sets
   of enough similarity share one of their rarest members, as many as may be missing and
   one. Those of all classes are dealt by value; values that the same classes have count as
   one. Of those that classes of different components have, all classes are compared across
   components by their places in either order, after which enough members must be left, and
   by digests of 512 bits, whose differing bits are never more than the members that differ.
   What that cannot tell is confirmed on full sets, so no link between two components is
   left out.

How often a value occurs is counted in ``COUNTERS`` sums; that only decides the order in
which a set's members count as rare. Links are exact.

Defined results: null and empty texts have no shingles and link with nothing; rows
without an id take part in no link, their component is null; repeated rows are
returned as often as they come; an empty table gives an empty table; columns other
than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.llm.components import components
from stratalog.llm.words import Words, distinct_sets, mixed, per_row, shingles, text_slices, within
from stratalog.operators.blocks import tree_reduce
from stratalog.session import settle_table

TREES, DEPTH, NEAR = 20, 5, 2
#: Classes of a region that are all compared with each other by their sketches.
CROWD = 64
#: Sums that values are counted in, words of 64 bits of a set's digest, and comparisons of digests made together.
COUNTERS, DIGEST, TOGETHER = 1 << 19, 8, 1 << 20
#: Words of the longer digest by which pairs are looked at again before their sets are moved.
LONG_DIGEST = 128
#: Rows of an order that a task holds at once.
HELD_ROWS = 50_000
SHINGLE, SIMILAR = 5, 80
_LONGS = -(-TREES * DEPTH // 16)
_SEEDS = np.random.default_rng(64).integers(1, 1 << 63, (TREES * DEPTH, 2), dtype=np.uint64) | np.uint64(1)


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """uint16 min-hash values, one row per set."""
    out = np.zeros((len(counts), len(_SEEDS)), np.uint16)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    starts = (np.cumsum(counts) - counts)[some]
    for k, (times, plus) in enumerate(_SEEDS):
        least = np.minimum.reduceat(values * times + plus, starts)
        out[some, k] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _sets(batch_texts, n: int):
    for lo, hi, data, offsets in text_slices(batch_texts):
        words = Words(data, offsets)
        values, counts = shingles(words.hashes(lower=True), words.first, words.counts, n, short=True)
        yield lo, hi, *distinct_sets(values, counts)


def _digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = per_row(np.add, mixed(values ^ np.uint64(0x5851F42D4C957F2D)), counts, np.uint64(0))
    two = per_row(np.bitwise_xor, mixed(values ^ np.uint64(0x14057B7EF767814F)), counts, np.uint64(0))
    return mixed(one + counts.astype(np.uint64)).view(np.int64), two.view(np.int64)


def features(df: DataFrame, text: str, doc: str, n: int) -> DataFrame:
    """doc_id, version (digest of the text), n_shingles, key (digest of the set), check (another digest), signature, sketch (the lowest four bits of each value, as longs)."""
    source = df.select(df[doc].alias("doc_id"), df[text].alias("text"), F.xxhash64(df[text]).alias("version"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, values, counts in _sets(batch.column(1), n):
                key, check = _digests(values, counts)
                found = signatures(values, counts).astype(">u2")
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(_SEEDS)), hi - lo, [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
                low = np.zeros((hi - lo, 16 * _LONGS), np.uint8)
                low[:, : len(_SEEDS)] = found & 15
                low = (low[:, ::2] << 4 | low[:, 1::2]).view(np.int64)
                names = ["doc_id", "version", "n_shingles", "key", "check", "signature", "sketch"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array(key), pa.array(check), raw, pa.FixedSizeListArray.from_arrays(pa.array(low.ravel()), _LONGS).cast(pa.list_(pa.int64()))], names=names)

    return source.mapInArrow(run, f"doc_id {kind}, version long, n_shingles long, key long, check long, signature binary, sketch array<long>")


def long_digests(df: DataFrame, text: str, n: int) -> DataFrame:
    """key, size and the long digest, one row per row of ``df``."""

    def run(batches):
        for batch in batches:
            for lo, hi, values, counts in _sets(batch.column(0), n):
                key, _ = _digests(values, counts)
                digest = pa.FixedSizeListArray.from_arrays(pa.array(set_digests(values, counts, LONG_DIGEST).ravel()), LONG_DIGEST).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(counts.astype(np.int64)), digest], names=["key", "size", "digest"])

    return df.select(df[text].alias("text")).mapInArrow(run, "key long, size long, digest array<long>")


def sets_of(df: DataFrame, text: str, n: int) -> DataFrame:
    """key and the sorted set as an array of long, one row per row of ``df``."""

    def run(batches):
        for batch in batches:
            for lo, hi, values, counts in _sets(batch.column(0), n):
                key, _ = _digests(values, counts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))], names=["key", "members"])

    return df.select(df[text].alias("text")).mapInArrow(run, "key long, members array<long>")


def frequencies(df: DataFrame, text: str, n: int) -> np.ndarray:
    """How often the shingles of each counter occur in all texts."""

    def count(batches) -> bytes | None:
        total = None
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                words = Words(data, offsets)
                values, _ = shingles(words.hashes(lower=True), words.first, words.counts, n, short=True)
                found = np.bincount((values % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
                total = found if total is None else total + found
        return None if total is None else np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()

    def add(a: bytes, b: bytes) -> bytes:
        both = np.frombuffer(a, np.uint32).astype(np.int64) + np.frombuffer(b, np.uint32)
        return np.minimum(both, 0xFFFFFFFF).astype(np.uint32).tobytes()

    state = tree_reduce(df.select(df[text].alias("text")), count, add, 4 * COUNTERS)
    return np.zeros(COUNTERS, np.uint32) if state is None else np.frombuffer(state, np.uint32)


def rarest(values: np.ndarray, counts: np.ndarray, often: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the rarest members, one more than a similar set may lack, and their number."""
    rows = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, often[(values % np.uint64(COUNTERS)).astype(np.int64)], rows))
    wanted = np.where(counts > 0, counts - -(-similar * counts // 100) + 1, 0)
    at = np.repeat(np.cumsum(counts) - counts, wanted) + within(wanted)
    return values[order][at], wanted


def set_digests(values: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """Words of 64 bits per set; each member turns one bit, so that no more bits differ than members do."""
    bits, rows = 64 * words, np.repeat(np.arange(len(counts)), counts)
    spots = (mixed(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(rows * bits + spots, minlength=len(counts) * bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(len(counts), words)


def class_sets(df: DataFrame, text: str, full: str, n: int, similar: int, often: np.ndarray) -> DataFrame:
    """key, size, digest, the rarest members and, where ``full`` says so, all members; one row per set of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(often)

    def lists(values: np.ndarray, counts: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=None if mask is None else np.append(mask, False))
        return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))

    def run(batches):
        for batch in batches:
            for lo, hi, values, counts in _sets(batch.column(0), n):
                key, _ = _digests(values, counts)
                digests = set_digests(values, counts, DIGEST)
                wanted = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                members = values[np.repeat(wanted, counts)]
                arrays = [pa.array(key), pa.array(counts.astype(np.int64)), lists(digests.ravel(), np.full(hi - lo, DIGEST)), lists(*rarest(values, counts, shared.value, similar)), lists(members, np.where(wanted, counts, 0), ~wanted)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "size", "digest", "rarest", "members"])

    found = df.select(df[text].alias("text"), df[full].alias("full")).mapInArrow(run, "key long, size long, digest array<long>, rarest array<long>, members array<long>").where("size > 0")
    return found.groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("size", "digest", "rarest")], F.any_value("members", True).alias("members"))


def labels(classes: DataFrame) -> DataFrame:
    """One row per tree and class: tree, label (binary, twice DEPTH values), key."""
    width = 2 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    first = F.expr(f"substring(signature, tree * {width} + 1, {width})")
    second = F.expr(f"substring(signature, (tree + 1) % {TREES} * {width} + 1, {width})")
    return classes.select("key", "signature", tree).select("tree", F.concat(first, second).alias("label"), "key")


def neighbours(rows: DataFrame, near: int = NEAR) -> DataFrame:
    """Sorted order of all trees: a row per pair of close neighbours (a, b), and per member its region.

    Output: region (long hash of tree and prefix), key, other (a later neighbour or
    null), and for the first and last rows of a partition their place, for the edges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = rows.repartitionByRange(parts, "tree", "label", "key").sortWithinPartitions("tree", "label", "key")
    width = 2 * DEPTH

    def run(batches):
        part, held, place = TaskContext.get().partitionId(), None, 0

        def emit(table: pa.Table, upto: int, last: bool):
            """Pairs that start in the first ``upto`` rows."""
            n = table.num_rows
            keys, tree = table.column("key").to_numpy(), table.column("tree").to_numpy().astype(np.uint64)
            label = table.column("label").combine_chunks()
            start = np.frombuffer(label.buffers()[1], np.int32)[label.offset]
            own = np.frombuffer(label.buffers()[2], ">u2")[start // 2 : start // 2 + n * 2 * DEPTH].reshape(n, 2 * DEPTH)[:, :DEPTH]
            region = mixed(tree + np.uint64(1))
            for k in range(DEPTH):
                region = mixed(region ^ own[:, k].astype(np.uint64))
            region = region.view(np.int64)
            pairs = []
            for step in range(1, near + 1):
                at = np.arange(0, min(upto, n - step))
                at = at[region[at] == region[at + step]]
                pairs.append((region[at], keys[at], keys[at + step]))
            region_out = np.concatenate([region[:upto], *[p[0] for p in pairs]])
            key_out = np.concatenate([keys[:upto], *[p[1] for p in pairs]])
            other = pa.concat_arrays([pa.nulls(upto, pa.int64()), *[pa.array(p[2], pa.int64()) for p in pairs]])
            spots = np.full(len(region_out), -1, np.int64)
            at = np.arange(upto)
            spots[:upto][(at + place < near) | (last & (at >= n - near))] = 0
            spots[:upto] = np.where(spots[:upto] == 0, at + place, -1)
            return pa.RecordBatch.from_arrays([pa.array(region_out), pa.array(key_out), other, pa.array(np.full(len(region_out), part, np.int32)), pa.array(spots)], names=["region", "key", "other", "part", "place"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if held.num_rows > HELD_ROWS:
                upto = held.num_rows - near
                yield emit(held, upto, False)
                place += upto
                held = held.slice(upto)
        if held is not None and held.num_rows:
            yield emit(held, held.num_rows, True)

    return ordered.mapInArrow(run, "region long, key long, other long, part int, place long")


def _edge_pairs(found: DataFrame, near: int) -> DataFrame:
    """Pairs across partition edges: of ``near`` rows on either side, a few per partition."""
    edge = found.where("place >= 0 and other is null")
    order = W.orderBy("part", "place")
    steps = [F.struct(F.lead("region", k).over(order).alias("region"), F.lead("key", k).over(order).alias("key"), F.lead("part", k).over(order).alias("part")) for k in range(1, near + 1)]
    follow = edge.select("region", "key", "part", *[step.alias(f"n{k}") for k, step in enumerate(steps)])
    pairs = follow.select("region", "key", "part", F.explode(F.array(*[f"n{k}" for k in range(near)])).alias("n"))
    return pairs.select("region", "key", "part", "n.*").toDF("region", "key", "part", "r", "other", "p").where("r = region and p <> part").select("region", "key", "other")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= similar * union."""
    left = sets.select(F.col("key").alias("a"), F.col("members").alias("_a"))
    right = sets.select(F.col("key").alias("b"), F.col("members").alias("_b"))
    # both sides grow with the corpus: sorted and merged at every size
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    both = F.size(F.array_intersect("_a", "_b"))
    return joined.where(100 * both >= similar * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def _may_be_similar(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose long digests differ in no more bits than members of similar sets of their sizes may."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("key").alias(end), F.col("size").alias(f"_n{end}"), F.col("digest").alias(f"_d{end}")), end)
    differing = F.aggregate(F.zip_with("_da", "_db", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)
    return pairs.where(differing * (100 + similar) <= (F.col("_na") + F.col("_nb")) * (100 - similar)).select("a", "b")


def _ordered(a: str, b: str, df: DataFrame) -> DataFrame:
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def near_duplicates(df: DataFrame, text: str = "text", doc: str = "doc_id", n: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """Per row of ``df``: doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    joined = _grouped(df, text, doc, n, similar)
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(df: DataFrame, text: str = "text", doc: str = "doc_id", n: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """``df`` with one row of each group of linked rows: the one of smallest id, then of smallest digest of its text.

    Rows without shingles or without an id stay.
    """
    rows = _grouped(df, text, doc, n, similar).where("group is not null").select("group", "doc_id", "version")
    keepers = rows.groupBy("group").agg(F.min(F.struct("doc_id", "version")).alias("keep"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = settle_table(rows.join(keepers, "group"), "minhash-groups")
    kept = F.struct("doc_id", "version") == F.col("keep")
    names = F.col("doc_id").alias("_id"), F.col("version").alias("_version")
    gone = settle_table(several.where(~kept).select(*names).distinct(), "minhash-gone")
    repeats = settle_table(several.where(kept).groupBy("doc_id", "version").count().where("count > 1").select(*names), "minhash-repeats")

    def match(rows: DataFrame, ids: DataFrame):
        return (rows[doc] == ids["_id"]) & (F.xxhash64(rows[text]) == ids["_version"])

    left = df.join(gone.hint("merge"), match(df, gone), "left_anti")
    if not repeats.limit(1).count():
        return left
    again = left.join(repeats, match(left, repeats), "left_semi")
    return left.join(repeats, match(left, repeats), "left_anti").unionByName(again.dropDuplicates([doc, text]))


def _grouped(df: DataFrame, text: str, doc: str, n: int, similar: int) -> DataFrame:
    """Per row of ``df``: doc_id, version, n_shingles, group (of linked rows) and component_id, null where nothing can link."""
    docs = settle_table(features(df, text, doc, n), "minhash-features")
    linked = docs.where("n_shingles > 0 and doc_id is not null")
    one = F.any_value(F.struct("signature", "sketch")).alias("one")
    classes = settle_table(linked.groupBy("key", "check").agg(F.min("doc_id").alias("first_id"), one).select("key", "first_id", "one.*"), "minhash-classes")
    found = settle_table(neighbours(labels(classes)), "minhash-order")
    # regions with company only; a lone class has no candidates
    placed = found.where("other is null").select("region", "key")
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = settle_table(placed.join(sizes, "region"), "minhash-regions")
    central = members.groupBy("key").agg(F.sum("size").alias("score")).join(classes.select("key", "first_id", "sketch"), "key")
    central = settle_table(central, "minhash-central")
    members = members.join(central.drop("first_id"), "key")

    # one text of each class; all members of those with company
    firsts = classes.select("key", "first_id").join(central.select("key", F.lit(True).alias("met")), "key", "left").groupBy("first_id").agg(F.coalesce(F.bool_or("met"), F.lit(False)).alias("full"))
    texts = df.select(df[doc].alias("doc_id"), df[text].alias("text"))
    firsts = texts.join(firsts.hint("merge"), F.col("doc_id") == F.col("first_id"))
    every = settle_table(class_sets(firsts, "text", "full", n, similar, frequencies(df, text, n)), "minhash-sets")
    sets = every.where("members is not null").select("key", "members")

    # every member with the central class of its region
    centre = members.groupBy("region").agg(F.max_by(F.struct("key", "sketch"), F.struct("score", "key")).alias("centre"))
    compared = settle_table(members.join(centre.select("region", F.col("centre.key").alias("centre"), F.col("centre.sketch").alias("central")), "region"), "minhash-members")
    pairs = _ordered("key", "centre", compared.where(_alike("sketch", "central", similar)))
    links = settle_table(confirmed(settle_table(pairs, "minhash-pairs"), sets, similar), "minhash-links")
    labelled = settle_table(components(links), "minhash-components")

    # what that has not joined: close neighbours, and all members of regions that are not crowded
    near = found.where("other is not null").select("key", "other").union(_edge_pairs(found, NEAR).select("key", "other"))
    near = _across(_ordered("key", "other", near), labelled)
    placed = _placed(compared, labelled)
    few = placed.where(F.col("size") <= CROWD)
    one, two = few.where("apart").alias("one"), few.alias("two")
    fit = (F.col("one.region") == F.col("two.region")) & (F.col("one.own") != F.col("two.own")) & (~F.col("two.apart") | (F.col("one.key") < F.col("two.key")))
    rest = one.join(two, fit & _alike("one.sketch", "two.sketch", similar)).select(F.col("one.key").alias("key"), F.col("two.key").alias("other"))
    pairs = settle_table(near.union(_ordered("key", "other", rest)).distinct(), "minhash-pairs")
    links = settle_table(confirmed(pairs, sets, similar), "minhash-links")
    labelled = _relabelled(labelled, links)

    # whatever is similar still, across components
    pairs = settle_table(across_components(every, labelled, similar), "minhash-pairs")
    pairs = settle_table(_may_be_similar(pairs, _of_ends(pairs, classes, texts, long_digests, n), similar), "minhash-pairs")
    few = _of_ends(pairs, classes, texts, sets_of, n)
    links = settle_table(confirmed(pairs, few, similar), "minhash-links")
    labelled = _relabelled(labelled, links)
    of_class = _labelled(classes.select("key", "first_id"), labelled, "key", "_component")
    smallest = of_class.groupBy("_component").agg(F.min("first_id").alias("component_id"))
    resolved = of_class.join(smallest, "_component").select(F.col("key").alias("_key"), F.col("_component").alias("group"), "component_id")
    joined = docs.join(resolved, (docs["key"] == F.col("_key")) & docs["doc_id"].isNotNull() & (docs["n_shingles"] > 0), "left")
    return joined.select("doc_id", "version", "n_shingles", "group", "component_id")


def _of_ends(pairs: DataFrame, classes: DataFrame, texts: DataFrame, of, n: int) -> DataFrame:
    """What ``of`` (``long_digests`` or ``sets_of``) says of the classes in ``pairs``, read from their first texts."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(classes.select("key", "first_id"), "key")
    ends = settle_table(ends, "minhash-ends")
    asked = texts.join(ends.select("first_id").distinct(), F.col("doc_id") == F.col("first_id"), "left_semi")
    return settle_table(of(asked, "text", n).join(ends.select("key"), "key", "left_semi").dropDuplicates(["key"]), "minhash-few")


def _placed(compared: DataFrame, labelled: DataFrame) -> DataFrame:
    """The members with their component (own), and whether it is another than that of their region's central class (apart)."""
    named = _labelled(_labelled(compared, labelled, "key", "own"), labelled, "centre", "its")
    return settle_table(named.select("region", "key", "size", "own", "sketch", "score", (F.col("own") != F.col("its")).alias("apart")), "minhash-placed")


def _relabelled(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after the new ``links`` (a, b) between different components."""
    ends = _labelled(_labelled(links, labelled, "a", "_ca"), labelled, "b", "_cb")
    merged = components(ends.select(F.col("_ca").alias("a"), F.col("_cb").alias("b")))
    merged = settle_table(merged.withColumnsRenamed({"node": "_old", "component": "_new"}), "minhash-merged")
    known = labelled.join(merged, F.col("component") == F.col("_old"), "left").select("node", F.coalesce("_new", "component").alias("component"))
    fresh = merged.join(labelled.select("node"), F.col("_old") == F.col("node"), "left_anti").toDF("node", "component")
    return settle_table(known.unionByName(fresh), "minhash-components")


def _most_differing(similar: int) -> int:
    """Values in which the sketches of sets of the least similarity differ, at most: as expected and four and a half standard deviations."""
    n, share = len(_SEEDS), (100 - similar) / 100 * 15 / 16
    return int(n * share + 4.5 * (n * share * (1 - share)) ** 0.5)


def across_components(sets: DataFrame, labelled: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` in different components that have one of their rarest members in common, but for those whose digests differ in too many bits."""
    return candidates(sets, labelled, similar).distinct()


def candidates(sets: DataFrame, labelled: DataFrame, similar: int) -> DataFrame:
    """The pairs of ``across_components``, some of them more than once.

    A pair that is similar shows at its first value in common: no common member stands before it
    in either set's order, so those after it must do for the intersection. Values that the same
    sets have are compared as one, the first of them, as that is the first for every pair.
    """
    named = _labelled(sets.select("key", "size", "rarest"), labelled, "key", "own")
    rows = named.select(F.posexplode("rarest").alias("place", "value"), "key", "own", "size")

    def whole_values(batches):
        """Tables of whole values, and where each begins."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            value = held.column("value").to_numpy()
            last = int(np.searchsorted(value, value[-1]))
            if last:
                yield held.slice(0, last), np.flatnonzero(np.concatenate([[True], value[1:last] != value[: last - 1]]))
                held = held.slice(last)
        if held is not None and held.num_rows:
            value = held.column("value").to_numpy()
            yield held, np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))

    def several(batches):
        for table, opens in whole_values(batches):
            size, place = (table.column(c).to_numpy().astype(np.int64) for c in ("size", "place"))
            least = np.repeat(np.minimum.reduceat(size, opens), np.diff(np.append(opens, len(size))))
            left = (100 + similar) * (size - place) >= similar * (size + np.maximum(least, -(-similar * size // 100)))
            value, key, own = (table.column(c).to_numpy()[left] for c in ("value", "key", "own"))
            if not len(value):
                continue
            opens = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            counts = np.diff(np.append(opens, len(value)))
            met = np.repeat(np.minimum.reduceat(own, opens) != np.maximum.reduceat(own, opens), counts)
            holders, check = (np.repeat(x, counts)[met] for x in _digests(key.view(np.uint64), counts))
            arrays = [pa.array(x) for x in (holders, check, key[met], own[met], size[left][met], place[left][met])]
            yield pa.RecordBatch.from_arrays(arrays, names=["holders", "check", "key", "own", "size", "place"])

    ordered = rows.repartition("value").sortWithinPartitions("value")
    met = ordered.mapInArrow(several, "holders long, check long, key long, own long, size long, place long")
    first = [F.min(c).alias(c) for c in ("own", "size", "place")]
    met = settle_table(met.groupBy("holders", "check", "key").agg(*first).withColumnRenamed("holders", "value"), "minhash-met")
    digested = met.join(sets.select("key", "digest"), "key").select("value", "key", "own", "size", "place", "digest")

    def near(i: np.ndarray, j: np.ndarray, key: np.ndarray, own: np.ndarray, size: np.ndarray, left: np.ndarray, digest: np.ndarray):
        fit = (own[i] != own[j]) & (100 * np.minimum(size[i], size[j]) >= similar * np.maximum(size[i], size[j]))
        fit &= (100 + similar) * np.minimum(left[i], left[j]) >= similar * (size[i] + size[j])
        i, j = i[fit], j[fit]
        bits = np.bitwise_count(digest[i] ^ digest[j]).sum(1, dtype=np.int64)
        fit = bits * (100 + similar) <= (size[i] + size[j]) * (100 - similar)
        i, j = key[i[fit]], key[j[fit]]
        if len(i):
            both = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def compare(batches):
        for table, opens in whole_values(batches):
            key, own, size, place = (table.column(c).to_numpy() for c in ("key", "own", "size", "place"))
            left = size - place
            digest = table.column("digest").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, DIGEST)
            rows = np.diff(np.append(opens, len(key)))
            few, done = np.flatnonzero(rows <= CROWD), 0
            load = np.cumsum(rows[few] ** 2)
            while done < len(few):
                upto = max(done + 1, int(np.searchsorted(load, (load[done - 1] if done else 0) + TOGETHER // DIGEST, "right")))
                begin, count = opens[few[done:upto]], rows[few[done:upto]]
                i = np.repeat(begin, count) + within(count)
                earlier = i - np.repeat(begin, count)
                j = np.repeat(np.repeat(begin, count), earlier) + within(earlier)
                yield from near(np.repeat(i, earlier), j, key, own, size, left, digest)
                done = upto
            for group in np.flatnonzero(rows > CROWD).tolist():
                lo, n = opens[group], int(rows[group])
                _, component, members = np.unique(own[lo : lo + n], return_inverse=True, return_counts=True)
                # those of the largest component come last and are compared with the others only
                largest = component == members.argmax()
                order = lo + np.concatenate([np.flatnonzero(~largest), np.flatnonzero(largest)])
                start, rest = 0, int((~largest).sum())
                while start < rest:
                    upto = min(rest, start + max(1, TOGETHER // (DIGEST * n)))
                    yield from near(np.repeat(order[start:upto], n - start), np.tile(order[start:], upto - start), key, own, size, left, digest)
                    start = upto

    ordered = digested.repartition("value").sortWithinPartitions("value")
    return ordered.mapInArrow(compare, "a long, b long")


def _alike(a: str, b: str, similar: int):
    """Whether two sketches may be those of similar sets."""
    most = _most_differing(similar)
    differing = F.lit(0)
    for k in range(_LONGS):
        bits = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        differing = differing + F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))
    return differing <= most


def _labelled(rows: DataFrame, labelled: DataFrame, key: str, out: str) -> DataFrame:
    """Add the component of ``key``: its own where it has no link."""
    return rows.join(labelled.withColumnsRenamed({"node": "_node", "component": "_found"}), F.col(key) == F.col("_node"), "left").withColumn(out, F.coalesce("_found", key)).drop("_node", "_found")


def _across(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    return _labelled(_labelled(pairs, labelled, "a", "_ca"), labelled, "b", "_cb").where("_ca <> _cb").select("a", "b")
