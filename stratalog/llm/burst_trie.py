"""The prefix trie of conversations, built as a burst trie.

A turn's id is 128 bits of a digest of role and text, followed by the text's number
of code points, so ids compare, sort and join as fixed-width bytes. A conversation is
its ids in order; equal conversations are folded to one class with a count, so copies
cost no more than one.

1. The trie's heads hold containers of suffixes: what is left of each class below the
   head. A container above ``CONTAINER_BYTES`` bursts: its head becomes a node, and
   each suffix moves to the head one turn further on, chosen by its next turn id. Only
   the suffixes of bursting containers move, and this goes on until none is too large.
2. The containers that remain are dealt to tasks by head, each sorted and swept once:
   the common prefix of neighbours opens and closes nodes. A node's sums over its
   subtree are complete when the sweep leaves it.
3. Nodes that were burst get their sums from the heads below, each of which carries
   the burst heads above it.

Sequences are cut into segments of ``SEGMENT`` turns; the later ones are containers of
their own, under heads named by a running digest of what comes before, so a
conversation of any length never is one row. Segments that two different
conversations share are swept from the deepest up; all others in one go.

The conversations that end at a node are digested in order of id: ranges are joined to
blocks of text in parallel, and only blocks are streamed through the digest.

Defined results: null role and null text are empty; turns are ordered by turn (null
first), then role and text, so ties and repeated rows have one order. Rows without a
conversation id take part in nothing. The root has no text, and is there if there is
any conversation; an empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.operators.ordered import number, ordered_scan
from stratalog.session import settle_table

SEGMENT = 4096
CONTAINER_BYTES = 1 << 20
BLOCK_BYTES = 1 << 16
#: Bytes of a turn id, of which the last four are the text's code points.
ID = 20
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ending string, n_ends long, first_end long"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def turn_id(role: Column, text: Column) -> Column:
    """40 hexadecimal digits."""
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))


def numbered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1) and id of every turn of a conversation with an id."""
    empty = F.lit("")
    turns = df.select(df[conv].cast("long").alias("conv_id"), df[turn].alias("turn"), F.coalesce(df[role], empty).alias("role"), F.coalesce(df[text], empty).alias("text")).where("conv_id is not null")
    placed = ordered_scan(turns, ["conv_id"], ["turn", "role", "text"], {"place": number()})
    return settle_table(placed.select("conv_id", "place", turn_id(F.col("role"), F.col("text")).alias("id")), "turns")


def with_shared_openings(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations rebuilt on the first turns of conversation c - c % ``every``.

    The first h = crc32(c) % (most + 1) turns are those of that conversation (all if
    fewer, none if absent), then come a conversation's own turns after its first h.
    """
    counts = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    base = F.col("conv_id") - F.col("conv_id") % every
    wanted = counts.select("conv_id", "n", base.alias("base"), h.alias("h"))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    wanted = wanted.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    wanted = settle_table(wanted, "conversations")
    openings = turns.where(F.col("place") <= most).select(F.col("conv_id").alias("base"), "place", "id")
    first = openings.join(wanted.select("base", "conv_id", "h"), "base").where("place <= h").select("conv_id", "place", "id")
    own = turns.join(wanted.select("conv_id", "h", "taken"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "id")
    return first.unionByName(own), wanted.select("conv_id", "length")


def _segments(turns: DataFrame, lengths: DataFrame, segment: int) -> DataFrame:
    """conv_id, s, ids (binary), last, head and next (names of the nodes before and after), rest (code points after the segment)."""
    chars = F.conv(F.substring("id", 33, 8), 16, 10).cast("long")
    cut = turns.groupBy("conv_id", F.expr(f"(place - 1) div {segment}").alias("s")).agg(
        F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), "")).alias("ids"), F.sum(chars).alias("chars")
    )
    final = F.expr(f"greatest(length - 1, 0) div {segment}")
    rows = lengths.select("conv_id", final.alias("final")).join(cut, "conv_id", "left")
    rows = rows.select("conv_id", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("ids", F.lit(b"")).alias("ids"), F.coalesce("chars", F.lit(0)).alias("chars"), "final")
    short = rows.where("final = 0").select("conv_id", "s", "ids", F.lit(True).alias("last"), F.lit(0).cast("long").alias("rest"), F.lit("").alias("head"), *[F.lit(0).cast("decimal(38,0)").alias(c) for c in ("sum1", "sum2")])
    digest = F.md5(F.concat(F.col("s").cast("string").cast("binary"), F.col("ids")))
    parts = {c: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(28,0)") for c, at in (("d1", 1), ("d2", 16))}
    order = W.partitionBy("conv_id").orderBy("s")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    # a row per segment: a window over one conversation's segments
    long = rows.where("final > 0").withColumns(parts)
    long = long.select("conv_id", "s", "ids", (F.col("s") == F.col("final")).alias("last"), F.coalesce(F.sum("chars").over(after), F.lit(0)).alias("rest"), *[F.coalesce(F.sum(d).over(before), F.lit(0)).cast("decimal(38,0)").alias(c) for c, d in (("sum1", "d1"), ("sum2", "d2"))])
    long = long.withColumn("head", _head("s", F.col("sum1"), F.col("sum2")))
    every = short.unionByName(long)
    # the node after a full segment has one name, whether conversations end there or go on
    after_it = _head(F.col("s") + 1, *[F.col(c) + parts[d] for c, d in (("sum1", "d1"), ("sum2", "d2"))])
    return every.withColumn("next", F.when(F.length("ids") == segment * ID, after_it)).drop("sum1", "sum2")


def _head(s, one: Column, two: Column) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.when(s == 0, "").otherwise(F.md5(F.concat_ws(":", s.cast("string"), one.cast("decimal(38,0)").cast("string"), two.cast("decimal(38,0)").cast("string")).cast("binary")))


def trie(turns: DataFrame, lengths: DataFrame, segment: int = SEGMENT, container_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, place from 1, id) and ``lengths`` (conv_id, length).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (code points that sharing saves, over the subtree), n_ends and
    ends_sha256 (of the ids of the conversations that end there).
    """
    rows = _segments(turns, lengths, segment)
    ending = F.when(F.col("last"), F.md5(F.concat(F.concat_ws(":", F.col("s").cast("string"), "head").cast("binary"), F.lit(b"|"), F.col("ids"))))
    rows = settle_table(rows.withColumn("ending", ending), "segments")
    shape = ["s", "head", "ids", "ending", "next"]
    classes = settle_table(rows.groupBy(*shape).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.max("rest").alias("rest")), "classes")
    going = classes.where("ending is null")
    # how deep segments are shared by different conversations
    shared = classes.where("s > 0").groupBy("s", "head").count().where("count > 1").agg(F.max("s")).first()[0] or 0
    ended = classes.where("ending is not null and next is not null").select((F.col("s") + 1).alias("s"), F.col("next").alias("head"), F.col("first").alias("above"))
    classes = classes.join(ended, ["s", "head"], "left") if going.limit(1).count() else classes.withColumn("above", F.lit(None).cast("long"))

    more = F.col("ending").isNull()
    alone = {"next_children": F.when(more, 1).otherwise(0).cast("long"), "next_leaves": F.when(more, 1).otherwise(0).cast("long"), "next_saved": F.when(more, (F.col("n") - 1) * F.col("rest")).otherwise(0).cast("long")}
    nodes, totals = _level(classes.where(F.col("s") >= shared).withColumns(alone), segment, container_bytes)
    found = [nodes]
    for s in range(shared - 1, -1, -1):
        below = totals.where(F.col("s") == s + 1).select(F.col("head").alias("next"), "next_children", "next_leaves", "next_saved")
        level = classes.where(F.col("s") == s).join(below, "next", "left")
        level = level.withColumns({c: F.when(more, F.col(c)).otherwise(0).cast("long") for c in ("next_children", "next_leaves", "next_saved")})
        nodes, totals = _level(level, segment, container_bytes)
        found.append(nodes)
    every = found[0]
    for nodes in found[1:]:
        every = every.unionByName(nodes)
    several = classes.where("ending is not null and n > 1").select("ending")
    digests = ordered_digests(rows.select("ending", "conv_id").join(several, "ending"))
    joined = every.join(digests, "ending", "left")
    one = F.when(F.col("n_ends") == 0, F.sha2(F.lit(b""), 256)).otherwise(F.sha2(F.col("first_end").cast("string").cast("binary"), 256))
    return joined.select(*_NAMES[:7], "n_ends", F.coalesce("ends_sha256", one).alias("ends_sha256"))


def _level(classes: DataFrame, segment: int, container_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals of the containers' heads: s, head, next_children, next_leaves, next_saved) of some segments' classes."""
    start = {"at": F.col("head"), "base": F.col("s") * segment, "id": F.lit(None).cast("binary"), "path": F.array().cast("array<string>")}
    keep = ["s", "head", "at", "base", "id", "path", "ids", "n", "first", "ending", "next_children", "next_leaves", "next_saved", "above"]
    open_rows, closed, stops, burst = classes.withColumns(start).select(*keep), [], [], []
    while True:
        sizes = open_rows.groupBy("s", "at").agg(F.sum(F.length("ids")).alias("bytes"), F.count(F.lit(1)).alias("rows"))
        large = settle_table(sizes.where((F.col("bytes") > container_bytes) & (F.col("rows") > 1)).select("s", "at"), "large-containers")
        if not large.limit(1).count():
            closed.append(open_rows)
            break
        closed.append(open_rows.join(large, ["s", "at"], "left_anti").select(*keep))
        bursting = open_rows.join(large, ["s", "at"]).select(*keep)
        burst.append(bursting.groupBy("s", "at").agg(*[F.any_value(c).alias(c) for c in ("head", "base", "id", "path", "above")]))
        stops.append(bursting.where(F.length("ids") == 0))
        following = F.substring("ids", 1, ID)
        step = {"path": F.concat("path", F.array("at")), "at": F.md5(F.concat(F.col("at").cast("binary"), following)), "base": F.col("base") + 1, "id": following, "ids": F.expr(f"substring(ids, {ID + 1})")}
        open_rows = settle_table(bursting.where(F.length("ids") > 0).select(*[step[c].alias(c) if c in step else c for c in keep]), "suffixes")
    rows = closed[0]
    for part in closed[1:]:
        rows = rows.unionByName(part)
    swept = settle_table(_swept(rows), "trie-nodes")
    inner = swept.where("path is null").select(*_NAMES)
    heads = swept.where("path is not null")
    own = heads.where("base = s * %d" % segment)
    totals = own.select("s", "head", *[F.col(a).alias(b) for a, b in (("n_children", "next_children"), ("n_leaves", "next_leaves"), ("saved_tokens", "next_saved"))])
    root = own.where("s = 0").select(*_NAMES)
    if not burst:
        return inner.unionByName(root), totals
    halted, nodes = stops[0], burst[0]
    for more in stops[1:]:
        halted = halted.unionByName(more)
    for more in burst[1:]:
        nodes = nodes.unionByName(more)
    nodes = settle_table(nodes, "burst-heads")
    # what each burst head gets from the containers below, and from classes that stop at it or below
    below = heads.where("size(path) > 0").select("s", F.explode("path").alias("at"), F.col("conv_id").alias("first"), F.col("n_convs").alias("n"), F.col("n_leaves").alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * _chars()).alias("saved"))
    direct = heads.where("size(path) > 0").select("s", F.element_at("path", -1).alias("at"))
    direct = direct.unionByName(nodes.where("size(path) > 0").select("s", F.element_at("path", -1).alias("at"))).groupBy("s", "at").agg(F.count(F.lit(1)).alias("children"))
    through = halted.select("s", F.explode(F.concat("path", F.array("at"))).alias("at"), "first", "n", F.col("next_leaves").alias("leaves"), F.col("next_saved").alias("saved"))
    sums = below.unionByName(through).groupBy("s", "at").agg(F.min("first").alias("first"), *[F.sum(c).alias(c) for c in ("n", "leaves", "saved")])
    ends = halted.groupBy("s", "at").agg(F.max("ending").alias("ending"), F.sum("next_children").alias("more"), F.sum(F.when(F.col("ending").isNotNull(), F.col("n")).otherwise(0)).alias("n_ends"), F.min(F.when(F.col("ending").isNotNull(), F.col("first"))).alias("first_end"))
    full = settle_table(nodes.join(sums, ["s", "at"]).join(direct, ["s", "at"]).join(ends, ["s", "at"], "left"), "burst-sums")
    gains = full.select("s", F.explode("path").alias("at"), ((F.col("n") - 1) * _chars()).alias("gain")).groupBy("s", "at").agg(F.sum("gain").alias("gain"))
    full = full.join(gains, ["s", "at"], "left").select(
        "s", "at", "head", "base", "id", "path", F.least("first", "above").alias("named"), "first", F.col("n").alias("n_convs"),
        (F.col("children") + F.coalesce("more", F.lit(0))).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.coalesce("gain", F.lit(0))).alias("below"), "ending", F.coalesce("n_ends", F.lit(0)).alias("n_ends"), "first_end",
    )
    full = settle_table(full, "burst-nodes")
    mine = full.where("base = s * %d" % segment).select("s", "head", F.col("n_children").alias("next_children"), F.col("n_leaves").alias("next_leaves"), F.col("below").alias("next_saved"))
    parents = full.select("s", F.col("at").alias("_parent"), F.col("named").alias("_first"))
    of_burst = full.where("s = 0 or size(path) > 0").select("s", F.element_at(F.when(F.size("path") > 0, F.col("path")), -1).alias("_parent"), F.col("first").alias("conv_id"), F.col("base").alias("depth"), "n_convs", "n_children", "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * _chars()).alias("saved_tokens"), "ending", "n_ends", "first_end")
    of_heads = heads.where("size(path) > 0").select("s", F.element_at("path", -1).alias("_parent"), "conv_id", F.col("base").alias("depth"), "n_convs", "n_children", "n_leaves", (F.col("saved_tokens") + (F.col("n_convs") - 1) * _chars()).alias("saved_tokens"), "ending", "n_ends", "first_end")
    upper = of_burst.unionByName(of_heads).join(parents, ["s", "_parent"], "left").withColumn("parent_conv_id", F.col("_first")).select(*_NAMES)
    return inner.unionByName(root).unionByName(upper), totals.unionByName(mine)


def _chars() -> Column:
    """Code points of the turn that leads to a head; 0 for the root of a container."""
    return F.coalesce(F.conv(F.substring(F.hex("id"), 2 * ID - 7, 8), 16, 10).cast("long"), F.lit(0))


def _swept(rows: DataFrame) -> DataFrame:
    """The nodes of every container; its head has a path and the sums below it, its own turn left out."""
    ordered = rows.repartition("s", "at").sortWithinPartitions("s", "at", "ids")

    def run(batches):
        held, key = [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if key != (row["s"], row["at"]):
                    if held:
                        out += sweep(held)
                    held, key = [], (row["s"], row["at"])
                held.append(row)
            if out:
                yield _nodes(out)
        if held:
            yield _nodes(sweep(held))

    return ordered.mapInArrow(run, f"{_NODE}, s long, head string, base long, id binary, path array<string>")


def sweep(rows: list[dict]) -> list[tuple]:
    """The nodes of one container's sorted suffixes, as tuples; the head comes first."""
    top = rows[0]
    depth, parent, chars = [top["base"]], [-1], [0]
    n, first, children, leaves, saved, ending, ends, first_end = [0], [None], [0], [0], [0], [None], [0], [None]
    open_nodes, previous = [0], b""
    for row in rows:
        ids, same = row["ids"], 0
        most = min(len(ids), len(previous)) // ID
        while same < most and ids[same * ID : same * ID + ID] == previous[same * ID : same * ID + ID]:
            same += 1
        del open_nodes[same + 1 :]
        for k in range(same, len(ids) // ID):
            above = open_nodes[-1]
            children[above] += 1
            open_nodes.append(len(depth))
            depth.append(depth[above] + 1)
            parent.append(above)
            chars.append(int.from_bytes(ids[k * ID + ID - 4 : k * ID + ID], "big"))
            for values, empty in ((n, 0), (first, None), (children, 0), (leaves, 0), (saved, 0), (ending, None), (ends, 0), (first_end, None)):
                values.append(empty)
        at, previous = open_nodes[-1], ids
        n[at] += row["n"]
        first[at] = row["first"] if first[at] is None else min(first[at], row["first"])
        children[at] += row["next_children"]
        leaves[at] += row["next_leaves"]
        saved[at] += row["next_saved"]
        if row["ending"] is not None:
            ending[at], ends[at], first_end[at] = row["ending"], row["n"], row["first"]
    for at in range(len(depth) - 1, 0, -1):
        if not children[at]:
            leaves[at] = 1
        above = parent[at]
        n[above] += n[at]
        first[above] = first[at] if first[above] is None else min(first[above], first[at])
        leaves[above] += leaves[at]
        saved[at] += (n[at] - 1) * chars[at]
        saved[above] += saved[at]
    if not children[0]:
        leaves[0] = 1
    named = first[0] if top["above"] is None else min(first[0], top["above"])
    out = [(first[0], depth[0], None, n[0], children[0], leaves[0], saved[0], ending[0], ends[0], first_end[0], top["s"], top["head"], top["base"], top["id"], top["path"])]
    for at in range(1, len(depth)):
        over = named if parent[at] == 0 else first[parent[at]]
        out.append((first[at], depth[at], over, n[at], children[at], leaves[at], saved[at], ending[at], ends[at], first_end[at], top["s"], None, None, None, None))
    return out


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    types = [long] * 7 + [text, long, long, long, text, long, pa.binary(), pa.list_(text)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*_NAMES, "s", "head", "base", "id", "path"])


def ordered_digests(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """ending and ends_sha256: the SHA-256 of its conversation ids, ascending and comma-joined."""
    ranged = rows.repartitionByRange("ending", "conv_id").sortWithinPartitions("ending", "conv_id")

    def blocks(batches):
        key, held, size = None, [], 0
        for batch in batches:
            out = []
            for ending, conv in zip(*(batch.column(c).to_pylist() for c in ("ending", "conv_id"))):
                if held and (ending != key or size > block_bytes):
                    out.append((key, held[0], ",".join(map(str, held))))
                    held, size = [], 0
                key = ending
                held.append(conv)
                size += len(str(conv)) + 1
            if out:
                yield _texts(out)
        if held:
            yield _texts([(key, held[0], ",".join(map(str, held)))])

    joined = ranged.select("ending", "conv_id").mapInArrow(blocks, "ending string, conv_id long, ids string")
    dealt = joined.repartition("ending").sortWithinPartitions("ending", "conv_id")

    def digests(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for ending, ids in zip(*(batch.column(c).to_pylist() for c in ("ending", "ids"))):
                if ending != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = ending, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["ending", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["ending", "ends_sha256"])

    return dealt.mapInArrow(digests, "ending string, ends_sha256 string")


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["ending", "conv_id", "ids"])
