"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Words are runs of ASCII letters and digits and of all characters outside ASCII, A-Z
lower-cased. A benchmark item's windows are its runs of ``WINDOW`` words; an item of
fewer words is one window. A document word inside any occurrence of a window is hit.

1. Equal windows are folded, whichever items they come from. A window's tokens are
   its shingles of ``SHINGLE`` words (all of its words where it has fewer).
2. All documents are counted for those tokens: a bitmap of the tokens' hashes lets
   only theirs through, and counts are summed before they are shuffled.
3. A window is contained in a document only if all of its tokens are, so the prefix
   that has to meet is one token, the rarest. A window with a token that no document
   has is dropped there and then.
4. A second scan meets those tokens alone. Position bounds keep what leaves room for
   the window on both sides, length bounds what has as many words, and containment
   is verified over the item-sized window, word by word (64-bit hashes).

If the windows that are left fit ``BROADCAST_BYTES``, they are given to every task,
which finishes its documents without a shuffle. Beyond that, the tokens' places are
joined with the windows by token, each with the words around it. Both ways give the
same rows. The bitmap is at most ``BITMAP_BITS`` bits at any size of the benchmark.

Defined results: null and empty texts have no words, and as documents no hits; items
without words have no windows. An item without an id hits words like any other but is
in no list; texts of one item id are windows of one item. Repeated documents and rows
without an id are returned as often as they come. With no items nothing is hit; an
empty table of documents gives an empty table. Other columns are ignored whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.llm.words import NOT_ALNUM, Words, mixed, shingles, text_slices, within
from stratalog.operators.blocks import tree_reduce
from stratalog.session import settle_table

WINDOW, SHINGLE = 10, 5
BROADCAST_BYTES = 64 << 20
BITMAP_BITS = 1 << 29
#: Candidates that a task looks at together.
TOGETHER = 1 << 20


def _worded(texts):
    """(first row, last row + 1, words, their hashes) of slices of ``texts``."""
    for lo, hi, data, offsets in text_slices(texts):
        words = Words(data, offsets, NOT_ALNUM)
        yield lo, hi, words, words.hashes(lower=True)


def _token_hashes(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of ``size`` words of every row and the place of each in ``hashes``."""
    values, usable = shingles(hashes, first, counts, size, short=False)
    return mixed(values + np.uint64(size)), np.repeat(first, usable) + within(usable)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def item_windows(items: DataFrame, text: str, item: str, window: int) -> DataFrame:
    """item (as string) and words (hashes, in order), a row per window."""

    def run(batches):
        for batch in batches:
            for lo, hi, words, hashes in _worded(batch.column(1)):
                size = np.minimum(words.counts, window)
                n = np.where(words.counts > 0, np.maximum(words.counts - window, 0) + 1, 0)
                starts = np.repeat(words.first, n) + within(n)
                sizes = np.repeat(size, n)
                take = np.repeat(starts, sizes) + within(sizes)
                owner = pa.array(np.repeat(np.arange(lo, hi), n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), _lists(hashes[take], sizes)], names=["item", "words"])

    return items.select(items[item].cast("string").alias("item"), items[text].alias("text")).mapInArrow(run, "item string, words array<long>").distinct()


def window_tokens(windows: DataFrame, shingle: int) -> DataFrame:
    """words, token, place (of the token in the window) and size (words of the token)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            first = np.cumsum(counts) - counts
            for size in np.unique(np.minimum(counts, shingle)).tolist():
                rows = np.flatnonzero(np.minimum(counts, shingle) == size)
                tokens, at = _token_hashes(hashes, first[rows], counts[rows], size)
                owner = np.repeat(rows, counts[rows] - size + 1)
                arrays = [lists.take(pa.array(owner)), pa.array(tokens.view(np.int64)), pa.array((at - first[owner]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["words", "token", "place", "size"])

    return windows.select("words").mapInArrow(run, "words array<long>, token long, place int, size int")


class TokenFilter:
    """A bitmap of token hashes; it lets all given tokens through and few others."""

    def __init__(self, tokens: DataFrame, count: int):
        bits = 1 << 20
        while bits < min(64 * count, BITMAP_BITS):
            bits *= 2
        self.shift = np.uint64(64 - bits.bit_length() + 1)
        shift = self.shift

        def reduce(batches):
            found, some = np.zeros(bits // 8, np.uint8), False
            for batch in batches:
                at = (batch.column(0).to_numpy().view(np.uint64) >> shift).astype(np.int64)
                np.bitwise_or.at(found, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
                some = some or len(at) > 0
            return found.tobytes() if some else None

        def either(a: bytes, b: bytes) -> bytes:
            return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()

        state = tree_reduce(tokens.select("token"), reduce, either, bits // 8) or bytes(bits // 8)
        self.shared = tokens.sparkSession.sparkContext.broadcast(state)  # at most BITMAP_BITS bits

    def passing(self, tokens: np.ndarray) -> np.ndarray:
        at = (tokens >> self.shift).astype(np.int64)
        return np.flatnonzero(np.frombuffer(self.shared.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def token_counts(docs: DataFrame, known: TokenFilter, sizes: list[int]) -> DataFrame:
    """token and n, its occurrences in all documents; a few tokens that were not asked for may be among them."""

    def run(batches):
        for batch in batches:
            for _, _, words, hashes in _worded(batch.column(0)):
                for size in sizes:
                    tokens, _ = _token_hashes(hashes, words.first, words.counts, size)
                    values, counts = np.unique(tokens[known.passing(tokens)], return_counts=True)
                    if len(values):
                        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """words, token, place, size and n of the rarest token of every window whose tokens all occur in documents."""
    tokens = settle_table(window_tokens(windows, shingle), "window-tokens")
    kinds = tokens.groupBy("size").agg(F.approx_count_distinct("token").alias("tokens")).collect()  # a row per token size
    known = TokenFilter(tokens, sum(r.tokens for r in kinds))
    counted = settle_table(token_counts(docs, known, sorted(r["size"] for r in kinds)), "token-counts")
    seen = tokens.join(counted, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = seen.groupBy("words").agg(F.min(F.struct("n", "token", "place", "size")).alias("prefix"))
    return settle_table(rarest.where("prefix.n > 0").select("words", "prefix.*"), "window-prefixes")


_FOUND = "n_words long, n_hit long, spans array<struct<first_word:long,end_word:long>>, items array<string>"


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unions of the ranges lo .. hi, ends excluded, in order."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    opens = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[opens], hi[np.concatenate([opens[1:] - 1, [len(lo) - 1]])]


class _Probe:
    """The windows that are left, by token, as arrays for every task."""

    def __init__(self, rows: list, owners: dict[tuple, list[str]]):
        rows = sorted(rows, key=lambda r: (r.token, r.words))
        self.width = max(len(r.words) for r in rows)
        self.words = np.array([list(r.words) + [0] * (self.width - len(r.words)) for r in rows], np.int64).view(np.uint64)
        self.length = np.array([len(r.words) for r in rows], np.int64)
        self.place = np.array([r.place for r in rows], np.int64)
        self.sizes = sorted({r.size for r in rows})
        token = np.array([r.token for r in rows], np.int64)
        self.tokens, self.opens, self.counts = np.unique(token, return_index=True, return_counts=True)
        self.items = [owners.get(tuple(r.words), []) for r in rows]

    def occurrences(self, words: Words, hashes: np.ndarray, known: TokenFilter):
        """(row, start in ``hashes``, window) of every occurrence."""
        closes = words.first + words.counts
        out = [(np.zeros(0, np.int64),) * 3]
        for size in self.sizes:
            tokens, at = _token_hashes(hashes, words.first, words.counts, size)
            some = known.passing(tokens)
            tokens, at = tokens[some].view(np.int64), at[some]
            found = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            same = self.tokens[found] == tokens
            found, at = found[same], at[same]
            row = np.searchsorted(words.first, at, "right") - 1
            n = self.counts[found]
            edges = np.concatenate([[0], np.cumsum(n)])
            start = 0
            while start < len(at):
                end = max(start + 1, int(np.searchsorted(edges, edges[start] + TOGETHER, "right")) - 1)
                part = slice(start, end)
                window = np.repeat(self.opens[found[part]], n[part]) + within(n[part])
                rows, begins = np.repeat(row[part], n[part]), np.repeat(at[part], n[part]) - self.place[window]
                fits = (begins >= words.first[rows]) & (begins + self.length[window] <= closes[rows])
                rows, begins, window = rows[fits], begins[fits], window[fits]
                for k in range(self.width):
                    right = self.length[window] <= k
                    inner = np.flatnonzero(~right)
                    right[inner] = hashes[begins[inner] + k] == self.words[window[inner], k]
                    rows, begins, window = rows[right], begins[right], window[right]
                out.append((rows, begins, window))
                start = end
        return [np.concatenate(c) for c in zip(*out)]


def _by_broadcast(docs: DataFrame, prefix: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = prefix.collect()  # bounded by BROADCAST_BYTES, as are the items below
    known = TokenFilter(prefix, len(rows))
    owners: dict[tuple, list[str]] = {}
    for pair in pairs.join(prefix.select("words"), "words", "left_semi").where("item is not null").collect():
        owners.setdefault(tuple(pair.words), []).append(pair["item"])
    shared = docs.sparkSession.sparkContext.broadcast(_Probe(rows, owners) if rows else None)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_hit", "spans", "items"]

    def run(batches):
        probe = shared.value
        for batch in batches:
            for lo, hi, words, hashes in _worded(batch.column(1)):
                n_hit, spans, items = np.zeros(hi - lo, np.int64), [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                row, begins, window = probe.occurrences(words, hashes, known) if probe else [np.zeros(0, np.int64)] * 3
                order = np.lexsort((begins, row))
                row, begins, window = row[order], begins[order], window[order]
                edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else np.zeros(1, int)
                for a, b in zip(edges[:-1], edges[1:]):
                    one = int(row[a])
                    opens, closes = _spans(begins[a:b] - words.first[one], begins[a:b] - words.first[one] + probe.length[window[a:b]])
                    n_hit[one] = (closes - opens).sum()
                    spans[one] = [{"first_word": x, "end_word": y} for x, y in zip(opens.tolist(), closes.tolist())]
                    items[one] = sorted({i for w in np.unique(window[a:b]).tolist() for i in probe.items[w]}, key=lambda i: i.encode())
                struct = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(words.counts.astype(np.int64)), pa.array(n_hit), pa.array(spans, struct), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_FOUND}")


def _by_join(docs: DataFrame, prefix: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """The same, with the places of the tokens joined to the windows by token."""
    known = TokenFilter(prefix, prefix.count())
    sizes = [r["size"] for r in prefix.select("size").distinct().collect()]  # at most SHINGLE of them
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        names = ["doc_id", "version", "n_words", "token", "at", "before", "around"]
        for batch in batches:
            for lo, hi, words, hashes in _worded(batch.column(2)):
                n = len(words.counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(words.counts.astype(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
                closes = words.first + words.counts
                for size in sizes:
                    tokens, at = _token_hashes(hashes, words.first, words.counts, size)
                    some = known.passing(tokens)
                    tokens, at = tokens[some], at[some]
                    row = np.searchsorted(words.first, at, "right") - 1
                    opens, ends = np.maximum(at - window + 1, words.first[row]), np.minimum(at + window, closes[row])
                    around = _lists(hashes[np.repeat(opens, ends - opens) + within(ends - opens)], ends - opens)
                    owner = pa.array(row + lo)
                    arrays = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(words.counts[row].astype(np.int64)), pa.array(tokens.view(np.int64)), pa.array(at - words.first[row]), pa.array(at - opens), around]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {kind}, version long, n_words long, token long, at long, before long, around array<long>"
    scanned = settle_table(rows.mapInArrow(scan, schema), "token-places")
    every = scanned.where("token is null").select("doc_id", "version", "n_words")
    starts = F.col("at") - F.col("place")
    room = (F.col("place") <= F.col("before")) & (starts + F.size("words") <= F.col("n_words"))
    own = F.slice("around", (F.col("before") - F.col("place") + 1).cast("int"), F.size("words"))
    met = scanned.where("token is not null").join(prefix.select("token", "words", "place"), "token").where(room).where(own == F.col("words"))
    met = settle_table(met.select("doc_id", "version", starts.alias("lo"), (starts + F.size("words")).alias("hi"), "words").distinct(), "window-places")
    order = W.partitionBy("doc_id", "version").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    ranges = met.select("doc_id", "version", "lo", "hi").distinct()
    opened = ranges.withColumn("opens", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("opens").over(order))
    unions = opened.groupBy("doc_id", "version", "island").agg(F.min("lo").alias("first_word"), F.max("hi").alias("end_word"))
    hit = unions.groupBy("doc_id", "version").agg(F.sum(F.col("end_word") - F.col("first_word")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first_word", "end_word"))).alias("spans"))
    items = met.select("doc_id", "version", "words").distinct().join(pairs.where("item is not null"), "words").select("doc_id", "version", "item").distinct()
    listed = items.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list("item")).alias("items"))
    same = F.col("h.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("h.version") == F.col("l.version"))
    found = hit.alias("h").join(listed.alias("l"), same, "left").select(F.col("h.doc_id").alias("_id"), F.col("h.version").alias("_version"), "n_hit", "spans", "items")
    joined = every.join(found, every["doc_id"].eqNullSafe(F.col("_id")) & (every["version"] == F.col("_version")), "left")
    kinds = {c.split()[0]: c.split(" ", 1)[1] for c in _FOUND.split(", ")}
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *[F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c) for c in ("spans", "items")])


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", doc: str = "doc_id", item_text: str = "text", item: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, most_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, spans (hit words as merged ranges) and items (ids as strings, sorted)."""
    docs = docs.select(docs[doc].alias("doc_id"), docs[text].alias("text"))
    pairs = settle_table(item_windows(items, item_text, item, window), "item-windows")
    windows = pairs.select("words").distinct()
    prefix = prefixes(windows, docs, shingle)
    share = pairs.join(prefix.select("words"), "words", "left_semi").agg(F.sum(F.coalesce(F.length("item"), F.lit(0)) + 8), F.count(F.lit(1))).first()
    size = (share[0] or 0) + share[1] * 8 * (window + 6)
    return _by_broadcast(docs, prefix, pairs) if size <= most_bytes else _by_join(docs, prefix, pairs, window)
