"""Quality rules: word and line statistics, and a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: one of
all trusted documents, one of the whole corpus, counted over all documents; only
``BUCKETS`` sums reach the driver. No text is moved to find the trusted documents: every
task has a filter of hashed trusted ids, and of the ids that pass it those that are not
trusted are found by a join of ids alone and left out. A
document's own n-grams are left out of the counts that it is scored by: otherwise
those of trusted documents would speak for themselves in a small corpus. A score
is the sum of the n-grams' log ratios over their number, so length does not
matter. One threshold holds for all documents: as far below the trusted documents'
mean as ``MARGIN`` and ``DEVIATIONS`` say.

Defined results: a null text has no words; a text without words scores 0; an
empty corpus, or one without trusted documents, scores all 0 and passes all, so
only the base rules decide; repeated rows are counted and returned as often as they come;
columns of the input are kept whatever their names, apart from those added here.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.words import SPACES, Words, _range_hashes, free_name, mixed, shingles, text_slices
from stratalog.session import settle_table

BUCKETS = 1 << 14
#: How far below the mean of the trusted documents a score may lie: the larger of a fixed margin and of so many standard deviations.
MARGIN, DEVIATIONS = 0.06, 5.0
PRIOR = 1.0
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: Bits of the filter for each trusted id, at most in all, and those that an id sets.
ID_BITS, FILTER_BITS, PROBES = 16, 1 << 27, 4

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_LETTER = (~SPACES & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int64)


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and word pair."""
    single = words.hashes()
    pairs, n = shingles(single, words.first, words.counts, 2, short=False)
    values = np.concatenate([single, pairs])
    rows = np.concatenate([words.rows(), np.repeat(np.arange(len(n)), n)])
    return (values >> np.uint64(49)).astype(np.int64) % BUCKETS, rows


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_statistics(data: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n = len(words.counts)
    breaks = np.flatnonzero(data == 0x0A)
    edges = np.unique(np.concatenate([offsets[:-1], breaks, breaks + 1, offsets[1:]]))
    starts, ends = edges[:-1], edges[1:]
    some = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[some], ends[some]
    lines = np.searchsorted(offsets, starts, "right") - 1
    repeated = np.zeros(n, np.int64)
    if len(starts):
        keys = _range_hashes(data, starts, ends) ^ mixed(lines.astype(np.uint64) + np.uint64(1))
        _, firsts = np.unique(keys, return_index=True)
        repeated = np.bincount(lines, minlength=n) - np.bincount(lines[firsts], minlength=n)
    windows, counts = shingles(words.hashes(), words.first, words.counts, 3, short=False)
    n_all = len(words.starts) + 1
    covered = np.zeros(n_all, np.int64)
    if len(windows):
        rows = np.repeat(np.arange(n), counts)
        keys = windows ^ mixed(rows.astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        at = words.first[rows[at]] + at - (np.cumsum(counts) - counts)[rows[at]]
        covered = np.bincount(at, minlength=n_all) - np.bincount(at + 3, minlength=n_all)
    inside = (np.cumsum(covered)[:-1] > 0).astype(np.int64)
    bounds = np.concatenate([words.first, [len(words.starts)]])
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _sums(_LETTER[data], offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": repeated,
        "n_repeat_words": _sums(inside, bounds),
    }


@dataclass
class NgramModel:
    """N-gram counts per bucket of the corpus and of its trusted documents, and the threshold."""

    corpus: np.ndarray
    target: np.ndarray
    threshold: float = -1.0
    trusted: DataFrame | None = None  # their ids, once each; stays with the driver
    passes: np.ndarray | None = None  # the filter of their ids
    kind: T.DataType | None = None  # the type that their ids are compared in

    def scores(self, buckets: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio of the n-grams of each of ``n`` rows, were it trusted and were it not, with its own n-grams taken out of the counts that they are in."""
        size = len(self.corpus)
        length = np.bincount(rows, minlength=n)
        if not self.target.sum():
            return np.zeros(n), np.zeros(n)
        key, own = np.unique(rows * size + buckets, return_counts=True)
        row, bucket = key // size, key % size
        corpus = (self.corpus[bucket] - own + PRIOR) / ((self.corpus.sum() - length) + PRIOR * size)[row]
        found = []
        for within in (1, 0):
            # what would be below nothing belongs to a row that is not trusted
            target = np.maximum(self.target[bucket] - own * within, 0) + PRIOR
            target = target / (np.maximum(self.target.sum() - length * within, 0) + PRIOR * size)[row]
            # rounded, so that the order of summation cannot decide a verdict
            found.append(np.round(np.bincount(row, own * (np.log(target) - np.log(corpus)), n) / np.maximum(length, 1), 9))
        return found[0], found[1]


def _spots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of the filter that each id sets, a row per probe."""
    steps = np.arange(1, PROBES + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return mixed(hashes.view(np.uint64)[None, :] + steps) & np.uint64(bits - 1)


def id_filter(ids: DataFrame, column: str, kind: T.DataType) -> np.ndarray:
    """A Bloom filter of the ids as 64-bit words; of bounded size, merged by word."""
    bits = min(FILTER_BITS, max(64, 1 << (ids.count() * ID_BITS - 1).bit_length()))

    def words(batches):
        for batch in batches:
            spots = _spots(batch.column(0).to_numpy(), bits).ravel()
            masks = (np.uint64(1) << (spots & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((spots >> np.uint64(6)).astype(np.int64)), pa.array(masks)], names=["word", "mask"])

    found = ids.select(_hash(column, kind)).mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint64)


def _passing_ids(hashes: pa.Array, passes: np.ndarray) -> np.ndarray:
    """Whether the hashed ids pass the filter; null never does."""
    spots = _spots(hashes.fill_null(0).to_numpy(), len(passes) * 64)
    inside = (passes[spots >> np.uint64(6)] >> (spots & np.uint64(63)) & np.uint64(1)).all(0)
    return inside & hashes.is_valid().to_numpy(zero_copy_only=False)


def _mistaken(ids: DataFrame, trusted: DataFrame, passes: np.ndarray, kind: T.DataType) -> DataFrame:
    """Those of ``ids`` (id) that pass the filter and are not trusted, once each; written, so that their join knows how few they are."""
    shared = ids.sparkSession.sparkContext.broadcast(passes)

    def run(batches):
        for batch in batches:
            yield batch.select(["id"]).filter(pa.array(_passing_ids(batch.column(1), shared.value)))

    passed = ids.select("id", _hash("id", kind)).mapInArrow(run, ids.schema)
    return settle_table(passed.distinct().join(trusted, F.col("id") == F.col("trusted_id"), "left_anti").withColumnRenamed("id", "mistaken_id"), "quality-mistaken")


def _hash(column: str, kind: T.DataType) -> Column:
    """Hash of an id as it is compared with trusted ones, in the type that holds both; null of null."""
    return F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column).cast(kind)))


def fit(df: DataFrame, trusted: DataFrame, text: str = "text", doc: str = "doc_id", trusted_doc: str = "doc_id") -> NgramModel:
    """Count ``df``; ``trusted`` has the ids of the trusted documents, all of which are used."""
    ids = settle_table(trusted.select(trusted[trusted_doc].alias("trusted_id")).where("trusted_id is not null").distinct(), "quality-trusted")
    source = df.select(df[text].alias("text"), df[doc].alias("id"))
    kind = ids.union(source.select("id")).schema[0].dataType
    passes = id_filter(ids, "trusted_id", kind)
    shared = df.sparkSession.sparkContext.broadcast(passes)
    mistaken = _mistaken(source.select("id"), ids, passes, kind)
    among = source.join(mistaken, F.col("id") == F.col("mistaken_id"), "left_anti").select("text", _hash("id", kind).alias("hash"))

    def trusted_texts(batch: pa.RecordBatch) -> pa.Array:
        return batch.column(0).filter(pa.array(_passing_ids(batch.column(1), shared.value)))

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(trusted_texts(batch) if batch.num_columns > 1 else batch.column(0)):
                total += np.bincount(_buckets(Words(data, offsets))[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    def counted(texts: DataFrame) -> np.ndarray:
        found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(BUCKETS)
        total[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        return total

    model = NgramModel(counted(source.select("text")), counted(among))
    counts = NgramModel(model.corpus, model.target)

    def measure(batches):
        n, total, squares = 0, 0.0, 0.0
        for batch in batches:
            for lo, hi, data, offsets in text_slices(trusted_texts(batch)):
                words = Words(data, offsets)
                found = counts.scores(*_buckets(words), hi - lo)[0][words.counts >= MIN_WORDS]
                n, total, squares = n + len(found), total + found.sum(), squares + (found**2).sum()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([float(total)]), pa.array([float(squares)])], names=["n", "total", "squares"])

    n, total, squares = among.mapInArrow(measure, "n long, total double, squares double").agg(F.sum("n"), F.sum("total"), F.sum("squares")).first()
    if n:
        spread = max(squares / n - (total / n) ** 2, 0.0) ** 0.5
        model.threshold = round(total / n - max(MARGIN, DEVIATIONS * spread), 6)
    model.trusted, model.passes, model.kind = ids, passes, kind
    return model


def judge(df: DataFrame, model: NgramModel, text: str = "text", doc: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, unless given), the statistics, score, base_failed and kept."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in {*added, "score", "base_failed", "kept"}]
    words_of, ident, as_trusted, known = (free_name(c, [*keep, *added, "score"]) for c in ("text", "id", "as_trusted", "mistaken_id"))
    source = df.select(*[df[c] for c in keep], df[text].alias(words_of), df[doc].alias(ident))
    shared = df.sparkSession.sparkContext.broadcast(model.passes)
    mistaken = _mistaken(df.select(df[doc].alias("id")), model.trusted, model.passes, model.kind)
    schema = T.StructType([
        *source.schema.fields[:-2], *[T.StructField(c, T.LongType()) for c in added], T.StructField("score", T.DoubleType()),
        T.StructField(as_trusted, T.DoubleType()), source.schema.fields[-1],
    ])
    counts = NgramModel(model.corpus, model.target)

    def run(batches):
        for batch in batches:
            trusted = _passing_ids(batch.column(batch.num_columns - 1), shared.value)
            for lo, hi, data, offsets in text_slices(batch.column(batch.num_columns - 3)):
                words = Words(data, offsets)
                found = base_statistics(data, offsets, words)
                inside, outside = counts.scores(*_buckets(words), hi - lo)
                own = batch.slice(lo, hi - lo).columns
                inside = pa.array(inside, mask=~trusted[lo:hi])
                arrays = [*own[:-3], *[pa.array(found[c]) for c in added], pa.array(outside), inside, own[-2]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added, "score", as_trusted, ident])

    scored = source.select("*", _hash(ident, model.kind)).mapInArrow(run, schema)
    scored = scored.join(mistaken.withColumnRenamed("mistaken_id", known), F.col(ident) == F.col(known), "left")
    score = F.when(F.col(as_trusted).isNotNull() & F.col(known).isNull(), F.col(as_trusted)).otherwise(F.col("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("score", score).drop(as_trusted, ident, known)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= model.threshold))


def passing(df: DataFrame, model: NgramModel, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns and no others."""
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text].alias("text"), df[doc].alias("doc_id"))
    return judge(rows, model, keep=["row"]).where("kept").select("row.*")
