"""Words, shingles and their 64-bit hashes, for whole Arrow batches at a time.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so words never
depend on a locale. Null texts count as empty. All work is done on slices of
about a megabyte, which keeps a task's memory flat however long a batch is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Everything but ASCII letters, digits and bytes of characters outside ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = False
NOT_ALNUM[ord("0") : ord("9") + 1] = NOT_ALNUM[ord("A") : ord("Z") + 1] = NOT_ALNUM[ord("a") : ord("z") + 1] = False

SLICE_BYTES = 1 << 20
_BYTE = np.random.default_rng(20260701).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHAIN = np.uint64(0xD6E8FEB86659FD93)


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def small_text_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts be at most ``BATCH_BYTES`` from here on, unless the session has them smaller still.

    An executor holds a batch several times: in Spark, on the way and in Python.
    """
    said = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(BATCH_KEY, "64m").lower())
    if said is None or int(said[1]) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[said[2]] > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores as it needs not to be one of ``taken``."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= _CHAIN
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into them) of slices of about ``size`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, len(texts))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of one slice, the runs of bytes outside ``between``: byte ranges in order, and each row's first word and number of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES):
        self.data, self.offsets = data, offsets
        inside = ~between[data]
        opens, closes = inside.copy(), inside.copy()
        if len(data):
            cut = offsets[(offsets > 0) & (offsets < len(data))]
            before, after = ~inside[:-1], ~inside[1:]
            before[cut - 1] = True
            after[cut - 1] = True
            opens[1:] &= before
            closes[:-1] &= after
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        edges = np.searchsorted(self.starts, offsets)
        self.first, self.counts = edges[:-1], np.diff(edges)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return _range_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _STEP)]), dtype=np.uint64)
    return _POWERS


def _range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for ascending, disjoint, non-empty ranges."""
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    values = _BYTE[data[np.repeat(starts, lengths) + place]] * _powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _CHAIN)


def shingles(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words per row, in order, and the number per row.

    With ``short``, a row of 1 to n - 1 words has its whole sequence as one shingle.
    """
    usable = np.maximum(counts - (n - 1), 0)
    if len(hashes) >= n:
        runs = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            runs *= _CHAIN
            runs += hashes[k : len(hashes) - n + 1 + k]
        runs = mixed(runs)
    else:
        runs = np.zeros(0, np.uint64)
    at = np.repeat(first, usable) + within(usable)
    values = runs[at]
    if not short:
        return values, usable
    small = np.flatnonzero((counts > 0) & (counts < n))
    if not len(small):
        return values, usable
    whole = counts[small].astype(np.uint64)
    for k in range(n - 1):
        more = counts[small] > k
        whole[more] = mixed(whole[more] * _CHAIN + hashes[first[small][more] + k])
    into = np.cumsum(usable) - usable
    values = np.insert(values, into[small], whole)
    usable = usable.copy()
    usable[small] = 1
    return values, usable


def within(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for every row, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def distinct_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats, and the new number per row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.bincount(rows[new], minlength=len(counts))


def per_row(function: np.ufunc, values: np.ndarray, counts: np.ndarray, empty) -> np.ndarray:
    """``function.reduce`` over each row's values; ``empty`` for rows without any."""
    out = np.full(len(counts), empty, values.dtype)
    some = counts > 0
    if some.any():
        out[some] = function.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out
