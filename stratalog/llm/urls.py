"""URL filter: rules first, then logistic regression on hashed character n-grams.

A rule fits its host and all subdomains where the path starts with the rule's;
the longest fitting rule decides. Other urls are judged by the regression over
character n-grams of host and path, trained from a small labelled table of urls
that the caller gives; at most ``TRAIN_ROWS`` of its rows are used, those whose
digests are smallest, so the sample is the same on every run.

Defined results: a null url, or one without ``://``, has empty host and path and
is judged by the regression's intercept; an empty or one-sided labelled table
gives a model that allows or blocks everything alike (allows, if empty);
repeated rows stay repeated; columns are kept whatever their names, apart from
those the functions add.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.words import free_name, text_slices

TRAIN_ROWS = 4_000
BITS = 17
GRAMS = (3, 4, 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(str(r))).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def ngram_buckets(texts: pa.Array):
    """(first row, last row + 1, buckets, n-grams per row) by slices; texts are framed by ^ and $."""
    for lo, hi, data, offsets in text_slices(texts):
        lengths = np.diff(offsets)
        framed = np.full(len(data) + 2 * len(lengths), ord("^"), np.uint8)
        starts = offsets[:-1] + 2 * np.arange(len(lengths))
        inside = np.repeat(starts + 1 - offsets[:-1], lengths) + np.arange(len(data))
        framed[inside] = data
        ends = starts + lengths + 2
        framed[ends - 1] = ord("$")
        values, rows = [], []
        row = np.repeat(np.arange(len(lengths)), lengths + 2)
        for n in GRAMS:
            if len(framed) < n:
                continue
            h = np.full(len(framed) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ framed[k : len(framed) - n + 1 + k]) * np.uint64(0x100000001B3)
            same = row[: len(h)] == row[n - 1 :]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            values.append((h >> np.uint64(64 - BITS))[same])
            rows.append(row[: len(h)][same])
        values = np.concatenate(values) if values else np.zeros(0, np.uint64)
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield lo, hi, values.astype(np.int64), rows


@dataclass
class UrlModel:
    weights: np.ndarray
    intercept: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, buckets, rows in ngram_buckets(texts):
            n = hi - lo
            sums = np.bincount(rows, self.weights[buckets], n)
            out[lo:hi] = sums / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -40, 40)))


def train(labelled: DataFrame, host: str = "host", path: str = "path", label: str = "label", rows: int = TRAIN_ROWS, steps: int = 300, rate: float = 2.0, decay: float = 1e-4) -> UrlModel:
    """Fit on at most ``rows`` rows (label 1 blocks); rows without a label are left out."""
    text = F.concat(F.coalesce(labelled[host], F.lit("")), F.coalesce(labelled[path], F.lit("")))
    sample = labelled.select(text.alias("text"), labelled[label].cast("int").alias("label")).where("label is not null")
    table = sample.orderBy(F.xxhash64("text", "label"), "text", "label").limit(rows).toArrow()
    truth = table.column("label").to_numpy().astype(float)
    if not len(truth) or truth.min() == truth.max():
        return UrlModel(np.zeros(1 << BITS), 20.0 if len(truth) and truth[0] else -20.0)
    buckets, owners = [], []
    for lo, _, found, at in ngram_buckets(table.column("text").combine_chunks()):
        buckets.append(found)
        owners.append(at + lo)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    used, column = np.unique(bucket, return_inverse=True)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(truth)), 1))[owner]
    weights, intercept = np.zeros(len(used)), 0.0
    for _ in range(steps):
        score = np.bincount(owner, weights[column] * scale, len(truth)) + intercept
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - truth) / len(truth)
        weights -= rate * (np.bincount(column, error[owner] * scale, len(used)) + decay * weights)
        intercept -= rate * error.sum()
    dense = np.zeros(1 << BITS)
    dense[used] = weights
    return UrlModel(dense, float(intercept))


def score(df: DataFrame, model: UrlModel, host: str = "host", path: str = "path", out: str = "block_probability") -> DataFrame:
    """All columns and the probability that the url is to be blocked."""
    keep = [c for c in df.columns if c != out]
    source = df.select(*[df[c] for c in keep], F.concat(F.coalesce(df[host], F.lit("")), F.coalesce(df[path], F.lit(""))).alias(free_name("url", keep)))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            found = model.probabilities(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*keep, out])

    return source.mapInArrow(run, schema)
