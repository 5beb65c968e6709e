"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Every match of the split pattern is merged on its own. Long texts are cut before
encoding, only where a letter or digit is followed by a space: no match of the
pattern reaches across such a place, and its look-ahead sees white space only,
so the cut pieces give the ids of the whole text. A text without such a place is
encoded in one piece.

Defined results: a null text counts as empty and gives no ids; an empty table
gives an empty table; repeated rows stay repeated; other columns, whatever their
names, are passed on by ``encode`` and ``decode``, whose own columns replace
columns of the same name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratalog.llm.words import free_name

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_CHARS = 1 << 16
BATCH_IDS = 1 << 20


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` into pieces of about ``size`` characters at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = text.rfind(" ", start + 1, start + size)
        while cut > start and not text[cut - 1].isalnum():
            cut = text.rfind(" ", start + 1, cut)
        if cut <= start:
            cut = text.find(" ", start + size)
            while cut > 0 and not text[cut - 1].isalnum():
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode_text(encoder: tiktoken.Encoding, text: str | None, size: int = PIECE_CHARS) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) <= size:
        return encoder.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([encoder.encode_to_numpy(piece, disallowed_special=()) for piece in safe_pieces(text, size)])


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", *, keep: list[str] | None = None, rank_file: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns ``keep`` (all, unless given) and ``ids``, an array of int, for every row."""
    keep = [c for c in (df.columns if keep is None else keep) if c != ids]
    source = df.select(*[df[c] for c in keep], df[text].alias(free_name("text", keep)))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = encoding(rank_file, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], names=keep) if keep else None
            start, held, size = 0, [], 0
            for row, value in enumerate(texts):
                held.append(encode_text(encoder, value.as_py()))
                size += len(held[-1])
                if size >= BATCH_IDS or row == len(texts) - 1:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held).astype(np.int32)))
                    columns = rest.slice(start, len(held)).columns if keep else []
                    yield pa.RecordBatch.from_arrays([*columns, lists], names=[*keep, ids])
                    start, held, size = row + 1, [], 0

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "token_ids", decoded: str = "decoded", *, rank_file: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All columns and ``decoded``, the raw bytes of the ids; null ids give empty bytes.

    The bytes are not forced into UTF-8: a list cut inside a character is kept as it is.
    """
    keep = [c for c in df.columns if c != decoded]
    source = df.select(*keep)
    schema = T.StructType([*source.schema.fields, T.StructField(decoded, T.BinaryType())])
    place = keep.index(ids)

    def run(batches):
        encoder = encoding(rank_file, pattern)
        for batch in batches:
            lists = batch.column(place)
            values = [encoder.decode_bytes(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=[*keep, decoded])

    return source.mapInArrow(run, schema)
