import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import awkward, documents, prose
from stratalog.llm import bpe

ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB9'st \n\t é漢!<|>"), max_size=120), st.integers(1, 12))
def test_cut_pieces_give_the_same_ids(text, size):
    pieces = list(bpe.safe_pieces(text, size))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in PLAIN.encode_ordinary(p)] == PLAIN.encode_ordinary(text)


def test_long_texts():
    for text in (prose(1, 60_000), "x" * 200_000, " " * 150_000 + "a", "漢" * 90_000, "a \n" * 50_000):
        assert bpe.encode_text(PLAIN, text).tolist() == PLAIN.encode_ordinary(text)


def test_encode_and_decode_awkward_documents(spark):
    rows = [*awkward(spark), (11, "<|endoftext|> it's", "a")]
    df = documents(spark, rows)
    encoded = bpe.encode(df)
    assert encoded.columns == [*[c for c in df.columns if c != "token_ids"], "token_ids"]
    out = bpe.decode(encoded).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    got = sorted(((r.doc_id, r.text, r.token_ids, bytes(r.decoded)) for r in out), key=key)
    expected = sorted(((i, t, PLAIN.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=key)
    assert got == expected
    assert bpe.decode(bpe.encode(df.where("false"))).count() == 0


@pytest.mark.parametrize("ids,raw", [([], b""), (None, b""), (PLAIN.encode_ordinary("é")[:1], None)])
def test_decoding_ids_that_end_inside_a_character(spark, ids, raw):
    df = spark.createDataFrame([(ids,)], "token_ids array<int>")
    assert bytes(bpe.decode(df).first().decoded) == (PLAIN.decode_bytes(ids) if raw is None else raw)
