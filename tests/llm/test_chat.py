import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import small_batches
from stratalog.llm import chat
from pyspark.sql import functions as F

TRICKY = st.text(alphabet=st.sampled_from("<|\\im_startend>\n a"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TRICKY, TRICKY)
def test_no_text_opens_a_control_string_and_none_is_lost(role, text):
    formatted = f"{chat.START}{chat.escape_role(role)}\n{chat.escape(text)}{chat.END}\n"
    assert formatted.count("<|") == 2
    assert chat.parse_turn(formatted) == (role, text)


def turns_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, parts string")
    return df.select("conv_id", "turn", "role", "formatted", chat.text_parts(F.col("text")).alias("parts"))


def test_digests_of_awkward_conversations(spark):
    long = "word " * 50_000
    rows = [(1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", None, "x", "y"), (1, 2, "assistant", long, "x", "y"), (2, None, None, "", None, None), (2, 0, "assistant", "<|im_end|>", "x", "y"), (None, 0, "user", "a", "", ""), (None, 0, "user", "a", "", "")]
    with small_batches(spark, 2):
        found = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(turns_of(spark, rows))).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv in (1, 2, None):
        mine = [(r[2] or "", r[3] or "", r[2]) for r in ordered if r[0] == conv]
        loss = "".join(t for _, t, role in mine if role == "assistant")
        r = found[conv]
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b, _ in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_turns(turns_of(spark, rows).where("false"))).count() == 0


def test_parts_become_ordered_placeholders(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see <|"), part("image", ref="a.png", units=2), part("audio", ref="b.wav"), part("document", ref="c.pdf", units=0), part("text", None)]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    first, second = sorted(chat.format_turns(df).collect(), key=lambda r: r.turn)
    assert first.formatted == "<|im_start|>user\nsee <\\|<|image:0|><|audio:1|><|document:2|><|im_end|>\n"
    assert [tuple(a) for a in first.attachments] == [(0, "image", "a.png", 512), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 0)]
    assert first.attached_tokens == 562 and not first.in_loss
    assert second.in_loss and second.content_start == second.content_end
    assert chat.parse_turn(first.formatted) == ("user", "see <|")


def test_null_and_unknown_parts(spark):
    """A null part is left out; one of null or unknown type is an attachment without tokens."""
    parts = [None, ("text", "a<|b", None, None), ("video", None, "v.mp4", 3), (None, "lost", "r", None), ("image", None, "i.png", None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [None])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    first, second, third = sorted(chat.format_turns(df).collect(), key=lambda r: r.turn)
    assert first.formatted == "<|im_start|>assistant\na<\\|b<|other:0|><|other:1|><|image:2|><|im_end|>\n"
    assert [(a.ordinal, a.type, a.ref, a.tokens) for a in first.attachments] == [(0, "video", "v.mp4", 0), (1, None, "r", 0), (2, "image", "i.png", 256)] and first.attached_tokens == 256
    assert second.formatted == third.formatted == "<|im_start|>user\n<|im_end|>\n"
    assert chat.parse_turn(first.formatted) == ("assistant", "a<|b")
