"""Chat formatting: typed content parts to one marked text per turn, and back.

A turn has a list of parts (``type``, ``text``, ``ref``, ``units``). A visitor
flattens them in order: text is escaped, and an image, audio or document part
becomes a numbered placeholder while its reference and the number of tokens it
expands to are recorded. Every turn is formatted on its own, without a shuffle,
so a conversation of any length costs no task more than its rows.

Control strings start with ``<|``. Inside texts and roles, ``<`` followed by any
number of backslashes and ``|`` gets one more backslash, which ``unescape`` takes
away; no formatted text can therefore open a control string, and nothing is lost.

Defined results: null text is empty, null role is empty, a null list of parts
has none, a null part is left out; a part of null or unknown type is an attachment
without tokens, with a placeholder of its own (``other``). Turns are ordered by turn (nulls
last), role and text, so ties and repeated rows have one order. Rows without a
conversation id form one conversation. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a part whose ``units`` is null; with units (image tiles, audio seconds, document pages), tokens per unit.
TOKENS_PER_UNIT = {"image": 256, "audio": 50, "document": 512}
TRAINED_ROLE = "assistant"

_HIDE = re.compile(r"<(\\*)\|")
_SHOW = re.compile(r"<\\(\\*)\|")
_PLACE = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")


def escape(text: str) -> str:
    return _HIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class PartVisitor:
    """Walks the parts of one turn in order."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type']}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self.attach(part)

    visit_audio = visit_document = visit_image

    def attach(self, part: dict) -> None:
        kind, ordinal = part["type"], len(self.attachments)
        units = part["units"] if part["units"] is not None else 1
        self.attachments.append({"ordinal": ordinal, "type": kind, "ref": part["ref"], "tokens": max(0, units) * TOKENS_PER_UNIT[kind]})
        self.pieces.append(f"<|{kind}:{ordinal}|>")

    def visit_other(self, part: dict) -> None:
        ordinal = len(self.attachments)
        self.attachments.append({"ordinal": ordinal, "type": part["type"], "ref": part["ref"], "tokens": 0})
        self.pieces.append(f"<|other:{ordinal}|>")


PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"
ATTACHMENTS = pa.list_(pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def text_parts(text: Column) -> Column:
    """The list of one text part."""
    nothing = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), nothing.cast("string").alias("ref"), nothing.cast("int").alias("units")))


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Per turn: conv_id, turn, formatted, content_start, content_end, in_loss, attachments, attached_tokens.

    The content range is in code points of ``formatted``; it is the loss mask of a turn with ``in_loss``.
    """
    source = df.select(df[conv].alias("conv_id"), df[turn].alias("turn"), df[role].alias("role"), df[parts].cast(PARTS).alias("parts"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = (
        f"conv_id {types['conv_id']}, turn {types['turn']}, formatted string, content_start int, content_end int, in_loss boolean, "
        "attachments array<struct<ordinal:int,type:string,ref:string,tokens:bigint>>, attached_tokens bigint"
    )

    def run(batches):
        for batch in batches:
            formatted, starts, ends, loss, attached, tokens = [], [], [], [], [], []
            for name, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                visitor = PartVisitor()
                for part in content or []:
                    visitor.visit(part)
                head, body = f"{START}{escape_role(name or '')}\n", "".join(visitor.pieces)
                formatted.append(f"{head}{body}{END}\n")
                starts.append(len(head))
                ends.append(len(head) + len(body))
                loss.append(name == TRAINED_ROLE)
                attached.append(visitor.attachments)
                tokens.append(sum(a["tokens"] for a in visitor.attachments))
            arrays = [batch.column(0), batch.column(1), pa.array(formatted, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(loss, pa.bool_()), pa.array(attached, ATTACHMENTS), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "formatted", "content_start", "content_end", "in_loss", "attachments", "attached_tokens"])

    return source.mapInArrow(run, schema)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders of attachments are left out of the text."""
    if not (formatted.startswith(START) and formatted.endswith(f"{END}\n")):
        raise ValueError("not a formatted turn")
    head, _, body = formatted[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(head), unescape(_PLACE.sub("", body))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Read formatted turns back: one row per conversation.

    The digests run over the turns in order. Rows are dealt by conversation and
    sorted, and a task keeps two running digests and no text, so the longest
    conversation takes time but no memory.
    """
    ordered = (
        turns.select("conv_id", "turn", "formatted", "content_start", "content_end", "in_loss")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "formatted")
    )
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        kind, current, state, done = pa.int64(), None, None, []
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, formatted, start, end, loss in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if state is None or conv != current:
                    if state is not None:
                        done.append(_row(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(formatted)
                if loss:
                    trained = unescape(_PLACE.sub("", formatted[start:end]))
                    state[2] += len(trained)
                    state[3].update(trained.encode())
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind if i == 0 else None) for i, x in enumerate(zip(*done))], names=names)
                done = []
        if state is not None:
            done.append(_row(current, state))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind if i == 0 else None) for i, x in enumerate(zip(*done))], names=names)

    return ordered.mapInArrow(run, schema)


def _row(conv, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
