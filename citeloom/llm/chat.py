r"""Chat formatting: typed content parts, a reversible template, and the loss mask.

A turn's content is a list of parts, each text, image, audio or document. A
visitor flattens it: text is escaped and written as it is, every other part
becomes a placeholder in its place, its reference recorded as an attachment with
the number of tokens it expands to. A text column is one text part.

Template, one segment a turn (a conversation is its segments in order):

    <|turn|>role\n content <|end|>\n          (without the blanks)

The role, if it is the learner's, puts the content under the loss mask. Control
strings inside texts are broken by a backslash after their first sign, and a
backslash is doubled, so what was written can be read back exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import fields, lean, pieces

TURN, END = "<|turn|>", "<|end|>"
#: Strings that may not stand unbroken inside a text: ours, and those of common templates.
CONTROL = (TURN, END, "<|image|>", "<|audio|>", "<|document|>", "<|unknown|>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNER = "assistant"

_ESCAPED = re.compile("|".join(rf"{re.escape(a)}(?={'|'.join(re.escape(c[1:]) for c in CONTROL if c[0] == a)})" for a in sorted({c[0] for c in CONTROL})) + r"|\\")
_SEGMENT = re.compile(rf"{re.escape(TURN)}([^\n]*)\n((?s:.*?)){re.escape(END)}\n")


def escape(text: str) -> str:
    """A text in which no control string stands unbroken."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    """What `escape` was given."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    """What `escape_role` was given."""
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


#: Amounts from here on are taken for errors, as are negative ones and those that are no number.
ABSURD = 1e9


def _amount(x: float | None) -> float:
    """A width, length or number of pages; 0 where it can't be one."""
    return x if x is not None and 0 < x < ABSURD else 0


@dataclass
class Visitor:
    """Flattens parts in order; `text` grows, attachments and tokens are noted.

    An attachment takes a token at least. Sizes that can't be (null, negative, no
    number, absurd) count as 0; a kind that is not known is an attachment of one
    token and kind "unknown".
    """

    patch: int = 14
    audio_rate: int = 25
    page_tokens: int = 512
    text: list[str] = field(default_factory=list)
    size: int = 0
    attachments: list[dict[str, Any]] = field(default_factory=list)

    def visit(self, part: dict[str, Any]) -> None:
        kind = part.get("kind") or "text"
        method: Callable = getattr(self, f"visit_{kind}", self.visit_unknown)
        method(part)

    def write(self, s: str) -> None:
        self.text.append(s)
        self.size += len(s)

    def attach(self, kind: str, part: dict[str, Any], tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.size, "tokens": tokens})
        self.write(f"<|{kind}|>")

    def visit_text(self, part: dict[str, Any]) -> None:
        self.write(escape(part.get("text") or ""))

    def visit_image(self, part: dict[str, Any]) -> None:
        """A token for each patch of width by height."""
        w, h = _amount(part.get("width")), _amount(part.get("height"))
        self.attach("image", part, max(1, math.ceil(w / self.patch) * math.ceil(h / self.patch)))

    def visit_audio(self, part: dict[str, Any]) -> None:
        self.attach("audio", part, max(1, math.ceil(_amount(part.get("seconds")) * self.audio_rate)))

    def visit_document(self, part: dict[str, Any]) -> None:
        self.attach("document", part, max(1, int(_amount(part.get("pages"))) * self.page_tokens))

    def visit_unknown(self, part: dict[str, Any]) -> None:
        self.attach("unknown", part, 1)


PART = T.StructType(fields("kind string, text string, ref string, width int, height int, seconds double, pages int"))
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))
FORMATTED = [
    *fields("formatted string, loss_start int, loss_end int"),
    T.StructField("attachments", T.ArrayType(T.StructType(fields("kind string, ref string, at int, tokens long")))),
    *fields("expanded_tokens long"),
]


def text_part(column: str = "text") -> Column:
    """A text column as a list of one part; null counts as empty."""
    return F.array(F.struct(*[(F.coalesce(column, F.lit("")) if f.name == "text" else F.lit("text") if f.name == "kind" else F.lit(None)).cast(f.dataType).alias(f.name) for f in PART]))


def format_turns(turns: DataFrame, learner: str = LEARNER) -> DataFrame:
    """A formatted segment for each turn: conv_id, turn, role, and FORMATTED's columns.

    `turns` has conv_id, turn, role and content (a list of PART; null is none) or
    text. Loss offsets are code points in the segment, null outside the
    learner's turns. A null role counts as empty, a null text or part as nothing.
    Repeated rows are turns of their own; other columns are not read, whatever
    their names.
    """
    content = F.col("content") if "content" in turns.columns else text_part()
    kept = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"))
    schema = T.StructType([*kept.schema.fields[:3], *FORMATTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], [], [], []]
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("content").to_pylist()):
                head = f"{TURN}{escape_role(role)}\n"
                v = Visitor()
                v.write(head)
                for p in parts or []:
                    v.visit(p or {})
                span = (len(head), v.size) if role == learner else (None, None)
                v.write(f"{END}\n")
                for column, x in zip(made, ("".join(v.text), *span, v.attachments, sum(a["tokens"] for a in v.attachments))):
                    column.append(x)
            kinds = (pa.string(), pa.int32(), pa.int32(), _ATTACHED, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.select(["conv_id", "turn", "role"]).columns, *(pa.array(c, t) for c, t in zip(made, kinds))], names=schema.names)

    return kept.mapInArrow(lean(run), schema)


def conversations(segments: DataFrame) -> DataFrame:
    """conv_id and the whole formatted conversation, for use where one fits a row."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "formatted")))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x.formatted), "").alias("formatted"))


class _Digest:
    """What has been read of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        m = _SEGMENT.fullmatch(formatted)
        if m is None:
            raise ValueError("a segment that the template did not write")
        text = unescape(m[2])
        self.turns.update(f"{unescape_role(m[1])}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.n += 1
        self.chars += len(formatted)
        if start is not None:
            learned = unescape(formatted[start:end])
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(learned)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted segments and their masks.

    Segments are dealt by conversation and sorted by turn, role and text (so ties
    of turn have one order); a conversation passes through as a stream and only
    its digests are held. A digest over ordered texts can't be split, so one
    conversation is read by one task.
    """
    schema = T.StructType([segments.schema["conv_id"], *fields("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")])
    dealt = segments.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end")
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: tuple[Any, _Digest] | None = None

        def close() -> None:
            if now:
                k, d = now
                done.append((k, d.n, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars))

        def out() -> pa.RecordBatch:
            kinds = (id_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=schema.names)

        for whole in batches:
            id_kind = whole.schema.field("conv_id").type
            for batch in pieces(whole, "formatted"):
                for conv, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                    if now is None or now[0] != conv:
                        close()
                        now = (conv, _Digest())
                    now[1].add(text, start, end)
                if len(done) > 4096:
                    yield out()
                    done.clear()
        close()
        if done:
            yield out()

    return dealt.mapInArrow(lean(run), schema)
