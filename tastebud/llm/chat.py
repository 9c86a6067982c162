"""Chat formatting with typed content parts.

A message holds ordered parts: text, image, audio or document. A visitor turns
each into its piece of the formatted turn: text is escaped, an attachment
becomes a placeholder ``<|kind:n|>`` and is recorded with its reference, its
position and the number of model tokens that it expands to. A turn is
``<s>role\\n ... </s>\\n``; control strings inside texts are broken by a
backslash after their first character (and backslashes doubled), so the output
can be read back exactly.

A turn is formatted by itself, row by row, without a shuffle: a conversation
with very many turns is never gathered in one task. Only the check that reads
the output back streams over sorted turns, with constant memory.

Defined results: a null text or an empty part list is an empty turn; a null role
is the empty role; line feeds in a role are escaped; attachments without size
count one token; a part of an unknown kind or of none is a placeholder ``unknown``
of one token.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastebud.llm.common import small_batches

OPEN, CLOSE = "<s>", "</s>\n"
# Strings with a meaning in the template or in common chat templates (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"((?:[^\\\n]|\\.)*)\n(.*)", re.DOTALL)  # the role ends at the first line feed that isn't escaped
PLACEHOLDER = re.compile(r"<\|(image|audio|document|unknown):(\d+)\|>")

PART = T.StructType([
    T.StructField("kind", T.StringType()),     # text, image, audio, document
    T.StructField("text", T.StringType()),     # of text parts
    T.StructField("ref", T.StringType()),      # of the others: where the content lies
    T.StructField("width", T.LongType()),      # image: pixels
    T.StructField("height", T.LongType()),
    T.StructField("seconds", T.DoubleType()),  # audio
    T.StructField("pages", T.LongType()),      # document
])
ATTACHMENT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("start", T.LongType()), T.StructField("tokens", T.LongType()),
])
TURN = T.StructType([
    T.StructField("formatted", T.StringType()),
    T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()),
    T.StructField("attachments", T.ArrayType(ATTACHMENT)),
])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    """A role stands on one line: its line feeds are escaped too."""
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _given(x) -> bool:
    return x is not None and not (isinstance(x, float) and math.isnan(x))


@dataclass
class Flattener:
    """Visitor over the parts of one turn; collects the text and the attachments."""
    image_patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 1024
    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part) -> None:
        getattr(self, f"visit_{part['kind']}", self.unknown)(part)

    def unknown(self, part):
        """A part of another kind keeps its place and reference, as one token."""
        self.attach("unknown", part["ref"], 1)

    def emit(self, piece: str) -> None:
        self.out.append(piece)
        self.length += len(piece)

    def attach(self, kind: str, ref, tokens: int) -> None:
        n = len(self.attachments) + 1
        self.attachments.append({"n": n, "kind": kind, "ref": ref, "start": self.length, "tokens": max(1, tokens)})
        self.emit(f"<|{kind}:{n}|>")

    def visit_text(self, part) -> None:
        self.emit(escape(part["text"] or ""))

    def visit_image(self, part) -> None:
        w, h = (part[k] if _given(part[k]) else 0 for k in ("width", "height"))
        self.attach("image", part["ref"], math.ceil(w / self.image_patch) * math.ceil(h / self.image_patch))

    def visit_audio(self, part) -> None:
        self.attach("audio", part["ref"], math.ceil((part["seconds"] if _given(part["seconds"]) else 0) * self.audio_rate))

    def visit_document(self, part) -> None:
        self.attach("document", part["ref"], int(part["pages"] if _given(part["pages"]) else 0) * self.page_tokens)


def format_turn(role: str | None, parts, trained: str = "assistant", **sizes) -> dict:
    """Formatted turn, the span of it under the loss mask (code points) and the attachments."""
    v = Flattener(**sizes)
    v.emit(f"{OPEN}{escape_role(role or '')}\n")
    start = v.length
    for part in parts if parts is not None else ():
        v.visit(part)
    end = v.length
    v.emit(CLOSE)
    loss = (start, end) if role == trained else (start, start)
    return {"formatted": "".join(v.out), "loss_start": loss[0], "loss_end": loss[1], "attachments": v.attachments}


def text_parts(text_col: Column) -> Column:
    """A plain text column as a list of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text_col, F.lit("")).alias("text"),
                            null.cast("string").alias("ref"), null.cast("long").alias("width"),
                            null.cast("long").alias("height"), null.cast("double").alias("seconds"),
                            null.cast("long").alias("pages")))


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts") -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end, attachments) for every message row."""
    small_batches(rows.sparkSession)

    @F.pandas_udf(TURN)
    def formatted(roles: pd.Series, parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([format_turn(r, p) for r, p in zip(roles, parts, strict=True)],
                            columns=["formatted", "loss_start", "loss_end", "attachments"])

    return (rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        formatted(F.col(role_col), F.col(parts_col)).alias("t"))
            .select("conv_id", "turn", "t.*"))


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text (placeholders stay) of a formatted turn."""
    if not formatted.startswith(OPEN) or not formatted.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    turn = _TURN.fullmatch(formatted[len(OPEN):-len(CLOSE)])
    if turn is None:
        raise ValueError("not a formatted turn")
    return unescape(turn[1]), unescape(turn[2])


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, n_attachments long, attachment_tokens long")


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.attached = self.tokens = 0

    def add(self, formatted, start, end, attachments):
        role, text = read_turn(formatted)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        under = unescape(formatted[start:end])
        self.loss.update(under.encode("utf-8", "surrogatepass"))
        self.n += 1
        self.loss_chars += len(under)
        self.chars += len(formatted)
        self.attached += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self):
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.attached, self.tokens)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read from the formatted turns in order of turn (ties by the formatted text).

    The turns of a conversation are hashed as they stream by in sorted order;
    neither a conversation nor a group is held in memory.
    """
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in DIGEST.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
        now = None
        for b in batches:
            rows = []
            ids = b["conv_id"].astype("Int64")
            for conv, f, s, e, a in zip(ids, b["formatted"], b["loss_start"], b["loss_end"], b["attachments"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now.conv_id != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = _Digest(conv)
                now.add(f, s, e, a)
            yield frame(rows)
        if now is not None:
            yield frame([now.row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end", "attachments").mapInPandas(digests, DIGEST)
