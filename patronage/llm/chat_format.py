"""Chat formatting with typed content parts.

A turn's content is a list of parts (type, text, ref, tokens). A visitor, one
method for each type, flattens them into text with ordered placeholders and
records every attachment: its place in the turn, type, reference and how many
tokens the placeholder stands for. A plain text is one text part.

The template marks a turn as ``<|turn|>role\\ntext<|end|>\\n``. Control strings
inside roles and texts are escaped: a backslash follows the first character of
each, a backslash is doubled and one stands before a line break of a role, so
no control string is left inside and reading back restores every character.

Every turn is one row with its piece of the conversation, its place in it and
the span that takes part in the loss; concatenating the pieces gives the
conversation. Pieces are made and read back in streams over partitions sorted
by conversation, so the memory does not grow with a conversation.

Defined cases: a null role or text is empty, an unknown part type is empty
text; turns of a conversation stand by turn (null first), then role, then
text, repeated rows included; a null conv_id is a conversation of its own.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template and the control strings that texts may not hold.
TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = (TURN, END, *PLACEHOLDERS.values(), "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>",
           "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

PARTS = "array<struct<type:string,text:string,ref:string,tokens:long>>"
PIECES = ("conv_id long, seq long, role string, piece string, start long, loss_from long, loss_to long, "
          "attachments array<struct<at:long,type:string,ref:string,tokens:long>>, n_tokens_expanded long")

_HIDDEN = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_SHOWN = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _HIDDEN.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _SHOWN.sub(r"\1", text)


@dataclass
class Flattener:
    """Visitor of the parts of one turn."""
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_text)(part)

    def visit_text(self, part) -> None:
        self.out.append(escape(part["text"] or ""))

    def _attach(self, part) -> None:
        self.attachments.append({"at": sum(map(len, self.out)), "type": part["type"], "ref": part["ref"],
                                 "tokens": int(part["tokens"] or 0)})
        self.out.append(PLACEHOLDERS[part["type"]])

    visit_image = visit_audio = visit_document = _attach


def format_turn(role: str, parts) -> tuple[str, int, int, list[dict]]:
    """A turn's piece, the span of its content in it and its attachments."""
    v = Flattener()
    for part in parts:
        v.visit(part)
    head = TURN + escape(role).replace("\n", "\\\n") + "\n"
    content = "".join(v.out)
    shift = [a | {"at": a["at"] + len(head)} for a in v.attachments]
    return head + content + END + "\n", len(head), len(head) + len(content), shift


def read_turn(piece: str) -> tuple[str, str]:
    """(role, content with placeholders) of a piece: what the template wrote, unescaped."""
    if not piece.startswith(TURN) or not piece.endswith(END + "\n"):
        raise ValueError("not a turn")
    m = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S).match(piece, len(TURN))
    return unescape(m[1]), unescape(piece[m.end():-len(END) - 1])


def as_parts(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with their text as one text part."""
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"),
                    F.lit(None).cast("long").alias("tokens"))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, seq, start = object(), 0, 0
    for b in batches:
        out = []
        for c, role, parts in zip(b["conv_id"].astype("Int64"), b["role"], b["parts"], strict=True):
            c = None if c is pd.NA else c
            if c != conv:
                conv, seq, start = c, 0, 0
            role = role or ""
            piece, low, high, attachments = format_turn(role, parts if parts is not None else [])
            spoken = role == "assistant"
            out.append((c, seq, role, piece, start, start + low if spoken else None, start + high if spoken else None,
                        attachments, sum(a["tokens"] for a in attachments)))
            seq += 1
            start += len(piece)
        cols = [x.split()[0] for x in PIECES.replace(", attachments array<struct<at:long,type:string,ref:string,tokens:long>>",
                                                     ", attachments x").split(", ")]
        frame = pd.DataFrame(out, columns=cols)
        for x in ("conv_id", "loss_from", "loss_to"):
            frame[x] = frame[x].astype("Int64")
        yield frame


def formatted(turns: DataFrame) -> DataFrame:
    """A row for every turn of turns (conv_id, turn, role, parts), sorted inside the partitions."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.col("parts").cast(PARTS).alias("parts"))
    return (x.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
            .select("conv_id", "role", "parts").mapInPandas(_write, PIECES))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations, read back from their pieces."""
    conv, state = object(), None

    def row():
        n, turns, chars, loss, length = state
        return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), length)

    def frame(rows):
        f = pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])
        f["conv_id"] = f["conv_id"].astype("Int64")
        return f

    for b in batches:
        out = []
        for c, piece, start, low, high in zip(b["conv_id"].astype("Int64"), b["piece"], b["start"].astype("int64"),
                                              b["loss_from"].astype("Int64"), b["loss_to"].astype("Int64"), strict=True):
            c = None if c is pd.NA else c
            if state is None or c != conv:
                if state is not None:
                    out.append(row())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if low is not pd.NA:
                spoken = unescape(piece[low - start:high - start])
                state[2] += len(spoken)
                state[3].update(spoken.encode("utf-8", "surrogatepass"))
            state[4] += len(piece)
        if out:
            yield frame(out)
    if state is not None:
        yield frame([row()])


def digest(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of ``formatted`` pieces as they stand in its partitions."""
    return pieces.select("conv_id", "piece", "start", "loss_from", "loss_to").mapInPandas(_read, DIGEST)
