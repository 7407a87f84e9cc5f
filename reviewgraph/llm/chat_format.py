"""Conversations as training text: typed parts, marked turns, escaped control strings, loss masks.

A turn has an ordered list of typed parts. A visitor flattens them: text as it is (escaped),
images, audio and documents as ordered placeholders, for which it records the attachment and the
number of tokens that the placeholder expands to. A turn becomes one segment of formatted text; a
conversation is its segments in the order of turns, so that no conversation has to fit in one row.

Control strings inside texts and roles get a mark after their first character, and marks that were
there before are doubled: reading back is exact for any text.

Defined results: a null text is empty, a null role is the empty role. Turns with equal numbers
are ordered by role, then text, nulls as empty; a null turn number comes first. A null conversation
id is a conversation like others. Repeated rows are turns each. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgraph.llm.batches import bounded_batches

# Fixed values of the template. MARK is the word joiner, which shows nothing.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
MARK = "⁠"
# Strings of this and other common templates that no text may bring along unescaped.
CONTROL = (TURN, BODY, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]",
           "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
# Tokens that an attachment expands to when its part does not say.
TOKENS = {"image": 256, "audio": 128, "document": 512}
LOSS_ROLE = "assistant"

_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_UNMARK = re.compile(f"{MARK}({MARK}?)")


def escaped(text: str) -> str:
    """The text with no control string left in it."""
    return _CONTROL.sub(rf"\1{MARK}", text.replace(MARK, MARK * 2))


def unescaped(text: str) -> str:
    """The text that was escaped."""
    return _UNMARK.sub(r"\1", text) if MARK in text else text


@dataclass
class Flattener:
    """Visits the parts of one turn in order."""

    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(escaped(part.get("text") or ""))

    def _attach(self, kind: str, part: dict) -> None:
        n = part.get("tokens")
        self.attachments.append({"position": len(self.attachments), "type": kind,
                                 "ref": part.get("ref"), "tokens": int(TOKENS[kind] if n is None
                                                                       else n)})
        self.text.append(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)


def segment(role: str, parts: Iterable[dict]) -> tuple[str, int, int, list[dict]]:
    """A turn's formatted text, where its loss starts and ends in it, and its attachments."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    head, body = f"{TURN}{escaped(role)}{BODY}", "".join(flat.text)
    loss = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
    return head + body + END, *loss, flat.attachments


def read_segment(text: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay in the text."""
    role, body = text[len(TURN):-len(END)].split(BODY)
    return unescaped(role), unescaped(body)


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its turn, in the JSON that format_turns reads."""
    return F.to_json(F.array(F.struct(F.lit("text").alias("type"),
                                      F.coalesce(text, F.lit("")).alias("text"))))


FORMATTED = ("conv_id long, turn long, role string, segment string, loss_start int, loss_end int,"
             " attachments array<struct<position:int,type:string,ref:string,tokens:int>>,"
             " expanded_tokens long")


def format_turns(turns: DataFrame, parts: Column, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """A formatted segment for each turn, with its loss span (code points) and attachments.

    parts is a JSON list of parts {type, text, ref, tokens}; types are text, image, audio and
    document, others count as text. Null or an empty list is an empty turn.
    """
    bounded_batches(turns.sparkSession)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"),
                        F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        parts.alias("parts"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [segment(role, json.loads(told) if told else [])
                   for role, told in zip(batch["role"], batch["parts"])]
            yield pd.DataFrame({
                "conv_id": batch["conv_id"].astype("Int64"), "turn": batch["turn"].astype("Int64"),
                "role": batch["role"], "segment": [x[0] for x in out],
                "loss_start": [x[1] for x in out], "loss_end": [x[2] for x in out],
                "attachments": [x[3] for x in out],
                "expanded_tokens": [sum(a["tokens"] for a in x[3]) for x in out]})

    return rows.mapInPandas(run, FORMATTED)


@dataclass
class _Digest:
    """What is known of a conversation after some of its turns."""

    conv_id: int | None
    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, text: str, loss_start: int, loss_end: int) -> None:
        role, body = read_segment(text)
        self.n_turns += 1
        self.formatted_chars += len(text)
        self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        loss = unescaped(text[loss_start:loss_end])
        self.loss_chars += len(loss)
        self.loss.update(loss.encode("utf-8", "surrogatepass"))


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
           " formatted_chars long")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Conversations read back from their segments, each as a stream in the order of turns.

    Segments are dealt out by conversation and sorted; a task holds one batch and the digests so
    far, however long a conversation is.
    """
    rows = (formatted.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
            .select("conv_id", "segment", "loss_start", "loss_end"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(d: _Digest) -> tuple:
            return (d.conv_id, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(),
                    d.formatted_chars)

        def frame(done: list[tuple]) -> pd.DataFrame:
            names = [x.split()[0] for x in DIGESTS.split(", ")]
            out = pd.DataFrame(done, columns=names)
            return out.assign(conv_id=out["conv_id"].astype("Int64"))

        now: _Digest | None = None
        for batch in batches:
            done = []
            ids = [None if pd.isna(x) else int(x) for x in batch["conv_id"]]
            for conv, text, a, b in zip(ids, batch["segment"], batch["loss_start"],
                                        batch["loss_end"]):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(row(now))
                    now = _Digest(conv)
                now.add(text, a, b)
            yield frame(done)
        if now is not None:
            yield frame([row(now)])

    return rows.mapInPandas(run, DIGESTS)
