"""Chat formatting: typed content parts, control-string escaping, loss mask, reading back.

A conversation is formatted as a row of *pieces*, one per turn, whose texts joined in
order are the formatted conversation; so no conversation is ever held whole, and
escaping, visiting and counting run in parallel even within one huge conversation.
Only the digests, sequential by nature, stream over the sorted pieces of a conversation.

Template, for each turn: ``<|im_start|>`` role LF text ``<|im_end|>`` LF. Inside roles
and texts every ``<``, backslashes, ``|`` gets one more backslash before the bar, so no
control string can arise from content; roles also escape backslash and line feed. Both
are undone exactly by the reader. The loss mask covers the text of assistant turns.

A turn's content may also be an array of typed parts (struct of kind, text, ref, width,
height, seconds, pages). A visitor flattens them into text and ordered placeholders
``<|image_N|>``, ``<|audio_N|>``, ``<|document_N|>``, N counting from 1 within the turn,
and records for each placeholder its reference and the tokens it expands to.

Defined cases: null role or text is empty; turns sort by turn (null first), then by role and text
as formatted;
repeated rows are turns of their own; rows without conv_id form the conversation null;
unknown part kinds raise; null parts and null lists hold nothing; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<ordinal:int,kind:string,ref:string,n_tokens:bigint,at:bigint>"
PIECES = (
    "conv_id long, turn long, role string, content string, piece string, in_loss boolean, "
    f"loss_start long, loss_end long, attachments array<{ATTACHMENT}>, n_attachment_tokens long"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Budget:
    """What attachments expand to, in tokens; fixed by the model that is trained."""

    image_patch: int = 28
    image_max: int = 4096
    audio_per_second: float = 25.0
    document_per_page: int = 768


@dataclass
class Flattener:
    """Visits the typed parts of one turn."""

    budget: Budget = field(default_factory=Budget)
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        kind = part.get("kind") or "text"
        visitor = getattr(self, f"visit_{kind}", None)
        if visitor is None:
            raise ValueError(f"unknown kind of content part: {kind!r}")
        visitor(part)

    def _emit(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def _attach(self, kind: str, part: dict, n_tokens: int) -> None:
        n = len(self.attachments) + 1
        self.attachments.append({"ordinal": n, "kind": kind, "ref": part.get("ref"), "n_tokens": n_tokens, "at": self.length})
        self._emit(f"<|{kind}_{n}|>")

    def visit_text(self, part: dict) -> None:
        self._emit(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = lambda k: math.ceil(max(part.get(k) or 0, 1) / self.budget.image_patch)
        self._attach("image", part, min(self.budget.image_max, side("width") * side("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.budget.audio_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.budget.document_per_page)
        if part.get("text"):
            self._emit("\n" + escape(part["text"]))


def flatten(parts: list[dict | None] | None, budget: Budget | None = None) -> tuple[str, list[dict]]:
    """Escaped text with placeholders, and its attachments."""
    f = Flattener(budget or Budget())
    for p in parts or []:
        f.visit(p)
    return "".join(f.out), f.attachments


def format_turns(turns: DataFrame, parts: str | None = None, loss_roles: tuple[str, ...] = ("assistant",), budget: Budget | None = None) -> DataFrame:
    """A piece per turn of (conv_id, turn, role, text), or with the array column ``parts`` in place of text.

    loss_start and loss_end are code points within the piece. Row by row: no shuffle.
    """
    kind = f"array<{PART}>"
    content = (
        F.col(parts).cast(kind)
        if parts
        else F.array(F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))).cast(kind)
    )
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", PIECES)]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64()), ("at", pa.int64())])), pa.int64()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body, found = flatten(content, budget)
                role = role or ""
                head = f"{START}{escape_role(role)}\n"
                loss = role in loss_roles
                rows.append((conv, turn, role, body, f"{head}{body}{END}\n", loss, len(head) if loss else None, len(head) + len(body) if loss else None, found, sum(a["n_tokens"] for a in found)))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), content.alias("content")
    ).mapInArrow(pieces, PIECES)


class Reader:
    """Parses formatted text, given in any chunks, back into turns."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, escaped text) of each turn that ends in what was fed so far."""
        self.rest += text
        while (end := self.rest.find(END)) >= 0:
            if not self.rest.startswith(START):
                raise ValueError("a turn doesn't start with its control string")
            head = self.rest.index("\n")
            yield unescape_role(self.rest[len(START) : head]), self.rest[head + 1 : end]
            self.rest = self.rest[end + len(END) + 1 :]

    def close(self) -> None:
        if self.rest:
            raise ValueError("the last turn is cut short")


class _Digest:
    def __init__(self, conv: int | None) -> None:
        self.conv, self.n, self.loss_chars, self.chars = conv, 0, 0, 0
        self.turns, self.loss, self.reader = hashlib.sha256(), hashlib.sha256(), Reader()

    def add(self, piece: str, loss: bool, start: int | None, end: int | None) -> None:
        self.chars += len(piece)
        for role, body in self.reader.feed(piece):
            text = unescape(body)
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if loss:
            text = unescape(piece[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        self.reader.close()
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, digests of what a reader of its formatted text finds, and of what its loss mask covers.

    Streams over pieces sorted by conversation and turn; holds one piece at a time. A
    conversation's SHA-256 is sequential, so one task hashes it, but it only hashes:
    pieces come ready, sorted by Spark with spilling.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in DIGEST.split(", ")]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            masks = zip(*(batch.column(c).to_pylist() for c in ("in_loss", "loss_start", "loss_end")), strict=True)
            for conv, piece, mask in zip(batch.column("conv_id").to_pylist(), batch.column("piece"), masks, strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                        if len(done) == 5000:
                            yield out()
                            done.clear()
                    now = _Digest(conv)
                now.add(piece.as_py(), *mask)
        if now is not None:
            done.append(now.row())
        if done:
            yield out()

    return (
        pieces.select("conv_id", "turn", "piece", "in_loss", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "piece")
        .select("conv_id", "piece", "in_loss", "loss_start", "loss_end")
        .mapInArrow(digest, DIGEST)
    )


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = f"{END}{START}assistant ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, t.turn, t.role, '{control}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_back(format_turns(turns.unionByName(extra)))


QUERIES = {"op1_chat": op1_chat}
ORACLE = {
    "op1_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(text) + length(regexp_extract_all(text, '<\\*\|'))
    + length(regexp_extract_all(role, '<\\*\|')) + 10 + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
}
