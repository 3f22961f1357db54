r"""Chat formatting: typed content parts of turns to one training text with a loss mask.

A visitor flattens the parts of a turn: text is escaped and copied; an image, audio or document part becomes
an ordered placeholder ``<|kind:k|>`` (k counts the turn's attachments from 0), with its reference and its
expanded token count recorded. A turn is written as ``### Role: `` + content + ``</turn>`` + newline.
Inside texts a backslash goes before every backslash, ``### ``, ``</turn>`` and ``<|``, so that nothing in a
text reads as a marker and the texts come back exactly.

The rows of a conversation are ordered by turn, ties by role and text. Null text or parts: empty. A null
role is the empty role; a null conversation id is an id of its own. Repeated rows are turns of their own.
A malformed part is left out and its reason recorded in ``problems``; parts that aren't a JSON list, likewise,
give an empty turn. Empty tables give empty results; other columns aren't read, whatever their names. A very
long text is held by itself. One task streams over a conversation's rows in order and keeps only offsets and digests, so that memory
doesn't grow with a conversation.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import sliced, tidy

CONTROL = re.compile(r"\\|### |</turn>|<\|")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: What ends a header or a turn when a backslash doesn't stand before it.
MARKS = re.compile(r"\\.|: |</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class Malformed(ValueError):
    """What is wrong with a part."""


def amount(part: dict, name: str, otherwise: float) -> float:
    """A part's size: a finite number that isn't negative; ``otherwise`` where it's absent or zero."""
    value = part.get(name)
    if value is None:
        return otherwise
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < 1e12:
        raise Malformed(f"{name} is no size")
    return value or otherwise


class PartVisitor:
    """Flattens content parts. Each is a dict with ``type``, and ``text`` or ``ref`` and its sizes."""

    def __init__(self, image_patch: int = 14, image_merge: int = 2, audio_rate: float = 25.0, page_tokens: int = 256):
        self.image_patch, self.image_merge, self.audio_rate, self.page_tokens = image_patch, image_merge, audio_rate, page_tokens
        self.visits = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}

    def read(self, raw: str | None) -> tuple[str, list[dict], list[str]]:
        """As ``flatten``, of parts as JSON."""
        try:
            parts = json.loads(raw) if raw else []
        except (ValueError, RecursionError):
            return "", [], ["parts are no JSON"]
        if parts is None:
            parts = []
        return self.flatten(parts) if isinstance(parts, list) else ("", [], ["parts are no list"])

    def flatten(self, parts: list) -> tuple[str, list[dict], list[str]]:
        """The escaped content with placeholders, the attachments in order, and what was wrong with parts that are left out."""
        content, found, problems = [], [], []
        for k, part in enumerate(parts):
            try:
                if not isinstance(part, dict):
                    raise Malformed("no object")
                kind = part.get("type") or "text"
                visit = self.visits.get(kind) if isinstance(kind, str) else None
                if visit is None:
                    raise Malformed("unknown type")
                content.append(visit(part, found))
            except Malformed as e:
                problems.append(f"part {k}: {e}")
        return "".join(content), found, problems

    def visit_text(self, part: dict, found: list[dict]) -> str:
        text = part.get("text")
        if text is not None and not isinstance(text, str):
            raise Malformed("text is no text")
        return escape((text or "").encode("utf-8", "replace").decode())  # JSON may hold half a surrogate pair

    def visit_image(self, part: dict, found: list[dict]) -> str:
        cell = self.image_patch * self.image_merge
        return self._attach("image", part, found, math.ceil(amount(part, "width", cell) / cell) * math.ceil(amount(part, "height", cell) / cell))

    def visit_audio(self, part: dict, found: list[dict]) -> str:
        return self._attach("audio", part, found, math.ceil(amount(part, "seconds", 0) * self.audio_rate))

    def visit_document(self, part: dict, found: list[dict]) -> str:
        return self._attach("document", part, found, math.ceil(amount(part, "pages", 1)) * self.page_tokens)

    def _attach(self, kind: str, part: dict, found: list[dict], tokens: int) -> str:
        ref = part.get("ref")
        if ref is not None and not isinstance(ref, str):
            raise Malformed("ref is no text")
        if tokens >= 1 << 62:
            raise Malformed("too large")
        found.append({"kind": kind, "ref": ref and ref.encode("utf-8", "replace").decode(), "tokens": tokens})
        return f"<|{kind}:{len(found) - 1}|>"


def header(role: str) -> str:
    """The role is escaped too, and its colons, so that the header's end is found."""
    return "### " + escape(role[:1].upper() + role[1:] if role in ("system", "user", "assistant", "tool") else f"={role}").replace(": ", "\\: ") + ": "


def read_turn(segment: str) -> tuple[str, str, tuple[int, int]]:
    """Role, content with escapes, and the content's span: what ``header`` and the turn's end enclose."""
    if not segment.startswith("### "):
        raise ValueError("a turn must begin with its header")
    head = next(m for m in MARKS.finditer(segment, 4) if m[0] == ": ")
    role = unescape(segment[4 : head.start()])
    end = next((m for m in MARKS.finditer(segment, head.end()) if m[0] == "</turn>\n"), None)
    if end is None or end.end() != len(segment):
        raise ValueError("a turn must end with its marker, once")
    return role[1:] if role.startswith("=") else role[:1].lower() + role[1:], segment[head.end() : end.start()], (head.end(), end.start())


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None, loss_roles: tuple[str, ...] = ("assistant",), visitor: PartVisitor | None = None) -> DataFrame:
    """One row per turn, a conversation's rows together and in order: ``conv``, ``turn``, ``segment`` (their
    concatenation is the conversation), ``start`` (the segment's offset in it, in code points), ``loss_start``
    and ``loss_end`` (offsets under the loss mask; null outside it), ``attachments``, ``attachment_tokens`` and ``problems``.

    ``parts``: a column with a JSON array of content parts or an array of structs; it's taken instead of ``text``.
    """
    visitor = visitor or PartVisitor()
    body = F.to_json(parts) if parts and not isinstance(turns.schema[parts].dataType, type(turns.schema[role].dataType)) else F.col(parts or text)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(body, F.lit("")).alias("body"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "body")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"conv {kinds['conv']}, turn {kinds['turn']}, segment string, start bigint, loss_start bigint, loss_end bigint, attachments array<struct<kind:string,ref:string,tokens:bigint>>, attachment_tokens bigint, problems array<string>"
    typed = bool(parts)

    def run(batches):
        import pyarrow as pa

        now, at = object(), 0
        for batch in sliced(batches, 3):
            made = {k: [] for k in ("segment", "start", "loss_start", "loss_end", "attachments", "attachment_tokens", "problems")}
            for c, who, what in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if c != now:
                    now, at = c, 0
                content, found, problems = visitor.read(what) if typed else visitor.flatten([{"type": "text", "text": what}])
                head = header(who)
                segment = f"{head}{content}</turn>\n"
                learnt = who in loss_roles
                for k, v in (("segment", segment), ("start", at), ("loss_start", at + len(head) if learnt else None), ("loss_end", at + len(head) + len(content) if learnt else None), ("attachments", found), ("attachment_tokens", min((1 << 63) - 1, sum(x["tokens"] for x in found))), ("problems", problems)):
                    made[k].append(v)
                at += len(segment)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            types = {"segment": pa.string(), "attachments": kind, "problems": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, types.get(k, pa.int64())) for k, v in made.items())], names=["conv", "turn", *made])

    return rows.mapInArrow(tidy(run), schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the conversations, from the segments and loss spans alone: the rows must come as ``format_turns`` leaves them."""
    conv = formatted.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches):
        import pyarrow as pa

        def row():
            return (now, n, turns.hexdigest(), lost, loss.hexdigest(), at)

        now, n = None, 0
        kind = None
        for batch in sliced(batches, 2):
            out, kind = [], batch.column(0).type
            for c, segment, start, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if n and c != now:
                    out.append(row())
                    n = 0
                if not n:
                    now, at, lost, turns, loss = c, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, content, _ = read_turn(segment)
                turns.update(f"{role}\n{unescape(content)}\n".encode())
                if a is not None:
                    text = unescape(segment[a - start : b - start])
                    loss.update(text.encode())
                    lost += len(text)
                at, n = at + len(segment), n + 1
            yield columns(out, kind)
        if n:
            yield columns([row()], kind)

    def columns(out, kind):
        import pyarrow as pa

        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return formatted.mapInArrow(tidy(run), schema)


#: The conversation whose texts are made of control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the tricky one, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.unionByName(extra))).withColumnRenamed("conv", "conv_id")


OP5_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(regexp_replace(text, '(\\|### |</turn>|<\|)', '\\\1', 'g')) + length(role) + 4 + 2 + 8
    + CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN 0 ELSE 1 END AS chars FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
