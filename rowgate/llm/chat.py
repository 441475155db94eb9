"""Chat formatting of typed content parts.

A turn's content is a text or an array of parts (type text, image, audio or document). A visitor flattens the parts, in order, into one
string with a placeholder for each attachment, and records the attachment's reference and the tokens that it expands to. A turn is written as

    <turn>role NEWLINE content</turn> NEWLINE

Backslashes and everything in a text that looks like the beginning of a mark get a backslash before them, so a text can never end
its turn and is read back exactly. Turns are formatted row by row; a conversation is its pieces in the order of turns and is never gathered.
Reading back streams through sorted pieces, whatever the length of a conversation.

Defined results: null roles and texts are empty; null parts and parts of an unknown type are empty texts; turns with the same number (or none, which
come first) follow by their formatted text; repeated rows are turns of their own; a null conversation id is a conversation; an empty table gives no rows.
Other columns of the input are not looked at."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import map_batches, quoted
from rowgate.llm.tokens import kept_encoder, model_text

_MARK = re.compile(r"\\|<(?=/?(?:turn|image|audio|document)\b)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLACE = re.compile(r"\\.|<(image|audio|document)/>", re.S)
_TURN = re.compile(r"<turn>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    out = _MARK.sub(lambda m: "\\" + m[0], text)
    return out.replace("\n", "\\\n") if role else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Costs:
    """Tokens that attachments expand to: image patches of so many pixels a side, per second of audio, per page of a document."""

    patch: int = 28
    audio_second: float = 25.0
    page: int = 1024


class Visitor:
    """Flattens the parts of one turn. Attachments: (kind, reference, place in the content, tokens)."""

    def __init__(self, costs: Costs) -> None:
        self.costs, self.out, self.size = costs, [], 0
        self.texts: list[str] = []
        self.attachments: list[tuple[str, str | None, int, int]] = []

    def visit(self, part: dict | None) -> None:
        part = part or {}
        method = getattr(self, f"visit_{part.get('type')}", None) if part.get("type") in ("text", "image", "audio", "document") else None
        (method or self.visit_text)(part if method else {})

    def _write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((kind, part.get("uri"), self.size, tokens))
        self._write(f"<{kind}/>")

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")
        self._write(escape(self.texts[-1]))

    def visit_image(self, part: dict) -> None:
        sides = [max(1, math.ceil((part.get(k) or 0) / self.costs.patch)) for k in ("width", "height")]
        self._attach("image", part, sides[0] * sides[1])

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.costs.audio_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.costs.page)


def format_turns(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None,
    loss_role: str = "assistant", tokenizer: str | None = None, costs: Costs | None = None,
) -> DataFrame:
    """One row per turn: conv_id, turn, piece, loss_start and loss_end (the part of the piece that bears loss, null if none), attachments and n_tokens
    (of the texts, if a tokenizer file is given, and of the attachments). parts_col takes the place of text_col."""
    model = model_text(tokenizer) if tokenizer else None
    costs = costs or Costs()
    content = quoted(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("type"), quoted(text_col).alias("text")))
    rows = turns.select(quoted(id_col).alias("conv_id"), quoted(turn_col).alias("turn"), quoted(role_col).alias("role"), content.alias("parts"))
    kinds = [turns.schema[c].dataType.simpleString() for c in (id_col, turn_col)]
    attachment = pa.list_(pa.struct([("kind", pa.string()), ("reference", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())]))

    def formatted(batches):
        encoder = kept_encoder(model, literal=True) if model else None
        for batch in batches:
            pieces, starts, ends, attached, texts = [], [], [], [], []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                visitor = Visitor(costs)
                for part in parts or []:
                    visitor.visit(part)
                head, body = f"<turn>{escape(role or '', role=True)}\n", "".join(visitor.out)
                pieces.append(f"{head}{body}</turn>\n")
                starts.append(len(head) if role == loss_role else None)
                ends.append(len(head) + len(body) if role == loss_role else None)
                attached.append([dict(zip(("kind", "reference", "place", "tokens"), (k, r, p + len(head), t), strict=True)) for k, r, p, t in visitor.attachments])
                texts.append(" ".join(visitor.texts))
            n = [len(x) for x in encoder.encode(texts)] if encoder else [0] * len(texts)
            n = [a + sum(x["tokens"] for x in b) for a, b in zip(n, attached, strict=True)]
            big = pa.int64()
            data = [pa.array(pieces, pa.string()), pa.array(starts, big), pa.array(ends, big), pa.array(attached, attachment), pa.array(n, big)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *data], ["conv_id", "turn", "piece", "loss_start", "loss_end", "attachments", "n_tokens"])

    schema = f"conv_id {kinds[0]}, turn {kinds[1]}, piece string, loss_start bigint, loss_end bigint, "
    schema += "attachments array<struct<kind:string,reference:string,place:bigint,tokens:bigint>>, n_tokens bigint"
    return map_batches(rows, formatted, schema)


def read_turns(piece: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in formatted text; attachments are left out of the text."""
    found, at = [], 0
    while at < len(piece):
        m = _TURN.match(piece, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(_PLACE.sub(lambda x: "" if x[1] else x[0], m[2]))))
        at = m.end()
    return found


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted pieces alone: conv_id, n_turns, turns_sha256 (role, newline, text, newline of every turn),
    loss_chars and loss_sha256 (all text under the loss mask), formatted_chars, n_attachments and n_tokens."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    parts = formatted.select("conv_id", "turn", "piece", "loss_start", "loss_end", F.size("attachments").cast("bigint").alias("a"), "n_tokens")
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "n_tokens"]

    def read(batches):
        state = None
        for batch in batches:
            done, kinds = [], batch.schema.field(0).type
            for conv, _, piece, start, end, attached, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in read_turns(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    text = unescape(_PLACE.sub(lambda x: "" if x[1] else x[0], piece[start:end]))
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(piece)
                state[6] += attached
                state[7] += tokens
            if done:
                yield rows(done, kinds)
        if state:
            yield rows([state], kinds)

    def rows(states, kinds):
        columns = list(zip(*((s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), *s[5:]) for s in states), strict=True))
        types = [kinds, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, n_tokens bigint"
    return map_batches(parts, read, schema)
