"""Chat formatting of typed content parts.

A visitor walks over the parts of every message (text, image, audio, document), flattens them to text with ordered placeholders, notes which attachment each
placeholder stands for, and counts the tokens the placeholder will expand to. Control strings inside texts, roles and references are escaped
reversibly, so the formatted conversation can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Strings that the template, or other usual templates, give a meaning to. All are longer than one character and none holds a backslash.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|body|>", "<|end|>",
           "<|image:", "<|audio:", "<|document:", "<|endoftext|>"]
BEGIN, END, TURN, BODY, STOP = "<s>", "</s>", "<|turn|>", "<|body|>", "<|end|>"
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PART_TYPE = pa.struct([("type", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("width", pa.int32()),
                       ("height", pa.int32()), ("seconds", pa.float64()), ("pages", pa.int32())])
_ATTACHMENT = pa.struct([("place", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())])


def escape(text: str) -> str:
    """Double every backslash, then put one behind the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Visitor:
    """Flattens the parts of one message. ``expand`` gives the tokens of an attachment, by type."""

    def __init__(self, patch: int = 14, tokens_per_second: float = 25.0, tokens_per_page: int = 800) -> None:
        self._patch, self._per_second, self._per_page = patch, tokens_per_second, tokens_per_page

    def visit(self, parts: list[dict]) -> tuple[str, list[dict]]:
        """The flattened text and its attachments; places count from 0 within the message."""
        out: list[str] = []
        attachments: list[dict] = []
        for part in parts:
            kind = part.get("type") or "text"
            step: Callable[[dict], int] | None = getattr(self, f"_{kind}", None) if kind in ("image", "audio", "document") else None
            if step is None:
                # A part of unknown type is kept as the text it has.
                out.append(escape(part.get("text") or ""))
                continue
            out.append(f"<|{kind}:{len(attachments)}|>")
            attachments.append({"place": len(attachments), "type": kind, "ref": part.get("ref"), "n_tokens": step(part)})
        return "".join(out), attachments

    def _image(self, part: dict) -> int:
        side = lambda n: -(-max(1, n or 1) // self._patch)
        return side(part.get("width")) * side(part.get("height"))

    def _audio(self, part: dict) -> int:
        return max(1, int(-(-(part.get("seconds") or 0.0) * self._per_second // 1)))

    def _document(self, part: dict) -> int:
        return max(1, part.get("pages") or 1) * self._per_page


def format_messages(messages: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """One formatted piece per message of ``messages`` (conv_id long, turn long, role string, parts array of ``PART``).

    Gives conv_id, turn, piece, loss_start and loss_end (code points of the piece that are trained on: the body of assistant messages, or 0
    and 0), attachments and n_tokens of attachments. A conversation is ``BEGIN``, its pieces in the order of their
    turns, and ``END``. It stays a run of pieces, so one of any length is never held at once. Null roles and parts count as empty; a
    table without rows gives none; other columns are ignored.
    """
    visitor = visitor or Visitor()
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
                        ("attachments", pa.list_(_ATTACHMENT)), ("n_tokens", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for conv, turn, role, parts in zip(*(c.to_pylist() for c in batch.columns)):
                body, attachments = visitor.visit(parts or [])
                head = TURN + escape(role or "") + BODY
                trained = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
                rows.append((conv, turn, head + body + STOP, *trained, attachments, sum(a["n_tokens"] for a in attachments)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return messages.select("conv_id", "turn", "role", F.col("parts").cast(f"array<{PART}>").alias("parts")).mapInArrow(
        run, "conv_id long, turn long, piece string, loss_start long, loss_end long, "
             "attachments array<struct<place:long,type:string,ref:string,n_tokens:long>>, n_tokens long")


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and flattened body of a piece, both unescaped; placeholders stay."""
    if not piece.startswith(TURN) or not piece.endswith(STOP):
        raise ValueError("not a formatted message")
    role, _, body = piece[len(TURN):-len(STOP)].partition(BODY)
    return unescape(role), unescape(body)


def as_parts(conversations: DataFrame) -> DataFrame:
    """Plain messages (conv_id, turn, role, text) as messages of one text part; a null text is an empty part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                    F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                    F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def read_back(pieces: DataFrame) -> DataFrame:
    """Digest of each conversation from its formatted ``pieces``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Equal turns are ordered by their piece. Pieces of a conversation follow each other in one sorted partition and are read as a stream with constant
    memory: a digest is sequential by its nature.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_, done = None, False, []
        for batch in stream:
            for conv, piece, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if not any_ or conv != now:
                    if any_:
                        done.append((now, turns, every.hexdigest(), trained, loss.hexdigest(), chars))
                    now, any_, turns, trained, chars = conv, True, 0, 0, len(BEGIN) + len(END)
                    every, loss = hashlib.sha256(), hashlib.sha256()
                role, body = parse_piece(piece)
                every.update(f"{role}\n{body}\n".encode())
                answer = unescape(piece[start:end])
                loss.update(answer.encode())
                turns, trained, chars = turns + 1, trained + len(answer), chars + len(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
                done = []
        if any_:
            done = [(now, turns, every.hexdigest(), trained, loss.hexdigest(), chars)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
    return (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
            .select("conv_id", "piece", "loss_start", "loss_end")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


def rendered(pieces: DataFrame) -> DataFrame:
    """(conv_id, text): whole formatted conversations, for those that fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "piece")))
    return pieces.groupBy("conv_id").agg(ordered.alias("p")).select(
        "conv_id", F.concat(F.lit(BEGIN), F.concat_ws("", "p.piece"), F.lit(END)).alias("text"))
