"""Fill-in-the-middle samples: a text is cut at two borders of its units, and the middle is moved to the end.

One full match of the repeated unit keeps every repetition of its group: the ends of the group are the borders of all units. Their number and both
places to cut at are read from these, without a loop over the units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import slices, texts

UNIT = r"[^\n]*\n|[^\n]+"
SEED = "7"
#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, those that are rearranged; and of these, those with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
_SLICE = 4 << 20


@dataclass(frozen=True)
class Sample:
    """A rearranged text, and the lengths of its parts in characters if it is."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, ...]:
    """Four numbers of 32 bits from a document's id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


class Cutter:
    """Cuts texts into ``unit`` repetitions, each tried with all its alternatives in order at one place only."""

    def __init__(self, unit: str = UNIT, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
                 marks: tuple[str, str, str] = MARKS) -> None:
        # Possessive: a unit that was matched is not taken back, so nothing is kept for it but its place.
        self._units = regex.compile(f"({unit})*+")
        self.seed, self.rate, self.suffix_first, self.marks = seed, rate, suffix_first, marks

    def ends(self, text: str) -> list[int]:
        """The ends of all units of a text."""
        match = self._units.fullmatch(text)
        if match is None:
            raise ValueError("the units do not cover the text")
        return match.ends(1)

    def __call__(self, doc_id: int | None, text: str) -> Sample:
        ends = self.ends(text)
        n = len(ends)
        h1, h2, h3, h4 = draws(doc_id, self.seed)
        if not text or any(mark in text for mark in self.marks) or h3 % 100 >= self.rate:
            return Sample(n, "plain", None, None, text)
        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[i - 1] if i else 0 for i in (first, last))
        prefix, suffix, middle = (mark + part for mark, part in zip(self.marks, (text[:a], text[b:], text[a:b])))
        if h4 % 100 < self.suffix_first:
            return Sample(n, "spm", a, b - a, suffix + prefix + middle)
        return Sample(n, "psm", a, b - a, prefix + suffix + middle)


def restored(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that a sample was made of. No mark stands in a text that was rearranged, so each is found where it was put."""
    if form == "plain":
        return output
    p, s, m = marks
    if form == "psm":
        prefix, _, rest = output[len(p):].partition(s)
        suffix, _, middle = rest.partition(m)
    else:
        suffix, _, rest = output[len(s):].partition(p)
        prefix, _, middle = rest.partition(m)
    return prefix + middle + suffix


def rearrange(docs: DataFrame, cutter: Cutter | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs`` (doc_id, text).

    Null and empty texts, and texts that hold a mark, stay as they are: plain, without lengths of parts. Rows of one id are cut by the same draws; a
    null id has draws of its own. An empty table gives none; other columns are ignored. Nothing is shuffled.
    """
    made = cutter or Cutter()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch, _SLICE):
                ids = part.column(0).to_pylist()
                out = [made(i, t) for i, t in zip(ids, texts(part.column(1)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s.n for s in out], pa.int64()), pa.array([s.form for s in out], pa.string()),
                     pa.array([s.prefix_chars for s in out], pa.int64()), pa.array([s.middle_chars for s in out], pa.int64()),
                     pa.array([s.output for s in out], pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(samples: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of ``samples`` (with output and form) and ``restored``, the text read back from them, in place of a column of that name."""
    spec = StructType([f for f in samples.schema.fields if f.name != "restored"]).add("restored", "string")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at, form = (batch.schema.get_field_index(c) for c in ("output", "form"))
            for part in slices(batch, _SLICE, at):
                text = [restored(o, f, marks) for o, f in zip(texts(part.column(at)), part.column(form).to_pylist())]
                kept = {n: c for n, c in zip(batch.schema.names, part.columns) if n != "restored"} | {"restored": pa.array(text, pa.string())}
                yield pa.RecordBatch.from_arrays([kept[n] for n in spec.names], names=spec.names)

    return samples.mapInArrow(run, spec)


def infill_digest(docs: DataFrame) -> DataFrame:
    """Samples of every row, with digests of the output and of the text that is read back from it."""
    return restore(rearrange(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                           F.sha2("restored", 256).alias("restored_sha256"))
