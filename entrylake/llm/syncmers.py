"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the smallest of its inner s-mers lies at its start or at its end. Whether it is
chosen depends on the k-mer alone, not on what surrounds it, so equal passages have equal anchors wherever they stand, and anchors
of two texts can be matched with their positions. Any k - s + 1 neighbouring k-mers hold at least one anchor.

The fingerprint of a text has the hash and position of every anchor whose hash is below a fixed share (one in ``SHARE``), so it grows with the text; if
these have fewer than ``SKETCH`` different hashes, the anchors of the ``SKETCH`` smallest. The likeness of two fingerprints is the share of anchors that match in
the same order in both: an estimate of what the texts have in common, passage for passage.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import slices, texts

K, S = 24, 9
#: A fingerprint has one anchor in ``SHARE``, and at least those of the ``SKETCH`` smallest hashes; hashes have ``BITS`` bits there.
SKETCH, SHARE, BITS = 64, 16, 48
_BELOW = (1 << BITS) // SHARE - 1
_ANCHOR = np.dtype([("hash", np.uint64), ("at", np.int64)])
_SEGMENT = 1 << 20
_SLICE = 4 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` characters at every position, by doubling."""
    h, done = codes, 1
    while done < width:
        step = min(done, width - done)
        h = h[:len(h) - step] * _M1 + (h[step:] ^ (h[step:] >> np.uint64(29))) * _M2
        done += step
    return _stir(h)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def anchors(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers of a text.

    A text shorter than ``k`` has one anchor, itself; an empty one has none. Of equal s-mers each counts as smallest, so
    a run of one character has an anchor at every place.
    """
    if len(codes) > _SEGMENT + k - 1:
        # No anchor depends on what lies outside its k-mer, so long texts are read in segments.
        parts = [(start, *anchors(codes[start:start + _SEGMENT + k - 1], k, s)) for start in range(0, len(codes) - k + 1, _SEGMENT)]
        return np.concatenate([start + at for start, at, _ in parts]), np.concatenate([h for _, _, h in parts])
    codes = codes.astype(np.uint64) + np.uint64(1)
    n = len(codes) - k + 1
    if n <= 0:
        whole = xxhash.xxh64_intdigest(codes.tobytes())
        return np.zeros(min(1, len(codes)), np.int64), np.full(min(1, len(codes)), whole, np.uint64)
    inner = _hashes(codes, s)
    span = k - s + 1
    padded = np.full(-(-len(inner) // span) * span, ~np.uint64(0))
    padded[:len(inner)] = inner
    grid = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[span - 1:span - 1 + n])
    at = np.flatnonzero((inner[:n] == least) | (inner[span - 1:span - 1 + n] == least))
    return at, _hashes(codes, k)[at]


def matched(a: np.ndarray, b: np.ndarray, k: int = K, s: int = S) -> list[tuple[int, int]]:
    """Position pairs of anchors that occur once in each of two texts."""
    sides = []
    for codes in (a, b):
        at, h = anchors(codes, k, s)
        value, first, times = np.unique(h, return_index=True, return_counts=True)
        sides.append((value[times == 1], at[first[times == 1]]))
    _, i, j = np.intersect1d(sides[0][0], sides[1][0], return_indices=True)
    return sorted(zip(sides[0][1][i].tolist(), sides[1][1][j].tolist()))


def _limit(hashes: np.ndarray) -> int:
    """A fingerprint has all anchors of its text up to this hash; ``hashes`` are those of the text or of the fingerprint."""
    distinct = np.unique(hashes)
    return (1 << BITS) - 1 if len(distinct) < SKETCH else max(_BELOW, int(distinct[SKETCH - 1]))


def sketch(codes: np.ndarray) -> np.ndarray:
    """The anchors (hash, at) of the fingerprint by rising position."""
    at, h = anchors(codes)
    h = h >> np.uint64(64 - BITS)
    low = h <= np.uint64(_limit(h))
    made = np.empty(int(low.sum()), _ANCHOR)
    made["hash"], made["at"] = h[low], at[low]
    return made


def packed(fingerprint: np.ndarray) -> bytes:
    """A fingerprint as bytes: the number of anchors (four bytes), six for each hash, then the distance of each position from the one
    before in groups of seven bits, the lowest first, with the high bit set if another group follows."""
    hashes = fingerprint["hash"].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8:]
    gaps = np.diff(fingerprint["at"], prepend=0)
    size = 1 + sum((gaps >> 7 * level > 0).astype(np.int64) for level in range(1, 9))
    out, start = np.empty(int(size.sum()), np.uint8), np.cumsum(size) - size
    for level in range(int(size.max(initial=0))):
        some = size > level
        out[start[some] + level] = (gaps[some] >> 7 * level & 127) | np.where(size[some] > level + 1, 128, 0)
    return len(fingerprint).to_bytes(4, "big") + hashes.tobytes() + out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The fingerprint that ``packed`` made bytes of."""
    made = np.zeros(int.from_bytes(data[:4], "big"), _ANCHOR)
    cut = 4 + BITS // 8 * len(made)
    for byte in np.frombuffer(data[4:cut], np.uint8).reshape(len(made), BITS // 8).T:
        made["hash"] = made["hash"] << np.uint64(8) | byte
    at = gap = shift = n = 0
    for byte in data[cut:]:
        gap |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            at += gap
            made["at"][n] = at
            gap, shift, n = 0, 0, n + 1
    return made


def written(fingerprint: np.ndarray) -> str:
    """The bytes of a fingerprint as hex digits."""
    return packed(fingerprint).hex()


def _alike_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two lists begin with in common."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def in_order(a: np.ndarray, b: np.ndarray) -> int:
    """The most anchors of two lists of hashes that match one to one in the same order (the longest common subsequence).

    What both begin and end with is matched as it stands. Of the rest, pairs of equal hashes are walked one by one; if hashes repeat so often that these
    are more than 16 a place, a row of the table is made at once, as the bits of one number. Both ways give the same.
    """
    ahead = _alike_ahead(a, b)
    a, b = a[ahead:], b[ahead:]
    behind = _alike_ahead(a[::-1], b[::-1])
    a, b, alike = a[:len(a) - behind], b[:len(b) - behind], ahead + behind
    order = np.argsort(b, kind="stable")
    start, end = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    if (end - start).sum() > 16 * (len(a) + len(b)):
        return alike + _in_order_by_bits(a, b)
    tails: list[int] = []
    for i in np.flatnonzero(end > start).tolist():
        # The last one first: an anchor of ``a`` is matched once.
        for to in order[start[i]:end[i]][::-1].tolist():
            at = bisect_left(tails, to)
            tails[at:at + 1] = [to]
    return alike + len(tails)


def _in_order_by_bits(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; bit j of ``row`` is zero where the table rises at ``b[j]``."""
    places = {}
    for value in np.intersect1d(a, b):
        places[int(value)] = int.from_bytes(np.packbits(b == value, bitorder="little").tobytes(), "little")
    whole = row = (1 << len(b)) - 1
    for value in a.tolist():
        if value in places:
            both = row & places[value]
            row = (row + both | row - both) & whole
    return len(b) - row.bit_count()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the anchors that two texts have in common in the same order, from their fingerprints; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    # Up to here both have all anchors of their texts.
    limit = np.uint64(min(_limit(a["hash"]), _limit(b["hash"])))
    x, y = (f["hash"][f["hash"] <= limit] for f in (a, b))
    both = in_order(x, y)
    return both / (len(x) + len(y) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text)."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made = [written(sketch(code_points(t))) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


_RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
           ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT_SQL = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
               "near_edited double, near_next double")


def _compare(doc_id: int | None, codes: np.ndarray, own: np.ndarray, after: np.ndarray, after_sketch: np.ndarray) -> tuple:
    half = len(codes) // 2
    edited = np.concatenate([codes[:len(codes) - half], after[:half]])
    changed = sketch(edited)
    return (doc_id, len(codes), hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).digest(), packed(own), packed(changed),
            likeness(own, changed), likeness(own, after_sketch))


def _place(doc_id: int | None, h: int) -> tuple[bool, int, int]:
    """Where a row comes: by falling id, null ids last, rows of one id by the hash of their text."""
    return doc_id is None, -(doc_id or 0), h


def _parts(keyed: DataFrame) -> list[tuple[bool, int, int]]:
    """The first places of evenly filled parts of the rows (doc_id, _h): numbers only, and some per task of the next shuffle."""
    n = 4 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.select("doc_id", "_h").repartitionByRange(n, F.col("doc_id").desc_nulls_last(), F.col("_h"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0))), F.col("_h"), F.col("doc_id").alias("id")))
    return sorted(_place(r[1]["id"], r[1]["_h"]) for r in ranged.groupBy(F.spark_partition_id()).agg(first.alias("first")).collect())


def edit_study(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; columns as in ``_RESULT``, bytes as hex digits.

    The edited text ends in the beginning of the next document by falling doc_id (after the last: the first); its last half
    makes room for it. Null texts count as empty, null ids come last, rows of one id are ordered by their text. A single row follows itself.

    Rows are cut into parts along their order, from a pass over ids and hashes only. The texts are shuffled once, by part; the first row of a part
    also goes to the part before, so that every row has its next one beside it.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    starts = _parts(keyed)
    columns = [F.lower(F.hex(n)).alias(n) if kind == pa.binary() else F.col(n) for n, kind in _RESULT]

    def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, str] = {}
        for batch in (part for whole in stream for part in slices(whole, _SLICE)):
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            part = [bisect_right(starts, _place(i, h)) - 1 for i, h in zip(ids, hashes)]
            kinds = [pa.array(part, pa.int32()), pa.array([False] * len(part))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *kinds], names=["doc_id", "text", "_h", "_part", "_after"])
            # Rows of one place may be many; the smallest text of each task is enough.
            for row, (i, h, p) in enumerate(zip(ids, hashes, part)):
                if _place(i, h) == starts[p] and ((text := batch.column(1)[row].as_py()) < sent.get(p, text + "x")):
                    sent[p] = text
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int64()), pa.array([text]), pa.array([h], pa.int64()), pa.array([(p - 1) % len(starts)], pa.int32()),
                         pa.array([True])], names=["doc_id", "text", "_h", "_part", "_after"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in (part for whole in stream for part in slices(whole, _SLICE)):
            rows = []
            for doc_id, text, _, part, after in zip(*(c.to_pylist() for c in batch.columns)):
                if after and (before is None or before[3] != part):
                    continue  # another copy of the row that was taken
                codes = code_points(text)
                own = sketch(codes)
                if before is not None:
                    rows.append(_compare(*before[:3], codes, own))
                before = None if after else (doc_id, codes, own, part)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _RESULT)], names=[n for n, _ in _RESULT])

    placed = (keyed.mapInArrow(assign, "doc_id long, text string, _h long, _part int, _after boolean").repartition("_part")
              .sortWithinPartitions("_part", "_after", F.col("doc_id").desc_nulls_last(), "_h", "text"))
    return placed.mapInArrow(run, _RESULT_SQL).select(*columns)
