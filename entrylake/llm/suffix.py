"""Suffix-array deduplication with a run-length index.

Removes every byte that is covered by a string of ``width`` bytes which also starts anywhere else.

1. *Anchors.* The window of ``width`` bytes at each position is routed by its smallest gram of ``GRAM`` bytes (leftmost if tied).
   Equal windows have equal anchors at equal offsets, whatever surrounds them. Consecutive windows of one anchor form a
   region.
2. *Region classes.* Equal regions (same anchor, offset and bytes) are counted. Two or more: all their windows repeat.
   An anchor of one region only: none repeats. These need no bytes beyond their hashes.
3. *Index.* What is left are anchors with several different regions, some of them single: edges of shared passages and near copies. One
   region of each class is cut from the texts, and all regions of an anchor meet in one block of bounded size. A block is a
   repetitive collection: its Burrows-Wheeler transform is run-compressed, text positions are sampled at the run
   ends, and the length of the longest match elsewhere is streamed along the text from those samples only. Lengths of
   ``width`` or more are marked.
4. Anchors whose different regions exceed a block are settled window by window, by counting hashes of whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import forget, lean, raw, slices, stored

WIDTH = 400
GRAM = 128
#: Bytes of different regions of one anchor that are indexed; an anchor with more is settled by whole windows. Smaller anchors are
#: indexed together up to a share of it: the index takes some 90 times its block in memory.
BLOCK_BYTES = 1 << 20
SHARED = 4
#: Bytes of text that a task works on at once.
_SLICE = 1 << 20
#: A text is cut into segments of so many windows; segments up to so many bytes are handled at once.
SEGMENT = 1 << 17
#: Bytes that stand for a word where repeats are judged by words.
CODE = 6
_SEPARATOR = 255  # never occurs in UTF-8
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = (x * _M1) ^ ((y + _M3) * _M2)
    h ^= h >> np.uint64(31)
    h *= _M3
    h ^= h >> np.uint64(32)
    return h


def words_at(a: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one big-endian number; zero beyond the end."""
    b = np.concatenate([a, np.zeros(15, np.uint8)]).tobytes()
    out = np.empty(len(a), np.uint64)
    for shift in range(8):
        part = out[shift::8]
        part[:] = np.frombuffer(b, ">u8", count=len(part), offset=shift)
    return out


def gram_hashes(a: np.ndarray, length: int = GRAM) -> np.ndarray:
    """Hash of the ``length`` bytes (8 at least) at every position, by doubling."""
    h, done = words_at(a)[:len(a) - 7], 8
    while done < length:
        step = min(done, length - done)
        h = _mix(h[:len(h) - step], h[step:])
        done += step
    return h


def leftmost_minima(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of each ``span`` consecutive values (upper 32 bits count), leftmost if tied."""
    n = len(h) - span + 1
    low = np.uint64(0xFFFFFFFF)
    key = np.full(-(-len(h) // span) * span, ~np.uint64(0))
    key[:len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    key = key.reshape(-1, span)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & low).astype(np.int64)


def _segments(data: list[bytes], width: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, first byte, end) with about ``SEGMENT`` bytes; neighbouring segments overlap by width - 1."""
    group, size = [], 0
    for row, text in enumerate(data):
        for start in range(0, max(0, len(text) - width + 1), SEGMENT):
            end = min(len(text), start + SEGMENT + width - 1)
            group.append((row, start, end))
            size += end - start
            if size >= SEGMENT:
                yield group
                group, size = [], 0
    if group:
        yield group


def regions(data: list[bytes], width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor hash, region hash, first window, windows, count) of the regions of texts.

    Equal regions of one text within a segment are given once with their count; beside it come, with count zero, the
    runs of their windows, all of which repeat.
    """
    for group in _segments(data, width):
        joined = b"".join([data[r][s:e] for r, s, e in group])
        a = np.frombuffer(joined, np.uint8)
        sizes = np.array([e - s for _, s, e in group])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(group)), sizes)
        h = gram_hashes(a, gram)
        anchor = leftmost_minima(h, width - gram + 1)
        at = np.flatnonzero(np.arange(len(anchor)) + width <= ends[owner[:len(anchor)]])
        p = anchor[at]
        new = np.r_[True, (np.diff(p) != 0) | (np.diff(at) != 1)]
        first = at[new]
        count = np.diff(np.r_[np.flatnonzero(new), len(at)])
        p = p[new]
        seg = owner[first]
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        body = np.fromiter((digest(view[s:s + n + width - 1], o) for s, n, o in
                            zip(first.tolist(), count.tolist(), (p - first).tolist())), np.uint64, len(first))
        row = np.array([r for r, _, _ in group])[seg]
        lo = first - (ends - sizes)[seg] + np.array([s for _, s, _ in group])[seg]
        key = _mix(_mix(h[p], body), row.astype(np.uint64))
        _, where, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        yield row[where], h[p][where].view(np.int64), body[where].view(np.int64), lo[where], count[where], times
        if (twice := times[inverse] > 1).any():
            row, lo, end = row[twice], lo[twice], (lo + count)[twice]
            new = np.r_[True, (row[1:] != row[:-1]) | (lo[1:] > end[:-1])]
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(row) - 1]
            zero = np.zeros(int(new.sum()), np.int64)
            yield row[new], zero, zero, lo[new], end[last] - lo[new], zero


_OWNER = [("doc_id", pa.int64()), ("own", pa.int64())]


def _read(column: pa.Array, coded: bool) -> list[bytes]:
    """Texts as bytes, or as the codes of their words."""
    return [word_codes(t) for t in raw(column)] if coded else raw(column)


def _scan(width: int, gram: int, coded: bool):
    schema = pa.schema([*_OWNER, ("anchor", pa.int64()), ("region", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()),
                        ("times", pa.int32())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in slices(whole, _SLICE, 2)):
            ids, own = batch.column(0), batch.column(1)
            for row, anchor, region, lo, n, times in regions(_read(batch.column(2), coded), width, gram):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), own.take(pa.array(row)), pa.array(anchor), pa.array(region), pa.array(lo),
                     pa.array(n.astype(np.int32)), pa.array(times.astype(np.int32))], schema=schema)
    return run


def suffix_order(a: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of ``a`` in the order of their first ``depth`` bytes or more (ties by position), and the ranks by length.

    Ranks are tripled: three ranks of 21 bits make one sort key, so ``a`` has at most 2**21 - 1 bytes.
    """
    n = len(a)
    key, length, ranks = words_at(a), 8, []
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        ranks.append((length, rank.astype(np.int32)))
        if length >= depth or rank[order[-1]] == n:
            return order, ranks
        padded = np.concatenate([rank, np.zeros(2 * length, np.int64)])
        key = rank << 42 | padded[length:length + n] << 21 | padded[2 * length:2 * length + n]
        length *= 3


def common_prefix(a: np.ndarray, ranks: list[tuple[int, np.ndarray]], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes ``p`` and ``q``, from ranks of falling length and then bytes."""
    n, out = len(a), np.zeros(len(p), np.int64)
    for length, rank in reversed(ranks):
        padded = np.concatenate([rank, np.zeros(1, np.int32)])
        for _ in range(2):
            x = padded[np.minimum(p + out, n)]
            out += length * ((x == padded[np.minimum(q + out, n)]) & (x > 0))
    padded = np.concatenate([a.astype(np.int16), np.array([-1], np.int16)])
    open_ = np.ones(len(p), bool)
    for _ in range(7):
        x = padded[np.minimum(p + out, n)]
        open_ &= (x == padded[np.minimum(q + out, n)]) & (x >= 0)
        out += open_
    return out


def longest_elsewhere(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the joined ``parts``: the length of the longest string from there that also starts at another byte
    (exact up to ``depth``, strings may not leave their part), and the first byte of each part.

    Inside a run of equal bytes of the Burrows-Wheeler transform, suffixes and their neighbours in suffix order move on together, so the
    match at a text position is that of the position before less one. Match lengths are therefore computed at run ends (and
    at the first byte of each part) only and streamed from there.
    """
    sizes = np.array([len(x) + 1 for x in parts])
    first = np.cumsum(sizes) - sizes
    a = np.frombuffer(bytes([_SEPARATOR]).join(parts) + bytes([_SEPARATOR]), np.uint8)
    n = len(a)
    # A position that a match may not be carried over to: the first byte of a part.
    fresh = np.zeros(n, bool)
    fresh[first] = True
    order, ranks = suffix_order(a, max(depth, int(sizes.max())))
    before = np.where(fresh[order], _SEPARATOR + np.arange(n), a[order - 1].astype(np.int64))
    run = np.r_[True, before[1:] != before[:-1], True]
    longest = np.zeros(n, np.int64)
    for ends, step in ((np.flatnonzero(run[:-1]), -1), (np.flatnonzero(run[1:]), 1)):
        inner = ends[(ends + step >= 0) & (ends + step < n)]
        sampled = np.full(n, -1, np.int64)
        sampled[order[ends]] = 0
        sampled[order[inner]] = common_prefix(a, ranks, order[inner], order[inner + step])
        at = np.arange(n)
        last = np.maximum.accumulate(np.where(sampled >= 0, at, 0))
        longest = np.maximum(longest, sampled[last] - (at - last))
    left = np.repeat(first + sizes - 1, sizes) - np.arange(n)
    return np.minimum(longest, left), first


def _index(width: int, block_bytes: int):
    schema = pa.schema([*_OWNER, ("lo", pa.int64()), ("hi", pa.int64())])

    def marks(block: list[tuple]) -> pa.RecordBatch | None:
        long_enough, first = longest_elsewhere([r[1] for r in block], width)
        found = []
        for (_, text, doc, own, lo, single), at in zip(block, first.tolist()):
            if single:
                hit = np.flatnonzero(long_enough[at:at + len(text) - width + 1] >= width)
                if len(hit):
                    cut = np.flatnonzero(np.diff(hit) > 1)
                    for s, e in zip(hit[np.r_[0, cut + 1]].tolist(), hit[np.r_[cut, len(hit) - 1]].tolist()):
                        found.append((doc, own, lo + s, lo + e + width))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema) if found else None

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group, size, extra, places = [], [], 0, 0, set()
        for batch in stream:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    if block and size + extra > block_bytes // SHARED:
                        if (made := marks(block)) is not None:
                            yield made
                        block, size = [], 0
                    block, size, group, extra = block + group, size + extra, [], 0
                    places.clear()
                if row[2:5] not in places:
                    places.add(row[2:5])
                    group.append(row)
                    extra += len(row[1]) + 1
        for last in ([block, group] if size + extra > block_bytes // SHARED else [block + group]):
            if last and (made := marks(last)) is not None:
                yield made
    return run


def _cut(width: int, coded: bool):
    """Regions of each row's text; rows are (doc_id, _own, text, places)."""
    schema = pa.schema([("anchor", pa.int64()), ("bytes", pa.binary()), *_OWNER, ("lo", pa.int64()), ("single", pa.bool_())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: set[tuple] = set()
        for batch in (part for whole in stream for part in slices(whole, _SLICE, 2)):
            ids, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # Repeated rows come together; one of them is enough.
            seen, rows = set(), []
            for text, owner, places in zip(_read(batch.column(2), coded), zip(ids, own), batch.column(3).to_pylist()):
                if owner not in before and owner not in seen:
                    rows += [(p["anchor"], text[p["lo"]:p["lo"] + p["n"] + width - 1], *owner, p["lo"], p["single"]) for p in places]
                seen.add(owner)
            before = seen
            for s in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s:s + 20_000]), schema.types)], schema=schema)
    return run


def _windows(width: int):
    """Every window of the regions, by a hash of 128 bits."""
    schema = pa.schema([("window", pa.binary()), *_OWNER, ("lo", pa.int64()), ("single", pa.bool_())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for _, text, doc, own, lo, single in zip(*(c.to_pylist() for c in batch.columns)):
                view, n = memoryview(text), len(text) - width + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(view[i:i + width]) for i in range(n)], pa.binary()), pa.array([doc] * n, pa.int64()),
                     pa.array([own] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int64()), pa.array([single] * n)], schema=schema)
    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, coded: bool = False,
                   tables: list[DataFrame] | None = None) -> DataFrame:
    """(doc_id, own, lo, hi): byte spans of repeated windows; they may touch and overlap. ``docs`` has doc_id, text and
    ``_own``, which together stand for a text; rows that agree in them have their spans once. If ``coded``, bytes are those of the codes of the words.
    Stored tables that the result reads are put into ``tables``."""
    docs = docs.select("doc_id", "_own", "text")
    found = stored(docs.mapInArrow(
        lean(_scan(width, gram, coded)), "doc_id long, own long, anchor long, region long, lo long, n int, times int"), "regions")
    rows = found.where("times > 0")
    classes = rows.groupBy("anchor", "region").agg(F.sum("times").alias("times"), F.min(F.struct("doc_id", "own", "lo", "n")).alias("one"))
    anchors = (classes.groupBy("anchor").agg(F.sum("times").alias("all_times"), F.count(F.lit(1)).alias("classes"),
                                             F.count_if(F.col("times") == 1).alias("singles"), F.sum(F.col("one.n") + width).alias("size"))
               .where("all_times > 1"))
    seen = stored(classes.join(anchors, "anchor"), "classes")
    whole = (rows.join(seen.where("times > 1").select("anchor", "region"), ["anchor", "region"], "left_semi")
             .select("doc_id", "own", "lo", (F.col("lo") + F.col("n") + (width - 1)).alias("hi")))
    within = found.where("times = 0").select("doc_id", "own", "lo", (F.col("lo") + F.col("n") + (width - 1)).alias("hi"))
    spans = whole.unionByName(within)
    tables = [] if tables is None else tables
    tables += [found, seen]
    open_ = seen.where("singles > 0 and classes > 1")
    for large in (False, True):
        some = open_.where((F.col("size") > block_bytes) if large else (F.col("size") <= block_bytes))
        if large and some.isEmpty():
            continue
        places = (some.select("one.*", F.struct(F.col("anchor"), F.col("one.lo").alias("lo"), F.col("one.n").alias("n"),
                                                (F.col("times") == 1).alias("single")).alias("place"))
                  .groupBy(F.col("doc_id").alias("_d"), F.col("own").alias("_o")).agg(F.collect_list("place").alias("_places")))
        marked = _with(docs, places, "inner").select(*docs.columns, "_places")
        cut = _cut(width, coded)
        if not large:
            cut_out = marked.mapInArrow(lean(cut), "anchor long, bytes binary, doc_id long, own long, lo long, single boolean")
            spans = spans.unionByName(cut_out.repartition("anchor").sortWithinPartitions("anchor")
                                      .mapInArrow(lean(_index(width, block_bytes)), "doc_id long, own long, lo long, hi long"))
            continue
        of_regions = _windows(width)  # in the same worker as ``cut``
        windows = stored(marked.mapInArrow(lean(lambda rows: of_regions(cut(rows))),  # noqa: B023, run before the loop goes on
                                           "window binary, doc_id long, own long, lo long, single boolean"), "windows")
        tables.append(windows)
        again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        spans = spans.unionByName(windows.where("single").join(again, "window", "left_semi")
                                  .select("doc_id", "own", "lo", (F.col("lo") + width).alias("hi")))
    return spans


def _with(docs: DataFrame, more: DataFrame, how: str) -> DataFrame:
    return docs.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_own") == F.col("_o")), how)


def _own() -> Column:
    return F.xxhash64("text")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of (lo, hi) spans that touch or overlap."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def kept_parts(data: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
    bounds = [0, *(x for run in runs for x in run), len(data)]
    return [data[s:e] for s, e in zip(bounds[::2], bounds[1::2])]


def word_codes(data: bytes) -> bytes:
    """``CODE`` bytes (7 bits each) for every word, so that equal runs of words are equal bytes of known length."""
    hashes = b"".join(map(xxhash.xxh64_digest, data.split()))
    return (np.frombuffer(hashes, np.uint8).reshape(-1, 8)[:, :CODE] & 127).tobytes()


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    space = np.isin(np.frombuffer(data, np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def has_sparse_window(data: bytes, width: int, words: int) -> bool:
    """Whether some ``width`` bytes hold no more than ``words`` words with white space on both sides.

    A text with such bytes is the only one that can share them. All other windows that repeat have a run of more words that repeats.
    """
    last = len(data) - width
    if last < 0:
        return False
    starts, ends = word_bounds(data)
    # Windows from just behind the start of one word on have the words from the next one on.
    first = np.concatenate([[0], starts])
    stop = np.full(len(first), len(data) + 1)
    known = ends[words:]
    stop[:len(known)] = known
    return bool((stop + 1 > first + width)[first <= last].any())


def _sparse(docs: DataFrame, width: int, words: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, _own, text) whose text has a sparse window."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in slices(whole, _SLICE, 2)):
            yield batch.filter(pa.array([has_sparse_window(t, width, words) for t in raw(batch.column(2))], pa.bool_()))
    narrow = docs.select("doc_id", "_own", "text")
    return narrow.mapInArrow(lean(run), narrow.schema)


def in_bytes(data: bytes, spans: list[dict] | None) -> list[dict] | None:
    """Spans of bytes from those of bytes and of word codes. Words that codes cover in part are left out."""
    if not any(s["coded"] for s in spans or []):
        return spans
    starts, ends = (x.tolist() for x in word_bounds(data))
    out = []
    for s in spans:
        if not s["coded"]:
            out.append(s)
        elif (first := -(-s["lo"] // CODE)) < (last := s["hi"] // CODE):
            out.append({"lo": starts[first], "hi": ends[last - 1]})
    return out


def with_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, *, words: int = 0) -> DataFrame:
    """``docs`` (doc_id long, text string) and ``_spans``, an unordered array of (lo, hi) of repeated bytes, or null. No other column may begin
    with an underscore, but for ``_rest``.

    Null and empty texts have none. Repeated rows repeat each other, so long ones are covered whole. Ids may be null or repeat.
    With ``words``, runs of more than so many words that repeat have spans too: (lo, hi) in their word codes, marked as ``coded``. Of repeated bytes
    that hold such a run, words that are cut off at their ends may be left out.
    """
    keyed = docs.withColumn("_own", _own())
    fields = ["lo", "hi"]
    if words:
        # One after the other, so that their workers are not there at once. Bytes are read only where runs of words do not settle them.
        run = (words + 1) * CODE
        used: list[DataFrame] = []
        by_words = stored(repeated_spans(keyed, run, min(gram, run // 2), block_bytes, True, used), "word-spans")
        forget(*used)
        used = [stored(_sparse(keyed, width, words), "sparse")]
        by_bytes = stored(repeated_spans(used[0], width, gram, block_bytes, False, used), "byte-spans")
        forget(*used)
        found = by_bytes.withColumn("coded", F.lit(False)).unionByName(by_words.withColumn("coded", F.lit(True)))
        fields.append("coded")
    else:
        found = repeated_spans(keyed, width, gram, block_bytes)
    spans = (found.groupBy(F.col("doc_id").alias("_d"), F.col("own").alias("_o"))
             .agg(F.collect_list(F.struct(*fields)).alias("_spans")))
    return _with(keyed, spans, "left").select(*docs.columns, "_spans")


def dedup_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in slices(whole, _SLICE)):
            rows = []
            for i, data, spans in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist()):
                runs = merged(spans)
                rows.append((i, len(data), sum(e - s for s, e in runs), len(runs),
                             hashlib.sha256(b"".join(kept_parts(data, runs))).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return with_spans(docs.select("doc_id", "text"), width).mapInArrow(
        lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = WIDTH, words: int = 0) -> DataFrame:
    """The rows of ``docs`` with repeated bytes cut from their texts; a null text stays null.

    With ``words``, runs of more than so many words (between ASCII white space, whichever it is) that also stand elsewhere go as well, however short.

    A text stays valid UTF-8: of a character that is partly covered nothing is removed. A column n_chars follows the new text.
    """
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in slices(whole, _SLICE)):
            made = []
            for data, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if data is not None and spans:
                    runs = []
                    for s, e in merged(in_bytes(data, spans) if words else spans):
                        while s < e and data[s] & 0xC0 == 0x80:
                            s += 1
                        while s < e < len(data) and data[e] & 0xC0 == 0x80:
                            e -= 1
                        runs.append((s, e))
                    data = b"".join(kept_parts(data, runs))
                made.append(None if data is None else data.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["_rest", "text"])

    # The other columns travel in one, so that their names meet none of those used here.
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest")
    marked = with_spans(docs.select("doc_id", "text", rest), width, words=words).select("_rest", "text", "_spans")
    out = marked.mapInArrow(lean(run), StructType([marked.schema["_rest"], docs.schema["text"]]))
    out = out.select(*[F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
