"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes, and two fingerprints that differ in at most three bits
share at least five of them. The index is keyed by (position, byte) postings. Single postings lists are far too
long to pair up (each holds one 256th of all rows), so lists are intersected before pairs are formed: eight triples of
positions are chosen such that any five positions contain one of them. Each pair is formed under the first triple it shares,
its shared positional bytes are tallied, pairs that reach the five guaranteed matches are kept, and the
differing bits are counted. Triples shared by very many fingerprints are intersected with two further lists;
what then remains is a set of fingerprints that agree in five bytes, which is connected without forming its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import raw, stored
from .components import components

MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
#: Every five of the eight positions hold three of one half: four triples from each half are enough.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Triples shared by more fingerprints than this are refined.
CROWDED = 64
_SHINGLES_AT_ONCE = 65_536


def fingerprint(data: bytes, width: int = 3) -> int:
    """64 majority bits over the XXH64 hashes (seed 42) of all ``width``-word shingles, repeats included.

    A-Z are lower-cased, words are split at ASCII white space. Fewer words than ``width``: their whole sequence is the
    one shingle; no words: zero.
    """
    words = data.lower().split()
    if not words:
        return 0
    total = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for start in range(0, total, _SHINGLES_AT_ONCE):
        part = words[start:start + min(_SHINGLES_AT_ONCE, total - start) + width - 1]
        shingles = zip(*(part[i:] for i in range(width))) if len(part) >= width else [part]
        made = b"".join([digest(join(s), 42) for s in shingles])
        ones += np.unpackbits(np.frombuffer(made, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def majority(hashes: np.ndarray) -> int:
    """64 majority bits over 64-bit hashes; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _SHINGLES_AT_ONCE):
        part = hashes[start:start + _SHINGLES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns and ``fp`` long of every row; a null text counts as empty."""
    source = docs.select(*key, F.col(text).cast("string").alias("_text"))
    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1]) + "fp long"

    def kernel(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made = pa.array([fingerprint(t) for t in raw(batch.column(batch.num_columns - 1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "fp"])
    return source.mapInArrow(kernel, out)


def _byte(x: Column, position: int) -> Column:
    return F.shiftright(x, 8 * position).bitwiseAND(F.lit(255))


def _bytes_at(x: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(255 << 8 * p for p in positions)
    return x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def shared_bytes(difference: Column) -> Column:
    """Number of positional bytes that two fingerprints share, from their exclusive-or."""
    return sum((_byte(difference, p) == 0).cast("int") for p in range(8))


def near_pairs(fps: DataFrame, max_crowd: int = CROWDED) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, each once) that differ in at most three bits.

    Uncrowded triples give every such pair. In crowded ones enough pairs to connect what is connected
    are given, but not all of them.
    """
    keyed = fps.select(F.col("fp"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("triple"), _bytes_at(F.col("fp"), t).alias("bytes")) for i, t in enumerate(TRIPLES)])).alias("k")) \
        .select("fp", "k.triple", "k.bytes")
    crowded = stored(keyed.groupBy("triple", "bytes").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_crowd)
                     .select("triple", "bytes"), "crowded")
    any_crowded = not crowded.isEmpty()
    open_rows = keyed.join(crowded, ["triple", "bytes"], "left_anti") if any_crowded else keyed
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(_bytes_at(F.col("x"), t) == 0, F.lit(i)) for i, t in enumerate(TRIPLES)])
    pairs = (open_rows.withColumnRenamed("fp", "a").join(open_rows.withColumnRenamed("fp", "b"), ["triple", "bytes"])
             .where("a < b").withColumn("x", x))
    if not any_crowded:
        pairs = pairs.where(first == F.col("triple"))
    links = (pairs.where(shared_bytes(F.col("x")) >= MIN_SHARED).where(F.bit_count("x") <= MAX_BITS).select("a", "b"))
    if not any_crowded:
        return links
    fives = list(combinations(range(8), MIN_SHARED))
    # Positions of a triple and two more: the rows of crowded triples meet again under five shared bytes.
    within = F.coalesce(*[F.when(F.col("triple") == i, F.array(*[
        F.struct(F.lit(j).alias("five"), _bytes_at(F.col("fp"), f).alias("bytes"))
        for j, f in enumerate(fives) if set(t) <= set(f)])) for i, t in enumerate(TRIPLES)])
    dense = (keyed.join(crowded, ["triple", "bytes"], "left_semi").select("fp", F.explode(within).alias("k"))
             .select("k.five", "k.bytes", "fp").distinct())
    return links.unionByName(
        dense.repartition("five", "bytes").sortWithinPartitions("five", "bytes", "fp")
        .mapInArrow(_connect_groups(fives), "a long, b long"))


def _connect_groups(fives: list[tuple[int, ...]]):
    """Links that connect each sorted (five, bytes) group; a group has at most 2**24 members by construction."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in stream:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            rest.append(rows)
            last = rows[-1, :2]
            if (rows[0, :2] == last).all():
                continue
            rows = np.concatenate(rest)
            cut = np.flatnonzero((rows[:, :2] != last).any(axis=1))[-1] + 1
            yield from linked(rows[:cut])
            rest = [rows[cut:]]
        if rest:
            yield from linked(np.concatenate(rest))

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts, ends = np.r_[0, new], np.r_[new, len(rows)]
        for s, e in zip(starts, ends):
            if e - s > 1:
                fps = rows[s:e, 2]
                free = [p for p in range(8) if p not in fives[rows[s, 0]]]
                root = connect_24_bits(np.stack([fps >> 8 * p & 255 for p in free], axis=1) @ np.array([1 << 16, 1 << 8, 1]))
                at = np.flatnonzero(root != np.arange(e - s))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[root[at]]), pa.array(fps[at])], names=["a", "b"])
    return run


def connect_24_bits(values: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For distinct 24-bit ``values``: the index of the smallest member that is reachable by steps of at most ``max_bits`` bits.

    Small sets compare all members; large ones look up each value's neighbours in a table of the 2**24 places.
    """
    n = len(values)
    label = np.arange(n)
    if n <= 2048:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= max_bits
        steps = [(None, near)]
    else:
        place = np.full(1 << 24, -1, np.int32)
        place[values] = np.arange(n, dtype=np.int32)
        steps = [(sum(1 << b for b in bits), None) for k in range(1, max_bits + 1) for bits in combinations(range(24), k)]
    while True:
        before = label.copy()
        for flip, near in steps:
            if near is not None:
                label = np.where(near, label[None, :], n).min(axis=1)
            else:
                other = place[values ^ flip]
                label = np.where(other >= 0, np.minimum(label, label[other]), label)
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(fp, component_id) for every fingerprint of ``prints`` (``doc_id``, fp): the smallest id that is reachable by links.

    Equal fingerprints are one class from the start, so copies never meet in pairs. Ids that are null are passed over; a
    component of null ids only has a null id.
    """
    classes = stored(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "classes")
    member = components(near_pairs(classes.select("fp")))
    member = classes.join(member.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return member.select("fp", "root").join(least, "root").select("fp", "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows each get their row back. Other
    columns of ``docs`` are ignored; an empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, ["doc_id"]), "fingerprints")
    return (prints.join(near_duplicates(prints), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that of the smallest (doc_id, hash of the text).

    Null ids come last. Repeated rows of the one that stays are reduced to one.
    """
    own = F.xxhash64("text")
    keyed = docs.select("doc_id", "text", own.alias("_own"))
    prints = stored(fingerprints(keyed, ["doc_id", "_own"]), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_own").alias("o"), F.col("fp").alias("f"))
    classes = stored(prints.groupBy("fp").agg(F.min(rank).alias("first")), "classes")
    member = components(near_pairs(classes.select("fp"))).withColumnRenamed("node", "fp")
    stay = (classes.join(member, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("first").alias("first")))
    return first_rows(docs, stay)


def row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """_n, _d and _o, which are never null and name a row by its doc_id and the hash of its text."""
    return [doc_id.isNull().alias("_n"), F.coalesce(doc_id, F.lit(0)).alias("_d"), text_hash.alias("_o")]


def first_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``stay`` names by ``first`` (d: doc_id, o: hash of the text), each once."""
    at = ["_n", "_d", "_o"]
    whole = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(F.col("doc_id"), F.xxhash64("text")))
    # Join and window share one shuffle of the texts.
    return (whole.join(stay.select(*row_key(F.col("first.d"), F.col("first.o"))), at)
            .withColumn("_copy", F.row_number().over(Window.partitionBy(*at).orderBy("_o")))
            .where("_copy = 1").select("_row.*"))
