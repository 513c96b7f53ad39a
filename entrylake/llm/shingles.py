"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from two indexes, and each is verified by its exact sets, so nothing less similar is ever linked.

1. The byte-position index of ``simhash`` over fingerprints of the five-word shingles finds those that differ in at most three bits.
2. At 0.8 two 64-bit fingerprints differ in about ten bits, and in up to twenty: no block of them is sure to be shared. The farther pairs are
   found by MinHash: two texts share all ``ROWS`` minima of one of ``BANDS`` bands with a chance of 1 - (1 - s**ROWS)**BANDS, which misses 5 of a
   million pairs at s = 0.8.

Texts of equal sets are one class from the start. Only what is connected counts, so each band's classes are compared with the band's first one, its pivot, and
then with those that are not connected with them yet. Two classes that are near have similar distances from any third one, so those whose distances from the
pivot differ by more than 0.2 are passed over.

In bands shared by very many classes all pairs would be far too many. There the rarest shingles decide: two sets that are near have one in common among the first few of
each, in one order of all shingles by the number of classes that hold them. The classes of crowded bands are listed under these shingles, and those of a list meet in turns,
one, three, twelve .. of the classes at a time, unless they are connected already. What a large group has in common is not rare in it, so classes too far from
the others to be connected hardly share a list. Nothing is left out: no link between components is lost, however crowded a band is.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import forget, lean, raw, slices, stored
from .components import components
from .simhash import first_rows, majority, near_pairs, row_key
from .suffix import _mix

WIDTH = 5
LEAST = Fraction(4, 5)
ROWS, BANDS = 6, 40
#: Bands shared by more classes than this are connected by the rarest shingles, in turns.
CROWDED = 64
#: Shingles that are counted together, in one task.
_COUNTED = 1 << 18
_AT_ONCE = 512
_SLICE = 1 << 20
_rng = np.random.default_rng(11)
_FLIP = _rng.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32)
_TIMES = _rng.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32) | np.uint32(1)


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text.

    A-Z are lower-cased, words are split at ASCII white space. Fewer words than ``width``: their whole sequence is the one
    shingle; no words: none.
    """
    words = data.lower().split()
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    n = max(1, len(h) - width + 1)
    made = h[:n]
    for i in range(1, min(width, len(h))):
        made = _mix(made, h[i:i + n])
    return np.unique(made)


def bands(made: np.ndarray) -> np.ndarray:
    """One number per band, from the smallest values of a set of shingles under ``ROWS`` orders each; none for an empty set."""
    if not len(made):
        return np.zeros(0, np.int64)
    short = (made >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), _AT_ONCE):
        np.minimum(least, ((short[start:start + _AT_ONCE] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mix(key, row.astype(np.uint64))
    return key.view(np.int64)


def printed(docs: DataFrame) -> DataFrame:
    """doc_id and _own of every row of ``docs`` (doc_id, _own, text), ``cls`` (a hash of its set of shingles), the set's ``size``, its fingerprint
    ``fp`` and its ``bands``. The sets themselves are several times as large; ``_sets`` makes those that are compared."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in slices(whole, _SLICE, 2)):
            rows = []
            for text in raw(batch.column(2)):
                made = shingles(text)
                rows.append((np.uint64(xxhash.xxh64_intdigest(made.tobytes())).view(np.int64), len(made), majority(made), bands(made)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(
                        zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]],
                    names=["doc_id", "_own", "cls", "size", "fp", "bands"])
    return docs.select(F.col("doc_id").cast("long"), "_own", "text").mapInArrow(
        lean(run), "doc_id long, _own long, cls long, size int, fp long, bands array<long>")


def _sets(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """cls and the ``members`` of its set, for each class of ``ranks`` (cls, rank), from the text that stands for it in ``docs``."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in slices(whole, _SLICE)):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).view(np.int64) for t in raw(batch.column(1))],
                                                                           pa.list_(pa.int64()))], names=["cls", "members"])

    at = ["_n", "_d", "_o"]
    named = ranks.select("cls", *row_key(F.col("rank.d"), F.col("rank.o")))
    # Repeated rows come together in the join; one of them is enough.
    one = (docs.select("text", *row_key(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(named, at)
           .groupBy(*at, "cls").agg(F.first("text").alias("text")))
    return one.select("cls", "text").mapInArrow(lean(run), "cls long, members array<long>")


def _measured(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` of classes (a, b), each once, with the sizes of their sets (n_a, n_b) and of what these have in common (``both``)."""
    a, b = (sets.select(F.col("cls").alias(to), F.col("members").alias(f"m_{to}")) for to in "ab")
    return stored(pairs.join(b, "b").join(a, "a").select("a", "b", F.size("m_a").alias("n_a"), F.size("m_b").alias("n_b"),
                                                         F.size(F.array_intersect("m_a", "m_b")).alias("both")), "measured")


def _members(pairs: DataFrame) -> DataFrame:
    """The classes (cls) of ``pairs`` (a, b)."""
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()


def _near(measured: DataFrame, least: Fraction) -> DataFrame:
    """Links (a, b): |both| / |either| >= least, in whole numbers."""
    return measured.where(F.col("both") * (least.numerator + least.denominator) >= (F.col("n_a") + F.col("n_b")) * least.numerator).select("a", "b")


def _needed(a: Column | str, b: Column | str, least: Fraction) -> Column:
    """The fewest shingles that two sets of sizes ``a`` and ``b`` share if they are near."""
    return F.ceil((F.col(a) + F.col(b)) * least.numerator / F.lit(float(least.numerator + least.denominator)) - 1e-9)


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``classes`` (cls, fp) to measure: the first class of each fingerprint with the others, and with those of near fingerprints."""
    first = stored(classes.groupBy("fp").agg(F.min("cls").alias("a")), "fingerprints")
    equal = classes.join(first, "fp").where("a <> cls").select("a", F.col("cls").alias("b"))
    near = (near_pairs(first.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
            .join(first.withColumnsRenamed({"fp": "x"}), "x").join(first.withColumnsRenamed({"fp": "y", "a": "b"}), "y").select("a", "b"))
    return equal.unionByName(near)


def shared_bands(classes: DataFrame) -> DataFrame:
    """band, n, pivot, smallest, cls, size and o of the bands that ``n`` > 1 of ``classes`` (cls, size, bands) share; ``o`` orders the classes, the first is
    the pivot, and ``smallest`` is the least size among them."""
    rows = classes.select("cls", "size", F.explode("bands").alias("band"))
    # An order of the classes that has nothing to do with what they hold, the same in all bands.
    order = F.struct(F.pmod(F.xxhash64("cls"), F.lit(1 << 31)).alias("u"), F.col("cls").alias("c"))
    several = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(order)["c"].alias("pivot"), F.min("size").alias("smallest")).where("n > 1")
    return rows.join(several, "band").select("band", "n", "pivot", "smallest", "cls", "size", order.alias("o"))


def _dealt(n: int):
    """Rows (cls, first, members) cut into ``n`` parts by the value of the members."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, _AT_ONCE):
                out = []
                for cls, first, members in zip(*(c.slice(start, _AT_ONCE) for c in batch.columns)):
                    values = members.values.to_numpy(zero_copy_only=False)
                    part = values % n
                    order = np.argsort(part, kind="stable")
                    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                    out += [(cls.as_py(), first.as_py(), int(part[held[0]]), values[held]) for held in np.split(order, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                                                 names=["cls", "first", "part", "members"])
    return run


def _counted(group: pa.Table) -> pa.Table:
    """``rare`` of every row of one part: its ``first`` rarest members, each with the number of rows that hold it."""
    lists = group["members"].combine_chunks()
    values, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    _, which, times = np.unique(values, return_inverse=True, return_counts=True)
    n = times[which]
    order = np.lexsort((values, n, row))
    ends = np.cumsum(np.bincount(row, minlength=len(lists)))
    place = np.arange(len(values)) - np.r_[0, ends[:-1]][row]
    order = order[place < group["first"].to_numpy()[row]]
    offsets = np.r_[0, np.cumsum(np.bincount(row[order], minlength=len(lists)))].astype(np.int32)
    rare = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(n[order], pa.int64()), pa.array(values[order])], names=["n", "s"]))
    return pa.table({"cls": group["cls"], "first": group["first"], "rare": rare})


def rare_shingles(crowd: DataFrame, sets: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """cls, list and place: the shingles (list) under which a class of ``crowd`` (cls, size, smallest) meets all near ones of at least ``smallest`` members.

    Shingles are ordered by the number of classes that hold them; ``place`` counts from 0. The first one that two sets share has, from there on, all that they share
    behind it in both; so it is among the first ones of each, up to the number that may be missing. Those that one class alone holds have a place but no row.
    """
    crowd = crowd.withColumn("smallest", F.greatest("smallest", F.ceil(F.col("size") * least.numerator / F.lit(float(least.denominator)) - 1e-9)))
    named = stored(crowd.select("cls", (F.col("size") - _needed("size", "smallest", least) + 1).cast("int").alias("first"), "size")
                   .join(sets, "cls").select("cls", "first", "members"), "crowd")
    total = named.agg(F.sum(F.size("members"))).first()[0] or 0
    counted = (named.mapInArrow(lean(_dealt(1 + total // _COUNTED)), "cls long, first int, part long, members array<long>")
               .groupBy("part").applyInArrow(_counted, "cls long, first int, rare array<struct<n: long, s: long>>"))
    rare = counted.groupBy("cls", "first").agg(F.array_sort(F.flatten(F.collect_list("rare"))).alias("rare"))
    made = stored(rare.select("cls", F.posexplode(F.slice("rare", F.lit(1), F.col("first"))).alias("place", "x"))
                  .where("x.n > 1").select("cls", F.col("x.s").alias("list"), "place"), "rare")
    forget(named)
    return made


def _listed(shared: DataFrame, known: DataFrame, sets: DataFrame, least: Fraction, max_crowd: int) -> DataFrame:
    """list, cls, size, o, d, place, turn and root: the lists whose classes are to be connected, and the turn in which a class meets those of its list.

    Bands that are not crowded are lists with one turn, ``d`` is the distance from their pivots. Of a crowd of n classes about 4**t have a turn of at most t.
    """
    plain = (shared.where((F.col("n") > 2) & (F.col("n") <= max_crowd)).join(known, ["pivot", "cls"], "left").select(
        F.col("band").alias("list"), "cls", "size", "o", F.coalesce("d", F.lit(0.0)).alias("d"), F.lit(0).alias("place"), F.lit(0).alias("turn")))
    crowd = stored(shared.where(F.col("n") > F.greatest(F.lit(max_crowd), F.lit(2))).groupBy("cls").agg(
        F.first("size").alias("size"), F.first("o").alias("o"), F.max("n").alias("n"), F.min("smallest").alias("smallest")), "crowded")
    turn = F.floor(F.log2(F.col("o.u") * F.col("n") / F.lit(float(1 << 31)) + 1) / 2).cast("int")
    if not crowd.isEmpty():
        plain = plain.unionByName(rare_shingles(crowd, sets, least).join(crowd, "cls").select(
            "list", "cls", "size", "o", F.lit(0.0).alias("d"), "place", turn.alias("turn")))
    return plain.withColumn("root", F.col("cls"))


def near_classes(docs: DataFrame, classes: DataFrame, least: Fraction = LEAST, max_crowd: int = CROWDED) -> DataFrame:
    """Verified links (a, b) between ``classes`` (cls, rank, fp, size, bands) of ``docs`` that connect all near ones."""
    shared = stored(shared_bands(classes), "bands")
    from_pivot = shared.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
    pairs = stored(fingerprint_pairs(classes).unionByName(from_pivot).distinct(), "candidates")
    sets = stored(_sets(docs, classes.select("cls", "rank").join(_members(pairs), "cls", "left_semi")), "sets")
    measured = _measured(sets, pairs)
    forget(pairs)
    found = [_near(measured, least)]
    distance = 1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    known = measured.select(F.col("a").alias("pivot"), F.col("b").alias("cls"), distance.alias("d"))
    left = _listed(shared, known, sets, least, max_crowd)
    links, done, turn = found[0], [shared], 0
    while True:
        # Links between roots are all that is new: nothing is connected again.
        left = left.join(components(links).select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
        left = left.withColumn("root", F.coalesce("_to", "root")).drop("_to")
        largest = left.groupBy("list", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("list").agg(
            F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        left = stored(left.join(largest.select("list", "main"), "list").withColumn("in_main", F.col("root") == F.col("main")).drop("main"), "left")
        forget(*done)
        if left.isEmpty():
            break
        a, b = (left.select("list", *[F.col(c).alias(f"{n}_{to}") for c, n in
                                      (("size", "n"), ("o", "o"), ("d", "d"), ("place", "p"), ("turn", "t"), ("root", "r"), ("in_main", "m"))],
                            F.col("cls").alias(to)) for to in "ab")
        # Classes of a list's largest root meet the others only, not each other.
        a = a.where(F.col("t_a") == turn).withColumn("side", F.col("m_a"))
        b = b.withColumn("side", F.explode(F.when(F.col("m_b"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
        apart = float(1 - least) + 1e-9
        pairs = stored(a.join(b, ["list", "side"]).where(
            (F.col("r_a") != F.col("r_b")) & ((F.col("t_b") > turn) | (F.col("o_a") < F.col("o_b")))
            & (F.abs(F.col("d_a") - F.col("d_b")) <= apart)
            & (F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) >= _needed("n_a", "n_b", least))
        ).select("a", "b", "r_a", "r_b").distinct(), "candidates")
        some = stored(sets.join(_members(pairs), "cls", "left_semi"), "members")
        found.append(_near(_measured(some, pairs), least))
        links = stored(pairs.join(found[-1], ["a", "b"], "left_semi").select(F.col("r_a").alias("a"), F.col("r_b").alias("b")), "root-links")
        done, turn = [left, pairs, some, links], turn + 1
        left = left.where(F.col("turn") >= turn).drop("in_main")
    forget(left, sets)
    return reduce(DataFrame.unionByName, found)


def keep_one(docs: DataFrame, least: Fraction = LEAST, max_crowd: int = CROWDED) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group that near pairs connect, that of the smallest (doc_id, hash of the text).

    Null ids come last. Repeated rows of the one that stays are reduced to one. Texts without words are copies of each other.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_own").alias("o"))
    classes = stored(printed(docs.select("doc_id", F.xxhash64("text").alias("_own"), "text")).groupBy("cls").agg(
        F.min(rank).alias("rank"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")), "classes")
    member = components(near_classes(docs, classes, least, max_crowd)).withColumnRenamed("node", "cls")
    ranks = stored(classes.select("cls", "rank"), "ranks")
    forget(classes)  # with the bands of all sets
    return first_rows(docs, ranks.join(member, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("rank").alias("first")))
