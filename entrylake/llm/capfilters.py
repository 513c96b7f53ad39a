"""Embedding near-duplicates by spherical-cap filters.

Vectors are turned by a random rotation and cut into blocks; a random code of unit vectors for each block makes a product code whose
words are the filter directions. A vector is stored under the direction nearest to it (one codeword per block), and is list-decoded to every direction
that exceeds its own best inner product less a margin. Stored and decoded vectors meet on (label, direction) and are verified in double precision.

Margin. Let x be stored under f, and g be the direction nearest to y. Then <y, g - f> is at most <y - x, g - f>, for x prefers f. For
unit vectors with cosine t, |y - x| is sqrt(2 - 2t); under a random rotation its part along g - f has standard deviation |y - x| |g - f| / sqrt(d).
The margin is ``SIGMAS`` of those: a link at the threshold itself is missed with a chance below 3e-7, a closer one with less.

A pair is tested at one direction only, that of the stored vector, so links are counted where they are found and pairs are never listed. Vectors of a crowded
direction are cut into blocks of bounded size; pairs of blocks are multiplied, and each yields counts and at most one link
per vector that connects what is linked. Equal vectors are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .components import components

THRESHOLD = 0.98
SIGMAS = 5.0
#: Vectors per block of a crowded direction.
BLOCK = 256
_SEED = 11


def codewords_for(n_classes: int) -> int:
    """Codewords of each of the two blocks: directions grow with the number of vectors."""
    return int(min(256, max(16, 16 * np.ceil(np.sqrt(n_classes / 100_000)))))


class ProductCode:
    """Filter directions for vectors of ``dim`` components; the same for the same arguments."""

    def __init__(self, dim: int, codewords: int, threshold: float) -> None:
        rng = np.random.default_rng([_SEED, dim, codewords])
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cuts = [range(0, dim)] if dim < 2 else [range(0, dim // 2), range(dim // 2, dim)]
        self.codes = []
        for cut in self.cuts:
            code = rng.normal(size=(codewords, len(cut)))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True))
        self.scale = 1 / np.sqrt(len(self.codes))
        self.unit = SIGMAS * np.sqrt(2 - 2 * threshold) / np.sqrt(dim)

    def decode(self, unit_vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The nearest direction of each vector, and all its directions within the margin (the nearest one included)."""
        turned = unit_vectors @ self.rotation
        inner = [turned[:, cut.start:cut.stop] @ code.T * self.scale for cut, code in zip(self.cuts, self.codes)]
        best = [x.argmax(axis=1) for x in inner]
        gaps = [x.max(axis=1, keepdims=True) - x for x in inner]
        # Squared distance from the best word, block by block.
        apart = [self.scale ** 2 * (2 - 2 * code @ code.T)[b] for code, b in zip(self.codes, best)]
        n = len(self.codes[0])
        if len(self.codes) == 1:
            return best[0], [np.flatnonzero(g <= self.unit * np.sqrt(np.maximum(a, 0)) + 1e-9) for g, a in zip(gaps[0], apart[0])]
        lists = []
        for i in range(len(turned)):
            # Words of the first block that no word of the second could make good are left out before the lists are crossed.
            few = np.flatnonzero(gaps[0][i] <= self.unit * np.sqrt(apart[0][i] + apart[1][i].max()) + 1e-9)
            ok = gaps[0][i][few, None] + gaps[1][i][None, :] <= self.unit * np.sqrt(np.maximum(apart[0][i][few, None] + apart[1][i][None, :], 0)) + 1e-9
            a, b = np.nonzero(ok)
            lists.append(few[a] * n + b)
        return best[0] * n + best[1], lists


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; large components do not overflow."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _decode(codewords: int, threshold: float):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in stream:
            cid, vectors = (batch.column(i) for i in range(2))
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                code = codes.setdefault(dim, ProductCode(dim, codewords, threshold))
                for s in range(0, len(rows), 2048):
                    part = rows[s:s + 2048]
                    home, lists = code.decode(unit(_rows(vectors.take(pa.array(part)), dim)))
                    yield pa.RecordBatch.from_arrays([cid.take(pa.array(part)), pa.array(home.astype(np.int32)),
                                                      pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))], names=["cid", "home", "near"])
    return run


def _verify(threshold: float):
    """Per pair of blocks: counts of links by vector, and links that connect what is linked."""
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

    def side(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = column[i].values
        cid, times, vector = (block.field(k) for k in range(3))
        dim = len(vector[0])
        return cid.to_numpy(), times.to_numpy(), unit(_rows(vector, dim))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                h_id, h_times, h = side(batch.column(0), i)
                p_id, _, p = side(batch.column(1), i)
                link = (p @ h.T >= threshold) & (p_id[:, None] != h_id[None, :])
                if not link.any():
                    continue
                n = link @ h_times
                none = len(h_id)
                root = np.arange(none)
                while True:
                    to = np.where(link, root[None, :], none).min(axis=1)
                    new = np.minimum(root, np.where(link, to[:, None], none).min(axis=0))
                    if (new == root).all():
                        break
                    root = new
                hit = np.flatnonzero(n)
                moved = np.flatnonzero(root != np.arange(none))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[p_id[hit], h_id[moved]]), pa.array(np.r_[n[hit], np.zeros(len(moved), np.int64)]),
                     pa.array(np.r_[h_id[to[hit]], h_id[root[moved]]])], schema=schema)
    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, codewords: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id long, embedding array of float or double, label).

    Rows link if their labels are equal and not null, their vectors equally long, and their cosine is ``threshold`` or more. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without a label, link with nothing and are their own component. Repeated rows and equal
    vectors link with each other. A null vec_id is passed over when a component is named; other columns are ignored.
    """
    usable = (F.col("label").isNotNull() & (F.size("embedding") > 0)
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    rows = vectors.select("vec_id", "embedding", F.col("label").alias("label"), F.coalesce(usable, F.lit(False)).alias("_usable"))
    rows = rows.withColumn("_hash", F.xxhash64("label", "embedding"))
    # A class gets its number when it is written, so the number is fixed from then on.
    classes = stored(rows.where("_usable").groupBy("_hash", "label", "embedding")
                     .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
                     .withColumn("cid", F.monotonically_increasing_id()), "vectors")
    codewords = codewords or codewords_for(classes.count())
    decoded = classes.select("cid", "embedding").mapInArrow(_decode(codewords, threshold), "cid long, home int, near array<int>")
    placed = stored(classes.select("cid", "label", "embedding", "times").join(decoded, "cid"), "directions")
    item = F.struct("cid", "times", "embedding").alias("item")
    width = F.size("embedding").alias("dim")
    homes = placed.select("label", width, F.col("home").alias("direction"), item)
    probes = placed.select("label", width, F.explode("near").alias("direction"), item)
    at = ["label", "dim", "direction"]

    def blocks(side: DataFrame, name: str, only: DataFrame | None = None) -> DataFrame:
        sizes = side.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
        sizes = sizes.join(only, at, "left_semi") if only is not None else sizes
        return (side.join(sizes, at).withColumn("_block", F.pmod(F.xxhash64("item.cid"), F.col("_blocks")))
                .groupBy(*at, "_block").agg(F.collect_list("item").alias(name)).drop("_block"))

    met = (blocks(homes, "home").join(blocks(probes, "probe", homes.select(*at).distinct()), at).select("home", "probe")
           .mapInArrow(_verify(threshold), "cid long, n long, to long"))
    found = stored(met, "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    member = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "cid")
    named = (classes.join(counts, "cid", "left").join(member, "cid", "left")
             .withColumn("root", F.coalesce("root", "cid")).withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("times") - 1))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("_hash", F.col("label").alias("_l"), F.col("embedding").alias("_e"), "n_links", "component_id")
    rows = rows.withColumn("_hash", F.when(F.col("_usable"), F.col("_hash")))
    out = rows.join(named.withColumnRenamed("_hash", "_h"), (F.col("_hash") == F.col("_h")) & (F.col("label") == F.col("_l"))
                    & (F.col("embedding") == F.col("_e")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
