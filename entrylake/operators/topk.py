"""Top-k of many queries at once, as blocked matrix products inside Arrow batches.

No pair of query and entry ever becomes a row: a task multiplies a block of entries with
a block of queries and emits at most k rows per query. Two ways to bring them together:

* ``scan``: the queries are few (checked) and broadcast; the corpus is read once, unshuffled.
* ``grid``: any number of queries and entries, both split into blocks of bounded size
  inside a cell; a task gets one block of each. Hot cells become many blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import work_dir

METRICS = ("cosine", "inner", "l2")
BROADCAST_BYTES = 64 * 2**20
BLOCK_ROWS = 50_000
_CELLS_AT_ONCE = 4_000_000
#: Entries of a tile, and pairs of one: its products stay in the processor's caches.
_TILE, _TILE_CODED, _CELLS_IN_TILE = 1024, 512, 1_048_576
#: Codes of a query up to which columns of a tile are added up, and columns that are taken at once.
_SHORT, _ADDED = 96, 500
_LISTED_CELLS = 100_000
#: One in so many pairs is few.
_FEW = 64
_DIGITS = 1e6
RESULT = "q_id long, id long, score double"
_HITS = pa.schema([("q_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def list_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Searchable vectors of an Arrow list column: (row numbers, matrix in double precision).

    Vectors that are null, of another width, not finite or zero are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    usable = lengths == dim
    if column.null_count:
        usable &= np.asarray(column.is_valid())
    rows = np.flatnonzero(usable)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    matrix = flat[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))
    good = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
    return rows[good], matrix[good]


def _word_codes(words: pa.Array, dim: int) -> np.ndarray:
    """``functions.text.token_code`` of many tokens; each different one is hashed once."""
    coded = words.dictionary_encode()
    digests = [hashlib.md5(w.encode()).hexdigest() for w in coded.dictionary.to_pylist()]
    table = np.array([int(h[:8], 16) % dim * 2 + (h[8] < "8") for h in digests], dtype=np.int64)
    return table[coded.indices.to_numpy()] if len(table) else np.empty(0, dtype=np.int64)


def code_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bags of tokens, from lists of tokens or of their codes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    values = column.values[offsets[0]:offsets[-1]]
    codes = (_word_codes(values, dim) if pa.types.is_string(values.type)
             else values.to_numpy(zero_copy_only=False).astype(np.int64))
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    cells = np.bincount(row * dim + (codes >> 1), weights=2.0 * (codes & 1) - 1.0,
                        minlength=len(column) * dim)
    matrix = cells.reshape(len(column), dim)
    rows = np.flatnonzero(matrix.any(axis=1))
    return rows, matrix[rows]


def _round(x: np.ndarray) -> np.ndarray:
    """Half away from zero at six decimals; never minus zero."""
    return np.sign(x) * np.floor(np.abs(x) * _DIGITS + 0.5) / _DIGITS + 0.0


class Dense:
    """Query vectors as rows of a matrix."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.q2, self.terms = rows, np.square(rows).sum(1), rows.shape[1]
        self._small: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.rows)

    def full(self, which: np.ndarray) -> np.ndarray:
        return self.rows[which]

    def products(self, which: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.rows[which], entries)

    def share(self, which: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return ((self.rows[which] != 0) & (entries != 0)).any(axis=1)

    def prepared(self, block: np.ndarray, divisor: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        return scaled

    def near(self, which, scale: np.ndarray | float, extra: float | None, tile: np.ndarray) -> np.ndarray:
        """Products, in single precision, of the scaled queries (with ``extra`` as a further coordinate) and a tile of entries."""
        if self._small is None:
            scaled = self.rows / np.reshape(scale, (-1, 1))
            self._small = (scaled if extra is None else np.column_stack([scaled, np.full(len(scaled), extra)])).astype(np.float32)
        return self._small[which] @ tile.T


class Coded:
    """Sparse queries of whole numbers: every unit of a weight is one code, its column, or ``dim`` more if it is negative."""

    def __init__(self, dim: int, sizes: np.ndarray, codes: np.ndarray):
        self.dim, self.codes, self.sizes = dim, codes, sizes
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.q2 = np.empty(len(sizes))
        step = rows_per_matrix(dim)
        for a in range(0, len(sizes), step):
            self.q2[a:a + step] = np.square(self.full(np.arange(a, min(a + step, len(sizes))))).sum(1)
        self.terms = dim

    def __len__(self) -> int:
        return len(self.sizes)

    @staticmethod
    def split(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and codes of the rows of a matrix."""
        row, column = np.nonzero(matrix)
        weight = matrix[row, column].astype(np.int64)
        sizes = np.bincount(row, weights=np.abs(weight), minlength=len(matrix)).astype(np.int64)
        return sizes, np.repeat(column + matrix.shape[1] * (weight < 0), np.abs(weight)).astype(np.int32)

    def _taken(self, which: np.ndarray, blank: int) -> np.ndarray:
        """The codes of some queries, one row each, filled up with ``blank``."""
        sizes = self.sizes[which]
        places = np.arange(sizes.max(initial=0))
        inside = places[None, :] < sizes[:, None]
        at = np.where(inside, self.begins[which][:, None] + places, 0)
        return np.where(inside, self.codes[at] if len(self.codes) else blank, blank)

    def _met(self, which: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``which`` and, for every code of these queries, what it adds to the product with the entry of that place."""
        sizes = self.sizes[which]
        place = np.repeat(np.arange(len(which)), sizes)
        code = self.codes[np.repeat(self.begins[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(place))]
        return place, entries[place, code % self.dim] * (1.0 - 2.0 * (code >= self.dim))

    def products(self, which: np.ndarray, entries: np.ndarray) -> np.ndarray:
        place, added = self._met(which, entries)
        return np.bincount(place, weights=added, minlength=len(which))

    def share(self, which: np.ndarray, entries: np.ndarray) -> np.ndarray:
        place, added = self._met(which, entries)
        return np.bincount(place, weights=added != 0, minlength=len(which)) > 0

    def full(self, which: np.ndarray) -> np.ndarray:
        sizes = self.sizes[which]
        row = np.repeat(np.arange(len(which)), sizes)
        at = np.repeat(self.begins[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(row))
        code = self.codes[at]
        cells = np.bincount(row * self.dim + code % self.dim, weights=1.0 - 2.0 * (code >= self.dim), minlength=len(which) * self.dim)
        return cells.reshape(len(which), self.dim)

    def prepared(self, block: np.ndarray, divisor: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns of a tile by code (the last is empty), what their sums are divided by, and the tile; small integers where sums fit them."""
        columns = scaled.T
        if np.abs(block).max() * min(_SHORT, self.sizes.max(initial=0)) < 2**15:
            columns = block.T.astype(np.int16)
        else:
            divisor = np.ones(len(block))
        columns = np.ascontiguousarray(columns)
        return np.concatenate([columns, -columns, np.zeros((1, len(block)), columns.dtype)]), divisor.astype(np.float32), scaled

    def near(self, which, scale: np.ndarray, extra: float | None, tile: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Products, in single precision, of the scaled queries and a tile of entries: short queries add up columns of the tile."""
        columns, divisor, scaled = tile
        which = np.arange(len(self))[which]
        out = np.empty((len(which), len(divisor)), np.float32)
        sizes = self.sizes[which]
        order = np.argsort(sizes, kind="stable")
        order, long = np.split(order, [np.searchsorted(sizes[order], _SHORT, "right")])
        sizes, codes = sizes[order], self._taken(which[order], 2 * self.dim)
        at = 0
        while at < len(order):
            upto = min(len(order), at + max(1, _ADDED // max(1, int(sizes[at]))))
            some = codes[at:upto, :sizes[upto - 1]]
            added = columns[some.ravel()].reshape(*some.shape, len(divisor))
            out[order[at:upto]] = np.add.reduce(added, axis=1, dtype=columns.dtype)
            at = upto
        out /= divisor
        for a in range(0, len(long), rows_per_matrix(self.dim)):
            some = long[a:a + rows_per_matrix(self.dim)]
            out[some] = self.full(which[some]).astype(np.float32) @ scaled.T
        out /= scale[which].astype(np.float32)[:, None]
        return out


class Best:
    """The best k entries seen so far of each query, ties by smaller id.

    A tile of queries meets a tile of entries in single precision first. What may reach the bar of its query, given the error of
    such products, is scored in double precision; memory is that of a tile and of the best k.

    With ``overlap`` an entry counts only if it shares a non-zero column with the query.
    """

    def __init__(self, q_ids: np.ndarray, queries: np.ndarray | Dense | Coded, k: int, metric: str,
                 skip_self: bool, overlap: bool, floor: float | np.ndarray | None):
        self.q_ids, self.k, self.metric = q_ids, k, metric
        self.queries = Dense(queries) if isinstance(queries, np.ndarray) else queries
        self.skip_self, self.overlap, self.floor = skip_self, overlap, floor
        self.length = np.sqrt(self.queries.q2)
        self.ids = np.zeros((len(q_ids), k), dtype=np.int64)
        self.score = np.full((len(q_ids), k), -np.inf)
        self.error = (self.queries.terms + 8) * 1.2e-7
        # Vectors too long or too short for single precision are all scored in double precision.
        self.plain = bool(len(q_ids)) and not (1e-15 < self.length.min() and self.length.max() < 1e15)
        self.plain |= metric == "l2" and isinstance(self.queries, Coded)
        self.scale = self.length.max(initial=1e-30) if metric == "l2" else self.length
        self.own = np.argsort(q_ids, kind="stable") if skip_self else None
        self.repeats, self.scored = False, np.zeros(len(q_ids), dtype=np.int64)

    def add(self, ids: np.ndarray, block: np.ndarray, only: np.ndarray | None = None,
            guess: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Score a block against all queries, or against the query positions ``only``.

        ``guess``, for cosine, are vectors near those of the block scaled to unit length, and how far off they can be: what they rule out
        is not scored.
        """
        if only is not None and len(only) == len(self.q_ids):
            only = None
        asked = len(self.q_ids) if only is None else len(only)
        if not asked or not len(ids):
            return
        needed = self._needed(ids, block)
        if len(needed) < len(ids):
            ids, block = ids[needed], block[needed]
            guess = guess and (guess[0][needed], guess[1][needed])
        length = np.sqrt(np.square(block).sum(1))
        wide = _TILE_CODED if isinstance(self.queries, Coded) else _TILE
        for a in range(0, len(ids), wide):
            some = slice(a, a + wide)
            off = None if guess is None else guess[1][some].astype(np.float32)
            tile = self._tile(block[some], length[some]) if guess is None or self.plain else np.column_stack([guess[0][some], off]).astype(np.float32)
            own = self._own(ids[some]) if self.skip_self else None
            high = max(wide, _CELLS_IN_TILE // len(ids[some]))
            for b in range(0, asked, high):
                which = slice(b, min(b + high, asked)) if only is None else only[b:b + high]
                self._add(ids[some], block[some], length[some], tile, off, own, which)

    def _needed(self, ids: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Positions without entries that are equal to k + 1 others of smaller id: they are among the best of no query."""
        order = np.argsort(ids, kind="stable")
        if len(ids) <= self.k + 1 or (ids[order][1:] == ids[order][:-1]).any():
            return np.arange(len(ids))
        rows = np.ascontiguousarray(block + 0.0)[order]
        _, group = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel(), return_inverse=True)
        by_group = np.argsort(group, kind="stable")
        place = np.arange(len(ids)) - np.searchsorted(group[by_group], group[by_group])
        return np.sort(order[by_group[place <= self.k]])

    def _tile(self, block: np.ndarray, length: np.ndarray):
        """Entries in single precision, scaled for the metric; None if they do not fit it."""
        most = length.max()
        if self.plain or not (1e-15 < length.min() and most < 1e15):
            return None
        if self.metric != "l2":
            divisor = length if self.metric == "cosine" else np.full(len(length), most)
            return self.queries.prepared(block, divisor, (block / divisor[:, None]).astype(np.float32))
        if not most < 1e9 * self.scale:
            return None
        return np.column_stack([block / self.scale, np.square(length / self.scale)]).astype(np.float32)

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, entry position) of equal ids."""
        names = self.q_ids[self.own]
        first, last = np.searchsorted(names, ids, "left"), np.searchsorted(names, ids, "right")
        n = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.own[at], np.repeat(np.arange(len(ids)), n)

    def _here(self, own: tuple[np.ndarray, np.ndarray], which, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs ``own`` whose query is one of the n of a tile, by its place there."""
        if isinstance(which, slice):
            place = own[0] - which.start
        else:
            back = np.full(len(self.q_ids), -1)
            back[which] = np.arange(n)
            place = back[own[0]]
        there = (place >= 0) & (place < n)
        return place[there], own[1][there]

    def _bar(self, which) -> np.ndarray:
        worst = self.score[which, -1]
        return worst if self.floor is None else np.maximum(worst, self.floor[which] if np.ndim(self.floor) else self.floor)

    def _least(self, which, bar: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Single-precision products that can belong to scores of at least ``bar``, and how far two such products of like scores can lie apart."""
        length = self.length[which]
        if self.metric == "cosine":
            apart = np.full(len(bar), self.error + 1e-6)
            return bar - apart, apart
        if self.metric == "inner":
            apart = self.error + 1e-6 / (length * most)
            return bar / (length * most) - apart, apart
        error = self.error * (length * most + most * most) / self.scale**2
        least = (np.square(length) - np.square(np.where(bar > -np.inf, 1e-6 - bar, 0.0))) / (2 * self.scale**2) - error
        return np.where(bar > -np.inf, least, -np.inf), error + 1e-6 * (length + most + 1e-6) / self.scale**2

    def _kth(self, near: np.ndarray, off: np.ndarray | None) -> np.ndarray:
        """At most the k-th highest of each row, less what the entries are off by; of groups of columns only the highest counts."""
        if off is not None:
            near = near - 2 * off
        groups = max(64, 8 * self.k)
        if near.shape[1] >= 2 * groups:
            fold = near.shape[1] // groups
            near = near[:, :fold * groups].reshape(len(near), fold, groups).max(axis=1)
        if near.shape[1] < self.k:
            return np.full(len(near), -np.inf, np.float32)
        return np.partition(near, -self.k, axis=1)[:, -self.k]

    def _add(self, ids: np.ndarray, block: np.ndarray, length: np.ndarray, tile,
             off: np.ndarray | None, own: tuple[np.ndarray, np.ndarray] | None, which) -> None:
        positions = np.arange(len(self.q_ids))[which]
        bar = self._bar(which)
        if tile is None:
            q, r = (x.ravel() for x in np.indices((len(positions), len(ids))))
            self.scored[positions] += len(ids)
        else:
            extra = -0.5 if self.metric == "l2" else 1.0 if off is not None else None
            if own is not None:
                own = self._here(own, which, len(positions))
            found = self._reach(self.queries.near(which, self.scale, extra, tile), bar, block, length, off, own, positions)
            own_tile = self._tile(block, length) if off is not None and np.count_nonzero(found) > found.size // _FEW else None
            if own_tile is not None:
                # Guesses that leave many are followed by products of the vectors, which cost less than as many scores.
                self.scored[positions] += np.bitwise_count(np.packbits(found, axis=1)).sum(axis=1, dtype=np.int64)
                near = self.queries.near(which, self.scale, extra, np.column_stack([own_tile, np.zeros(len(ids), np.float32)]))
                found &= self._reach(near, bar, block, length, None, own, positions)
            q, r = np.divmod(_set_places(found), len(ids))
            if own_tile is None:
                self.scored[positions] += np.bincount(q, minlength=len(positions))
        # Few pairs are left unless entries are alike; they are scored in pieces.
        step = max(1, _CELLS_AT_ONCE // block.shape[1])
        for a in range(0, len(q), step):
            self._score(ids, block, length, positions[q[a:a + step]], r[a:a + step])

    def _reach(self, near: np.ndarray, bar: np.ndarray, block: np.ndarray, length: np.ndarray, off: np.ndarray | None,
               own: tuple[np.ndarray, np.ndarray] | None, positions: np.ndarray) -> np.ndarray:
        """Flags of the pairs whose score may reach the bar of its query, by products in single precision (changed here)."""
        if own is not None:
            near[own] = -np.inf
        least, apart = self._least(positions, bar, length.max())
        new = np.flatnonzero(self.score[positions, -1] == -np.inf)
        if len(new):
            least[new] = np.maximum(least[new], self._kth(near[new], off) - 2 * apart[new])
        if self.overlap:
            # Without a shared column the score is 0, so only low bars need the check.
            low = np.flatnonzero(least <= 0)
            for a in range(0, len(low), rows_per_matrix(block.shape[1])):
                some = low[a:a + rows_per_matrix(block.shape[1])]
                shared = (self.queries.full(positions[some]) != 0).astype(np.float32) @ (block != 0).astype(np.float32).T
                near[some] = np.where(shared > 0, near[some], -np.inf)
                least[some] = np.maximum(self._least(positions[some], bar[some], length.max())[0], self._kth(near[some], off) - 2 * apart[some])
        # Rounded down, as the products are compared in single precision.
        least = np.nextafter(np.maximum(least, -3e38).astype(np.float32), np.float32(-np.inf))
        return near >= least[:, None]

    def _score(self, ids: np.ndarray, block: np.ndarray, length: np.ndarray, q: np.ndarray, r: np.ndarray) -> None:
        entries = block[r]
        if self.metric == "l2":
            score = -_round(np.sqrt(np.square(self.queries.full(q) - entries).sum(1)))
        else:
            product = self.queries.products(q, entries)
            score = _round(product if self.metric == "inner" else product / (self.length[q] * length[r]))
        good = (score >= self._bar(q)) & (score > -np.inf)
        if self.skip_self:
            good &= self.q_ids[q] != ids[r]
        if self.overlap:
            maybe = np.flatnonzero(good & (score == 0))
            good[maybe] = self.queries.share(q[maybe], entries[maybe])
        self._keep(q[good], ids[r[good]], score[good])

    def _keep(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.unique(q)
        held = self.score[touched] > -np.inf
        q = np.concatenate([q, np.repeat(touched, held.sum(axis=1))])
        ids, score = np.concatenate([ids, self.ids[touched][held]]), np.concatenate([score, self.score[touched][held]])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        if not self.repeats:
            fresh = np.ones(len(q), dtype=bool)
            fresh[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
            q, ids, score = q[fresh], ids[fresh], score[fresh]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.score[touched] = -np.inf
        self.ids[q[keep], rank[keep]] = ids[keep]
        self.score[q[keep], rank[keep]] = score[keep]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What is held, in batches of bounded size."""
        for a in range(0, len(self.q_ids), 100_000):
            q, place = np.nonzero(self.score[a:a + 100_000] > -np.inf)
            score = self.score[a + q, place]
            yield pa.RecordBatch.from_arrays([pa.array(self.q_ids[a + q]), pa.array(self.ids[a + q, place]),
                                              pa.array(-score + 0.0 if self.metric == "l2" else score)], names=["q_id", "id", "score"])


def _set_places(flags: np.ndarray) -> np.ndarray:
    """Flat positions of the set flags; eight at a time are passed over, as most are not set."""
    flat = flags.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    eight, one = np.nonzero(flat.reshape(-1, 8)[some])
    return some[eight] * 8 + one


def rank_hits(hits: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Global rank of block-wise hits: (q_id, rnk, id, score)."""
    best_first = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    w = Window.partitionBy("q_id").orderBy(best_first, F.col("id"))
    return (hits.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)
            .select("q_id", "rnk", "id", "score"))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared working folder and read back."""
    spark = df.sparkSession
    place = work_dir(spark, purpose)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def rows_per_matrix(dim: int) -> int:
    """Rows that are turned into one dense matrix at a time (32 MB)."""
    return max(1, _CELLS_AT_ONCE // dim)


def scan(packed: tuple[np.ndarray, np.ndarray], corpus: DataFrame, matrix: Callable, dim: int, k: int,
         metric: str, route: Callable | None = None, **options) -> DataFrame:
    """Hits of broadcast queries (ids, matrix) in one pass over corpus (id, v, ...).

    ``route(batch, rows, block)`` yields (block positions, query positions) to be scored;
    without it every query meets every entry.
    """
    # A broadcast names the classes of its objects, and workers may lack this package; kernels carry theirs along.
    coded = isinstance(packed[1], Coded)
    shared = corpus.sparkSession.sparkContext.broadcast((packed[0], vars(packed[1]) if coded else packed[1], route))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, queries, find = shared.value
        if coded:
            given, queries = queries, Coded.__new__(Coded)
            vars(queries).update(given)
        best = Best(q_ids, queries, k, metric, **options)
        step = rows_per_matrix(dim)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                rows, block = matrix(part.column("v"), dim)
                if not len(rows):
                    continue
                ids = part.column("id").to_numpy()[rows]
                if find is None:
                    best.add(ids, block)
                    continue
                for entries, asked in find(part, rows, block):
                    best.add(ids[entries], block[entries], asked)
        yield from best.batches()

    return corpus.mapInArrow(kernel, RESULT)


def _large_cells(df: DataFrame, block_rows: int, name: str) -> DataFrame | None:
    """Number of blocks of the cells with more than ``block_rows`` rows; None if there are none.

    A short list is fetched and broadcast, a longer one is joined like any table.
    """
    counts = (df.groupBy("cell").count().where(F.col("count") > block_rows)
              .select("cell", F.ceil(F.col("count") / block_rows).cast("int").alias(name)))
    listed = counts.limit(_LISTED_CELLS + 1).collect()
    if not listed:
        return None
    if len(listed) > _LISTED_CELLS:
        return counts
    return F.broadcast(df.sparkSession.createDataFrame(listed, counts.schema))


def _with_blocks(df: DataFrame, large: DataFrame | None, name: str) -> DataFrame:
    if large is None:
        return df.withColumn(name, F.lit(1))
    return df.join(large, "cell", "left").withColumn(name, F.coalesce(name, F.lit(1)))


def grid(queries: DataFrame, corpus: DataFrame, matrix: Callable, dim: int, k: int, metric: str,
         block_rows: int = BLOCK_ROWS, query_rows: int | None = None, **options) -> DataFrame:
    """Hits of queries (q_id, v, cell) among corpus rows (id, v, cell) of the same cell.

    A cell with more than ``block_rows`` entries or ``query_rows`` (else ``block_rows``) queries is cut into blocks; each pair of
    blocks is one task's work, so neither a hot cell nor many queries fill a task.
    """
    shards = _large_cells(corpus, block_rows, "shards")
    blocks = _large_cells(queries, query_rows or block_rows, "blocks")

    def placed(df: DataFrame, id_col: str, own: str, other: str) -> DataFrame:
        sized = _with_blocks(_with_blocks(df, shards, "shards"), blocks, "blocks")
        mine = F.pmod(F.xxhash64(id_col), F.col(own)).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return sized.select(F.col("cell").alias("cell"), F.col(id_col).alias(id_col),
                            F.col("v").alias("v"), mine, copies)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], _HITS)
        step = rows_per_matrix(dim)
        rows, asked = _queries((left.column("v").slice(a, step) for a in range(0, left.num_rows, step)), matrix, dim)
        best = Best(left.column("q_id").to_numpy()[rows], asked, k, metric, **options)
        for a in range(0, right.num_rows, step):
            part = right.slice(a, step)
            rows, block = matrix(part.column("v"), dim)
            best.add(part.column("id").to_numpy()[rows], block)
        return pa.Table.from_batches(best.batches(), _HITS)

    where = ["cell", "shards", "blocks"]
    # So many that a group is rarely with others in a task; the number keeps small ones from being merged.
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * queries.sparkSession.sparkContext.defaultParallelism)
    return (placed(queries, "q_id", "blocks", "shards").repartition(parts, *where).groupBy(*where)
            .cogroup(placed(corpus, "id", "shards", "blocks").repartition(parts, *where).groupBy(*where))
            .applyInArrow(kernel, RESULT))


def _queries(columns: Iterator[pa.Array], matrix: Callable, dim: int) -> tuple[np.ndarray, Dense | Coded]:
    """Row numbers of the searchable queries of an Arrow column given in slices, and the queries."""
    rows, made, at = [], [], 0
    for column in columns:
        some, block = matrix(column, dim)
        rows.append(some + at)
        made.append(Coded.split(block) if matrix is code_matrix else block)
        at += len(column)
    if matrix is code_matrix:
        return np.concatenate(rows), Coded(dim, *(np.concatenate(x) for x in zip(*made)))
    return np.concatenate(rows), Dense(np.concatenate(made))


def pack(queries: DataFrame, matrix: Callable, dim: int,
         max_bytes: int = BROADCAST_BYTES) -> tuple[np.ndarray, np.ndarray | Coded] | None:
    """The queries (q_id, v) in memory, or None if they would exceed ``max_bytes``; counted first. Tokens stay sparse."""
    coded = matrix is code_matrix
    if coded:
        n, codes = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("v"), F.lit(0))), F.lit(0))).first()
        if 16 * n + 4 * codes > max_bytes:
            return None
    elif queries.count() > max_bytes // (8 * dim):
        return None

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = rows_per_matrix(dim)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                rows, block = matrix(part.column("v"), dim)
                if coded:
                    sizes, codes = Coded.split(block)
                    block = np.split(codes, np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([part.column("q_id").take(pa.array(rows)), pa.array([r.tobytes() for r in block[:len(rows)]], pa.binary())],
                                                 names=["q_id", "row"])

    # What comes to the driver is what was counted, however long the lists of a query are.
    table = queries.select(F.col("q_id").cast("long").alias("q_id"), "v").mapInArrow(dense, "q_id long, row binary").toArrow()
    rows = table.column("row").to_pylist()
    whole = b"".join(rows)
    if coded:
        return table.column("q_id").to_numpy(), Coded(dim, np.array([len(r) // 4 for r in rows], dtype=np.int64), np.frombuffer(whole, np.int32))
    if table.num_rows == 0:
        return np.empty(0, dtype=np.int64), np.empty((0, dim))
    return table.column("q_id").to_numpy(), np.frombuffer(whole, np.float64).reshape(-1, dim)


def _as_codes(df: DataFrame, key: str, dim: int) -> DataFrame:
    """Lists of tokens as lists of their codes, encoded where they are read: what is shuffled is smaller and is not hashed again."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = rows_per_matrix(dim)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                rows, block = code_matrix(part.column("v"), dim)
                sizes, codes = Coded.split(block)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), (codes % dim * 2 + (codes < dim)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(rows)), lists], names=[key, "v"])

    return df.select(key, "v").mapInArrow(kernel, f"{key} long, v array<int>")


def _query_rows(queries: DataFrame, corpus: DataFrame, block_rows: int) -> int:
    """So many queries of a block that it has as many codes as a block of entries; every block is a copy of the corpus.

    Fewer if the tasks would not keep all cores busy, but not fewer than ``block_rows``.
    """
    (asked, codes), (n, held) = (df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first() for df in (queries, corpus))
    alike = block_rows * (held / max(1, n)) / max(1.0, codes / max(1, asked))
    blocks = -(-4 * queries.sparkSession.sparkContext.defaultParallelism // max(1, -(-n // block_rows)))
    return max(block_rows, min(int(alike), -(-asked // blocks)))


def top_k(queries: DataFrame, corpus: DataFrame, matrix: Callable, dim: int, k: int, metric: str,
          max_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """Exact top-k of queries (q_id, v) in corpus (id, v): (q_id, rnk, id, score). Ids are integers."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    queries = queries.select(F.col("q_id").cast("long").alias("q_id"), "v")
    corpus = corpus.select(F.col("id").cast("long").alias("id"), "v")
    packed = pack(queries, matrix, dim, max_bytes)
    if packed is not None:
        hits = scan(packed, corpus, matrix, dim, k, metric, **options)
    else:
        if matrix is code_matrix:
            # Texts are encoded once, whatever reads them then.
            queries, corpus = (stored(_as_codes(df, key, dim), "codes") for df, key in ((queries, "q_id"), (corpus, "id")))
            options["query_rows"] = _query_rows(queries, corpus, block_rows)
        everywhere = F.lit(0).alias("cell")
        hits = grid(queries.select("q_id", "v", everywhere), corpus.select("id", "v", everywhere),
                    matrix, dim, k, metric, block_rows, **options)
    return rank_hits(hits, k, metric)
