"""Rate limits, as-of lookups, sessions and expiry over activity logs.

Every ordered job works on (key, chunk) as cut by ``skew.chunk_hot_keys``; a key that
holds a large share of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .. import schemas as S
from ..functions.clock import SECOND, from_micros, micros
from ..functions.text import limiter_key
from .skew import ROWS_PER_CHUNK, Chunked, chunk_hot_keys

# --- rate limits -----------------------------------------------------------------


def window_counts(t: np.ndarray, first: np.ndarray, entry: dict[int, tuple[int, int]],
                  width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of the limiter window and hit number of each event.

    ``t`` is sorted inside each run, ``first`` marks the first row of a run, ``entry`` maps
    such a row to a window (start, hits) that was already open before it. The loop takes one
    step per window, not per event.
    """
    n = len(t)
    begins = np.flatnonzero(first)
    ends = np.append(begins[1:], n)
    following = np.empty(n, dtype=np.int64)
    run = np.cumsum(first) - 1
    span = int(t.max()) - int(t.min()) + width + 1
    if span < 2**62 // max(1, len(begins)):
        # One search for the whole batch: shift the runs so that they do not overlap.
        line = (t - t.min()) + run * span
        following = np.searchsorted(line, line + width)
    else:
        for a, b in zip(begins, ends):
            following[a:b] = a + np.searchsorted(t[a:b], t[a:b] + width)
    end_of = dict(zip(begins.tolist(), ends.tolist()))
    step = following.tolist()
    opened, carried = [], []
    i = 0
    while i < n:
        if i in entry:
            start, hits = entry[i]
            j = i + int(np.searchsorted(t[i:end_of[i]], start + width))
            if j > i:
                carried.append((i, j, start, hits))
                i = j
                continue
        opened.append(i)
        i = step[i]
    at = np.zeros(n, dtype=np.int64)
    at[opened] = opened
    at = np.maximum.accumulate(at)
    start, hits = t[at], np.arange(n) - at + 1
    for a, b, start0, hits0 in carried:
        start[a:b] = start0
        hits[a:b] = hits0 + np.arange(1, b - a + 1)
    return start, hits


def _run_starts(batch: pa.RecordBatch, names: list[str], previous: pa.RecordBatch | None) -> np.ndarray:
    """True where a row has another key than the row before it."""
    n = batch.num_rows
    first = np.zeros(n, dtype=bool)
    for name in names:
        column = batch.column(name)
        if n > 1:
            first[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        first[0] |= previous is None or column[0] != previous.column(name)[0]
    return first


def _count_hits(width: int, limit: int, keep: list[str], carried: bool, with_start: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, open_window = None, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            first = _run_starts(batch, ["_key", "_chunk"], previous)
            t = batch.column("_t").to_numpy()
            entry = {}
            if carried and batch.column("_start").null_count < n:
                runs = pa.array(np.flatnonzero(first))
                starts, hits = (batch.column(c).take(runs).to_pylist() for c in ("_start", "_hits"))
                entry = {i: (a, h) for i, a, h in zip(runs.to_pylist(), starts, hits) if a is not None}
            if not first[0]:
                first[0], entry[0] = True, open_window
            start, hits = window_counts(t, first, entry, width)
            open_window = (int(start[-1]), int(hits[-1]))
            previous = batch.select(["_key", "_chunk"]).slice(n - 1, 1)
            made = {"n": hits, "allowed": hits <= limit} | ({"start": start} if with_start else {})
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(a) for a in made.values()],
                names=[*keep, *made])
    return kernel


def _chunk_transitions(width: int):
    """What a chunk makes of a window that is still open when the chunk begins.

    One row per group of entry times with the same outcome: an open window that ends at or
    before ``until`` is replaced, and ``exit_start`` / ``exit_hits`` is open after the chunk.
    """
    def kernel(key: tuple, rows: pa.Table) -> pa.Table:
        t = np.sort(rows.column("_t").to_numpy())
        n = len(t)
        following = np.searchsorted(t, t + width)
        last = np.where(following < n, following, np.searchsorted(t, t))
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        reach = min(n, int(np.searchsorted(t, t[0] + width, side="right")) + 1)
        pick = np.flatnonzero(np.append(last[1:reach] != last[:reach - 1], True))
        same = rows.select(["_key", "_chunk"]).slice(0, 1).to_pylist()[0]
        return pa.table({
            "_key": [same["_key"]] * len(pick), "_chunk": pa.array([same["_chunk"]] * len(pick), pa.int32()),
            "_rows": np.full(len(pick), n), "until": t[pick],
            "exit_start": t[last[pick]], "exit_hits": n - last[pick]})
    return kernel


def _walk_chunks(width: int):
    """Follow the open window from chunk to chunk; needs rows sorted by key, chunk, until.

    ``first_start`` / ``first_hits`` is a window that was open before the first chunk.
    """
    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = chunk = state = None
        settled, rows = True, 0
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.key_ != key or r.chunk_ != chunk:
                    if not settled and state is not None:
                        state = (state[0], state[1] + rows)
                    if r.key_ != key:
                        state = None if pd.isna(r.first_start) else (int(r.first_start), int(r.first_hits))
                    if state is not None:
                        out.append((r.key_, r.chunk_, *state))
                    key, chunk, rows = r.key_, r.chunk_, r.rows_
                    settled = False
                if not settled and (state is None or r.until >= state[0] + width):
                    state, settled = (r.exit_start, r.exit_hits), True
            yield pd.DataFrame(out, columns=["_key", "_chunk", "_start", "_hits"])
    return kernel


def _open_windows(chunked: Chunked, width: int, opened: DataFrame) -> DataFrame:
    """(key, chunk, start, hits) of the window that is open where a chunk of a hot key begins."""
    moves = (chunked.hot_rows().select("_key", "_chunk", "_t").groupBy("_key", "_chunk")
             .applyInArrow(_chunk_transitions(width), "_key string, _chunk int, _rows long, "
                                                      "until long, exit_start long, exit_hits long"))
    before = chunked.hot.select("_key").join(opened, "_key", "left").withColumnsRenamed(
        {"_start": "first_start", "_hits": "first_hits"})
    # One row per hot key, their number is bounded.
    return (moves.join(F.broadcast(before), "_key")
            .withColumnsRenamed({"_key": "key_", "_chunk": "chunk_", "_rows": "rows_"})
            .repartition("key_").sortWithinPartitions("key_", "chunk_", "until")
            .mapInPandas(_walk_chunks(width), "_key string, _chunk int, _start long, _hits long"))


def rate_limit(events: DataFrame, key: str | Column, ts: str, order: str, limit: int, seconds: int,
               rows_per_chunk: int = ROWS_PER_CHUNK, opened: DataFrame | None = None) -> DataFrame:
    """Keyed rate limit: adds ``n``, the hit number in its window, and ``allowed``.

    The first hit of a key opens a window of ``seconds``; a hit at or after its end opens the
    next one. Events are taken in order of (``ts``, ``order``); ``order`` must be unique and
    ``ts`` not null. All columns of ``events`` pass through Python, so select the needed ones first. A key
    of null counts as the empty string. ``opened`` (key, start, hits; start in microseconds,
    at most one row per key) are windows still open from earlier events; with it the column
    ``start`` is added, from which the next ``opened`` can be made.
    """
    width = seconds * SECOND
    key_column = F.col(key) if isinstance(key, str) else key
    text_key = F.coalesce(key_column.cast("string"), F.lit(""))
    keyed = events.withColumns({"_key": text_key, "_t": micros(events, ts), "_id": F.col(order)})
    chunked = chunk_hot_keys(keyed, "_key", ["_t", "_id"], rows_per_chunk)
    spark = events.sparkSession
    windows = (spark.createDataFrame([], "_key string, _start long, _hits long") if opened is None
               else opened.select(F.col("key").alias("_key"), F.col("start").alias("_start"),
                                  F.col("hits").alias("_hits")))
    rows, carry_columns = chunked.df, []
    if opened is not None:
        first_chunk = windows.withColumn("_chunk", F.lit(0))
        rows = chunked.df.join(first_chunk, ["_key", "_chunk"], "left")
    if chunked.split:
        carry = _open_windows(chunked, width, windows).withColumnsRenamed({"_start": "_s", "_hits": "_h"})
        rows = rows.join(F.broadcast(carry), ["_key", "_chunk"], "left")
        before = (F.col("_start"), F.col("_hits")) if opened is not None else (F.lit(None), F.lit(None))
        rows = rows.withColumns({"_start": F.coalesce(F.col("_s"), before[0].cast("long")),
                                 "_hits": F.coalesce(F.col("_h"), before[1].cast("long"))})
    if opened is not None or chunked.split:
        carry_columns = ["_start", "_hits"]
    shape = StructType(list(events.schema.fields)).add("n", "long").add("allowed", "boolean")
    if opened is not None:
        shape = shape.add("start", "long")
    return (rows.repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", "_t", "_id")
            .select(*events.columns, "_key", "_chunk", "_t", *carry_columns)
            .mapInArrow(_count_hits(width, limit, events.columns, bool(carry_columns), opened is not None), shape))


def rate_count(events: DataFrame, key: str | Column, ts: str, seconds: int = 60) -> DataFrame:
    """Hits per key and clock-aligned window, for dashboards."""
    key_column = F.col(key) if isinstance(key, str) else key
    return (events.groupBy(key_column.alias("key"), F.window(ts, f"{seconds} seconds").alias("_w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("key", F.col("_w.start").alias("window_start"), "n"))


def token_throttle(requests: DataFrame, email: str, ts: str, order: str,
                   seconds: int = S.TOKEN_THROTTLE_SECONDS, **options) -> DataFrame:
    """A reset token is issued only if the last issued one is at least ``seconds`` old."""
    return rate_limit(requests, email, ts, order, 1, seconds, **options)


# --- as-of -----------------------------------------------------------------------


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, order: str, values: list[str],
         rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time.

    Both sides have ``key``, ``ts`` and a unique ``order`` column; ties on time take the
    highest ``order``. Adds the struct ``match`` (``_t`` in microseconds, ``values``), null
    where there is none. One shuffle of both sides together, no range join.
    """
    hit = F.struct(F.col("_t"), *values)
    lefts = left.withColumns({"_t": micros(left, ts), "_side": F.lit(1), "_id": F.col(order)})
    rights = right.withColumns({"_t": micros(right, ts), "_side": F.lit(0), "_id": F.col(order)})
    row = F.struct(*left.columns)
    both = (rights.select(key, "_t", "_side", "_id", hit.alias("_right"))
            .unionByName(lefts.select(key, "_t", "_side", "_id", row.alias("_left")),
                         allowMissingColumns=True))
    # Rows without a key match nothing; give them an own group instead of dropping them.
    grouped = both.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")),
                                                 F.lit("")))
    chunked = chunk_hot_keys(grouped, "_key", ["_t", "_side", "_id"], rows_per_chunk)
    w = (Window.partitionBy("_key", "_chunk").orderBy("_t", "_side", "_id")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = F.last("_right", ignorenulls=True).over(w)
    if chunked.split:
        newest = (chunked.hot_rows().groupBy("_key", "_chunk")
                  .agg(F.max_by(F.col("_right"),
                                F.when(F.col("_side") == 0, F.struct("_t", "_id"))).alias("_last")))
        earlier = (Window.partitionBy("_key").orderBy("_chunk")
                   .rowsBetween(Window.unboundedPreceding, -1))
        carry = newest.select("_key", "_chunk",
                              F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
        rows = chunked.attach(carry).withColumn("match", F.coalesce(seen, F.col("_before")))
    else:
        rows = chunked.df.withColumn("match", seen)
    match = F.when(F.col(key).isNotNull(), F.col("match")).alias("match")
    return rows.where("_side = 1").select("_left.*", match)


def _age(t: Column) -> Column:
    return t - F.col("match._t")


def fresh_confirmation(actions: DataFrame, confirms: DataFrame, key: str, ts: str, order: str,
                       seconds: int = S.CONFIRM_LIFETIME_SECONDS, **options) -> DataFrame:
    """Adds ``fresh``: the last confirmation is at most ``seconds`` old."""
    joined = asof(actions, confirms, key, ts, order, [], **options)
    fresh = _age(micros(actions, ts)) <= seconds * SECOND
    return joined.withColumn("fresh", F.coalesce(fresh, F.lit(False))).drop("match")


def redeem_tokens(redeems: DataFrame, tokens: DataFrame, key: str, ts: str, order: str,
                  seconds: int = S.TOKEN_LIFETIME_SECONDS, **options) -> DataFrame:
    """Outcome of each redemption against the latest token of the e-mail.

    ``no_token``, ``invalid`` (another value), ``expired`` or ``ok``. Both sides have ``token``.
    """
    joined = asof(redeems, tokens, key, ts, order, ["token"], **options)
    outcome = (F.when(F.col("match").isNull(), "no_token")
               .when(~F.col("match.token").eqNullSafe(F.col("token")), "invalid")
               .when(_age(micros(redeems, ts)) > seconds * SECOND, "expired").otherwise("ok"))
    return joined.withColumn("outcome", outcome).drop("match")


# --- sessions and expiry ---------------------------------------------------------


def sessionize(events: DataFrame, key: str, ts: str, order: str, minutes: int = S.SESSION_MINUTES,
               rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Activity sessions (key, first_ts, last_ts, n); an idle gap of ``minutes`` ends one."""
    gap = minutes * 60 * SECOND
    plain = events.where(F.col(key).isNotNull()).select(
        F.col(key), micros(events, ts).alias("_t"), F.col(order).alias("_id"))
    chunked = chunk_hot_keys(plain, key, ["_t", "_id"], rows_per_chunk)
    part = Window.partitionBy(key, "_chunk")
    idle = F.col("_t") - F.lag("_t").over(part.orderBy("_t", "_id"))
    runs = chunked.df.withColumn("_new", F.coalesce((idle >= gap).cast("int"), F.lit(1)))
    in_order = part.orderBy("_t", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (runs.withColumn("_run", F.sum("_new").over(in_order))
             .groupBy(key, "_chunk", "_run")
             .agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count(F.lit(1)).alias("n")))
    if chunked.split:
        # Only the first and the last session of a chunk can go on in a neighbouring chunk.
        hot = F.broadcast(chunked.hot.select(key, F.lit(True).alias("_hot")))
        ends = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(part))
        marked = (local.withColumn("_end", ends).join(hot, key, "left")
                  .withColumn("_open", F.col("_end") & F.coalesce("_hot", F.lit(False))))
        w = Window.partitionBy(key).orderBy("_a", "_chunk")
        far = F.col("_a") - F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1))
        joined = (marked.where("_open")
                  .withColumn("_new", F.coalesce((far >= gap).cast("int"), F.lit(1)))
                  .withColumn("_run", F.sum("_new").over(
                      w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                  .groupBy(key, "_run")
                  .agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("n").alias("n")))
        local = marked.where(~F.col("_open")).select(key, "_a", "_b", "n").unionByName(
            joined.select(key, "_a", "_b", "n"))
    return local.select(key, from_micros(events, ts, F.col("_a")).alias("first_ts"),
                        from_micros(events, ts, F.col("_b")).alias("last_ts"), "n")


def session_status(sessions: DataFrame, now: int, minutes: int = S.SESSION_MINUTES) -> DataFrame:
    """Live and expired sessions and the last activity per user; guests have a null user_id."""
    expired = F.col("last_activity") + minutes * 60 < now
    return sessions.groupBy("user_id").agg(
        F.count_if(~expired).alias("live"), F.count_if(expired).alias("expired"),
        F.max("last_activity").alias("last_activity"))


def live_sessions(sessions: DataFrame, now: int, minutes: int = S.SESSION_MINUTES) -> DataFrame:
    """Sessions that are not expired; a plain comparison, so it is pushed into the scan."""
    return sessions.where(F.col("last_activity") >= now - minutes * 60)


def retain_live(df: DataFrame, expiry: str, now: int) -> DataFrame:
    """Rows of a keyed table whose expiry (epoch seconds) is still ahead."""
    return df.where(F.col(expiry) > now)


def expired_counts(df: DataFrame, expiry: str, now: int, prefix: Column) -> DataFrame:
    """Expired rows per key prefix."""
    return (df.where(F.col(expiry) <= now).groupBy(prefix.alias("prefix"))
            .agg(F.count(F.lit(1)).alias("expired")))


def login_limits(attempts: DataFrame, limit: int = S.LOGIN_LIMIT, seconds: int = S.LOGIN_SECONDS,
                 **options) -> DataFrame:
    """The login limiter: keyed by folded lower-case e-mail and address."""
    return rate_limit(attempts, limiter_key(F.col("email"), F.col("ip")), "ts", "event_id",
                      limit, seconds, **options)
