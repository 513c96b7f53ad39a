"""Streams whose rows are handled in order of their time: redemption of tokens, keys that expire.

A key's rows wait in state until the watermark has passed them, so neither the order of arrival nor the bounds of micro-batches show in the
results. Event-time timers wake a key when its next row or its expiry is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..functions.clock import SECOND, micros

Waiting = tuple[int, int, int, "str | None"]  # time in microseconds, side, id, value


class _InOrder(StatefulProcessor):
    """Holds the newest (value, time, id) of a key and the rows that wait for the watermark."""

    columns: list[str]

    def __init__(self, seconds: int):
        self.width = seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, side int, id long, value string")
        self.held = handle.getValueState("held", "value string, t long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            self.waiting.appendList([(int(t), int(side), int(i), None if pd.isna(v) else v)
                                     for t, side, i, v in zip(pdf["t"], pdf["side"], pdf["id"], pdf["value"])])
            first = int(pdf["t"].min()) if first is None else min(first, int(pdf["t"].min()))
        self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: tuple(r[:3])) if self.waiting.exists() else []
        due = [tuple(r) for r in rows if r[0] < now]
        left = [tuple(r) for r in rows if r[0] >= now]
        held = tuple(self.held.get()) if self.held.exists() else None
        held, out = self.step(due, held, now)
        self.waiting.clear()
        if left:
            self.waiting.appendList(left)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        times = [r[0] for r in left[:1]] + ([] if (end := self.ends(held)) is None else [end])
        if times:
            self._wake(min(times))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.columns])

    def _wake(self, t: int) -> None:
        self.handle.registerTimer(-(-t // 1000))

    def step(self, due: list[Waiting], held: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        """What is held after the rows that are due, and what they give."""
        raise NotImplementedError

    def ends(self, held: tuple | None) -> int | None:
        """When what is held has to be looked at again."""
        return None

    def close(self) -> None:
        pass


class _Redeem(_InOrder):
    columns = ["id", "outcome"]

    def step(self, due, held, now):
        out = []
        for t, side, i, value in due:
            if side == 0:
                held = (value, t, i)
            elif held is None:
                out.append((i, "no_token"))
            elif held[0] != value:
                out.append((i, "invalid"))
            else:
                out.append((i, "expired" if t - held[1] > self.width else "ok"))
        return held, out


class _Expiring(_InOrder):
    columns = ["value", "id", "event", "t"]

    def step(self, due, held, now):
        out = []
        for t, _, i, value in due:
            if (end := self.ends(held)) is not None and t >= end:
                out.append((held[0], held[2], "expired", end))
                held = None
            out.append((value, i, "created" if held is None else "replaced", t))
            held = (value, t, i)
        if (end := self.ends(held)) is not None and end < now:
            out.append((held[0], held[2], "expired", end))
            held = None
        return held, out

    def ends(self, held):
        return None if held is None else held[1] + self.width


def _rows(df: DataFrame, key: Column, ts: str, order: str, value: str, side: int, lateness: str) -> DataFrame:
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    return timed.select("_ts", key.alias("key"), micros(timed, ts).alias("t"), F.lit(side).alias("side"),
                        F.col(order).cast("long").alias("id"), F.col(value).cast("string").alias("value"))


def stream_redeem(redeems: DataFrame, tokens: DataFrame, key: str, ts: str, order: str, seconds: int = S.TOKEN_LIFETIME_SECONDS,
                  lateness: str = "10 minutes") -> DataFrame:
    """Outcome (id, outcome) of each redemption against the latest token of its key, as ``redeem_tokens`` gives it.

    Both streams have a watermark of their own, and the slower one counts: a redemption is judged when no token before it can come any
    more. Later rows than ``lateness`` are dropped. State is one token per key, and the rows of the last ``lateness``. A redemption without a key has no
    token.
    """
    own = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = _rows(tokens.where(F.col(key).isNotNull()), own, ts, order, "token", 0, lateness).unionByName(
        _rows(redeems, own, ts, order, "token", 1, lateness))
    made = rows.groupBy("key").transformWithStateInPandas(_Redeem(seconds), "key string, id long, outcome string", "Append", "EventTime")
    return made.select("id", "outcome")


def stream_expiring(writes: DataFrame, key: str, ts: str, order: str, value: str, seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """What becomes of keys that live ``seconds`` after their last write: (key, value, id, event, at).

    ``created`` and ``replaced`` at each write, in order of time; ``expired`` with the last value at the moment the life is over (a write at that
    moment creates the key anew). Null keys count as empty. Later writes than ``lateness`` are dropped.
    """
    rows = _rows(writes, F.coalesce(F.col(key).cast("string"), F.lit("")), ts, order, value, 0, lateness)
    made = rows.groupBy("key").transformWithStateInPandas(_Expiring(seconds), "key string, value string, id long, event string, t long",
                                                          "Append", "EventTime")
    return made.select("key", "value", "id", "event", F.timestamp_micros("t").alias("at"))
