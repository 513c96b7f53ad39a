"""Streams that are handled in order of time, over micro-batches in any order, against plain versions."""

import random
import time
from datetime import datetime, timedelta

import pytest

from entrylake.operators import temporal as T
from entrylake.session import work_dir
from entrylake.streaming import jobs as R, ordered as O

START = datetime(2024, 1, 1)
SHAPE = "id long, key string, ts timestamp_ntz, token string"
END = (-1, "end", START + timedelta(days=9), "x")


def at(minutes):
    return START + timedelta(minutes=minutes)


def streamed(spark, batches):
    """A stream of one file per batch, and one far later row that closes all."""
    place = work_dir(spark, "ordered")
    for rows in [*batches, [END]]:
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(place)
        time.sleep(0.05)
    return R.read_files(spark, place, spark.createDataFrame([], SHAPE).schema, files_per_batch=1)


def finished(spark, result):
    root = work_dir(spark, "run")
    query = R.write_files(result, f"{root}/out", f"{root}/progress", 4)
    query.awaitTermination(200)
    assert not query.isActive
    return [r for r in spark.read.schema(result.schema).parquet(f"{root}/out").collect() if r["id"] >= 0]


def in_batches(rows, seed):
    """Rows in four batches by time, shuffled so that some come up to an hour late."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.uniform(0, 60)))
    n = len(rows) // 4 + 1
    return [rows[i:i + n] for i in range(0, len(rows), n)]


def test_redemption_equals_batch(spark):
    rng = random.Random(5)
    keys = ["a", "b", "c", "d", None]
    tokens = [(i, rng.choice(keys), at(rng.randrange(4000)), rng.choice("xyz")) for i in range(120)]
    redeems = [(1000 + i, rng.choice([*keys, "never"]), at(rng.randrange(4000)), rng.choice(["x", "y", "z", None])) for i in range(200)]
    redeems += [(5000, "edge", at(60), "t"), (5001, "edge", at(61), "t"), (5002, "edge", at(0), "t")]
    tokens += [(900, "edge", at(0), "t")]
    want = T.redeem_tokens(spark.createDataFrame(redeems, SHAPE), spark.createDataFrame(tokens, SHAPE), "key", "ts", "id", 3600)
    got = finished(spark, O.stream_redeem(streamed(spark, in_batches(redeems, 1)), streamed(spark, in_batches(tokens, 2)),
                                          "key", "ts", "id", 3600, lateness="2 hours"))
    assert len(got) == len(redeems)
    assert {r["id"]: r["outcome"] for r in got} == {r["id"]: r["outcome"] for r in want.collect()}
    assert {r["outcome"] for r in got} == {"no_token", "invalid", "expired", "ok"}


def plain_expiring(rows, width):
    out, held = [], {}
    for i, key, t, value in sorted(rows, key=lambda r: (r[2], r[0])):
        key = key or ""
        last = held.get(key)
        if last and t >= last[1] + width:
            out.append((key, last[0], last[2], "expired", last[1] + width))
            last = None
        out.append((key, value, i, "replaced" if last else "created", t))
        held[key] = (value, t, i)
    return sorted([*out, *((k, v, i, "expired", t + width) for k, (v, t, i) in held.items())], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_expiry_is_put_out(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "c", None]), at(rng.randrange(6000)), rng.choice(["x", None, "y"])) for i in range(150)]
    rows += [(900, "edge", at(0), "p"), (901, "edge", at(30), "q"), (902, "edge", at(59), "r"), (903, "edge", at(59), "s")]
    got = finished(spark, O.stream_expiring(streamed(spark, in_batches(rows, seed)), "key", "ts", "id", "token", 1800, lateness="2 hours"))
    assert sorted(((r["key"], r["value"], r["id"], r["event"], r["at"]) for r in got), key=str) == plain_expiring(rows, timedelta(minutes=30))
    assert {r["event"] for r in got} == {"created", "replaced", "expired"}
