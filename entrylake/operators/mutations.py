"""Changes of tables, each a job from one snapshot to the next."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions.clock import SECOND, micros
from . import quality as Q
from .skew import ROWS_PER_CHUNK, number_rows


class Registered(NamedTuple):
    users: DataFrame
    rejects: DataFrame


class Verified(NamedTuple):
    users: DataFrame
    events: DataFrame


def judge_registrations(users: DataFrame, batch: DataFrame, env: str = "local") -> DataFrame:
    """The batch with ``violations``; the e-mail is stored, and compared, in lower case."""
    lowered = batch.withColumn("email", F.lower("email"))
    password = [Q._flag(~Q._filled("password"), "password.required"),
                *Q.policy_rules("password", env), Q.confirmed_rule("password")]
    rules = Q.name_rules() + Q.email_rules() + password
    checked = lowered.withColumn("_broken", Q.join_violations(rules))
    unique = Q.check_unique(checked, users, F.col("_broken") == "")
    return unique.withColumn(
        "violations", F.when(F.col("taken"), F.lit("email.unique")).otherwise(F.col("_broken"))) \
        .drop("taken", "_broken")


def register(users: DataFrame, batch: DataFrame, now: datetime | Column, env: str = "local",
             hash_password: Callable[[Column], Column] = lambda c: F.sha2(c, 256),
             rows_per_chunk: int = ROWS_PER_CHUNK) -> Registered:
    """Append the valid rows of a batch (seq, name, email, password and its confirmation).

    New ids follow the largest id in order of ``seq``. ``hash_password`` stands in for the
    product's password hashing; the clear text goes neither to the users nor to the rejects.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    judged = judge_registrations(users, batch, env)
    top = users.agg(F.max("id")).first()[0]
    fresh = number_rows(judged.where("violations = ''"), ["seq"], "_rn", rows_per_chunk,
                        at_most=batch.count())
    values = {"id": F.lit(0 if top is None else top) + F.col("_rn"), "name": F.col("name"),
              "email": F.col("email"), "password": hash_password(F.col("password")),
              "created_at": now, "updated_at": now}
    new = fresh.select([values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in users.schema.fields])
    rejects = judged.where("violations <> ''").select("seq", "violations")
    return Registered(users.unionByName(new), rejects)


def judge_profile_changes(users: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes (id, name, email) with ``violations``."""
    checked = Q.validate_profile(changes).withColumnRenamed("violations", "_broken")
    unique = Q.check_unique_except_self(checked, users, F.col("_broken") == "")
    return unique.withColumn(
        "violations", F.when(F.col("taken"), F.lit("email.unique")).otherwise(F.col("_broken"))) \
        .drop("taken", "_broken")


def update_profiles(users: DataFrame, changes: DataFrame, now: datetime | Column) -> DataFrame:
    """Apply the valid changes, one per id; a new e-mail is unverified again."""
    now = now if isinstance(now, Column) else F.lit(now)
    good = judge_profile_changes(users, changes).where("violations = ''").select(
        "id", F.col("name").alias("_name"), F.col("email").alias("_email"))
    hit = F.col("_email").isNotNull()
    moved = hit & (F.col("_email") != F.col("email"))
    dirty = moved | (hit & (F.col("_name") != F.col("name")))
    types = {f.name: f.dataType for f in users.schema.fields}
    values = {
        "name": F.coalesce("_name", "name"), "email": F.coalesce("_email", "email"),
        "email_verified_at": F.when(~F.coalesce(moved, F.lit(False)), F.col("email_verified_at")),
        "updated_at": F.when(dirty, now.cast(types["updated_at"])).otherwise(F.col("updated_at")),
    }
    return users.join(good, "id", "left").select(
        [values.get(c, F.col(c)).alias(c) for c in users.columns])


def overwrite_column(users: DataFrame, changes: DataFrame, column: str, seq: str | None = None) -> DataFrame:
    """Set one column by id from ``changes`` (id and the column, already hashed).

    With ``seq`` the latest change of an id counts; without it ids must be unique.
    """
    if seq:
        changes = changes.groupBy("id").agg(F.max_by(column, seq).alias(column))
    new = changes.select("id", F.col(column).alias("_new"))
    return users.join(new, "id", "left").select(
        [F.coalesce("_new", column).alias(c) if c == column else F.col(c) for c in users.columns])


def delete_users(users: DataFrame, ids: DataFrame) -> DataFrame:
    return users.join(ids.select("id"), "id", "left_anti").select(*users.columns)


def apply_verifications(users: DataFrame, clicks: DataFrame,
                        minutes: int = S.VERIFY_LIFETIME_MINUTES) -> Verified:
    """Mark users as verified by their first good click (event_id, id, hash, ts, issued_at).

    A click is good within ``minutes`` of its issue and if its hash is the SHA-1 of the
    user's e-mail. Verified users stay as they are and cause no event. Clicks are first
    reduced to one per (id, hash), so a link that is clicked very often costs no join.
    """
    in_time = micros(clicks, "ts") <= micros(clicks, "issued_at") + minutes * 60 * SECOND
    earliest = (clicks.where(in_time).groupBy("id", "hash")
                .agg(F.min(F.struct("ts", "event_id")).alias("_click")))
    open_users = users.where("email_verified_at is null").select("id", F.sha1("email").alias("hash"))
    events = earliest.join(open_users, ["id", "hash"]).select(
        "id", F.col("_click.ts").alias("verified_at"), F.col("_click.event_id").alias("event_id"))
    verified_type = users.schema["email_verified_at"].dataType
    stamped = users.join(events.select("id", F.col("verified_at").alias("_at")), "id", "left")
    out = stamped.select([
        F.coalesce("email_verified_at", F.col("_at").cast(verified_type)).alias(c)
        if c == "email_verified_at" else F.col(c) for c in users.columns])
    return Verified(out, events)


def verification_worklist(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Unverified users who asked for a mail (requests: id), each once."""
    asked = requests.select("id").distinct()
    return users.where("email_verified_at is null").join(asked, "id", "left_semi") \
        .select("id", "email")


def latest(changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` of each key, reduced before the shuffle."""
    row = F.struct(*changes.columns)
    return (changes.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
            .agg(F.max_by(row, seq).alias("_row")).select("_row.*"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], seq: str, op: str | None = None) -> DataFrame:
    """Last write wins per key; on equal ``seq`` the change wins. ``op = 'delete'`` removes a key.

    ``base`` has unique keys; without a ``seq`` column every change wins. Few changes are broadcast by their measured size, and then
    the base is never shuffled; its second reading touches the key columns only.
    """
    newest = latest(changes, keys, seq)
    columns = base.columns
    deleted = F.col(op) == "delete" if op else F.lit(False)
    marks = newest.select(*keys, F.col(seq).alias("_seq"), F.lit(True).alias("_hit"))
    new = newest.where(~F.coalesce(deleted, F.lit(False)))
    old = base.join(marks, keys, "left")
    if seq not in columns:
        return old.where("_hit is null").select(*columns).unionByName(new.select(*columns))
    ahead = F.col("_hit") & F.coalesce(F.col(seq) > F.col("_seq"), F.lit(False))
    kept = old.where(F.col("_hit").isNull() | ahead).select(*columns)
    # Changes that lose against a newer row of the base.
    beaten = old.where(ahead).select(*keys)
    return kept.unionByName(new.join(beaten, keys, "left_anti").select(*columns))
