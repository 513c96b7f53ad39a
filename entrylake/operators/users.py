"""Projections, predicates and lookups on the account table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import initials, url_path
from .temporal import login_limits

# Columns that may come from input, and columns that never leave.
FILLABLE = ["name", "email", "password"]
HIDDEN = ["password", "two_factor_secret", "two_factor_recovery_codes", "remember_token"]
_DATETIMES = ["email_verified_at", "two_factor_confirmed_at"]


def fillable(df: DataFrame) -> DataFrame:
    """The columns that input may set, whatever else it carries."""
    return df.select([c for c in FILLABLE if c in df.columns])


def public_users(users: DataFrame) -> DataFrame:
    """Users without secrets, with the initials shown in the interface."""
    return users.drop(*HIDDEN).withColumn("initials", initials(F.col("name")))


def export_users(users: DataFrame) -> DataFrame:
    """One JSON document per user, without secrets."""
    shown = users.drop(*HIDDEN)
    return shown.select("id", F.to_json(F.struct(*shown.columns)).alias("json"))


def cast_users(raw: DataFrame) -> DataFrame:
    """Read-side casts: the verified and confirmed columns become timestamps."""
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in _DATETIMES})


def is_verified() -> Column:
    return F.col("email_verified_at").isNotNull()


def verified(users: DataFrame) -> DataFrame:
    return users.where(is_verified())


def unverified(users: DataFrame) -> DataFrame:
    return users.where(~is_verified())


def two_factor_on() -> Column:
    """A secret is set and was confirmed."""
    return F.col("two_factor_secret").isNotNull() & F.col("two_factor_confirmed_at").isNotNull()


def two_factor_enabled(users: DataFrame) -> DataFrame:
    return users.where(two_factor_on())


def lookup_users(keys: DataFrame, users: DataFrame, values: dict[str, Column] | None = None) -> DataFrame:
    """Left join of login names to users, ignoring case; adds ``user_id`` and ``values``.

    The many side is the left one, so a login name that is tried very often is split by
    adaptive skew-join handling; a small user table is broadcast by its measured size.
    """
    found = users.select(F.lower("email").alias("_login"), F.col("id").alias("user_id"),
                         *[c.alias(name) for name, c in (values or {}).items()])
    return (keys.withColumn("_login", F.lower("email")).join(found, "_login", "left")
            .drop("_login"))


def login_outcomes(attempts: DataFrame, users: DataFrame, **limits) -> DataFrame:
    """What became of each login attempt: limited, unknown, bad_password, two_factor or ok."""
    needed = attempts.select("event_id", "ts", "email", "ip", "password_ok")
    judged = lookup_users(login_limits(needed, **limits), users, {"_second": two_factor_on()})
    outcome = (F.when(~F.col("allowed"), "limited").when(F.col("user_id").isNull(), "unknown")
               .when(~F.coalesce("password_ok", F.lit(False)), "bad_password")
               .when(F.col("_second"), "two_factor").otherwise("ok"))
    return judged.withColumn("outcome", outcome).select("event_id", "user_id", "n", "outcome")


def path_rollup(pages: DataFrame) -> DataFrame:
    """Pages per URL path; malformed URLs are left out."""
    return (pages.select(url_path(F.col("url")).alias("path")).where("path is not null")
            .groupBy("path").agg(F.count(F.lit(1)).alias("pages")))
