"""Synthetic accounts for load tests."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S
from .tables import evolve

# Fixed values of the seed account.
SEED_NAME, SEED_EMAIL = "Test User", "test@example.com"
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _draw(key: Column, salt: str) -> Column:
    """A number 0..99 that depends on the key only, so reruns and retries agree."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(100))


def users_for(ids: DataFrame, unverified_pct: int = 0, two_factor_pct: int = 0,
              now: datetime = _EPOCH) -> DataFrame:
    """An account for each ``id``: a share of them unverified, a share with two-factor on."""
    key, stamp = F.col("id"), F.lit(now).cast("timestamp")
    two_factor = _draw(key, "two-factor") < two_factor_pct
    text = key.cast("string")
    made = ids.select(
        key.cast("long").alias("id"),
        F.concat(F.lit("User "), text).alias("name"),
        F.concat(F.lit("user."), text, F.lit("@example.com")).alias("email"),
        F.when(_draw(key, "unverified") >= unverified_pct, stamp).alias("email_verified_at"),
        F.sha2(F.lit("password"), 256).alias("password"),
        F.when(two_factor, F.base64(F.lit("secret"))).alias("two_factor_secret"),
        F.when(two_factor, F.base64(F.lit('["recovery-code-1"]'))).alias("two_factor_recovery_codes"),
        F.when(two_factor, stamp).alias("two_factor_confirmed_at"),
        F.substring(F.md5(text), 1, 10).alias("remember_token"),
        stamp.alias("created_at"), stamp.alias("updated_at"))
    return evolve(made, S.USERS)


def gen_users(spark: SparkSession, n: int, unverified_pct: int = 0, two_factor_pct: int = 0,
              now: datetime = _EPOCH) -> DataFrame:
    """n accounts with ids 2..n+1, and the seed account with id 1."""
    stamp = F.lit(now).cast("timestamp")
    seed = users_for(spark.range(1, 2), now=now).withColumns(
        {"name": F.lit(SEED_NAME), "email": F.lit(SEED_EMAIL), "email_verified_at": stamp})
    return users_for(spark.range(2, n + 2), unverified_pct, two_factor_pct, now).unionByName(seed)
