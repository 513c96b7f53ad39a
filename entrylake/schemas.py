"""Typed tables. Timestamps are UTC; epoch columns are whole seconds."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, DataType, FloatType, IntegerType, LongType, MapType, ShortType, StringType,
    StructField, StructType, TimestampType,
)

_LONG, _STR, _INT, _TS = LongType(), StringType(), IntegerType(), TimestampType()


def _table(*columns: tuple[str, DataType, bool]) -> StructType:
    return StructType([StructField(name, dtype, nullable) for name, dtype, nullable in columns])


# The account table before and after two-factor columns were added.
USERS_V1 = _table(
    ("id", _LONG, False), ("name", _STR, False), ("email", _STR, False),
    ("email_verified_at", _TS, True), ("password", _STR, False), ("remember_token", _STR, True),
    ("created_at", _TS, True), ("updated_at", _TS, True),
)
USERS = _table(
    ("id", _LONG, False), ("name", _STR, False), ("email", _STR, False),
    ("email_verified_at", _TS, True), ("password", _STR, False),
    ("two_factor_secret", _STR, True), ("two_factor_recovery_codes", _STR, True),
    ("two_factor_confirmed_at", _TS, True), ("remember_token", _STR, True),
    ("created_at", _TS, True), ("updated_at", _TS, True),
)
PASSWORD_RESET_TOKENS = _table(
    ("email", _STR, False), ("token", _STR, False), ("created_at", _TS, True),
)
SESSIONS = _table(
    ("id", _STR, False), ("user_id", _LONG, True), ("ip_address", _STR, True),
    ("user_agent", _STR, True), ("payload", _STR, False), ("last_activity", _LONG, False),
)
CACHE = _table(("key", _STR, False), ("value", _STR, False), ("expiration", _LONG, False))
CACHE_LOCKS = _table(("key", _STR, False), ("owner", _STR, False), ("expiration", _LONG, False))
JOBS = _table(
    ("id", _LONG, False), ("queue", _STR, False), ("payload", _STR, False),
    ("attempts", ShortType(), False), ("reserved_at", _LONG, True),
    ("available_at", _LONG, False), ("created_at", _LONG, False),
)
JOB_BATCHES = _table(
    ("id", _STR, False), ("name", _STR, False), ("total_jobs", _INT, False),
    ("pending_jobs", _INT, False), ("failed_jobs", _INT, False),
    ("failed_job_ids", ArrayType(_STR), False), ("options", _STR, True),
    ("cancelled_at", _LONG, True), ("created_at", _LONG, False), ("finished_at", _LONG, True),
)
FAILED_JOBS = _table(
    ("id", _LONG, False), ("uuid", _STR, False), ("connection", _STR, False),
    ("queue", _STR, False), ("payload", _STR, False), ("exception", _STR, False),
    ("failed_at", _TS, False),
)
ENTRIES = _table(
    ("id", _LONG, False), ("title", _STR, True), ("body", _STR, False), ("category", _STR, True),
    ("tags", ArrayType(_STR), False), ("metadata", MapType(_STR, _STR), True),
    ("content_hash", _STR, False), ("created_at", _TS, True), ("updated_at", _TS, True),
)
ENTRY_EMBEDDINGS = _table(
    ("entry_id", _LONG, False), ("model", _STR, False), ("dim", _INT, False),
    ("embedding", ArrayType(FloatType()), False),
)
ENTRY_RESOURCES = _table(
    ("entry_id", _LONG, False), ("pos", _INT, False), ("kind", _STR, False),
    ("lang", _STR, True), ("content", _STR, True),
)

TABLES: dict[str, StructType] = {
    "users": USERS, "password_reset_tokens": PASSWORD_RESET_TOKENS, "sessions": SESSIONS,
    "cache": CACHE, "cache_locks": CACHE_LOCKS, "jobs": JOBS, "job_batches": JOB_BATCHES,
    "failed_jobs": FAILED_JOBS, "entries": ENTRIES, "entry_embeddings": ENTRY_EMBEDDINGS,
    "entry_resources": ENTRY_RESOURCES,
}

# Limits and lifetimes; fixed values of the product.
STRING_LIMIT = 255
IP_LIMIT = 45
EMBEDDING_DIM = 1536
LOGIN_LIMIT, LOGIN_SECONDS = 5, 60
TWO_FACTOR_LIMIT, TWO_FACTOR_SECONDS = 5, 60
PASSWORD_LIMIT, PASSWORD_SECONDS = 6, 60
TOKEN_THROTTLE_SECONDS = 60
TOKEN_LIFETIME_SECONDS = 3600
VERIFY_LIFETIME_MINUTES = 60
CONFIRM_LIFETIME_SECONDS = 10800
SESSION_MINUTES = 120
RETRY_AFTER_SECONDS = 90
