"""Field rules, uniqueness and table audits.

Violations are written ``field.rule``, joined by commas in rule order; '' means valid.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions.text import trim_space

_EMAIL = r"^[^\s@.]+(\.[^\s@.]+)*@[^\s@.]+(\.[^\s@.]+)*$"


def _filled(name: str) -> Column:
    value = F.col(name)
    return value.isNotNull() & (trim_space(value) != "")


def _flag(broken: Column, label: str) -> Column:
    return F.when(broken, F.lit(label))


def join_violations(rules: list[Column]) -> Column:
    return F.concat_ws(",", *rules)


def name_rules() -> list[Column]:
    return [_flag(~_filled("name"), "name.required"),
            _flag(F.length("name") > S.STRING_LIMIT, "name.max")]


def email_rules() -> list[Column]:
    """A blank address breaks only the required rule."""
    filled = _filled("email")
    return [_flag(~filled, "email.required"),
            _flag(filled & ~F.col("email").rlike(_EMAIL), "email.email"),
            _flag(filled & (F.length("email") > S.STRING_LIMIT), "email.max")]


def confirmed_rule(name: str) -> Column:
    return _flag(~F.col(name).eqNullSafe(F.col(f"{name}_confirmation")), f"{name}.confirmed")


def policy_rules(name: str, env: str) -> list[Column]:
    """Production wants 12 characters, both cases, a letter, a digit and a symbol."""
    if env != "production":
        return []
    value = F.col(name)
    both_cases = value.rlike(r"\p{Lu}") & value.rlike(r"\p{Ll}")
    return [_flag(F.length(value) < 12, f"{name}.min"),
            _flag(~both_cases, f"{name}.mixed"),
            _flag(~value.rlike(r"\p{L}"), f"{name}.letters"),
            _flag(~value.rlike(r"\p{N}"), f"{name}.numbers"),
            _flag(~value.rlike(r"[\p{Z}\p{S}\p{P}]"), f"{name}.symbols")]


def validate_profile(df: DataFrame) -> DataFrame:
    """Adds ``violations`` of the name and e-mail rules."""
    return df.withColumn("violations", join_violations(name_rules() + email_rules()))


def check_confirmed(df: DataFrame, name: str) -> DataFrame:
    """Adds ``violations``: the value must equal its ``_confirmation`` twin."""
    return df.withColumn("violations", join_violations([confirmed_rule(name)]))


def audit_password_policy(df: DataFrame, env: str, name: str = "password") -> DataFrame:
    """Adds ``violations`` of the password policy and drops the password itself."""
    rules = policy_rules(name, env)
    return df.withColumn("violations", join_violations(rules)).drop(name, f"{name}_confirmation")


def check_unique(batch: DataFrame, users: DataFrame, valid: Column | None = None,
                 order: str = "seq") -> DataFrame:
    """Adds ``taken``: the e-mail exists already, or an earlier valid row of the batch has it.

    Only rows for which ``valid`` holds claim an address; for the others ``taken`` is false.
    ``order`` is unique. All later rows of an address lose anyway, so only its first row is
    looked up in ``users``, and no join has a repeated key.
    """
    valid = F.lit(True) if valid is None else valid
    claims = (batch.where(valid).groupBy("email").agg(F.min(order).alias(order)))
    first = (claims.join(users.select("email"), "email", "left_anti")
             .select(order, F.lit(True).alias("_first")))
    return (batch.join(first, order, "left")
            .withColumn("taken", F.coalesce(valid, F.lit(False)) & F.col("_first").isNull())
            .drop("_first").select(*batch.columns, "taken"))


def check_unique_except_self(changes: DataFrame, users: DataFrame,
                             valid: Column | None = None) -> DataFrame:
    """Adds ``taken``: another user has the e-mail, or a valid change of a smaller id wants it."""
    valid = F.lit(True) if valid is None else valid
    owners = users.groupBy("email").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    theirs = changes.join(owners, "email", "left").withColumn(
        "_owned", F.coalesce((F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id")),
                             F.lit(False)))
    first = (theirs.where(valid & ~F.col("_owned")).groupBy("email").agg(F.min("id").alias("id"))
             .select("id", F.lit(True).alias("_first")))
    return (theirs.join(first, "id", "left")
            .withColumn("taken", F.coalesce(valid, F.lit(False))
                        & (F.col("_owned") | F.col("_first").isNull()))
            .select(*changes.columns, "taken"))


def screen_breached(df: DataFrame, digests: DataFrame, name: str = "password") -> DataFrame:
    """Rows whose SHA-1 is in the supplied ``digest`` table; the password is not returned."""
    hashed = df.withColumn("digest", F.sha1(name)).drop(name, f"{name}_confirmation")
    return hashed.join(digests.select("digest"), "digest", "left_semi").drop("digest")


@dataclass(frozen=True)
class TableRules:
    """Constraints of one table."""

    table: str
    unique: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    max_length: dict[str, int] = field(default_factory=dict)


USER_RULES = TableRules("users", unique=[["id"], ["email"]], not_null=["id", "name", "email", "password"],
                        max_length={"name": S.STRING_LIMIT, "email": S.STRING_LIMIT,
                                    "password": S.STRING_LIMIT})
SESSION_RULES = TableRules("sessions", unique=[["id"]], not_null=["id", "payload", "last_activity"],
                           max_length={"id": S.STRING_LIMIT, "ip_address": S.IP_LIMIT})
FAILED_JOB_RULES = TableRules("failed_jobs", unique=[["id"], ["uuid"]],
                              not_null=["id", "uuid", "queue", "failed_at"],
                              max_length={"uuid": S.STRING_LIMIT})


def audit_constraints(df: DataFrame, rules: TableRules) -> DataFrame:
    """One row per constraint: (table, rule, violations).

    All row rules are counted in one pass; a unique rule counts the rows beyond the first.
    """
    counted = {f"not_null:{c}": F.count_if(F.col(c).isNull()) for c in rules.not_null}
    counted |= {f"max:{c}": F.count_if(F.length(c) > n) for c, n in rules.max_length.items()}
    parts = []
    if counted:
        row = df.agg(F.map_from_arrays(F.array(*[F.lit(k) for k in counted]),
                                       F.array(*counted.values())).alias("_m"))
        parts.append(row.select(F.explode("_m").alias("rule", "violations")))
    for columns in rules.unique:
        copies = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])) \
                   .groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        extra = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
        parts.append(copies.agg(extra.alias("violations"))
                     .select(F.lit(f"unique:{','.join(columns)}").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts).select(
        F.lit(rules.table).alias("table_name"), "rule", "violations")


def orphan_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions of users that no longer exist; guest sessions are no orphans."""
    owners = users.select(F.col("id").alias("user_id"))
    return sessions.where("user_id is not null").join(owners, "user_id", "left_anti") \
        .select(*sessions.columns)
