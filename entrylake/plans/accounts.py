"""Registered queries: table files, accounts, validation, changes of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..operators import digests as G, mutations as M, quality as Q, users as U
from ..session import work_dir
from ..sources import keyed as T
from ..sources.generate import users_for
from ..sources.tables import evolve, read_snapshot, read_table, write_snapshot
from .inputs import table, view, with_views

_NOW_SQL = "timestamp '2024-06-01 00:00:00'"


def _now() -> Column:
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the base tables have them."""
    return df.select([F.col(f.name).cast("timestamp_ntz").alias(f.name)
                      if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema.fields])


def _read_table(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "customer").schema
    return read_table(spark, d, "customer.parquet", schema)


def _write_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of the users: all, then without those who left; reads the last one."""
    root = work_dir(spark, "snapshots")
    write_snapshot(view(spark, d, "users"), root, "users")
    left = M.delete_users(read_snapshot(spark, root, "users"), view(spark, d, "leavers"))
    write_snapshot(left, root, "users", sort_by=["id"])
    return read_snapshot(spark, root, "users")


def _evolved(spark: SparkSession, d: str) -> DataFrame:
    return _plain(evolve(evolve(view(spark, d, "users"), S.USERS_V1), S.USERS))


def _generated(spark: SparkSession, d: str) -> DataFrame:
    made = users_for(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 20, 30)
    return made.select("id", "name", "email", "remember_token",
                       F.col("email_verified_at").isNull().alias("unverified"),
                       F.col("two_factor_confirmed_at").isNotNull().alias("two_factor"))


def _cast(spark: SparkSession, d: str) -> DataFrame:
    users = view(spark, d, "users")
    raw = users.select("id", F.col("email_verified_at").cast("string").alias("email_verified_at"),
                       F.col("two_factor_confirmed_at").cast("string").alias("two_factor_confirmed_at"))
    return _plain(U.cast_users(raw))


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    attempts = view(spark, d, "attempts").select("event_id", "email")
    return U.lookup_users(attempts, view(spark, d, "users")).select("event_id", "email", "user_id")


def _taken(spark: SparkSession, d: str) -> DataFrame:
    batch = Q.validate_profile(view(spark, d, "registrations"))
    return Q.check_unique(batch, view(spark, d, "users"), F.col("violations") == "").select("seq", "taken")


def _taken_update(spark: SparkSession, d: str) -> DataFrame:
    changes = Q.validate_profile(view(spark, d, "profile_changes"))
    return Q.check_unique_except_self(changes, view(spark, d, "users"), F.col("violations") == "") \
        .select("id", "taken")


def _register(spark: SparkSession, d: str) -> M.Registered:
    return M.register(view(spark, d, "users"), view(spark, d, "registrations"), _now())


def _verify(spark: SparkSession, d: str) -> M.Verified:
    return M.apply_verifications(view(spark, d, "users"), view(spark, d, "verification_clicks"))


def _worklist(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("id"))
    return M.verification_worklist(requests, view(spark, d, "users"))


def _screen_stored(spark: SparkSession, d: str) -> DataFrame:
    """The screen of ``screen_breached``, from stored digests behind a filter."""
    root = work_dir(spark, "digests")
    G.digests_save(view(spark, d, "digests"), root, "breached")
    return G.screen_breached_stored(view(spark, d, "registrations"), root, "breached").select("seq", "email")


def _upsert_keyed(spark: SparkSession, d: str) -> DataFrame:
    """The upsert of ``upsert_cache``, which writes the buckets of the changed keys only."""
    root = work_dir(spark, "keyed")
    T.keyed_create(view(spark, d, "cache_base"), root, "cache", ["key"], buckets=64)
    T.keyed_apply(spark, root, "cache", view(spark, d, "cache"), lambda rows, changes, keys: M.upsert(rows, changes, keys, "seq", "op"))
    return T.keyed_read(spark, root, "cache")


QUERIES = {
    "read_table": _read_table,
    "write_snapshot": _write_snapshot,
    "evolve_schema": _evolved,
    "generate_users": _generated,
    "fillable": lambda s, d: U.fillable(view(s, d, "registrations")),
    "public_users": lambda s, d: U.public_users(view(s, d, "users")),
    "export_users": lambda s, d: U.export_users(view(s, d, "users")),
    "cast_users": _cast,
    "verified_users": lambda s, d: U.verified(view(s, d, "users")).select("id", "email_verified_at"),
    "unverified_users": lambda s, d: U.unverified(view(s, d, "users")).select("id", "email"),
    "two_factor_users": lambda s, d: U.two_factor_enabled(view(s, d, "users")).select("id", "email"),
    "lookup_users": _lookup,
    "login_outcomes": lambda s, d: U.login_outcomes(view(s, d, "attempts"), view(s, d, "users"), seconds=21600),
    "path_rollup": lambda s, d: U.path_rollup(table(s, d, "pages")),
    "validate_profile": lambda s, d: Q.validate_profile(view(s, d, "registrations")).select("seq", "violations"),
    "check_unique": _taken,
    "check_unique_except_self": _taken_update,
    "check_confirmed": lambda s, d: Q.check_confirmed(view(s, d, "registrations"), "password")
    .select("seq", "violations"),
    "audit_users": lambda s, d: Q.audit_constraints(
        view(s, d, "registrations").withColumnRenamed("seq", "id"), Q.USER_RULES),
    "audit_sessions": lambda s, d: Q.audit_constraints(view(s, d, "sessions"), Q.SESSION_RULES),
    "audit_failed_jobs": lambda s, d: Q.audit_constraints(view(s, d, "failed_jobs"), Q.FAILED_JOB_RULES),
    "orphan_sessions": lambda s, d: Q.orphan_sessions(
        view(s, d, "sessions"), M.delete_users(view(s, d, "users"), view(s, d, "leavers"))),
    "audit_password_policy": lambda s, d: Q.audit_password_policy(view(s, d, "registrations"), "production")
    .select("seq", "violations"),
    "screen_breached": lambda s, d: Q.screen_breached(view(s, d, "registrations"), view(s, d, "digests"))
    .select("seq", "email"),
    "screen_breached_stored": _screen_stored,
    "register_users": lambda s, d: _register(s, d).users,
    "register_rejects": lambda s, d: _register(s, d).rejects,
    "update_profiles": lambda s, d: M.update_profiles(view(s, d, "users"), view(s, d, "profile_changes"), _now()),
    "overwrite_password": lambda s, d: M.overwrite_column(
        view(s, d, "users"), view(s, d, "password_changes"), "password", "seq").select("id", "password"),
    "delete_users": lambda s, d: M.delete_users(view(s, d, "users"), view(s, d, "leavers")).select("id", "email"),
    "verify_emails": lambda s, d: _verify(s, d).users.select("id", "email_verified_at"),
    "verification_events": lambda s, d: _verify(s, d).events,
    "verification_worklist": _worklist,
    "upsert_keyed": _upsert_keyed,
    "upsert_cache": lambda s, d: M.upsert(view(s, d, "cache_base"), view(s, d, "cache"), ["key"], "seq", "op"),
}

# Parts of the SQL that several checks share.
_MAIL = r"'^[^\s@.]+(\.[^\s@.]+)*@[^\s@.]+(\.[^\s@.]+)*$'"
_PROFILE = f"""concat_ws(',', case when trim(name) = '' then 'name.required' end,
  case when length(name) > 255 then 'name.max' end,
  case when trim(email) = '' then 'email.required' end,
  case when trim(email) <> '' and not regexp_matches(email, {_MAIL}) then 'email.email' end,
  case when length(email) > 255 then 'email.max' end)"""
_JUDGED = f"""--more
batch as (select seq, name, lower(email) as email, password, password_confirmation from registrations),
checked as (select *, concat_ws(',', nullif({_PROFILE}, ''),
    case when password is distinct from password_confirmation then 'password.confirmed' end) as broken from batch),
ranked as (select *, row_number() over (partition by email, broken = '' order by seq) as place from checked),
judged as (select *, case when broken <> '' then broken
    when place > 1 or email in (select email from users) then 'email.unique' else '' end as violations from ranked)
"""
_CHANGES = f"""--more
checked as (select *, {_PROFILE} as broken from profile_changes),
owned as (select c.*, exists (select 1 from users u where u.email = c.email and u.id <> c.id) as owned from checked c),
ranked as (select *, row_number() over (partition by email, broken = '' and not owned order by id) as place from owned),
judged as (select *, broken = '' and (owned or place > 1) as taken from ranked)
"""
_VERIFY = """--more
good as (select u.id, c.ts, c.event_id from verification_clicks c join users u on c.id = u.id
  where u.email_verified_at is null and c.hash = sha1(u.email) and c.ts <= c.issued_at + interval 60 minute),
firsts as (select id, ts as verified_at, event_id from good
  qualify row_number() over (partition by id order by ts, event_id) = 1)
"""
_DRAW = "('0x' || substr(md5(c_custkey::varchar || '{}'), 1, 8))::bigint % 100"
_TS = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g')"

SQL = {
    "read_table": "select * from customer",
    "write_snapshot": with_views("users leavers", "select * from users where id not in (select id from leavers)"),
    "evolve_schema": with_views("users", """
select id, name, email, email_verified_at, password, null::varchar as two_factor_secret,
  null::varchar as two_factor_recovery_codes, null::timestamp as two_factor_confirmed_at,
  remember_token, created_at, updated_at from users"""),
    "generate_users": f"""
select c_custkey as id, 'User ' || c_custkey as name, 'user.' || c_custkey || '@example.com' as email,
  substr(md5(c_custkey::varchar), 1, 10) as remember_token,
  {_DRAW.format('unverified')} < 20 as unverified, {_DRAW.format('two-factor')} < 30 as two_factor
from customer""",
    "fillable": with_views("registrations", "select name, email, password from registrations"),
    "public_users": with_views("users", """
select id, name, email, email_verified_at, two_factor_confirmed_at, created_at, updated_at,
  upper(case when name like '% %' then name[1] || split_part(name, ' ', -1)[1] else name[1] end) as initials
from users"""),
    "export_users": with_views("users", f"""
select id, '{{"id":' || id || ',"name":"' || name || '","email":"' || email || '"'
  || coalesce(',"email_verified_at":"' || {_TS.format('email_verified_at')} || '"', '')
  || coalesce(',"two_factor_confirmed_at":"' || {_TS.format('two_factor_confirmed_at')} || '"', '')
  || ',"created_at":"' || {_TS.format('created_at')} || '","updated_at":"' || {_TS.format('updated_at')}
  || '"}}' as json from users"""),
    "cast_users": with_views("users", "select id, email_verified_at, two_factor_confirmed_at from users"),
    "verified_users": with_views("users", "select id, email_verified_at from users where email_verified_at is not null"),
    "unverified_users": with_views("users", "select id, email from users where email_verified_at is null"),
    "two_factor_users": with_views("users", """
select id, email from users where two_factor_secret is not null and two_factor_confirmed_at is not null"""),
    "lookup_users": with_views("users attempts", """
select a.event_id, a.email, u.id as user_id from attempts a left join users u on lower(a.email) = lower(u.email)"""),
    "path_rollup": """
select path, count(*) as pages from (
  select case when url not like 'http%' then url
    else coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') end as path from pages)
group by path""",
    "validate_profile": with_views("registrations", f"select seq, {_PROFILE} as violations from registrations"),
    "check_unique": with_views("users registrations", f"""--more
checked as (select *, {_PROFILE} = '' as valid from registrations),
ranked as (select *, row_number() over (partition by email, valid order by seq) as place from checked)
select seq, valid and (place > 1 or email in (select email from users)) as taken from ranked"""),
    "check_unique_except_self": with_views("users profile_changes", _CHANGES + "select id, taken from judged"),
    "check_confirmed": with_views("registrations", """
select seq, case when password is distinct from password_confirmation then 'password.confirmed' else '' end
  as violations from registrations"""),
    "audit_users": with_views("registrations", """
select 'users' as table_name, 'not_null:id' as rule, count(*) filter (where seq is null) as violations from registrations
union all select 'users', 'not_null:name', count(*) filter (where name is null) from registrations
union all select 'users', 'not_null:email', count(*) filter (where email is null) from registrations
union all select 'users', 'not_null:password', count(*) filter (where password is null) from registrations
union all select 'users', 'max:name', count(*) filter (where length(name) > 255) from registrations
union all select 'users', 'max:email', count(*) filter (where length(email) > 255) from registrations
union all select 'users', 'max:password', count(*) filter (where length(password) > 255) from registrations
union all select 'users', 'unique:id', count(seq) - count(distinct seq) from registrations
union all select 'users', 'unique:email', count(email) - count(distinct email) from registrations"""),
    "audit_sessions": with_views("sessions", """
select 'sessions' as table_name, 'not_null:id' as rule, count(*) filter (where id is null) as violations from sessions
union all select 'sessions', 'not_null:payload', count(*) filter (where payload is null) from sessions
union all select 'sessions', 'not_null:last_activity', count(*) filter (where last_activity is null) from sessions
union all select 'sessions', 'max:id', count(*) filter (where length(id) > 255) from sessions
union all select 'sessions', 'max:ip_address', count(*) filter (where length(ip_address) > 45) from sessions
union all select 'sessions', 'unique:id', count(id) - count(distinct id) from sessions"""),
    "audit_failed_jobs": with_views("failed_jobs", """
select 'failed_jobs' as table_name, 'not_null:id' as rule, count(*) filter (where id is null) as violations from failed_jobs
union all select 'failed_jobs', 'not_null:uuid', count(*) filter (where uuid is null) from failed_jobs
union all select 'failed_jobs', 'not_null:queue', count(*) filter (where queue is null) from failed_jobs
union all select 'failed_jobs', 'not_null:failed_at', count(*) filter (where failed_at is null) from failed_jobs
union all select 'failed_jobs', 'max:uuid', count(*) filter (where length(uuid) > 255) from failed_jobs
union all select 'failed_jobs', 'unique:id', count(id) - count(distinct id) from failed_jobs
union all select 'failed_jobs', 'unique:uuid', count(uuid) - count(distinct uuid) from failed_jobs"""),
    "orphan_sessions": with_views("users leavers sessions", """
select * from sessions s where s.user_id is not null
  and not exists (select 1 from users u where u.id = s.user_id and u.id not in (select id from leavers))"""),
    "audit_password_policy": with_views("registrations", r"""
select seq, concat_ws(',', case when length(password) < 12 then 'password.min' end,
  case when not (regexp_matches(password, '\p{Lu}') and regexp_matches(password, '\p{Ll}')) then 'password.mixed' end,
  case when not regexp_matches(password, '\p{L}') then 'password.letters' end,
  case when not regexp_matches(password, '\p{N}') then 'password.numbers' end,
  case when not regexp_matches(password, '[\p{Z}\p{S}\p{P}]') then 'password.symbols' end) as violations
from registrations"""),
    "screen_breached": with_views("registrations digests", """
select seq, email from registrations where sha1(password) in (select digest from digests)"""),
    "screen_breached_stored": with_views("registrations digests", """
select seq, email from registrations where sha1(password) in (select digest from digests)"""),
    "register_users": with_views("users registrations", _JUDGED + f"""
select * from users union all
select (select max(id) from users) + row_number() over (order by seq), name, email, null, sha256(password),
  null, null, null, null, {_NOW_SQL}, {_NOW_SQL} from judged where violations = ''"""),
    "register_rejects": with_views("users registrations", _JUDGED
                                   + "select seq, violations from judged where violations <> ''"),
    "update_profiles": with_views("users profile_changes", _CHANGES + f"""
select u.id, coalesce(j.name, u.name) as name, coalesce(j.email, u.email) as email,
  case when j.email is null or j.email = u.email then u.email_verified_at end as email_verified_at,
  u.password, u.two_factor_secret, u.two_factor_recovery_codes, u.two_factor_confirmed_at, u.remember_token,
  u.created_at, case when j.email <> u.email or j.name <> u.name then {_NOW_SQL} else u.updated_at end as updated_at
from users u left join judged j on u.id = j.id and j.broken = '' and not j.taken"""),
    "overwrite_password": with_views("users password_changes", """
select u.id, coalesce(c.password, u.password) as password from users u left join (
  select id, password from password_changes qualify row_number() over (partition by id order by seq desc) = 1) c
  on u.id = c.id"""),
    "delete_users": with_views("users leavers",
                               "select id, email from users where id not in (select id from leavers)"),
    "verify_emails": with_views("users verification_clicks", _VERIFY + """
select u.id, coalesce(u.email_verified_at, f.verified_at) as email_verified_at
from users u left join firsts f on u.id = f.id"""),
    "verification_events": with_views("users verification_clicks", _VERIFY + "select * from firsts"),
    "verification_worklist": with_views("users", """
select id, email from users where email_verified_at is null
  and id in (select user_id from events where event_type = 'signup')"""),
    "upsert_keyed": with_views("cache_base cache", """
select key, value, expiration, seq from (
  select *, 0 as side, 'put' as op from cache_base union all by name select *, 1 as side from cache)
qualify row_number() over (partition by key order by seq desc, side desc) = 1 and op <> 'delete'"""),
    "upsert_cache": with_views("cache_base cache", """
select key, value, expiration, seq from (
  select *, 0 as side, 'put' as op from cache_base union all by name select *, 1 as side from cache)
qualify row_number() over (partition by key order by seq desc, side desc) = 1 and op <> 'delete'"""),
}
