"""Registered queries: rate limits, as-of lookups, sessions, expiry, queue rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..operators import queues as J, temporal as T, users as U
from .inputs import table, view, with_views

_COLUMNS = ["event_id", "n", "allowed"]


def _two_factor(spark: SparkSession, d: str) -> DataFrame:
    """Challenges of users with two-factor on, limited by the pending login's user."""
    users = U.two_factor_enabled(view(spark, d, "users"))
    attempts = view(spark, d, "attempts").select("event_id", "ts", "email")
    pending = U.lookup_users(attempts, users).where("user_id is not null").drop("email")
    return T.rate_limit(pending, "user_id", "ts", "event_id", S.TWO_FACTOR_LIMIT,
                        S.TWO_FACTOR_SECONDS).select(*_COLUMNS)


def _password(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts", "user_id")
    return T.rate_limit(events, "user_id", "ts", "event_id", S.PASSWORD_LIMIT, S.PASSWORD_SECONDS).select(*_COLUMNS)


def _login(spark: SparkSession, d: str) -> DataFrame:
    events = view(spark, d, "attempts").select("event_id", "ts", "email", "ip")
    return T.login_limits(events).select(*_COLUMNS)


def _six_hours(spark: SparkSession, d: str) -> DataFrame:
    events = view(spark, d, "attempts").select("event_id", "ts", "email", "ip")
    return T.login_limits(events, seconds=21600).select(*_COLUMNS)


def _throttle(spark: SparkSession, d: str) -> DataFrame:
    events = view(spark, d, "attempts").select("event_id", "ts", F.lower("email").alias("email"))
    return T.token_throttle(events, "email", "ts", "event_id").select(*_COLUMNS)


def _rate_count(spark: SparkSession, d: str) -> DataFrame:
    return T.rate_count(view(spark, d, "attempts"), F.lower("email"), "ts").select(
        "key", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    return T.fresh_confirmation(view(spark, d, "actions"), view(spark, d, "confirmations"),
                                "account", "ts", "event_id").select("event_id", "fresh")


def _redeem(spark: SparkSession, d: str) -> DataFrame:
    return T.redeem_tokens(view(spark, d, "actions"), view(spark, d, "confirmations"),
                           "account", "ts", "event_id").select("event_id", "outcome")


def _latest(df: DataFrame, column: str) -> int:
    """The report time: the newest moment in the log."""
    return df.agg(F.max(column)).first()[0] or 0


def _status(spark: SparkSession, d: str) -> DataFrame:
    sessions = view(spark, d, "sessions")
    return T.session_status(sessions, _latest(sessions, "last_activity"))


def _live(spark: SparkSession, d: str) -> DataFrame:
    sessions = view(spark, d, "sessions")
    return T.live_sessions(sessions, _latest(sessions, "last_activity")).select("id", "user_id")


def _middle(df: DataFrame, column: str) -> int:
    low, high = df.agg(F.min(column), F.max(column)).first()
    return ((low or 0) + (high or 0)) // 2


def _retained(spark: SparkSession, d: str) -> DataFrame:
    cache = view(spark, d, "cache")
    return T.retain_live(cache, "expiration", _middle(cache, "expiration")).select("key", "seq", "expiration")


def _expired(spark: SparkSession, d: str) -> DataFrame:
    cache = view(spark, d, "cache")
    return T.expired_counts(cache, "expiration", _middle(cache, "expiration"), F.substring("key", 1, 2))


def _backlog(spark: SparkSession, d: str) -> DataFrame:
    jobs = view(spark, d, "jobs")
    return J.queue_backlog(jobs, _latest(jobs, "created_at"))


def _waiting(spark: SparkSession, d: str) -> DataFrame:
    jobs = view(spark, d, "jobs")
    return J.oldest_waiting(jobs, _latest(jobs, "created_at"), 3)


def _sessionize(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return T.sessionize(events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")


QUERIES = {
    "rate_limit_login": _login,
    "rate_limit_two_factor": _two_factor,
    "rate_limit_password": _password,
    "rate_limit_six_hours": _six_hours,
    "token_throttle": _throttle,
    "rate_count": _rate_count,
    "redeem_tokens": _redeem,
    "fresh_confirmation": _fresh,
    "session_status": _status,
    "live_sessions": _live,
    "sessionize": _sessionize,
    "retain_live": _retained,
    "expired_counts": _expired,
    "queue_backlog": _backlog,
    "oldest_waiting": _waiting,
    "batch_progress": lambda s, d: J.batch_progress(view(s, d, "batch_members")),
    "batch_failed_members": lambda s, d: J.failed_members(view(s, d, "batch_members")),
    "failed_rollup": lambda s, d: J.failed_rollup(view(s, d, "failed_jobs")),
    "latest_failure": lambda s, d: J.latest_failure(view(s, d, "failed_jobs")),
}


def limiter_sql(key: str, limit: int, seconds: int, tail: str, views: str = "attempts",
                source: str = "attempts") -> str:
    """A replay of the limiter, one event per step and key."""
    return with_views(views, f"""--more
ev as (select event_id, ts, {key} as key,
    row_number() over (partition by {key} order by ts, event_id) as rn from {source}),
replay as (
  select event_id, key, rn, ts as start, 1 as hit from ev where rn = 1
  union all
  select e.event_id, e.key, e.rn, case when e.ts >= r.start + interval {seconds} second then e.ts else r.start end,
    case when e.ts >= r.start + interval {seconds} second then 1 else r.hit + 1 end
  from replay r join ev e on e.key = r.key and e.rn = r.rn + 1),
limited as (select event_id, hit::bigint as n, hit <= {limit} as allowed from replay)
{tail}""", recursive=True)


_LOGIN_KEY = "strip_accents(lower(email)) || '|' || ip"
_ALL = "select event_id, n, allowed from limited"
_ASOF = """--more
joined as (select a.event_id, a.ts, a.token, c.ts as seen, c.token as issued from actions a left join lateral (
  select ts, token from confirmations c where c.account = a.account and c.ts <= a.ts
  order by ts desc, event_id desc limit 1) c on true)
"""

SQL = {
    "login_outcomes": limiter_sql(_LOGIN_KEY, 5, 21600, """
select l.event_id, u.id as user_id, l.n, case when not l.allowed then 'limited' when u.id is null then 'unknown'
    when not a.password_ok then 'bad_password'
    when u.two_factor_secret is not null and u.two_factor_confirmed_at is not null then 'two_factor' else 'ok' end as outcome
from limited l join attempts a using (event_id) left join users u on lower(a.email) = lower(u.email)""",
                                  "users attempts"),
    "rate_limit_login": limiter_sql(_LOGIN_KEY, 5, 60, _ALL),
    "rate_limit_two_factor": limiter_sql("login_id", 5, 60, _ALL, "users attempts", """(
      select a.event_id, a.ts, u.id as login_id from attempts a join users u on lower(a.email) = lower(u.email)
      where u.two_factor_secret is not null and u.two_factor_confirmed_at is not null)"""),
    "rate_limit_password": limiter_sql("user_id", 6, 60, _ALL, "", "events"),
    "rate_limit_six_hours": limiter_sql(_LOGIN_KEY, 5, 21600, _ALL),
    "token_throttle": limiter_sql("lower(email)", 1, 60, _ALL),
    "rate_count": with_views("attempts", """
select lower(email) as key, date_trunc('minute', ts) as window_start, count(*) as n from attempts group by all"""),
    "redeem_tokens": with_views("confirmations actions", _ASOF + """
select event_id, case when seen is null then 'no_token' when token <> issued then 'invalid'
  when ts > seen + interval 3600 second then 'expired' else 'ok' end as outcome from joined"""),
    "fresh_confirmation": with_views("confirmations actions", _ASOF + """
select event_id, coalesce(ts <= seen + interval 10800 second, false) as fresh from joined"""),
    "session_status": with_views("sessions", """
select user_id, count(*) filter (where last_activity + 7200 >= now) as live,
  count(*) filter (where last_activity + 7200 < now) as expired, max(last_activity) as last_activity
from sessions, (select max(last_activity) as now from sessions) group by user_id"""),
    "live_sessions": with_views("sessions", """
select id, user_id from sessions where last_activity + 7200 >= (select max(last_activity) from sessions)"""),
    "sessionize": """
select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from (
  select *, sum(new) over (partition by user_id order by ts, event_id) as run from (
    select user_id, ts, event_id, case when ts < lag(ts) over (partition by user_id order by ts, event_id)
      + interval 120 minute then 0 else 1 end as new from events))
group by user_id, run""",
    "retain_live": with_views("cache", """
select key, seq, expiration from cache
where expiration > (select (min(expiration) + max(expiration)) // 2 from cache)"""),
    "expired_counts": with_views("cache", """
select substr(key, 1, 2) as prefix, count(*) as expired from cache
where expiration <= (select (min(expiration) + max(expiration)) // 2 from cache) group by prefix"""),
    "queue_backlog": with_views("jobs", """--more
stated as (select *, case when reserved_at < now - 90 then 'stale' when reserved_at is not null then 'reserved'
  when available_at > now then 'delayed' else 'ready' end as state
  from jobs, (select max(created_at) as now from jobs))
select queue, count(*) filter (where state = 'ready') as ready, count(*) filter (where state = 'delayed') as delayed,
  count(*) filter (where state = 'reserved') as reserved, count(*) filter (where state = 'stale') as stale,
  max(now) - min(created_at) as oldest_age from stated group by queue"""),
    "oldest_waiting": with_views("jobs", """
select queue, id, created_at, (row_number() over (partition by queue order by id))::int as rnk from jobs
where reserved_at is null and available_at <= (select max(created_at) from jobs) qualify rnk <= 3"""),
    "batch_progress": with_views("batch_members", """
select batch_id, count(*) as total_jobs, count(*) filter (where status = 'pending') as pending_jobs,
  count(*) filter (where status = 'failed') as failed_jobs,
  floor((count(*) - count(*) filter (where status = 'pending')) * 100 / count(*))::bigint as percent,
  case when count(*) filter (where status = 'pending') > 0 then 'running'
    when count(*) filter (where status = 'failed') > 0 then 'failed' else 'finished' end as status
from batch_members group by batch_id"""),
    "batch_failed_members": with_views("batch_members", """
select batch_id, job_id as failed_job_id from batch_members where status = 'failed'"""),
    "failed_rollup": with_views("failed_jobs", """
select queue, failed_at::date as day, count(*) as failures from failed_jobs group by all"""),
    "latest_failure": with_views("failed_jobs", """
select queue, count(*) over (partition by queue) as failures, uuid, failed_at from failed_jobs
qualify row_number() over (partition by queue order by failed_at desc, id desc) = 1"""),
}
