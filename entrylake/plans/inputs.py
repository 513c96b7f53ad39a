"""Input views over the given tables, written once for Spark and for DuckDB.

Every view reads its base tables whole. Names in braces are base tables; a view may use
other views by their plain name in the list ``needs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread_small

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_EMAIL = "lower(replace(c_name, '#', '.')) || '@example.com'"
_FENCE = "'```'"

VIEWS: dict[str, str] = {
    "users": f"""
select c_custkey as id, c_name as name, {_EMAIL} as email,
  case when c_custkey % 5 = 0 then null
       else timestamp '2024-01-01 00:00:00' + interval '1' minute * c_custkey end as email_verified_at,
  md5(c_name) as password,
  case when c_custkey % 3 = 0 then 'enc' end as two_factor_secret,
  case when c_custkey % 3 = 0 then '["code1","code2"]' end as two_factor_recovery_codes,
  case when c_custkey % 6 = 0 then timestamp '2024-01-02 00:00:00' end as two_factor_confirmed_at,
  substr(md5(c_name), 1, 10) as remember_token,
  timestamp '2024-01-01 00:00:00' as created_at, timestamp '2024-01-01 00:00:00' as updated_at
from {{customer}}""",
    "registrations": f"""
select c_custkey as seq, case when c_custkey % 28 = 3 then ' ' else c_name end as name,
  case when c_custkey % 36 = 3 then 'not-an-email'
       when c_custkey % 41 = 9 then ''
       when c_custkey % 5 = 0 then {_EMAIL}
       when c_custkey % 11 = 7 then 'twin.' || cast(c_custkey % 3 as string) || '@example.com'
       when c_custkey % 7 = 2 then 'NEW.' || cast(c_custkey as string) || '@Example.com'
       else 'new.' || cast(c_custkey as string) || '@example.com' end as email,
  case when c_custkey % 6 = 0 then 'short-1A' when c_custkey % 6 = 1 then 'no digits, no sign é'
       when c_custkey % 6 = 2 then 'only lower case 77' when c_custkey % 6 = 3 then 'NoSymbol123456'
       else 'Pw-' || c_name || '-9x' end as password,
  case when c_custkey % 6 > 3 and c_custkey % 52 = 4 then 'other'
       when c_custkey % 6 = 0 then 'short-1A' when c_custkey % 6 = 1 then 'no digits, no sign é'
       when c_custkey % 6 = 2 then 'only lower case 77' when c_custkey % 6 = 3 then 'NoSymbol123456'
       else 'Pw-' || c_name || '-9x' end as password_confirmation
from {{customer}}""",
    "profile_changes": f"""
select c_custkey as id,
  case when c_custkey % 33 = 4 then '' when c_custkey % 3 = 0 then c_name else 'New ' || c_name end as name,
  case when c_custkey % 21 = 0 then 'customer.000000001@example.com'
       when c_custkey % 14 = 0 then 'moved.' || cast(c_custkey as string) || '@example.com'
       when c_custkey % 25 = 3 then 'shared.' || cast(c_custkey % 4 as string) || '@example.com'
       else {_EMAIL} end as email
from {{customer}}""",
    "password_changes": """
select user_id as id, event_id as seq, md5('new' || cast(event_id as string)) as password
from {events} where event_type = 'error'""",
    "leavers": "select distinct user_id as id from {events} where event_type = 'signup' and value > 50",
    "digests": "select sha1('Pw-' || c_name || '-9x') as digest from {customer} where c_mktsegment = 'BUILDING'",
    "verification_clicks": f"""
select e.event_id, case when e.event_id % 13 = 0 then -1 else c.c_custkey end as id,
  case when e.event_id % 10 = 0 then sha1('wrong-email') else sha1({_EMAIL}) end as hash,
  e.ts, e.ts - interval '1' minute * (e.event_id % 90) as issued_at
from {{events}} e join {{customer}} c on e.user_id = c.c_custkey""",
    "attempts": """
select event_id, ts,
  case when user_id % 7 = 5 then 'nobody@example.com'
       when event_id % 2 = 0 then upper('customer.00000000' || cast(user_id % 7 as string) || '@example.com')
       else 'customer.00000000' || cast(user_id % 7 as string) || '@example.com' end as email,
  '127.0.0.1' as ip, event_type <> 'error' as password_ok
from {events}""",
    "sessions": """
select 's' || cast(event_id as string) as id, case when event_id % 11 = 0 then null else user_id end as user_id,
  '10.0.0.' || cast(user_id % 250 as string) as ip_address, 'agent-' || event_type as user_agent,
  props as payload, 1704067200 + event_id * 259 as last_activity
from {events}""",
    "cache": """
select 'k' || cast(user_id % 50 as string) as key, props as value,
  1704067200 + event_id * 259 as expiration, event_id as seq,
  case when event_type = 'error' then 'delete' else 'put' end as op
from {events}""",
    "cache_base": """
select 'k' || cast(c_custkey as string) as key, c_name as value,
  1704067200 + c_custkey as expiration, c_custkey * 7 as seq
from {customer}""",
    "jobs": """
select event_id as id, event_type as queue, props as payload, cast(event_id % 4 as int) as attempts,
  case when event_id % 4 = 1 then 1704067200 + event_id * 259 end as reserved_at,
  1704067200 + event_id * 259 + (event_id % 3) * 600 as available_at,
  1704067200 + event_id * 259 as created_at
from {events}""",
    "batch_members": """
select o_custkey as batch_id, o_orderkey as job_id,
  case o_orderstatus when 'F' then 'finished' when 'O' then 'pending' else 'failed' end as status
from {orders}""",
    "failed_jobs": """
select event_id as id, md5(cast(event_id as string)) as uuid, 'q' || cast(user_id % 5 as string) as queue,
  props as exception, ts as failed_at
from {events} where event_type = 'error'""",
    "confirmations": """
select event_id, user_id % 7 as account, ts, md5(cast(user_id % 7 as string)) as token
from {events} where event_type = 'signup'""",
    "actions": """
select event_id, user_id % 7 as account, ts,
  case when event_id % 4 = 0 then 'invalid-token' else md5(cast(user_id % 7 as string)) end as token
from {events} where event_type = 'purchase'""",
    "entries": """
select d.doc_id as id, d.text as body, d.source as category,
  split(d.lang || ',' || case when l.quality = 1 then 'good' when l.quality = 0 then 'poor' else 'unrated' end,
        ',') as tags, d.n_chars
from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    "described_entries": """
select doc_id as id, case when doc_id % 13 = 5 then null when doc_id % 17 = 4 then 'no json'
  else chr(123) || '"lang": "' || lang || '", ' || case when doc_id % 3 = 0 then '"reviewed": null, ' else '' end
       || '"thousands": ' || cast((n_chars - n_chars % 1000) / 1000 as int) || ', "source": "' || source || '"' || chr(125) end as metadata
from {documents}""",
    "raw_entries": """
select doc_id as id, case when doc_id % 17 = 3 then ' ' else text end as body, source as category,
  split(upper(lang) || ',' || source || ', ' || lang || ' ,', ',') as tags
from {documents}""",
    "entry_changes": """
select l.doc_id as id, 'changed ' || d.text as body, 'rated' as category, l.doc_id as seq,
  case when l.toxic = 1 then 'delete' else 'update' end as op
from {labels} l join {documents} d on l.doc_id = d.doc_id
union all
select 1000000 + page_id as id, html as body, 'page' as category, page_id as seq, 'create' as op from {pages}""",
    "wanted": "select doc_id as id from {labels} where quality = 1",
    "embedded": """
select doc_id as entry_id,
  case when doc_id % 9 = 4 then 'outdated' else {sha256} end as content_hash
from {documents} where source <> 'src3'""",
    "markdown": f"""
select doc_id as id, case
  when doc_id % 5 = 0 then text
  when doc_id % 5 = 1 then '# ' || source || chr(10) || {_FENCE} || lang || chr(10) || text || chr(10) || {_FENCE} || chr(10) || 'end'
  when doc_id % 5 = 2 then {_FENCE} || chr(10) || text || chr(10) || {_FENCE} || chr(10) || 'see [x](http://h/' || source
       || ') and' || chr(10) || {_FENCE} || 'sql' || chr(10) || 'select ' || cast(doc_id as string) || chr(10) || {_FENCE}
  when doc_id % 5 = 3 then 'open' || chr(10) || {_FENCE} || lang || chr(10) || text
  else text || ' [a](/p/' || cast(doc_id as string) || ') ![image](/i.png) [b](https://h/' || lang || ')' end as body
from {{documents}}""",
    "queries": "select item_id as q_id, text from {benchmark}",
    "agent_log": "select conv_id, turn, text from {conversations} where role = 'user'",
    "resources": "select page_id, url, html from {pages}",
}

# Functions and literals that the two engines spell differently.
_SPARK = {"sha256": "sha2(text, 256)"}
_DUCK = {"sha256": "sha256(text)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, name))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; timestamps carry no zone, as in the base tables."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in VIEWS[name]}
    text = VIEWS[name].replace("timestamp '", "timestamp_ntz '")
    for key, value in _SPARK.items():
        text = text.replace(f"{{{key}}}", value)
    return spark.sql(text, **used)


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """DuckDB text of a query over views, given as a WITH clause."""
    parts = []
    for name in names.split():
        text = VIEWS[name]
        for t in TABLES:
            text = text.replace(f"{{{t}}}", t)
        for key, value in _DUCK.items():
            text = text.replace(f"{{{key}}}", value)
        parts.append(f"{name} as ({text.strip()})")
    if body.lstrip().startswith("--more"):
        first, body = body.replace("--more", "", 1).strip(), ""
        parts.append(first)
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n" + body
