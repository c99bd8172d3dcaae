"""Session, account and throttle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelegate.operators import accounts as A
from allelegate.operators import merge as G
from allelegate.operators.throttle import throttle_attempts
from allelegate.plans.fixtures import view
from allelegate.queries import query

NOW = "2024-01-31 06:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


SESSIONS = f"""
    newest as (select user_id, arg_max(token, ts) as token, max(ts) as ts from fx_logins group by user_id),
    live as (select * from fx_sessions where expires_at > timestamp '{NOW}'),
    merged as (
      select coalesce(t.user_id, n.user_id) as user_id,
        coalesce(t.id, md5(concat_ws('|', 'session', cast(n.user_id as varchar)))) as id,
        coalesce(sha256(n.token), t.token_hash) as token_hash,
        coalesce(n.ts + interval 12 hour, t.expires_at) as expires_at, coalesce(n.ts, t.created_at) as created_at
      from live t full join newest n on n.user_id = t.user_id),
    current_sessions as (select * from merged where expires_at > timestamp '{NOW}')"""


def sessions(spark, sf):
    return G.upsert_sessions(view(spark, sf, "fx_sessions"), view(spark, sf, "fx_logins"), now())


@query("current_sessions", f"with {SESSIONS} select * from current_sessions")
def current_sessions(spark, sf):
    return sessions(spark, sf)


@query("unexpired", f"select * from fx_sessions where expires_at > timestamp '{NOW}'")
def unexpired(spark, sf):
    return G.unexpired(view(spark, sf, "fx_sessions"), now())


ACCOUNTS = """
    accounts as (
      select u.id as user_id, u.email, p.id as patient_id, p.first_name
      from fx_users u join (select *, row_number() over (partition by user_id order by created_at, id) as rn
        from fx_patients) p on p.user_id = u.id and p.rn = 1)"""


@query("account_patient", f"with {ACCOUNTS} select * from accounts")
def account_patient(spark, sf):
    return A.account_patient(view(spark, sf, "fx_users"), view(spark, sf, "fx_patients"))


@query(
    "session_account",
    f"""with {SESSIONS}, {ACCOUNTS} select a.*, s.token_hash, s.expires_at
        from current_sessions s join accounts a on a.user_id = s.user_id""",
)
def session_account(spark, sf):
    return A.session_account(sessions(spark, sf), view(spark, sf, "fx_users"), view(spark, sf, "fx_patients"), now())


@query(
    "exists_lookup",
    """select r.*, m.id is not null as has_medication_id, p.id is not null as has_patient_id
        from fx_requests r left join fx_meds m on m.id = r.medication_id left join fx_patients p on p.id = r.patient_id""",
)
def exists_lookup(spark, sf):
    return A.exists_lookup(
        view(spark, sf, "fx_requests"),
        {"medication_id": view(spark, sf, "fx_meds"), "patient_id": view(spark, sf, "fx_patients")},
    )


THROTTLE = """
    with recursive a as (
      select event_id, subject, ts, row_number() over (partition by subject order by ts, event_id) as n from fx_attempts),
    w as (
      select subject, min(ts) as start from a group by subject
      union all
      select w.subject, (select min(a.ts) from a where a.subject = w.subject and a.ts >= w.start + interval 10 day)
      from w where exists (select 1 from a where a.subject = w.subject and a.ts >= w.start + interval 10 day)),
    held as (
      select a.event_id, a.subject, a.ts, a.n, max(w.start) as window_start
      from a join w on w.subject = a.subject and w.start <= a.ts group by all)
    select event_id, subject, ts, window_start,
      row_number() over (partition by subject, window_start order by n) as attempt_no,
      row_number() over (partition by subject, window_start order by n) > 3 as throttled
    from held"""


@query("throttle_attempts", THROTTLE)
def throttle(spark, sf):
    return throttle_attempts(
        view(spark, sf, "fx_attempts"), "subject", "ts", ["event_id"], window_seconds=10 * 24 * 3600, maximum=3
    )
