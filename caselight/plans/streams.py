"""Queries that run the streams over all of the events, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.plans.catalog import query
from caselight.sources import bridge as B
from caselight.streaming import keyed as K
from caselight.streaming import streams as S


def _events(spark, d):
    return S.stream_table(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _decide(events):
    return B.predictions_of(B.cases_of(events))


@query("select case_id, decision, round(probability, 6) as probability from b_predictions")
def stream_decide(spark, d):
    return S.drained(S.decided(_events(spark, d), _decide).select("case_id", "decision", "probability"), "decided")


_STREAM_RATES = """count(*) as n, round(avg(case when decision = 'REFER' then 1.0::double else 0 end), 6) as refer_rate, round(avg(case when decision = 'MANUAL_REVIEW' then 1.0::double else 0 end), 6) as manual_rate, round(avg(case when gradable = 0 then 1.0::double else 0 end), 6) as ungradable_rate"""


@query(f"select strftime(date_trunc('week', created), '%Y-%m-%d') as week, {_STREAM_RATES} from b_predictions group by 1")
def stream_weekly_rates(spark, d):
    rows = S.newest(S.weekly_rates(_decide(_events(spark, d)), "created", "1 day"), ["start"], "weekly")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("week"), "n", "refer_rate", "manual_rate", "ungradable_rate")


@query(f"select strftime(date_trunc('day', created) - to_days(cast(k as int)), '%Y-%m-%d') as start, {_STREAM_RATES} from b_predictions cross join range(28) r(k) group by 1")
def stream_recent_window(spark, d):
    rows = S.newest(S.window_rates(_decide(_events(spark, d)), "created", "1 day", "28 days", "1 day"), ["start"], "recent")
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("select case_id, verdict_id, verdict from latest")
def stream_latest_verdict(spark, d):
    v = B.verdicts_of(_decide(_events(spark, d)))
    return S.newest(S.latest(v, "case_id", ["case_created", "row_id"], ["verdict_id", "verdict"]), ["case_id"], "latest")


@query(""", g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 15 minute then 0 else 1 end as first from events), s as (select user_id, ts, sum(first) over (partition by user_id order by ts, first desc rows unbounded preceding) as s from g),
t as (select user_id, min(ts) as start, max(ts) + interval 15 minute as stop, count(*) as n from s group by user_id, s) select user_id, cast(start as varchar) as start, n from t where stop <= (select max(ts) - interval 1 day from events)""")
def stream_idle_sessions(spark, d):
    rows = S.drained(S.sessions(_events(spark, d), "user_id", "ts", "15 minutes", "1 day"), "sessions")
    return rows.select("user_id", F.col("start").cast("string").alias("start"), "n")


_LOGINS = """, a as (select event_id, user_id, epoch(ts)::double as tm, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as pos from events where event_type in ('error', 'signup')),
w as (select event_id, user_id, pos, cast(case when bad then 1 else 0 end as int) as failures, -1::double as until, case when bad then 'failed' else 'ok' end as outcome from a where pos = 1 union all
  select a.event_id, a.user_id, a.pos, cast(case when tm < until then failures when not bad then 0 when failures >= 2 then 0 else failures + 1 end as int), case when tm >= until and bad and failures >= 2 then tm + 86400 else until end,
    case when tm < until then 'refused' when not bad then 'ok' when failures >= 2 then 'locked' else 'failed' end from w join a on a.user_id = w.user_id and a.pos = w.pos + 1)
select event_id, user_id, outcome from w"""


@query(_LOGINS, recursive=True)
def stream_lockout(spark, d):
    """Three failures lock for a day here, since the events of a user are hours apart."""
    e = _events(spark, d).where(F.col("event_type").isin("error", "signup")).withColumn("bad", F.col("event_type") == "error")
    return S.drained(S.lockouts(e, "user_id", "event_id", "ts", "bad", 3, 86400), "lockouts").withColumnRenamed("row", "event_id")


@query("""select user_id, cast(max(s) as int) as sessions, count(*) as n from (select user_id, sum(f) over (partition by user_id order by tm rows unbounded preceding) as s from (select user_id, epoch(ts)::double as tm, case when coalesce(epoch(ts)::double - lag(epoch(ts)::double) over (partition by user_id order by ts) < 900, false) then 0 else 1 end as f from events)) group by 1""")
def stream_capped_sessions(spark, d):
    return S.drained(S.capped_sessions(_events(spark, d), "user_id", "ts", 900, 8 * 3600), "capped").groupBy("user_id").agg(F.max("session").alias("sessions"), F.count("*").alias("n"))


@query("select distinct user_id, event_type from events")
def stream_dedup(spark, d):
    return S.drained(S.deduplicated(_events(spark, d), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "distinct")


#: What a stream with a lateness of a day has answered in the end: all up to the minute of the last watermark.
_FINAL = "(select epoch_ms(date_trunc('minute', max(ts) - interval 1 day)) from events)"


@query(_LOGINS.replace("select event_id, user_id, outcome from w", f"select w.event_id, w.user_id, outcome from w join a on a.event_id = w.event_id where tm * 1000 <= {_FINAL.replace('from events', 'from events where event_type in (' + chr(39) + 'error' + chr(39) + ', ' + chr(39) + 'signup' + chr(39) + ')')}"), recursive=True)
def stream_lockout_in_order(spark, d):
    """Lockouts with timers: attempts wait for the watermark and are answered in the order of time, whatever batch they came in."""
    e = _events(spark, d).where(F.col("event_type").isin("error", "signup")).withColumn("bad", F.col("event_type") == "error")
    with K.rocks(spark):
        return S.drained(K.lockouts(e, "user_id", "event_id", "ts", "bad", "1 day", 3, 86400, 400 * 86400), "ordered-lockouts").withColumnRenamed("row", "event_id")


@query(f""", r as (select user_id, (epoch_us(ts) // 1000) as ms, row_number() over (partition by user_id order by ts, event_id) as pos from events where (epoch_us(ts) // 1000) <= {_FINAL}),
w as (select user_id, pos, ms as first, ms as last, 1::bigint as n, 1 as s from r where pos = 1 union all select r.user_id, r.pos, case when cut then ms else first end, ms, case when cut then 1 else n + 1 end, case when cut then s + 1 else s end
  from (select r.*, w.first, w.n, w.s, r.ms >= least(w.last + 12 * 3600000, w.first + 48 * 3600000) as cut from w join r on r.user_id = w.user_id and r.pos = w.pos + 1) r),
z as (select user_id, s, first, max(last) as last, max(n) as n, least(max(last) + 12 * 3600000, first + 48 * 3600000) as ends from w group by user_id, s, first),
slot as (select user_id, (epoch_us(ts) // 1000) as ms, unnest([(epoch_us(ts) // 1000), (epoch_us(ts) // 1000) + 12 * 3600000]) as due from events), timer as (select user_id, (due + 59999) // 60000 * 60000 as due from slot where (due + 59999) // 60000 * 60000 <= {_FINAL})
select user_id, first as start_ms, last as last_ms, n from z where exists (select 1 from timer t where t.user_id = z.user_id and t.due >= ends)""", recursive=True)
def stream_sessions_by_timer(spark, d):
    """Sessions that end after half a day of silence and after two days at the latest, closed by timers."""
    with K.rocks(spark):
        return S.drained(K.sessions(_events(spark, d), "user_id", "event_id", "ts", "1 day", 12 * 3600, 48 * 3600), "timed-sessions")


@query("select case_id, verdict_id, verdict from latest")
def stream_latest_keyed(spark, d):
    """Latest verdicts from a state that forgets cases after a while."""
    v = B.verdicts_of(_decide(_events(spark, d)))
    with K.rocks(spark):
        rows = S.newest(K.latest(v, "case_id", "row_id", "case_created", "verdict", "60 days", 30 * 86400), ["case_id"], "keyed-latest")
    return rows.select("case_id", F.col("row").alias("verdict_id"), F.col("value").alias("verdict"))
