"""Queries of decisions with their reasons and of reports, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.operators import calibration as K
from caselight.operators import decisions as D
from caselight.operators import metrics as M
from caselight.operators import reports as R
from caselight.operators import tables as O
from caselight.plans.catalog import _CONFUSION, _DIVIDED, _RATES, _SIDES, COVERAGES, _auroc, _bands_sql, _U, query
from caselight.sources import bridge as B

_TWO = lambda x: f"cast(cast(cast({x} as decimal(12,6)) as decimal(12,2)) as varchar)"
_SHOWN = f"case when prob >= 0.995 then '>0.99' when prob <= 0.005 then '<0.01' else {_TWO('prob')} end"


def _one_auroc(rows: str) -> str:
    """(auroc, auprc) of one table with s and y."""
    return _auroc("1 as one", rows).replace("group by 1 as one", "").replace("partition by 1 as one ", "")


@query(f"""select case_id, case when gradable = 0 then 'MANUAL_REVIEW' when prob > 0.35 and prob < 0.65 then 'MANUAL_REVIEW' when prob >= 0.5 then 'REFER' else 'ROUTINE' end as decision, case when gradable = 1 then round(prob, 6) end as probability,
  case when gradable = 0 then 'not gradable: dark; blurred | take the picture again; this is no negative result' when prob > 0.35 and prob < 0.65 then 'probability ' || {_SHOWN} || ' within the abstention band 0.35 to 0.65'
  when prob >= 0.5 then 'probability ' || {_SHOWN} || ' at or above the operating point 0.50' else 'probability ' || {_SHOWN} || ' below the operating point 0.50 | other diseases are not assessed' end as reasons from b_cases""")
def decision_rule(spark, d):
    cases = B.cases(spark, d).withColumn("gate", F.array(F.lit("dark"), F.lit("blurred")))
    return D.decide(cases, 0.5, 0.35, 0.65, why="gate").select("case_id", "decision", "probability", F.array_join("reasons", " | ").alias("reasons"))


@query("""select item, len(r) = 0 as gradable, array_to_string(r, ';') as reasons from (select item, list_filter([case when p_ungradable < 0.25 then 'field of view too small' end, case when blur_var / 50 < 12 then 'not sharp' end,
  case when blur_var % 260 < 20 then 'too dark' end, case when blur_var % 260 > 235 then 'too bright' end], lambda x: x is not null) as r from b_quality)""")
def quality_gate_rule(spark, d):
    q = B.quality(spark, d).select("item", F.col("p_ungradable").alias("fov"), (F.col("blur_var") / 50).alias("blur"), (F.col("blur_var") % 260).alias("mean"))
    return D.assess_quality(q).select("item", "gradable", F.array_join("quality_reasons", ";").alias("reasons"))


_REASONS = _SIDES + """, top as (select s.visit, s.side, s.outcome, s.all_human, o.origin from sides s join outcomes o on s.case_id = o.case_id),
seen as (select visit, side, bool_or(v % 5 = 0) as suspected, arg_min(case when h % 2 = 0 then 'validated' else 'experimental' end, case_id) as status from b_predictions where side is not null and h % 4 <> 3 group by 1, 2),
turn as (select t.*, coalesce(suspected and status = 'validated', false) as sure, coalesce(suspected, false) as suspected, coalesce(suspected and status = 'validated', false) and origin = 'model' and outcome = 'ROUTINE' as turned from top t left join seen n on t.visit = n.visit and t.side = n.side),
lab as (select visit, side, all_human, case when turned then 'REFER' else outcome end as outcome, case when turned then 'FINDING' else outcome end as label, case when turned then 'referred' when sure then 'also' when suspected then 'advice' else '-' end as note from turn),
sd as (select visit, list(outcome) as f, bool_and(all_human) as human, count(*) as k, string_agg(side, ' and ' order by side) filter (label = 'REFER') as r1, string_agg(side, ' and ' order by side) filter (label = 'FINDING') as r2,
  string_agg(side, ' and ' order by side) filter (label = 'MANUAL_REVIEW') as r3, string_agg(side, ' and ' order by side) filter (note = 'also') as r4, string_agg(side, ' and ' order by side) filter (note = 'advice') as r5, bool_or(side = 'left') as l, bool_or(side = 'right') as r from lab group by 1),
al as (select c.visit, c.unlabelled, f, coalesce(human, false) as human, coalesce(l, false) as l, coalesce(r, false) as r, r1, r2, r3, r4, r5 from dec c left join sd on c.visit = sd.visit),
de as (select *, case when coalesce(list_contains(f, 'REFER'), false) then 'REFER' when coalesce(list_contains(f, 'MANUAL_REVIEW'), false) then 'MANUAL_REVIEW' when not (l and r) then 'INCOMPLETE' else 'ROUTINE' end as decision,
  case when l and r then '' when l then 'right' when r then 'left' else 'left,right' end as missing from al)
select visit, decision, missing, human and l and r as final, unlabelled, concat_ws(' | ', case when decision = 'REFER' then 'refer: ' || r1 end, case when decision = 'REFER' then 'refer for the finding: ' || r2 end, case when decision = 'MANUAL_REVIEW' then 'a grader must decide: ' || r3 end,
  case when decision = 'INCOMPLETE' then 'no result: ' || replace(missing, ',', ' and ') end, case when decision = 'ROUTINE' then 'nothing to refer on either side' end, 'finding also suspected: ' || r4, 'finding suspected, advice only: ' || r5,
  case when unlabelled > 0 then unlabelled || ' without a side, not used' end) as reasons from de"""


@query(_REASONS)
def visit_reasons(spark, d):
    p, h = B.predictions(spark, d), F.col("h")
    found = p.select(
        "visit", "side", "case_id", F.when(h % 4 != 3, F.col("v") % 5 == 0).alias("suspected"), F.col("prob").alias("finding_probability"), F.when(h % 2 == 0, "validated").otherwise("experimental").alias("finding_status")
    )
    rows = D.decide_visits(O.effective_outcomes(p, B.verdicts(spark, d)), found)
    return rows.withColumn("reasons", F.array_join("reasons", " | "))


@query("select case_id, coalesce(n.n_name, 'elsewhere') as n_name from b_cases left join nation n on h % 40 = n.n_nationkey")
def lookup_default(spark, d):
    names = B.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), "n_name")
    return D.lookup_default(B.cases(spark, d).withColumn("key", F.col("h") % 40), names, "key", "n_name", "elsewhere").select("case_id", "n_name")


@query(f"select c as coverage, round(low, 6) as low, round(high, 6) as high from {_bands_sql('b_cases')} where c = 0.85")
def band_lookup(spark, d):
    return D.band_for(M.abstention_bands(B.cases(spark, d), "prob", 0.5, COVERAGES), 0.85)


@query("""select count(*) as total, count(*) filter (decision = 'REFER') as refer, count(*) filter (decision = 'ROUTINE') as routine, count(*) filter (decision = 'MANUAL_REVIEW') as manual, count(*) filter (gradable = 0) as ungradable,
  count(latest) as reviewed, round(avg(case when latest in ('REFER', 'ROUTINE') and decision in ('REFER', 'ROUTINE') then (case when latest = decision then 1.0::double else 0 end) end), 6) as agreement, round(coalesce(median(latency_ms), 0), 6) as median_latency from outcomes""")
def ops_summary(spark, d):
    return R.ops_summary(O.effective_outcomes(B.predictions(spark, d), B.verdicts(spark, d)))


@query("""select count(*) as n, count(*) filter (decision = 'REFER') as refer, count(*) filter (decision = 'ROUTINE') as routine, count(*) filter (decision = 'MANUAL_REVIEW') as manual, count(*) filter (decision = 'MANUAL_REVIEW' and probability is null) as by_gate,
  count(*) filter (decision = 'MANUAL_REVIEW' and probability is not null) as by_band, round(count(*) filter (decision <> 'MANUAL_REVIEW') / count(*), 6) as coverage,
  round(count(*) filter (decision = 'REFER' and y = 1) / count(*) filter (decision <> 'MANUAL_REVIEW' and y = 1), 6) as sensitivity, round(count(*) filter (decision = 'ROUTINE' and y = 0) / count(*) filter (decision <> 'MANUAL_REVIEW' and y = 0), 6) as specificity,
  count(*) filter (decision = 'ROUTINE' and y = 1) as missed, count(*) filter (decision = 'REFER' and y = 0) as false_referrals from b_predictions""")
def served_summary(spark, d):
    return R.served_summary(B.predictions(spark, d))


_PERCENTS = ", ".join(f"round(quantile_cont(value, {q}), 6) as p{round(100 * q)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))


@query(f"select metric, reject, count(*) as n, {_PERCENTS} from (select 'blur_var' as metric, reject, blur_var as value from b_quality where item % 7 <> 0 union all select 'p_ungradable', reject, p_ungradable from b_quality) group by 1, 2")
def metric_percentiles(spark, d):
    unmeasured = F.when(F.col("item") % 14 == 0, F.lit("none")).when(F.col("item") % 7 == 0, F.lit("NaN")).otherwise(F.col("blur_var").cast("string"))
    return R.metric_percentiles(B.quality(spark, d).withColumn("blur_var", unmeasured), ["blur_var", "p_ungradable"], ["reject"])


@query(f"""select tp as caught, fn as missed, fp as false_rejects, round(tp / nullif(tp + fn, 0), 6) as catch_rate, round(fp / nullif(fp + tn, 0), 6) as false_reject_rate, round(auroc, 6) as auroc
  from (select {_CONFUSION} from (select p_ungradable as s, 0.6 as t, reject as y from b_quality)) cross join {_one_auroc("(select p_ungradable as s, reject as y from b_quality)")}""")
def gate_metrics(spark, d):
    return R.gate_metrics(B.quality(spark, d), "reject", "p_ungradable", 0.6)


_GATE = lambda name, s, t, area: f"""select '{name}' as gate, tp as caught, fp as false_rejects, round(tp / nullif(tp + fn, 0), 6) as catch_rate, round(fp / nullif(fp + tn, 0), 6) as false_reject_rate, round(auroc, 6) as auroc
  from (select {_CONFUSION} from (select {s} as s, {t} as t, reject as y from b_quality)) cross join {_one_auroc(f"(select {area} as s, reject as y from b_quality)")}"""  # noqa: E731


@query(_GATE("learned", "p_ungradable", "0.6", "p_ungradable") + " union all " + _GATE("classical", "case when blur_var < 500 then 1 else 0 end", "1", "-blur_var"))
def gate_compare(spark, d):
    return R.gate_compare(B.quality(spark, d), "reject", "p_ungradable", 0.6, "blur_var", 500)


@query("""select cast(i as int) as grade, count(c.grade) as n, round(100.0 * count(c.grade) / (select count(*) from b_cases where grade <> 3), 6) as percent, round(100.0 * (select count(*) from b_cases where grade in (2, 4)) / (select count(*) from b_cases where grade <> 3), 6) as referable_percent,
  round((select count(*) / count(distinct subject) from b_cases where grade <> 3), 6) as rows_per_subject from range(5) r(i) left join (select * from b_cases where grade <> 3) c on c.grade = i group by i""")
def grade_distribution(spark, d):
    return R.grade_distribution(B.cases(spark, d).where("grade <> 3"))  # an empty grade keeps its row


@query(f"select case when event_id % 5 = 0 then 'unknown' else device end as device, {_RATES} from (select o.*, case_id as event_id from outcomes o) group by 1")
def device_rates(spark, d):
    p = B.predictions(spark, d)
    return R.device_rates(p.withColumn("device", F.when(F.col("case_id") % 5 != 0, F.col("device"))), O.latest_verdict(B.verdicts(spark, d)))


@query(f"select case when created >= timestamp '2024-01-31' - interval 28 day then 'recent' else 'baseline' end as period, {_RATES} from outcomes where created >= timestamp '2024-01-31' - interval 90 day and created <= timestamp '2024-01-31' group by 1")
def recent_vs_baseline(spark, d):
    return R.recent_vs_baseline(B.predictions(spark, d), O.latest_verdict(B.verdicts(spark, d)), "2024-01-31")


@query("""select case when gradable = 1 then cast(grade as int) end as grade, case_id from (select *, row_number() over (partition by case when gradable = 1 then grade end order by case_id) as rk from b_predictions) where rk <= case when gradable = 1 then 4 else 2 end""")
def top_n_per_grade(spark, d):
    return R.sample_per_grade(B.predictions(spark, d), 4)


_VISITS = _SIDES + ", heads as (select visit, max(subject) as subject, min(created) as first_utc, max(created) as last_utc, count(*) as cases, count(*) filter (latest is null) as pending from outcomes group by 1) "


def _visits(spark, d):
    o = O.effective_outcomes(B.predictions(spark, d), B.verdicts(spark, d))
    return R.visit_list(o, D.decide_visits(o))


@query(_VISITS + "select h.visit, subject, cast(first_utc as varchar) as first_utc, cast(last_utc as varchar) as last_utc, cases, pending, decision from heads h join visits v on h.visit = v.visit")
def visit_list(spark, d):
    return _visits(spark, d).withColumns({c: F.col(c).cast("string") for c in ("first_utc", "last_utc")})


@query(_VISITS + """select visit, decision, pending from (select h.visit, decision, pending, last_utc from heads h join visits v on h.visit = v.visit order by last_utc desc, h.visit limit 100)""")
def visit_worklist(spark, d):
    return R.visit_worklist(_visits(spark, d), 100).select("visit", "decision", "pending")


@query("select row_id, rk from (select row_id, row_number() over (partition by content_md5 order by row_id) as rk, count(*) over (partition by content_md5) as n from b_dups) where n > 1")
def keep_first_dup(spark, d):
    return R.keep_first(B.duplicates(spark, d), "content_md5", "row_id").select("row_id", "rk")


@query(f"select case when {_U('holdout', 'case_id')} < 0.3 then 'holdout' else 'fit' end as part, count(*) as n, sum(y)::bigint as positives from b_cases group by 1")
def calibration_holdout(spark, d):
    parts = [p.select(F.lit(name).alias("part"), "y") for name, p in zip(("fit", "holdout"), K.holdout(B.cases(spark, d), "case_id"), strict=True)]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("select subject, count(*) as n from b_cases group by subject")
def split_guard(spark, d):
    """The rows of each subject after the checks that every subject is in one split and every case occurs once."""
    c = B.cases(spark, d)
    R.assert_no_leakage(O.split_by_subject(c, "subject", "grade"), "subject", "split")
    return R.assert_unique(c, "case_id").groupBy("subject").agg(F.count("*").alias("n"))
