"""Queries of the gates, checks and alerts, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.functions import columns as C
from caselight.operators import gates as G
from caselight.operators import metrics as M
from caselight.operators import tables as O
from caselight.plans.catalog import _CONFUSION, _DIVIDED, _RATES, _SPLIT, _auroc, query
from caselight.sources import bridge as B


@query("select item, cast(item as varchar) as subject from b_quality")
def subject_id_resolve(spark, d):
    q = B.quality(spark, d)
    return q.select("item", G.subject_of(q, "prefix", "filename").alias("subject"))


def _anatomy(df, h, v):
    f = lambda c, m, s: (c % m).cast("double") / F.lit(s)
    return G.anatomy_rule(df.withColumns({"red": f(h, 200, 1000.0), "centre": f(v, 256, 255.0), "corner": f(h, 256, 510.0), "disc": f(h, 100, 100.0)}))


def _anatomy_sql(src: str, h: str, v: str) -> str:
    return f"""(select *, not (r < 0.3) and sc >= 0.5 as passed from (select *, case when r < 0.3 then least(s0, 0.49) else s0 end as sc from (select *, 0.35 * r + 0.35 * f + 0.3 * (({h}) % 100) / 100.0::double as s0 from
      (select *, greatest(0.0::double, least(1.0::double, ((({h}) % 200) / 1000.0::double - 0.02) / 0.1)) as r, greatest(0.0::double, least(1.0::double, ((({v}) % 256) / 255.0::double - (({h}) % 256) / 510.0::double - 0.3) / 0.5)) as f from {src}))))"""


@query(f"select case_id, round(sc, 6) as score, passed from {_anatomy_sql('b_cases', 'h', 'v')}")
def anatomy_gate_rule(spark, d):
    return _anatomy(B.cases(spark, d), F.col("h"), F.col("v")).select("case_id", "score", "passed")


@query(f"""select item, blur_var >= 500 and blur_var <= 20000 and coalesce(pu < 0.6, true) and passed as gradable, case when pu is null then 'classical' else 'learned' end as source,
  concat_ws(';', case when blur_var < 500 then 'low sharpness' end, case when blur_var > 20000 then 'too bright' end, case when pu >= 0.6 then 'learnt gate' end, case when not passed then 'wrong subject' end) as reasons
  from (select *, case when item % 13 <> 0 then p_ungradable end as pu from {_anatomy_sql('b_quality', 'item * 7', 'item * 31')})""")
def combined_gate(spark, d):
    q = _anatomy(B.quality(spark, d), F.col("item") * 7, F.col("item") * 31)
    q = q.withColumn("reasons", G.named((F.col("blur_var") < 500, "low sharpness"), (F.col("blur_var") > 20000, "too bright"))).withColumn("p_ungradable", F.when(F.col("item") % 13 != 0, F.col("p_ungradable")))
    return G.combined_gate(q, 0.6).select("item", "gradable", "source", F.array_join("reasons", ";").alias("reasons"))


@query("""select verdict_id, problem, case when problem is null and verdict in ('REFER', 'ROUTINE') and decision in ('REFER', 'ROUTINE') then verdict = decision end as agreed from
  (select v.*, p.decision, case when p.case_id is null then 'unknown case' when verdict = 'UNGRADABLE' and (v.grade is not null or v.dme is not null) then 'ungradable with a finding' end as problem
  from b_verdicts v left join (select * from b_predictions where is_demo = 0) p on v.case_id = p.case_id)""")
def verdict_validate(spark, d):
    return G.checked_verdicts(B.verdicts(spark, d), B.predictions(spark, d).where("is_demo = 0")).select("verdict_id", "problem", "agreed")


@query("""select case_id, case when fs <> ts then 'subject mismatch' when fe is not null and fe not in ('L', 'right') then 'unknown side' when se <> te then 'side mismatch' when coalesce(fs, ts) is null then 'no subject' when coalesce(se, te) is null then 'no side' end as problem,
  coalesce(fs, ts) as subject, coalesce(se, te) as side, coalesce(fv, coalesce(fs, ts) || ':' || cast(cast(created as date) as varchar)) as visit, device from
  (select case_id, created, device, case when h % 7 > 0 then subject end as fs, case when h % 11 = 0 then 'S0' when h % 3 > 0 then subject end as ts, case when h % 13 = 0 then 'both' when side = 'left' then 'L' else side end as fe,
    case when h % 13 = 0 then null else side end as se, case when h % 17 = 0 then 'left' end as te, case when h % 5 = 0 then visit end as fv from b_predictions)""")
def ingest_reconcile(spark, d):
    h, side = F.col("h"), F.col("side")
    p = B.predictions(spark, d).withColumns({
        "form_subject": F.when(h % 7 > 0, F.concat(F.lit(" "), "subject")), "tag_subject": F.when(h % 11 == 0, "S0").when(h % 3 > 0, F.col("subject")),
        "form_side": F.when(h % 13 == 0, "both").when(side == "left", "L").otherwise(side), "tag_side": F.when(h % 17 == 0, "left"), "form_visit": F.when(h % 5 == 0, F.col("visit")).otherwise(" "), "form_device": F.col("device"),
    })
    return G.reconcile(p).select("case_id", "problem", F.col("subject_id").alias("subject"), F.col("side_id").alias("side"), F.col("visit_id").alias("visit"), F.col("device_id").alias("device"))


@query(_SPLIT + """, t as (select split, count(*) as n, count(*) filter (c.grade >= 2) as pos from b_cases c join split s on c.subject = s.subject group by 1)
select 'required columns' as "check", 'FAIL' as status, 1 as n union all select 'grade range', 'OK', count(*) filter (grade not between 0 and 4) from b_cases union all select 'subject', 'OK', count(*) filter (subject is null) from b_cases
union all select split || ' rows', case when n = 0 then 'FAIL' else 'OK' end, n from t union all select split || ' positives', case when pos = 0 then 'FAIL' else 'OK' end, pos from t""")
def schema_check(spark, d):
    c = B.cases(spark, d)
    c = c.join(O.split_by_subject(c, "subject", "grade").select("subject", "split"), "subject")
    return G.check_tables(c, "split", "grade", "subject", ["subject", "grade", "age_group"])


def _report(cases, by, y="y", score="prob", threshold=0.5):
    c = M.confusion(cases, y, score, threshold, by).join(M.auroc(cases, y, score, by), by)
    return c.join(M.ece(cases, y, score, by=by), by)


_REPORT = f""", rep as (select c.*, a.auroc, e.ece from (select device, {_DIVIDED} from (select device, {_CONFUSION} from (select device, prob as s, 0.5 as t, y from b_cases) group by device)) c
  join {_auroc('device', '(select device, prob as s, y from b_cases)')} a using (device) join (select device, sum(case when b >= 0 then abs(sp - sy) end) / sum(n) as ece from (select device, b, count(*) as n, sum(prob) as sp, sum(y) as sy from
  (select device, prob, y, cast(len(list_filter(list_transform(range(15), lambda i: i * (1.0::double / 15)), lambda x: x < prob)) as int) - 1 as b from b_cases) group by 1, 2) group by 1) e using (device)) """


@query(_REPORT + """select device, concat_ws(';', case when device = 'error' then 'other checkpoint' end, case when device = 'signup' then 'temperature at its bound' end, case when tp + fn < 30 then 'internal: too few positives' end, case when auroc < 0.85 then 'internal: auroc too low' end,
  case when sensitivity < 0.85 then 'internal: sensitivity too low' end, case when specificity < 0.5 then 'internal: specificity too low' end, case when ece > 0.1 then 'internal: ece too high' end, case when device = 'click' then 'no abstention band' end) as failures from rep""")
def acceptance_gate(spark, d):
    device = F.col("device")
    r = _report(B.cases(spark, d), ["device"]).withColumns({
        "internal": F.struct("tp", "fn", "auroc", "sensitivity", "specificity", "ece"), "external": F.lit(None).cast("struct<tp:long,fn:long,auroc:double,sensitivity:double,specificity:double,ece:double>"), "checkpoint_sha256": F.when(device == "error", "b").otherwise("a"), "preprocess_fingerprint": F.lit("f"),
        "operating_point": F.lit(0.5), "method": F.lit("temperature"), "temperature": F.when(device == "signup", 10.0).otherwise(2.0), "band_low": F.when(device != "click", 0.4), "band_high": F.lit(0.6),
    })
    return r.select("device", F.array_join(G.acceptance_failures(r, "a", "f"), ";").alias("failures"))


@query(_REPORT + """select device, case when f = '' then 'validated' else 'experimental' end as status, f as why from (select device, concat_ws(';', case when tp + fn < 30 then 'positives' end, case when auroc < 0.85 then 'auroc' end,
  case when sensitivity < 0.85 then 'sensitivity' end, case when specificity < 0.5 then 'specificity' end) as f from rep)""")
def status_rule(spark, d):
    r = _report(B.cases(spark, d), ["device"]).select("device", G.external_status(F.struct("tp", "fn", "auroc", "sensitivity", "specificity")).alias("s"))
    return r.select("device", "s.status", F.array_join("s.why", ";").alias("why"))


def _gate_sql(score: str) -> str:
    return f"""(select c.subject, tp / nullif(tp + fn, 0) as catch, fp / nullif(fp + tn, 0) as fr, tp + fn as rejects, auroc from (select subject, {_CONFUSION} from (select subject, {score} as s, 0.6 as t, reject as y from b_quality) group by subject) c
      join {_auroc('subject', f'(select subject, {score} as s, reject as y from b_quality)')} a using (subject))"""


@query(f"""select subject, concat_ws(';', case when n.rejects < 3 then 'too few rejects' end, case when coalesce(n.auroc < c.auroc - 0.02, n.auroc is null) then 'auroc' end, case when coalesce(n.catch < c.catch - 0.02, n.catch is null) then 'catch rate' end,
  case when coalesce(n.fr > greatest(c.fr, 0.05) + 0.02, n.fr is null) then 'false rejects' end) as why from {_gate_sql('p_ungradable')} c join {_gate_sql('p_ungradable * 0.9 + reason_flag * 0.2')} n using (subject)""")
def candidate_compare(spark, d):
    q = B.quality(spark, d).withColumn("p2", F.col("p_ungradable") * 0.9 + F.col("reason_flag") * 0.2)

    def gate(score, name):
        c = M.confusion(q, "reject", score, 0.6, ["subject"]).join(M.auroc(q, "reject", score, ["subject"]), "subject")
        return c.select("subject", F.struct(F.col("sensitivity").alias("catch_rate"), F.try_divide("fp", F.col("fp") + F.col("tn")).alias("false_reject_rate"), "auroc", (F.col("tp") + F.col("fn")).alias("rejects")).alias(name))

    both = gate("p_ungradable", "current").join(gate("p2", "candidate"), "subject")
    return both.select("subject", F.array_join(G.compare_candidate(both, 0.05, least=3), ";").alias("why"))


_BASE_AUC = lambda score: _auroc("subject", f"(select subject, {score} as s, reject as y from b_quality where item % 3 = 0)")


@query(f"""select n.subject, concat_ws(';', case when n.rejects < 3 then 'too few rejects' end, case when coalesce(n.auroc < c.auroc - 0.02, n.auroc is null) then 'auroc' end, case when coalesce(n.catch < c.catch - 0.02, n.catch is null) then 'catch rate' end,
  case when coalesce(n.fr > greatest(c.fr, 0.05) + 0.02, n.fr is null) then 'false rejects' end, case when coalesce(q.auroc < p.auroc - 0.02, q.auroc is null) then 'base auroc' end) as why
  from {_gate_sql('p_ungradable')} c join {_gate_sql('p_ungradable * 0.95 + reason_flag * 0.02')} n using (subject) join {_BASE_AUC('p_ungradable')} p using (subject) join {_BASE_AUC('p_ungradable * 0.5 + (item % 7) * 0.1')} q using (subject)""")
def candidate_guard(spark, d):
    """The comparison with the guard of the base test set, here every third item under a worse score."""
    q = B.quality(spark, d).withColumn("p2", F.col("p_ungradable") * 0.95 + F.col("reason_flag") * 0.02).withColumn("p3", F.col("p_ungradable") * 0.5 + (F.col("item") % 7) * 0.1)

    def gate(score, name):
        c = M.confusion(q, "reject", score, 0.6, ["subject"]).join(M.auroc(q, "reject", score, ["subject"]), "subject")
        return c.select("subject", F.struct(F.col("sensitivity").alias("catch_rate"), F.try_divide("fp", F.col("fp") + F.col("tn")).alias("false_reject_rate"), "auroc", (F.col("tp") + F.col("fn")).alias("rejects")).alias(name))

    base = lambda score, name: M.auroc(q.where("item % 3 = 0"), "reject", score, ["subject"]).select("subject", F.col("auroc").alias(name))
    both = gate("p_ungradable", "current").join(gate("p2", "candidate"), "subject").join(base("p_ungradable", "base_current"), "subject").join(base("p3", "base_candidate"), "subject")
    return both.select("subject", F.array_join(G.compare_candidate(both, 0.05, least=3), ";").alias("why"))


@query("select replace(filename, chr(92), '/') as filename from b_quality where item % 3 = 0 union select replace(filename, chr(92), '/') from b_quality where item % 5 = 0")
def seen_by_either(spark, d):
    """The files that the gate or its explainer was trained on."""
    q = B.quality(spark, d)
    return G.seen_by_either(q.where("item % 3 = 0"), q.where("item % 5 = 0"))


@query("""select item, p_ungradable >= 0.6 as rejected, case when p_ungradable < 0.6 then '' when a >= 0.5 and b >= 0.4 then (case when b > a then 'light;focus' else 'focus;light' end) when a >= 0.5 then 'focus' when b >= 0.4 then 'light' else 'no single cause' end as causes
  from (select *, 1 - 1 / (1 + exp(-((item % 7 - 3) / 2.0::double))) as a, 1 - 1 / (1 + exp(-((item % 5 - 2) / 1.5::double))) as b from b_quality)""")
def explained_gate(spark, d):
    z = lambda m, k, s: F.array(F.lit(5.0), (F.col("item") % m - k) / F.lit(s))
    cause = lambda p, t, text: F.struct(p.alias("p"), F.lit(t).alias("threshold"), F.lit(text).alias("text"))
    causes = F.array(cause(G.problem_probability(z(7, 3, 2.0), 2), 0.5, "focus"), cause(G.problem_probability(z(5, 2, 1.5), 2), 0.4, "light"))
    return G.explained_gate(B.quality(spark, d), "p_ungradable", 0.6, causes).select("item", "rejected", F.array_join("causes", ";").alias("causes"))


@query(f""", per as (select case when created >= timestamp '2024-01-31' - interval 14 day then 'recent' else 'baseline' end as period, {_RATES} from outcomes group by 1), r as (select * from per where period = 'recent'), b as (select * from per where period = 'baseline'),
dev as (select device, {_RATES} from outcomes group by 1)
select 'agreement' as alert, cast(null as varchar) as key, agreement as value from r where reviewed >= 20 and agreement < 0.85 union all select 'ungradable', null, round(r.ungradable_rate - b.ungradable_rate, 6) from r, b where r.n >= 30 and b.n >= 30 and r.ungradable_rate - b.ungradable_rate > 0.1
union all select 'referral', null, round(r.refer_rate - b.refer_rate, 6) from r, b where r.n >= 30 and b.n >= 30 and abs(r.refer_rate - b.refer_rate) > 0.1 union all select 'device', device, ungradable_rate from dev where n >= 20 and ungradable_rate > 0.25
union all select 'unvalidated', null, cast(count(*) as double) from b_predictions where is_demo = 0 and validated = 0 having count(*) > 0""")
def drift_alerts(spark, d):
    p, latest = B.predictions(spark, d), O.latest_verdict(B.verdicts(spark, d))
    now = F.lit("2024-01-31").cast("timestamp")
    period = F.when(F.col("created") >= now - F.expr("interval 14 days"), "recent").otherwise("baseline")
    return G.drift_alerts(M.rates(p.withColumn("period", period), latest, ["period"]), M.rates(p, latest, ["device"]), p.agg(F.count_if((F.col("is_demo") == 0) & (F.col("validated") == 0)).alias("n")))


@query(""", s as (select visit, side, outcome, case when all_human then 'grader' else 'model' end as origin from (select visit, side, outcome, row_number() over (partition by visit, side order by case outcome when 'REFER' then 2 when 'MANUAL_REVIEW' then 1 else 0 end desc, case_id) as rk,
  bool_and(origin = 'grader') over (partition by visit, side) as all_human from outcomes where side is not null) where rk = 1),
f as (select visit, side, bool_or(v % 5 = 0) as suspected, max(prob) as probability, arg_min(case when h % 2 = 0 then 'validated' else 'experimental' end, case_id) as status from b_predictions where side is not null and h % 4 <> 3 group by 1, 2)
select s.visit, s.side, case when t then 'REFER' else outcome end as outcome, suspected, round(probability, 6) as probability, status, case when t then 'referred' when suspected and status = 'validated' then 'also suspected' when suspected then 'advice' end as note
from (select s.*, f.suspected, f.probability, f.status, coalesce(f.suspected and f.status = 'validated' and s.origin = 'model' and s.outcome = 'ROUTINE', false) as t from s left join f on s.visit = f.visit and s.side = f.side) s""")
def secondary_finding(spark, d):
    p = B.predictions(spark, d)
    sides = O.side_outcomes(O.effective_outcomes(p, B.verdicts(spark, d))).select("visit", "side", "outcome", F.when(F.col("all_human"), "grader").otherwise("model").alias("origin"))
    h = F.col("h")
    found = p.select("visit", "side", "case_id", F.when(h % 4 != 3, F.col("v") % 5 == 0).alias("suspected"), F.col("prob").alias("finding_probability"), F.when(h % 2 == 0, "validated").otherwise("experimental").alias("finding_status"))
    return G.secondary_findings(sides, found)
