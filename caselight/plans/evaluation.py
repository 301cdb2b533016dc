"""Queries of evaluations, resampling, logged records, findings and label assembly, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.functions import columns as C
from caselight.operators import calibration as K
from caselight.operators import evaluation as E
from caselight.plans.catalog import _hash, query
from caselight.sources import bridge as B
from caselight.sources import files as S

_WEIGHT = lambda n: f"len(list_filter([{', '.join(f'{c}::double' for c in K.POISSON)}], lambda c: c <= {_hash("'boot:' || subject || ':' || i")} / 4294967296.0::double)) as w from sub cross join range({n}) r(i)"  # noqa: E731, E501


@query(""", q as (select *, item % 10 = 0 as seen, item % 37 <> 0 as readable from b_quality), u as (select *, p_ungradable >= 0.5 as gate from q where not seen and readable),
rk as (select p_ungradable as s, sum(reject) as pos, sum(1 - reject) as neg from u group by 1), au as (select sum(pos * (below + neg / 2.0::double)) / nullif(sum(pos) * sum(neg), 0) as auroc from (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from rk))
select (select count(*) filter (seen) from q) as excluded, (select count(*) filter (not seen and not readable) from q) as unreadable, count(*) as n_items, count(*) filter (reject = 1) as n_human_reject, count(*) filter (reject = 0) as n_human_accept,
  round(count(*) filter (reject = 1 and gate) / nullif(count(*) filter (reject = 1), 0), 6) as catch_rate, count(*) filter (reject = 1 and not gate) as missed_rejects, round(count(*) filter (reject = 0 and gate) / nullif(count(*) filter (reject = 0), 0), 6) as false_reject_rate,
  count(*) filter (reject = 0 and gate) as false_rejects, round((select auroc from au), 6) as auroc from u""")
def gate_validation(spark, d):
    q = B.quality(spark, d).withColumn("gradable", F.col("p_ungradable") < 0.5)
    seen = q.where("item % 10 = 0").select(F.replace("filename", F.lit("/"), F.lit("\\")).alias("filename"))
    return E.gate_validation(q, "reject", ["1"], seen, F.col("item") % 37 != 0)


def _logits(k: int) -> str:
    return ", ".join(f"(grade * 2 - {2 * i + 1} + (h % {7 + k} - 3) / 2.0::double) as z{i}" for i in range(4))


@query(f""", raw as (select 'clarity' as subscore, case when case_id % 6 > 0 then grade else -1 end as level, {_logits(0)} from b_cases union all select 'field', case when case_id % 5 > 0 then (grade + h % 2) % 5 else -1 end, {_logits(4)} from b_cases),
l as (select subscore, level, (z0 > 0)::int + (z1 > 0)::int + (z2 > 0)::int + (z3 > 0)::int as guess, level < 3 as y, 1 - 1 / (1 + exp(-greatest(-30, least(30, z2)))) as p from raw where level >= 0),
rk as (select subscore, p, count(*) filter (y) as pos, count(*) filter (not y) as neg from l group by all),
au as (select subscore, sum(pos * (below + neg / 2.0::double)) / (sum(pos) * sum(neg)) as auroc from (select *, coalesce(sum(neg) over (partition by subscore order by p rows between unbounded preceding and 1 preceding), 0) as below from rk) group by 1),
ma as (select subscore, level, count(*) as na from l group by all), mb as (select subscore, guess, count(*) as nb from l group by all), ch as (select subscore, sum((level - guess) * (level - guess) * na * nb) as chance from ma join mb using (subscore) group by 1)
select l.subscore, count(*) as n, count(*) filter (y) as n_problem, round(max(auroc), 6) as auroc, round(count(*) filter (y and p >= 0.4) / count(*) filter (y), 6) as sensitivity, round(count(*) filter (not y and p < 0.4) / count(*) filter (not y), 6) as specificity,
  round(1 - sum((level - guess) * (level - guess)) * count(*)::double / max(chance), 6) as weighted_kappa, round(count(*) filter (level = guess) / count(*), 6) as exact_agreement from l join au using (subscore) join ch using (subscore) group by 1""")
def subscore_metrics(spark, d):
    z = lambda k: F.array(*[F.col("grade") * 2 - (2 * i + 1) + (F.col("h") % (7 + k) - 3) / 2.0 for i in range(4)])
    raw = lambda c, levels: F.element_at(F.array(*[F.lit(v) for v in levels]), c.cast("int") + 1)
    steps = [1, 4, 6, 8, 10]
    c = B.cases(spark, d).withColumn("clarity", F.when(F.col("case_id") % 6 > 0, raw(F.col("grade"), steps))).withColumn("field", F.when(F.col("case_id") % 5 > 0, raw((F.col("grade") + F.col("h") % 2) % 5, steps)))
    c = c.select(C.level_index(F.col("clarity"), steps).alias("a"), C.level_index(F.col("field"), steps).alias("b"), z(0).alias("za"), z(4).alias("zb"))
    return E.subscore_metrics(c, {"clarity": ("a", "za", 5, 3), "field": ("b", "zb", 5, 3)}, 0.4)


@query(f""", sub as (select subject, sum(y) as pos, count(*) as n, sum(case when y = 1 and prob >= 0.5 then 1 else 0 end) as tp, sum(case when y = 0 and prob < 0.5 then 1 else 0 end) as tn, sum(grade) as grades from b_cases group by 1),
rep as (select sub.*, i, {_WEIGHT(500)}), boot as (select i, sum(w * tp) as tp, sum(w * tn) as tn, sum(w * pos) as pos, sum(w * n) as n, sum(w * grades) as grades from rep where w > 0 group by i),
all_rows as (select -1 as i, sum(tp) as tp, sum(tn) as tn, sum(pos) as pos, sum(n) as n, sum(grades) as grades from sub union all select * from boot),
m as (select i, 'balanced_accuracy' as metric, (tp / nullif(pos, 0) + tn / nullif(n - pos, 0)) / 2 as v from all_rows union all select i, 'mean_grade', grades / n from all_rows)
select metric, round(max(v) filter (i < 0), 6) as point, round(quantile_cont(v, 0.025) filter (i >= 0), 6) as low, round(quantile_cont(v, 0.975) filter (i >= 0), 6) as high, count(v) filter (i >= 0) as n_boot from m group by 1""")
def metric_fn(spark, d):
    hit = lambda y, call: F.when((F.col("y") == y) & call, 1).otherwise(0)
    sums = {"pos": F.col("y"), "n": F.lit(1), "tp": hit(1, F.col("prob") >= 0.5), "tn": hit(0, F.col("prob") < 0.5), "grades": F.col("grade")}
    metrics = lambda s: {
        "balanced_accuracy": (F.try_divide(s("tp"), s("pos")) + F.try_divide(s("tn"), s("n") - s("pos"))) / 2, "mean_grade": F.try_divide(s("grades"), s("n")),
    }
    return E.bootstrap(B.cases(spark, d), "subject", sums, metrics, 500)


@query(f""", e as (select min(logit) as lo, max(logit) as hi from b_cases), sub as (select subject, cast(least(199, floor((logit - lo) / (hi - lo) * 200)) as int) as step, sum(y) as pos, sum(1 - y) as neg from b_cases, e group by all),
rep as (select sub.*, i, {_WEIGHT(200)}), cell as (select i, step, sum(w * pos) as pos, sum(w * neg) as neg from rep where w > 0 group by all),
boot as (select i, sum(pos * (below + neg / 2.0::double)) / nullif(sum(pos) * sum(neg), 0) as v from (select *, coalesce(sum(neg) over (partition by i order by step rows between unbounded preceding and 1 preceding), 0) as below from cell) group by 1),
rk as (select logit as s, sum(y) as pos, sum(1 - y) as neg from b_cases group by 1), pt as (select sum(pos * (below + neg / 2.0::double)) / (sum(pos) * sum(neg)) as v from (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from rk))
select 'auroc' as metric, round((select v from pt), 6) as point, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, count(v) as n_boot from boot""")
def cluster_bootstrap_auroc(spark, d):
    return E.bootstrap_auroc(B.cases(spark, d), "y", "logit", "subject")


@query("""select case_id, case when prob < 0.02 then 'far from the threshold' else '' end || case when prob < 0.02 and side is null then ';' else '' end || case when side is null then 'no side' else '' end as reasons, not (prob < 0.02 or side is null) as gradable from b_cases""")
def gate_fn(spark, d):
    far = lambda rows: F.when(rows["prob"] < 0.02, F.array(F.lit("far from the threshold")))
    no_side = lambda rows: F.when(rows["side"].isNull(), F.array(F.lit("no side")))
    return E.gated(B.cases(spark, d), far, no_side).select("case_id", F.array_join("reasons", ";").alias("reasons"), "gradable")


@query("""select case_id as seq, 'prediction' as action, case when case_id % 53 = 0 then 'row missing' else 'row altered' end as problem from b_predictions where case_id % 53 = 0 or (case_id % 59 = 0 and coalesce(decision, '') <> 'ROUTINE')
union all select -verdict_id - 1, 'verdict', case when verdict_id % 61 = 0 then 'row missing' else 'row altered' end from b_verdicts where verdict_id % 61 = 0 or (verdict_id % 67 = 0 and grade is not null)""")
def record_hash_join(spark, d):
    p = B.predictions(spark, d).select("case_id", "decision", "probability", "device", "created")
    v = B.verdicts(spark, d).select("verdict_id", "case_id", "verdict", "grade", "grader")
    hashed = lambda df: df.withColumn("record_sha256", E.record_hash(df, df.columns))
    entry = lambda df, seq, action, entity, detail: df.select(seq.alias("seq"), F.lit(action).alias("action"), entity.cast("string").alias("entity_id"), detail.alias("detail"), "record_sha256")
    log = entry(hashed(p), F.col("case_id"), "prediction", F.col("case_id"), F.lit("{}")).unionByName(entry(hashed(v), -F.col("verdict_id") - 1, "verdict", F.col("case_id"), F.to_json(F.struct("verdict_id"))))
    now_p = p.where("case_id % 53 <> 0").withColumn("decision", F.when(F.col("case_id") % 59 == 0, "ROUTINE").otherwise(F.col("decision")))
    now_v = v.where("verdict_id % 61 <> 0").withColumn("grade", F.when(F.col("verdict_id") % 67 != 0, F.col("grade")))
    return E.check_records(log, {"prediction": (hashed(now_p), "case_id", F.col("entity_id")), "verdict": (hashed(now_v), "verdict_id", C.json_field(F.col("detail"), "$.verdict_id"))})


@query("""select 'S' || lpad(cast(user_id as varchar), 4, '0') as subject, 'P' || case_id || case when case_id % 2 = 0 then '_l' else '_r' end || h % 3 as image_id, case when device = 'click' then 'train' when device = 'view' then 'valid' else 'evaluation' end as split,
  case when case_id % 2 = 0 then 'left' else 'right' end as side, case when device in ('click', 'view') and case_id % 2 = 1 then (grade + 1) % 5 else grade end as raw_grade, case when device = 'view' then cast(v % 11 as int) end as clarity, case when h % 4 > 0 then 'site' || h % 3 else 'unknown' end as site
  from b_cases join (select event_id, user_id from events) e on case_id = event_id""")
def labels_union_sources(spark, d):
    c = B.cases(spark, d).withColumn("image_id", F.concat(F.lit("P"), F.col("case_id").cast("string"), F.when(F.col("case_id") % 2 == 0, "_l").otherwise("_r"), (F.col("h") % 3).cast("string")))
    ids = ["image_id", F.substring("subject", 2, 20).alias("patient_id")]
    sides = [F.col("grade").alias("left_grade"), ((F.col("grade") + 1) % 5).alias("right_grade")]
    parts = {
        "train": c.where("device = 'click'").select(*ids, *sides), "valid": c.where("device = 'view'").select(*ids, *sides, (F.col("v") % 11).cast("int").alias("clarity")),
        "evaluation": c.where("device not in ('click', 'view')").select(*ids, F.col("grade").alias("raw_grade")),
    }
    sites = c.where("h % 4 > 0").select("image_id", F.concat(F.lit("site"), (F.col("h") % 3).cast("string")).alias("site"))
    return S.assemble_multisource(parts, sites, c)


@query("""select verdict_id, codes, replace(replace(replace(codes, '["', ''), '"]', ''), '","', ';') as joined, n, month from (select verdict_id, '[' || string_agg('"' || x || '"', ',' order by x) || ']' as codes, count(*) as n, strftime(any_value(case_created), '%Y-%m') as month
  from (select distinct verdict_id, case_created, unnest([grader, verdict, case when grade is not null then 'graded' end, grader]) as x from b_verdicts) where x is not null group by 1)""")
def findings_codec(spark, d):
    found = F.array("grader", "verdict", F.when(F.col("grade").isNotNull(), "graded"), "grader")
    v = B.verdicts(spark, d).select("verdict_id", C.encode_findings(found).alias("codes"), C.encode_findings(found, ";").alias("joined"), C.month_of(F.col("case_created").cast("string")).alias("month"))
    return v.select("verdict_id", "codes", "joined", F.size(C.decode_findings(F.col("codes"))).cast("long").alias("n"), "month")


@query("""select item, prefix, case when x between -1e300 and 1e300 then round(x, 6) end as x, case when y between -1e300 and 1e300 then round(y, 6) end as y
  from (select item, item as prefix, case when item % 7 = 0 then cast('nan' as double) when item % 5 = 0 then cast('inf' as double) else p_ungradable end as x, case when item % 3 = 0 then cast('-inf' as double) else blur_var end as y from b_quality)""")
def json_safe(spark, d):
    bad = lambda text: F.lit(text).cast("double")
    x = F.when(F.col("item") % 7 == 0, bad("NaN")).when(F.col("item") % 5 == 0, bad("Infinity")).otherwise(F.col("p_ungradable"))
    y = F.when(F.col("item") % 3 == 0, bad("-Infinity")).otherwise(F.col("blur_var"))
    q = B.quality(spark, d).select("item", C.stem_prefix(F.col("filename")).cast("long").alias("prefix"), F.struct(x.alias("x"), F.array(y).alias("ys")).alias("r"))
    safe = q.select("item", "prefix", C.json_safe(F.col("r"), q.schema["r"].dataType).alias("r"))
    return safe.select("item", "prefix", "r.x", F.element_at("r.ys", 1).alias("y"))


_TAIL = lambda lo, hi: f"list_sum(list_transform(range({lo}, {hi}), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((a + b) / 2) + (n - j) * ln(1 - (a + b) / 2))))"


@query(f""", g as (select subject, count(*) filter (prob >= 0.5) as k, count(*) as n from b_cases where y = 1 group by 1),
w as (select subject, k, n, 0 as step, 'low' as side, 0.0::double as a, 1.0::double as b from g where k > 0 union all select subject, k, n, 0, 'high', 0.0, 1.0 from g where k < n union all
  select subject, k, n, step + 1, side, case when up then (a + b) / 2 else a end, case when up then b else (a + b) / 2 end from (select *, case when side = 'low' then {_TAIL('k', 'n + 1')} < 0.025 else {_TAIL('0', 'k + 1')} > 0.025 end as up from w where step < 40))
select g.subject, g.k, g.n, round(coalesce(l.a, 0), 6) as low, round(coalesce(h.a, 1), 6) as high from g left join w l on l.subject = g.subject and l.side = 'low' and l.step = 40 left join w h on h.subject = g.subject and h.side = 'high' and h.step = 40""", recursive=True)
def clopper_pearson(spark, d):
    g = B.cases(spark, d).where("y = 1").groupBy("subject").agg(F.count_if(F.col("prob") >= 0.5).alias("k"), F.count("*").alias("n"))
    return g.withColumn("ci", C.clopper_pearson(F.col("k"), F.col("n"))).select("subject", "k", "n", "ci.low", "ci.high")
