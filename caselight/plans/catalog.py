"""The registered queries and their oracles in DuckDB SQL. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.functions import columns as C
from caselight.operators import metrics as M
from caselight.operators import tables as O
from caselight.sources import bridge as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = "0" * 64
COVERAGES = [1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6]

VIEWS = """with b_cases as (select event_id as case_id, event_id as row_id, 'S' || user_id as subject,
  case when event_id % 11 = 0 then null when event_id % 2 = 0 then 'left' else 'right' end as side, 'S' || user_id || ':' || cast(cast(ts as date) as varchar) as visit,
  event_type as device, ts as created, grade, case when grade >= 2 then 1 else 0 end as y, h, v, cast(grade * 2000 + h - 7000 as double) / 1000.0::double as logit,
  round(1 / (1 + exp(-(cast(grade * 2000 + h - 7000 as double) / 1000.0::double))), 6) as prob, case when v % 20 = 0 then 0 else 1 end as gradable
  from (select a.*, case when v < 1500 then 0 when v < 4000 then 1 when v < 8000 then 2 when v < 14000 then 3 else 4 end as grade
    from (select e.*, cast(floor(value * 100) as bigint) as v, cast('0x' || substr(md5(cast(event_id as varchar)), 1, 8) as bigint) % 10000 as h from events e) a) b),
b_predictions as (select c.*, case when gradable = 0 then 'MANUAL_REVIEW' when prob > 0.35 and prob < 0.65 then 'MANUAL_REVIEW' when prob >= 0.5 then 'REFER' else 'ROUTINE' end as decision,
  case when gradable = 0 then null else prob end as probability, case when h % 50 = 0 then 1 else 0 end as is_demo, case when h % 40 = 1 then 0 when h % 40 = 2 then null else 1 end as validated,
  cast(h % 900 as double) as latency_ms from b_cases c),
b_verdicts as (select id as verdict_id, id as row_id, case_id, revision, created as case_created, 'g' || g % 5 as grader,
  case when g % 17 = 0 then 'UNGRADABLE' when g % 10 < 8 then (case when y = 1 then 'REFER' else 'ROUTINE' end) else (case when y = 1 then 'ROUTINE' else 'REFER' end) end as verdict,
  case when g % 4 = 0 then grade end as grade, case when g % 5 = 0 then y end as dme
  from (select p.*, k.k as revision, case_id * 10 + k.k as id, cast('0x' || substr(md5(cast(case_id * 10 + k.k as varchar)), 1, 8) as bigint) as g
    from b_predictions p cross join (select unnest([0, 1, 2]) as k) k where p.h % 3 = 0 and k.k <= p.h % 4) q),
b_quality as (select l.doc_id as item, 'd/' || d.source || '/' || l.doc_id || '_x.jpg' as filename, d.source as subject, 1 - l.quality as reject, l.toxic as reason_flag,
  cast((1 - l.quality) * 5000 + cast('0x' || substr(md5(cast(l.doc_id as varchar)), 1, 8) as bigint) % 10000 as double) / 15000.0::double as p_ungradable, cast(d.n_chars as double) as blur_var
  from labels l join documents d on l.doc_id = d.doc_id),
b_dups as (select doc_id as row_id, md5(text) as content_md5, cast('0x' || substr(md5(source), 1, 8) as bigint) % 5 as grade, source, lang from documents),
latest as (select * from (select *, row_number() over (partition by case_id order by case_created desc, row_id desc) as rn, count(*) over (partition by case_id) as revisions from b_verdicts) where rn = 1),
outcomes as (select p.*, case when l.verdict = 'UNGRADABLE' then 'MANUAL_REVIEW' else coalesce(l.verdict, p.decision) end as outcome, case when l.verdict is null then 'model' else 'grader' end as origin,
  l.verdict as latest from b_predictions p left join latest l on p.case_id = l.case_id),
curve as (select logit as thr, sum(sum(y)) over w as tps, sum(sum(1 - y)) over w as fps, sum(y) as pos, sum(1 - y) as neg from b_cases group by logit window w as (order by logit desc)),
roc0 as (select *, lead(fps) over w - fps <> fps - lag(fps) over w or lead(tps) over w - tps <> tps - lag(tps) over w as keep from curve window w as (order by thr desc)),
roc as (select cast('inf' as double) as thr, cast(0 as double) as fpr, cast(0 as double) as tpr union all
  select thr, fps / (select max(fps) from curve), tps / (select max(tps) from curve) from roc0 where coalesce(keep, true))
"""

_SIG6 = lambda z: f"(1 / (1 + exp(-greatest(-30.0::double, least(30.0::double, {z})))))"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[C.rounded(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else F.col(f"`{f.name}`") for f in df.schema])


def query(oracle: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with what follows VIEWS in its oracle."""
    views = VIEWS.replace("with ", "with recursive ", 1) if recursive else VIEWS
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = views + oracle
        return f

    return register


def _hash(x: str) -> str:
    return f"cast('0x' || substr(md5({x}), 1, 8) as bigint)"


_U = lambda seed, x: f"{_hash(f"'{seed}:' || {x}")} / 4294967296.0::double"
_RATES = """count(*) as n, round(avg(case when decision = 'REFER' then 1.0::double else 0 end), 6) as refer_rate, round(avg(case when decision = 'MANUAL_REVIEW' then 1.0::double else 0 end), 6) as manual_rate,
  round(avg(case when gradable = 0 then 1.0::double else 0 end), 6) as ungradable_rate, round(avg(probability), 6) as mean_probability, count(latest) as reviewed,
  round(avg(case when latest in ('REFER', 'ROUTINE') and decision in ('REFER', 'ROUTINE') then (case when latest = decision then 1.0::double else 0 end) end), 6) as agreement"""
_CONFUSION = """sum(case when s >= t and y = 1 then 1 else 0 end)::bigint as tp, sum(case when s >= t and y = 0 then 1 else 0 end)::bigint as fp,
  sum(case when s < t and y = 0 then 1 else 0 end)::bigint as tn, sum(case when s < t and y = 1 then 1 else 0 end)::bigint as fn"""
_DIVIDED = """tp, fp, tn, fn, round((tp + fn) / nullif(tp + fp + tn + fn, 0), 6) as prevalence, round(tp / nullif(tp + fn, 0), 6) as sensitivity, round(tn / nullif(tn + fp, 0), 6) as specificity,
  round(tp / nullif(tp + fp, 0), 6) as ppv, round(tn / nullif(tn + fn, 0), 6) as npv"""


def _auroc(by: str, rows: str) -> str:
    return f"""(select {by}, sum(neg * (cum_pos - pos / 2.0::double)) / nullif(sum(pos)::double * sum(neg), 0) as auroc, sum(pos * (cum_pos / (cum_pos + cum_neg)::double)) / nullif(sum(pos), 0) as auprc
      from (select *, sum(pos) over w as cum_pos, sum(neg) over w as cum_neg from (select {by}, s, sum(y) as pos, sum(1 - y) as neg from {rows} group by all) window w as (partition by {by} order by s desc)) group by {by})"""


@query(f"""select {_DIVIDED.replace("tp, fp, tn, fn, ", "c.tp, c.fp, c.tn, c.fn, ", 1)}, round(a.auroc, 6) as auroc, round(a.auprc, 6) as auprc
  from (select {_CONFUSION} from (select logit as s, 0.0 as t, y from b_cases)) c cross join {_auroc("1 as one", "(select logit as s, y from b_cases)").replace("group by 1 as one", "").replace("partition by 1 as one ", "")} a""")
def screening_metrics(spark, d):
    c = B.cases(spark, d)
    return M.screening_metrics(c, "y", "logit", 0.0)


@query(f"select device, {_DIVIDED} from (select device, {_CONFUSION} from (select device, prob as s, 0.5 as t, y from b_cases) group by device)")
def confusion_counts(spark, d):
    return M.confusion(B.cases(spark, d), "y", "prob", 0.5, ["device"])


@query(f"select device, round(auroc, 6) as auroc, round(auprc, 6) as auprc from {_auroc('device', '(select device, logit as s, y from b_cases)')}")
def auroc(spark, d):
    return M.auroc(B.cases(spark, d), "y", "logit", ["device"])


@query("select round(sum(pos * (tps / (tps + fps)::double)) / sum(pos), 6) as auprc from curve")
def auprc(spark, d):
    return M.auroc(B.cases(spark, d), "y", "logit").select("auprc")


@query("select round(thr, 6) as threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from roc")
def roc_curve(spark, d):
    return M.roc_points(B.cases(spark, d), "y", "logit").select("threshold", "fpr", "tpr")


@query("select thr as threshold, pos::bigint as pos, neg::bigint as neg, tps::bigint as cum_pos, fps::bigint as cum_neg from curve")
def prefix_sums(spark, d):
    c = B.cases(spark, d).withColumn("pos", F.col("y").cast("long")).withColumn("neg", (1 - F.col("y")).cast("long"))
    return M.prefix_sums(c, "logit", ["pos", "neg"]).withColumnRenamed("logit", "threshold")


@query("select coalesce(arg_min(thr, {'a': fpr, 'b': -thr}), 0.5) as threshold from roc where tpr >= 0.9 - 1e-12")
def threshold_at_sensitivity(spark, d):
    return M.threshold_at_sensitivity(B.cases(spark, d), "y", "logit", 0.9)


@query("""select round(sum(case when logit < t and y = 0 then 1.0::double else 0 end) / sum(1 - y), 6) as specificity from b_cases,
  (select arg_min(thr, {'a': fpr, 'b': -thr}) as t from roc where tpr >= 0.9 - 1e-12)""")
def spec_at_sens(spark, d):
    c = B.cases(spark, d)
    return c.crossJoin(F.broadcast(M.threshold_at_sensitivity(c, "y", "logit", 0.9))).agg((F.count_if((F.col("y") == 0) & (F.col("logit") < F.col("threshold"))) / F.count_if(F.col("y") == 0)).alias("specificity"))


@query("select least(round(arg_max(thr, {'a': round(tpr - fpr, 12), 'b': thr}), 6), 1.0) as threshold from roc")
def youden_threshold(spark, d):
    return M.youden(B.cases(spark, d), "y", "logit")


@query(f"""select round(sum(abs(sp - sy)) / (select count(*) from b_cases), 6) as ece from (select b, sum(prob) as sp, sum(y) as sy from
  (select prob, y, cast(len(list_filter(list_transform(range(15), lambda i: i * (1.0::double / 15)), lambda e: e < prob)) as int) - 1 as b from b_cases) where b >= 0 group by b)""")
def ece(spark, d):
    return M.ece(B.cases(spark, d), "y", "prob")


@query("""select cast(r.i as int) as bin, printf('(%.1f, %.1f]', r.i / 10.0::double, (r.i + 1) / 10.0::double) as label, coalesce(n, 0) as n, round(mp, 6) as mean_predicted, round(ob, 6) as observed
  from range(10) r(i) left join (select b, count(*) as n, avg(prob) as mp, avg(y) as ob from (select prob, y, cast(len(list_filter(list_transform(range(10), lambda i: i * (1.0::double / 10)), lambda e: e < prob)) as int) - 1 as b from b_cases) group by b) x on r.i = x.b""")
def reliability_table(spark, d):
    return M.reliability(B.cases(spark, d), "y", "prob")


@query("""select round(1 - seen * total / chance, 6) as qwk from (select sum((grade - g2) * (grade - g2) / 16.0::double * n) as seen, sum(n) as total from k),
  (select sum((a.grade - b.g2) * (a.grade - b.g2) / 16.0::double * na * nb) as chance from (select grade, sum(n) as na from k group by 1) a, (select g2, sum(n) as nb from k group by 1) b)""".replace("select round", ", k as (select grade, (grade + h % 3) % 5 as g2, count(*) as n from b_cases group by 1, 2) select round", 1))
def qwk(spark, d):
    return M.qwk(B.cases(spark, d).withColumn("g2", (F.col("grade") + F.col("h") % 3) % 5), "grade", "g2")


@query(f"""select attribute, grp as "group", (tp + fp + tn + fn) as n, tp + fn as positives, round(tp / nullif(tp + fn, 0), 6) as sensitivity, round(tn / nullif(tn + fp, 0), 6) as specificity, round(auroc, 6) as auroc,
  (tp + fp + tn + fn < 30 or tp + fn < 10) as underpowered from (select attribute, grp, {_CONFUSION} from u group by 1, 2) join {_auroc("attribute, grp", "u")} using (attribute, grp)""".replace("select attribute", ", u as (select 'device' as attribute, device as grp, prob as s, 0.5 as t, y from b_cases union all select 'side', side, prob, 0.5, y from b_cases where side is not null) select attribute", 1))
def subgroup_report(spark, d):
    return M.subgroups(B.cases(spark, d), "y", "prob", 0.5, ["device", "side", "age_group"])


@query("select subject, max(grade) as grade from b_cases group by subject")
def worst_grade(spark, d):
    return O.worst_grade(B.cases(spark, d), "subject", "grade")


@query("select cast(k.k as int) as k, round(sum(case when grade <= k.k then 1 else 0 end) / greatest(sum(case when grade > k.k then 1 else 0 end), 1), 6) as weight from b_cases cross join range(4) k(k) group by 1")
def pos_weights(spark, d):
    return O.pos_weights(B.cases(spark, d), "grade", 5)


@query(f"select case_id, round(avg(logit + ({_hash('cast(case_id * 8 + k as varchar)')} % 200 - 100) / 1000.0::double), 6) as logit from b_cases cross join range(8) r(k) group by case_id")
def view_average(spark, d):
    return O.view_average(O.view_rows(B.cases(spark, d)), "case_id", "logit")


@query(f"""select case_id, round(avg(m), 6) as logit from (select case_id, case when k < 5 then 0 else 1 end as member, avg(logit + ({_hash('cast(case_id * 8 + k as varchar)')} % 200 - 100) / 1000.0::double) as m
  from b_cases cross join range(8) r(k) group by 1, 2) group by 1""")
def ensemble_average(spark, d):
    """Views of two members, five and three of them, averaged by member first."""
    return O.view_average(O.view_rows(B.cases(spark, d)).withColumn("member", (F.col("view") >= 5).cast("int")), "case_id", "logit", "member")


@query("select device, round(avg(logit), 6) as mean, round(stddev_pop(logit), 6) as sd from b_cases group by device")
def repeat_mean_sd(spark, d):
    return O.repeat_mean_sd(B.cases(spark, d), ["device"], "logit")


def _bands_sql(src: str) -> str:
    cov = ", ".join(f"({c}::double)" for c in COVERAGES)
    return f"""(select c, case when c >= 1 then 0.5 else 1 / (1 + exp(cut)) end as low, case when c >= 1 then 0.5 else 1 / (1 + exp(-cut)) end as high from (select c, case {" ".join(f"when c = {c} then quantile_cont(dd, 1 - {c}::double)" for c in COVERAGES)} end as cut
      from (values {cov}) v(c), (select abs(ln(p / (1 - p))) as dd from (select greatest(1e-7, least(1 - 1e-7, prob)) as p from {src})) group by c))"""


@query(f"select c as coverage, round(low, 6) as low, round(high, 6) as high from {_bands_sql('b_cases')}")
def abstention_bands(spark, d):
    return M.abstention_bands(B.cases(spark, d), "prob", 0.5, COVERAGES)


@query(f"""select c as coverage, round(low, 6) as low, round(high, 6) as high, round(ret / n, 6) as actual, ret as retained, n - ret as referred, case when p > 0 and q > 0 then round(tp / p, 6) end as sensitivity,
  case when p > 0 and q > 0 then round(tn / q, 6) end as specificity, case when p > 0 and q > 0 then p - tp end as missed from (select c, low, high, count(*) as n, count(*) filter (k) as ret, count(*) filter (k and y = 1) as p, count(*) filter (k and y = 0) as q,
  count(*) filter (k and y = 1 and prob >= 0.5) as tp, count(*) filter (k and y = 0 and prob < 0.5) as tn from (select *, prob <= low or prob >= high as k from b_cases cross join {_bands_sql("(select * from b_cases where device in ('click', 'view'))")} where device = 'purchase') group by 1, 2, 3)""")
def abstention_curve(spark, d):
    c = B.cases(spark, d)
    return M.abstention_curve(c.where("device = 'purchase'"), "y", "prob", 0.5, c.where("device in ('click', 'view')"), COVERAGES)


@query()
def fit_temperature(spark, d):
    return M.fit_temperature(B.cases(spark, d), "logit", "y")


@query("select case_id, verdict_id, verdict, cast(grade as int) as grade, grader, cast(dme as int) as dme, revisions from latest")
def latest_verdict_join(spark, d):
    return O.latest_verdict(B.verdicts(spark, d))


@query("select case_id, outcome, origin from outcomes")
def effective_outcome(spark, d):
    return O.effective_outcomes(B.predictions(spark, d), B.verdicts(spark, d)).select("case_id", "outcome", "origin")


_SIDES = """, ranked as (select visit, side, outcome, case_id, origin, row_number() over (partition by visit, side order by case outcome when 'REFER' then 2 when 'MANUAL_REVIEW' then 1 else 0 end desc, case_id) as rk,
  bool_and(origin = 'grader') over (partition by visit, side) as all_human from outcomes where side is not null), sides as (select * from ranked where rk = 1),
dec as (select o.visit, count(*) filter (o.side is null) as unlabelled from outcomes o group by 1),
vis as (select d.visit, d.unlabelled, s.f, coalesce(s.l, false) as l, coalesce(s.r, false) as r, coalesce(s.h, false) as h from dec d left join
  (select visit, list(outcome) as f, bool_or(side = 'left') as l, bool_or(side = 'right') as r, bool_and(all_human) as h from sides group by 1) s on d.visit = s.visit),
visits as (select visit, case when list_contains(f, 'REFER') then 'REFER' when list_contains(f, 'MANUAL_REVIEW') then 'MANUAL_REVIEW' when not (l and r) then 'INCOMPLETE' else 'ROUTINE' end as decision,
  case when l and r then '' when l then 'right' when r then 'left' else 'left,right' end as missing, h and l and r as final, unlabelled from vis)
"""


@query(_SIDES + "select visit, side, outcome, case_id, all_human from sides")
def side_outcome(spark, d):
    return O.side_outcomes(O.effective_outcomes(B.predictions(spark, d), B.verdicts(spark, d)))


@query(_SIDES + "select visit, decision, missing, final, unlabelled from visits")
def visit_decision(spark, d):
    return O.visit_decisions(O.effective_outcomes(B.predictions(spark, d), B.verdicts(spark, d)))


@query(_SIDES + "select visit, missing from visits where missing <> ''")
def missing_side_except(spark, d):
    return O.visit_decisions(O.effective_outcomes(B.predictions(spark, d), B.verdicts(spark, d))).where("missing <> ''").select("visit", "missing")


@query("select visit, max(subject) as subject, cast(min(created) as varchar) as first_utc, cast(max(created) as varchar) as last_utc, count(*) as cases from b_predictions group by visit")
def visit_heads(spark, d):
    return O.visit_heads(B.predictions(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("first_utc", "last_utc")})


@query("""select case_id, decision, round(probability, 6) as probability from b_predictions order by case decision when 'MANUAL_REVIEW' then 0 when 'REFER' then 1 else 2 end, probability desc nulls last, created desc, case_id desc limit 200""")
def worklist(spark, d):
    return O.worklist(B.predictions(spark, d)).select("case_id", "decision", "probability")


@query("""select decision, round(med, 6) as median, case_id from (select *, row_number() over (partition by decision order by round(abs(probability - med), 9), case_id) as rk
  from (select *, median(probability) over (partition by decision) as med from b_predictions where probability is not null)) where rk = 1""")
def median_case(spark, d):
    return O.median_cases(B.predictions(spark, d), "decision", "probability", "case_id").select("decision", "median", "case_id")


@query("select case_id, string_agg(verdict, '>' order by case_created, row_id) as history, count(*) as n from b_verdicts group by case_id")
def case_timeline(spark, d):
    return O.case_timeline(B.verdicts(spark, d))


@query(f"select strftime(created, '%G-W%V') as week, {_RATES} from outcomes group by 1")
def weekly_rates(spark, d):
    return M.rates(B.predictions(spark, d).withColumn("week", C.iso_week(F.col("created"))), O.latest_verdict(B.verdicts(spark, d)), ["week"])


_SPLIT = f""", subj as (select subject, max(grade) as stratum, {_U("split", "subject")} as u from b_cases group by subject),
split as (select subject, cast(stratum as int) as stratum, case when sh < 0.7 then 'train' when sh < 0.85 then 'val' else 'test' end as split from
  (select *, (row_number() over (partition by stratum order by u, subject) - 0.5) / count(*) over (partition by stratum) as sh from subj)) """


@query(_SPLIT + "select subject, stratum, split from split")
def split_by_subject(spark, d):
    return O.split_by_subject(B.cases(spark, d), "subject", "grade")


@query(_SPLIT + "select s.split, count(*) as n, count(distinct c.subject) as subjects, sum(y)::bigint as positives from b_cases c join split s on c.subject = s.subject group by 1")
def semi_select_split(spark, d):
    c = B.cases(spark, d)
    return O.selected_split(c, O.split_by_subject(c, "subject", "grade"), "subject").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"), F.sum("y").alias("positives"))


@query("select subject, string_agg(distinct cast(case_id % 3 as varchar), ',' order by cast(case_id % 3 as varchar)) as splits, count(distinct case_id % 3) as n from b_cases group by subject having count(distinct case_id % 3) > 1")
def leakage_intersect(spark, d):
    return O.leaks(B.cases(spark, d).withColumn("fold", (F.col("case_id") % 3).cast("string")), "subject", "fold")


@query(f"select case_id, y, (row_number() over (partition by y order by {_U('fold', 'case_id')}, case_id) - 1) % 5 as fold from b_cases")
def stratified_kfold(spark, d):
    return O.stratified_folds(B.cases(spark, d), "case_id", "y").withColumn("fold", F.col("fold").cast("long"))


@query("select content_md5, count(*) as n from b_dups group by 1 having count(*) > 1")
def exact_duplicates(spark, d):
    return O.exact_duplicates(B.duplicates(spark, d), "content_md5")


@query("select content_md5, count(*) as n, count(distinct grade) as labels, case when count(distinct grade) = 1 then min(row_id) end as keep from b_dups group by 1 having count(*) > 1")
def label_conflicts(spark, d):
    return O.label_conflicts(B.duplicates(spark, d), "content_md5", "grade", "row_id")


@query("select user_id, event_type, count(*) as n from events group by all having count(*) > 1")
def duplicate_key_check(spark, d):
    return B.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 1")


_CODE = lambda kind, x: f"""substr(sha256(unhex(repeat('5c', 64)) || unhex(sha256(unhex(repeat('36', 64)) || encode('{kind}:' || {x})))), 1, 16)"""


@query(f"""select subject_code, case_code, visit_code, month, gradable, referable, case when cast('0x' || substr(subject_code, 1, 8) as bigint) / 4294967295.0::double < 0.2 then 'locked_test' else 'train' end as split
  from (select {_CODE("subject", "subject")} as subject_code, {_CODE("case", "case_id")} as case_code, {_CODE("visit", "visit")} as visit_code, strftime(created, '%Y-%m') as month, gradable, y as referable from b_predictions)""")
def pseudonymise(spark, d):
    return O.pseudonymise(B.predictions(spark, d), KEY)


@query(""", hist as (select subject as run, row_number() over (partition by subject order by created, case_id) as epoch, prob from b_cases),
best as (select *, (select min(h2.epoch) from hist h2 where h2.run = h.run and h2.epoch <= h.epoch and h2.prob = h.mx) as best from (select *, max(prob) over (partition by run order by epoch) as mx from hist) h),
stop as (select run, min(epoch) as stop_epoch from best where epoch - best >= 7 group by run)
select b.run, max(best) as best_epoch, max(stop_epoch) as stop_epoch from best b left join stop s on b.run = s.run where s.stop_epoch is null or b.epoch <= s.stop_epoch group by 1""")
def early_stop(spark, d):
    from pyspark.sql import Window as W

    h = B.cases(spark, d).select(F.col("subject").alias("run"), F.row_number().over(W.partitionBy("subject").orderBy("created", "case_id")).cast("long").alias("epoch"), "prob")
    return O.early_stop(h, "run", "epoch", "prob")


@query("select q.item, q.filename from b_quality q where q.subject not in (select source from documents where doc_id % 97 = 0)")
def filter_seen(spark, d):
    seen = B.table(spark, d, "documents").where("doc_id % 97 = 0").select(F.col("source").alias("subject")).distinct()
    return B.quality(spark, d).join(seen, "subject", "left_anti").select("item", "filename")


@query("""select device, lo as low, hi as high from (select device, round(greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) as lo,
  round(least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) as hi from (select device, avg(y) as p, count(*)::double as n from b_cases group by device))""")
def wilson_ci(spark, d):
    k = B.cases(spark, d).groupBy("device").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    return k.select("device", C.wilson(F.col("k"), F.col("n").cast("double")).alias("ci")).select("device", "ci.low", "ci.high")


@query("select event_type as action, user_id as entity, max(event_id) as seq, arg_max(props, event_id) as detail from events group by 1, 2")
def last_event(spark, d):
    log = B.table(spark, d, "events").select("event_id", "props", F.col("event_type").alias("action"), F.col("user_id").alias("entity"))
    return O.last_event(log, ["action", "entity"], "event_id", "props")


@query("select visit, string_agg(case_id, ',' order by created, case_id) as cases, count(*) as n from b_predictions group by visit")
def visit_cases_join(spark, d):
    return O.visit_cases(B.predictions(spark, d))


@query("select p.case_id from b_predictions p where not exists (select 1 from b_verdicts v where v.case_id = p.case_id)")
def anti_unanchored(spark, d):
    return B.predictions(spark, d).join(B.verdicts(spark, d).select("case_id"), "case_id", "left_anti").select("case_id")


@query("select case_id, sha256(concat_ws(chr(31), 'case_id=' || case_id, 'decision=' || decision, 'grade=' || grade, 'side=' || side)) as record_sha256 from b_predictions")
def canonical_hash(spark, d):
    return O.canonical_hash(B.predictions(spark, d), ["decision", "case_id", "side", "grade"]).select("case_id", "record_sha256")


@query(f""", subj as (select subject, max(grade) as stratum, {_U("site", "subject")} as u from b_cases group by subject)
select subject, case when sh < 0.5 then 'calibration' else 'evaluation' end as part from (select *, (row_number() over (partition by stratum order by u, subject) - 0.5) / count(*) over (partition by stratum) as sh from subj)""")
def split_site_half(spark, d):
    return O.halves_by_subject(B.cases(spark, d), "subject", "grade")


@query(""", r as (select unnest(list_filter([case when blur_var < 500 then 'low sharpness: ' || blur_var end, case when p_ungradable > 0.6 then 'model (score)' end, case when reason_flag = 1 then 'flagged' end], lambda x: x is not null)) as reason from b_quality)
select trim(split_part(split_part(reason, ':', 1), '(', 1)) as reason, count(*) as n from r group by 1""")
def reject_reason_counts(spark, d):
    q = B.quality(spark, d)
    reasons = F.array_compact(F.array(
        F.when(F.col("blur_var") < 500, F.concat(F.lit("low sharpness: "), F.col("blur_var").cast("string"))), F.when(F.col("p_ungradable") > 0.6, F.lit("model (score)")), F.when(F.col("reason_flag") == 1, F.lit("flagged")),
    ))
    return O.reason_counts(q.select(reasons.alias("reasons")), "reasons")


@query("""select round(case when k < n then v else mn end, 6) as threshold, k < n as strict from (select count(*) as n, cast(floor(0.05 * count(*)) as bigint) as k, min(p_ungradable) as mn, list_sort(list(p_ungradable), 'DESC')[cast(floor(0.05 * count(*)) as bigint) + 1] as v
  from b_quality where reject = 0)""")
def max_false_reject_threshold(spark, d):
    return M.max_false_reject_threshold(B.quality(spark, d), "reject", "p_ungradable", 0.05)
