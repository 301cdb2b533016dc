"""Queries of the exact resample of subjects, with oracles that take the same draws down the same tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from caselight.operators import calibration as K
from caselight.operators import reports as R
from caselight.operators import resampling as S
from caselight.plans.calibration import _SIG, _ece_sql
from caselight.plans.catalog import _CONFUSION, _DIVIDED, _U, _auroc, query
from caselight.sources import bridge as B

#: Replicates of the queries whose oracle makes a curve of each, and the levels of the oracles' tree (up to 2048 subjects).
REPLICATES, LEVELS = 200, 11


def _weights_sql(replicates: int, src: str = "b_cases") -> str:
    """CTEs that end in w(subject, r, w): draws halved level by level; the least k whose binomial distribution function exceeds a uniform number goes left."""
    out = [
        f"w_u as (select subject, {_U('resample', 'subject')} as u from (select distinct subject from {src}))",
        "w_s as (select subject, row_number() over (order by u, subject) - 1 as i, count(*) over () as total from w_u)",
        f"w_0 as (select 0::bigint as k, r, (select count(*) from w_s) as draws from range({replicates}) t(r))",
    ]
    for level in range(LEVELS):
        size, left = f"((k + 1) * total // {1 << level} - k * total // {1 << level})", f"((2 * k + 1) * total // {2 << level} - k * total // {1 << level})"
        u = f"cast('0x' || substr(md5('resample:{level}:' || k || ':' || r // 4), 1 + 8 * (r % 4), 8) as bigint) / 4294967296.0::double"
        mass = "exp(lgamma(draws + 1) - lgamma(x + 1) - lgamma(draws - x + 1) + x * ln(p) + (draws - x) * ln(1 - p))"
        out += [
            f"w_p{level} as (select k, r, draws, lft, sz, lft / nullif(sz, 0)::double as p, u from (select k, r, draws, {left} as lft, {size} as sz, {u} as u from w_{level}, (select count(*) as total from w_s)))",
            f"w_c{level} as (select k, r, count(*) filter (c <= u) as low from (select k, r, u, sum({mass}) over (partition by k, r order by x) as c from (select *, unnest(range(draws)) as x from w_p{level} where lft > 0 and lft < sz)) group by 1, 2)",
            f"w_l{level} as (select a.k, a.r, draws, case when lft = 0 then 0 when lft = sz then draws else coalesce(low, 0) end as low from w_p{level} a left join w_c{level} b on a.k = b.k and a.r = b.r)",
            f"w_{level + 1} as (select 2 * k as k, r, low as draws from w_l{level} union all select 2 * k + 1, r, draws - low from w_l{level})",
        ]
    out.append(f"w as (select subject, r, draws as w from w_s join w_{LEVELS} on k = ((i + 1) * {1 << LEVELS} - 1) // total where draws > 0)")
    return ", ".join(out)


def _rates_sql(src: str) -> str:
    """CTEs rates(r, sensitivity, specificity) and rate0(sensitivity, specificity); src has subject, s, t, y."""
    return f"""rate_s as (select subject, {_CONFUSION} from {src} group by subject),
    rates as (select r, sum(w * tp) / nullif(sum(w * (tp + fn)), 0) as sensitivity, sum(w * tn) / nullif(sum(w * (tn + fp)), 0) as specificity from rate_s join w using (subject) group by r),
    rate0 as (select sum(tp) / nullif(sum(tp + fn), 0) as sensitivity, sum(tn) / nullif(sum(tn + fp), 0) as specificity from rate_s)"""


def _curves_sql(src: str) -> str:
    """CTEs area(r, auroc) and spec(r, spec_at_sens) with each replicate's own threshold; src has subject, s, y."""
    return f"""cv_g as (select r, s, sum(w * y)::bigint as pos, sum(w * (1 - y))::bigint as neg from {src} join w using (subject) where s is not null group by 1, 2),
    cv_c as (select *, sum(pos) over v as tps, sum(neg) over v as fps, sum(pos) over (partition by r) as ap, sum(neg) over (partition by r) as an from cv_g window v as (partition by r order by s desc)),
    area as (select r, sum(neg * (tps - pos / 2.0::double)) / nullif(sum(pos)::double * sum(neg), 0) as auroc from cv_c group by r),
    cv_k as (select *, coalesce(lead(fps) over v - fps <> fps - lag(fps) over v or lead(tps) over v - tps <> tps - lag(tps) over v, true) as keep from cv_c window v as (partition by r order by s desc)),
    spec as (select r, 1 - min(fps) / max(an) as spec_at_sens from cv_k where keep and ap > 0 and an > 0 and tps / ap >= 0.9::double - 1e-12 group by r)"""


_CI = lambda t, m: f"round((select quantile_cont({m}, 0.025) from {t}), 6) as {m}_low, round((select quantile_cont({m}, 0.975) from {t}), 6) as {m}_high"
_ROW = lambda t, m, point: f"select '{m}' as metric, round({point}, 6) as point, round(quantile_cont({m}, 0.025), 6) as low, round(quantile_cont({m}, 0.975), 6) as high, count({m}) as n_boot from {t}"
_ONE = lambda src: _auroc("1 as one", src).replace("group by 1 as one", "").replace("partition by 1 as one ", "")
_PROB = "(select subject, prob as s, 0.5 as t, y from b_cases)"
_LOGIT = "(select subject, logit as s, y from b_cases)"
#: The specificity of all rows at their own threshold, from the catalog's curve.
_SPEC0 = "(select 1 - min(fpr) from roc where tpr >= 0.9::double - 1e-12)"


@query(f", {_weights_sql(1000)}, {_rates_sql(_PROB)} {_ROW('rates', 'sensitivity', '(select sensitivity from rate0)')} union all {_ROW('rates', 'specificity', '(select specificity from rate0)')}")
def subject_bootstrap(spark, d):
    """Sensitivity and specificity; every replicate draws as many subjects as there are."""
    return K.resample_rates(B.cases(spark, d), "y", "prob", F.lit(0.5), "subject")


@query(f", {_weights_sql(50)} select subject, sum(w)::bigint as drawn, count(*) as replicates, sum(w * r)::bigint as checked from w group by 1")
def resample_weights(spark, d):
    """Each subject's draws over 50 replicates."""

    @F.pandas_udf("array<int>")
    def numbers(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: np.frombuffer(x, dtype="<i4").tolist())

    w = S.resample_weights(B.cases(spark, d), "subject", 50).select("subject", F.posexplode(numbers("weights")).alias("r", "w")).where("w > 0")
    return w.groupBy("subject").agg(F.sum("w").alias("drawn"), F.count("*").alias("replicates"), F.sum(F.col("w") * F.col("r")).alias("checked"))


@query(f", {_weights_sql(REPLICATES)}, {_curves_sql(_LOGIT)} {_ROW('area', 'auroc', f'(select auroc from {_ONE(_LOGIT)})')} union all {_ROW('spec', 'spec_at_sens', _SPEC0)}")
def area_intervals(spark, d):
    """Exact area under the curve, and the specificity at a sensitivity of 0.9 with a threshold of its own in every replicate."""
    return S.resample_areas(B.cases(spark, d), "y", "logit", "subject", REPLICATES)


_KAPPA = lambda src, by: f"""select {by} 1 - seen * total / nullif(chance, 0)::double as kappa from (select {by} sum((grade - g2) * (grade - g2) * n) as seen, sum(n) as total from {src} group by all) a
  join (select {by} sum((x.grade - y.g2) * (x.grade - y.g2) * na * nb) as chance from (select {by} grade, sum(n) as na from {src} group by all) x join (select {by} g2, sum(n) as nb from {src} group by all) y {f"using ({by.rstrip(', ')})" if by else "on true"} group by all) b {f"using ({by.rstrip(', ')})" if by else "on true"}"""  # noqa: E731


@query(f""", {_weights_sql(REPLICATES)}, kc as (select subject, grade, (grade + h % 3) % 5 as g2, count(*) as n from b_cases group by all), kr as (select r, grade, g2, sum(n * w)::bigint as n from kc join w using (subject) group by all),
  k0 as (select grade, g2, sum(n)::bigint as n from kc group by all), kb as ({_KAPPA('kr', 'r, ')}) {_ROW('kb', 'kappa', f"(select kappa from ({_KAPPA('k0', '')}))")}""")
def resampled_kappa(spark, d):
    """Weighted kappa as a free function of the cells of two grades."""

    def kappa(cells: pd.DataFrame, n: np.ndarray) -> float:
        a, b = cells["grade"].to_numpy(), cells["g2"].to_numpy()
        gap = lambda x, y: (x - y) ** 2
        rows, cols = (pd.Series(n).groupby(x).sum() for x in (a, b))
        chance = sum(float(na) * float(nb) * gap(x, y) for x, na in rows.items() for y, nb in cols.items())
        return 1 - float((gap(a, b) * n).sum()) * n.sum() / chance if chance else float("nan")

    c = B.cases(spark, d).withColumn("g2", (F.col("grade") + F.col("h") % 3) % 5)
    return S.resample_callable(c, "subject", ["grade", "g2"], kappa, "kappa", REPLICATES)


_CELLS = f"(select {_CONFUSION} from (select prob as s, 0.5 as t, y from b_cases)) c"


@query(f""", {_weights_sql(REPLICATES)}, {_rates_sql(_PROB)}, {_curves_sql(_LOGIT)}, kc as (select grade, (grade + h % 3) % 5 as g2, count(*) as n from b_cases group by all)
select {_DIVIDED.replace("tp, fp, tn, fn, ", "c.tp, c.fp, c.tn, c.fn, ", 1)}, round(a.auroc, 6) as auroc, round(a.auprc, 6) as auprc, round({_ece_sql('b_cases', 'prob')}, 6) as ece, {_CI('rates', 'sensitivity')}, {_CI('rates', 'specificity')},
  {_CI('area', 'auroc')}, {_CI('spec', 'spec_at_sens')}, round({_SPEC0}, 6) as spec_at_sens, (select count(auroc) from area) as auroc_n_boot, round((select kappa from ({_KAPPA('kc', '')})), 6) as qwk from {_CELLS} cross join {_ONE(_LOGIT)} a""")
def full_report(spark, d):
    c = B.cases(spark, d).withColumn("g2", (F.col("grade") + F.col("h") % 3) % 5)
    return K.full_report(c, "y", "logit", "prob", "subject", grades=("grade", "g2"), replicates=REPLICATES)


_EXTERNAL = "(select subject, prob as s, case when prob >= 0.45 then 1 else 0 end as c, y from b_cases where gradable = 1 and h % 6 <> 0)"


@query(f""", ext as {_EXTERNAL}, {_weights_sql(REPLICATES, 'ext')}, {_curves_sql('ext')}
select {_DIVIDED}, round(auroc, 6) as auroc, {_CI('area', 'auroc')}, (select count(auroc) from area) as n_boot from (select {_CONFUSION} from (select c as s, 1 as t, y from ext)) cross join {_ONE('ext')}""")
def external_report(spark, d):
    c = B.cases(spark, d).withColumn("y", F.when(F.col("h") % 6 != 0, F.col("y"))).withColumn("call", F.col("prob") >= 0.45)
    return R.external_report(c, "y", "prob", "call", "subject", replicates=REPLICATES)


_FOLDS = "(select subject, prob as s, (40 + (case_id % 5) * 5) / 100.0::double as t, y from b_cases)"


@query(f""", {_weights_sql(REPLICATES)}, {_rates_sql(_FOLDS)}, {_curves_sql(_LOGIT)}
select {_DIVIDED}, round(auroc, 6) as auroc, round({_ece_sql('b_cases', 'prob')}, 6) as ece, {_CI('rates', 'sensitivity')}, {_CI('rates', 'specificity')}, {_CI('area', 'auroc')}, (select count(auroc) from area) as n_boot
from (select {_CONFUSION} from {_FOLDS}) cross join {_ONE(_LOGIT)}""")
def oof_report(spark, d):
    cut = (40 + (F.col("case_id") % 5) * 5) / F.lit(100.0)
    return R.oof_report(B.cases(spark, d).withColumn("cut", cut), "y", "logit", "prob", "cut", "subject", REPLICATES)
