"""Queries of calibration and resampling, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.functions import columns as C
from caselight.operators import calibration as K
from caselight.operators import metrics as M
from caselight.operators import sites as S
from caselight.operators import tables as O
from caselight.operators.fits import fit_temperatures, interpolated, isotonic_fits
from caselight.operators.store import written
from caselight.plans.catalog import _CONFUSION, _DIVIDED, ORACLES, VIEWS, _auroc, _hash, _U, query
from caselight.sources import bridge as B

_SIG = lambda z: f"(1 / (1 + exp(-greatest(-30.0::double, least(30.0::double, {z})))))"


def _temperature_sql(name: str, src: str) -> str:
    """CTEs that end in {name}(t): the grid of 400 steps, then 50 around its best."""
    loss = lambda grid: f"""select arg_min(t, {{'a': l, 'b': t}}) as t from (select t, round(sum(-n * ln(case when y = 1 then p else 1 - p end)), 6) as l from (select t, y, n, greatest(1e-7::double, least((1 - 1e-7)::double, {_SIG('z / t')})) as p
      from (select logit as z, y, count(*) as n from {src} group by 1, 2), {grid}) group by t)"""  # noqa: E731
    step = "((10 - 0.05::double) / 399)"
    first = loss(f"(select 0.05::double + i * {step} as t from range(400) r(i))")
    lo, hi = "greatest(0.05::double, t - (10 - 0.05::double) / 400)", "least(10::double, t + (10 - 0.05::double) / 400)"
    return f"{name}_a as ({first}), {name} as ({loss(f'(select {lo} + i * (({hi} - {lo}) / 49) as t from {name}_a, range(50) r(i))')})"


def _isotonic_sql(name: str, src: str) -> str:
    """CTEs that end in {name}(x, fitted) over the distinct scores: the largest, over starts, of the least mean from there to any end."""
    return f"""{name}_g as (select logit as x, sum(y)::double as s, count(*) as n from {src} group by 1), {name}_c as (select *, sum(s) over w as cs, sum(n) over w as cn from {name}_g window w as (order by x)),
    {name} as (select x, max(least_mean) as fitted from (select b.x, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)::double) over (partition by a.x order by b.x desc) as least_mean from {name}_c a join {name}_c b on a.x <= b.x) group by 1)"""


def _between_sql(rows: str, iso: str) -> str:
    """rows with fitted: a straight line between the fitted scores beside each, the ends beyond them."""
    return f"""(select r.*, case when l.x is null then u.fitted when u.x is null or u.x = l.x then l.fitted else l.fitted + (r.logit - l.x) / (u.x - l.x) * (u.fitted - l.fitted) end as fitted
      from {rows} r asof left join {iso} l on r.logit >= l.x asof left join {iso} u on r.logit <= u.x)"""


def _ece_sql(src: str, p: str) -> str:
    return f"""(select sum(abs(sp - sy)) filter (b >= 0) / sum(n) from (select b, count(*) as n, sum(p) as sp, sum(y) as sy from (select p, y, cast(len(list_filter(list_transform(range(15), lambda i: i * (1.0::double / 15)), lambda x: x < p)) as int) - 1 as b from (select {p} as p, y from {src})) group by 1))"""


ORACLES["fit_temperature"] = VIEWS + ", " + _temperature_sql("tt", "b_cases") + " select round(t, 6) as temperature from tt"


@query(", " + _isotonic_sql("iso", "b_cases") + " select round(x, 6) as logit, round(fitted, 6) as fitted from iso")
def fit_isotonic(spark, d):
    c = B.cases(spark, d)
    return K.apply_isotonic(c.select("logit").distinct(), "logit", K.fit_isotonic(c, "logit", "y"), "fitted")


@query(", part as (select * from b_cases where device in ('click', 'view')), " + _isotonic_sql("iso", "part") + " select case_id, round(fitted, 6) as calibrated from " + _between_sql("b_cases", "iso"))
def apply_isotonic(spark, d):
    c = B.cases(spark, d)
    return K.apply_isotonic(c, "logit", K.fit_isotonic(c.where("device in ('click', 'view')"), "logit", "y")).select("case_id", "calibrated")


_PARTS = f""", fit as (select *, {_SIG('logit')} as p from b_cases where {_U('holdout', 'case_id')} >= 0.3), held as (select *, {_SIG('logit')} as p from b_cases where {_U('holdout', 'case_id')} < 0.3),
{_temperature_sql('tt', 'fit')}, {_isotonic_sql('iso', 'fit')}, m as (select 'identity' as method, 0 as k, {_ece_sql('held', 'p')} as ece union all select 'temperature', 1, {_ece_sql('(select * from held, tt)', _SIG('logit / t'))}
union all select 'isotonic', 2, {_ece_sql(_between_sql('held', 'iso'), 'fitted')})"""


@query(_PARTS + " select method, round(ece, 6) as ece, k = (select arg_min(k, {'a': round(ece, 9), 'b': k}) from m) as chosen from m")
def calibrator_select(spark, d):
    return K.select_calibrator(*K.holdout(B.cases(spark, d), "case_id"), "logit", "y")


@query(_PARTS + f""", best as (select arg_min(method, {{'a': round(ece, 9), 'b': k}}) as method from m)
select case_id, (select method from best) as method, round(case (select method from best) when 'identity' then {_SIG('logit')} when 'temperature' then {_SIG('logit / (select t from tt)')} else greatest(0, least(1, fitted)) end, 6) as probability from {_between_sql('b_cases', 'iso')}""")
def calibrator_apply(spark, d):
    """All cases under a stored profile: the calibrator that is best on held-out cases, its parameters, threshold and band."""
    c = B.cases(spark, d)
    profile = K.fit_profile(c, "case_id", "logit", "y")
    return K.calibrated(c, "logit", profile, "probability").crossJoin(F.broadcast(profile.select("method"))).select("case_id", "method", "probability")


def _threshold_sql(name: str, src: str) -> str:
    """CTEs that end in {name}(thr): as the query threshold_at_sensitivity, of another table."""
    return f"""{name}_c as (select logit as thr, sum(sum(y)) over w as tps, sum(sum(1 - y)) over w as fps from {src} group by logit window w as (order by logit desc)),
    {name}_k as (select *, coalesce(lead(fps) over w - fps <> fps - lag(fps) over w or lead(tps) over w - tps <> tps - lag(tps) over w, true) as keep from {name}_c window w as (order by thr desc)),
    {name} as (select coalesce(arg_min(thr, {{'a': fps, 'b': -thr}}), 0.5) as thr from {name}_k where keep and tps / (select max(tps) from {name}_c) >= 0.9 - 1e-12)"""


def _profile_sql(label: str, src: str, t: str, thr: str) -> str:
    return f"""select '{label}' as profile, round(t, 6) as temperature, round(thr, 6) as threshold, count(*) as n, round(count(*) filter (logit >= thr and y = 1) / count(*) filter (y = 1), 6) as sensitivity, round(count(*) filter (logit < thr and y = 0) / count(*) filter (y = 0), 6) as specificity,
      round({_ece_sql(f'(select * from {src}, {t})', _SIG('logit / t'))}, 6) as ece from {src}, {t}, {thr} group by t, thr"""


_SITE = f""", subj as (select subject, max(grade) as stratum, {_U("site", "subject")} as u from b_cases where device = 'purchase' group by subject),
half as (select subject, (row_number() over (partition by stratum order by u, subject) - 0.5) / count(*) over (partition by stratum) < 0.5 as cal from subj), src as (select * from b_cases where device in ('click', 'view')),
cal as (select c.* from b_cases c join half h on c.subject = h.subject where device = 'purchase' and cal), ev as (select c.* from b_cases c join half h on c.subject = h.subject where device = 'purchase' and not cal),
{_temperature_sql('ts', 'src')}, {_threshold_sql('hs', 'src')}, {_temperature_sql('tc', 'cal')}, {_threshold_sql('hc', 'cal')} """


def _site(spark, d):
    c = B.cases(spark, d)
    site = c.where("device = 'purchase'")
    parts = site.join(O.halves_by_subject(site, "subject", "grade"), "subject")
    parts = written(parts.select("case_id", "logit", "y", "part"), "halves")  # both halves are read several times
    return parts.where("part = 'calibration'"), parts.where("part = 'evaluation'"), c.where("device in ('click', 'view')")


@query(_SITE + _profile_sql("site", "ev", "tc", "hc") + " union all " + _profile_sql("source", "ev", "ts", "hs"))
def site_calibration(spark, d):
    return K.site_calibration(*_site(spark, d), "logit", "y")


@query(_SITE + _profile_sql("source", "(select * from b_cases where device = 'purchase')", "ts", "hs"))
def source_profile_score(spark, d):
    c = B.cases(spark, d)
    return K.profile_score(c.where("device = 'purchase'"), "logit", "y", K.profile(c.where("device in ('click', 'view')"), "logit", "y")).select(F.lit("source").alias("profile"), "*")


@query(f""", tr as (select * from b_cases where device <> 'signup'), lk as (select * from b_cases where device = 'signup'), {_temperature_sql('tt', 'tr')}, {_threshold_sql('hh', 'tr')} """ + _profile_sql("candidate", "lk", "tt", "hh"))
def recalibrate_candidate(spark, d):
    c = B.cases(spark, d)
    return K.recalibrated(c.where("device <> 'signup'"), c.where("device = 'signup'"), "logit", "y").select(F.lit("candidate").alias("profile"), "*")


def _grouped_temperature_sql(name: str, src: str) -> str:
    """CTEs that end in {name}(repeat, fold, t): as _temperature_sql(), of each group of src."""
    loss = lambda grid, on: f"""select repeat, fold, arg_min(t, {{'a': l, 'b': t}}) as t from (select repeat, fold, t, round(sum(-n * ln(case when y = 1 then p else 1 - p end)), 6) as l
      from (select c.repeat, c.fold, t, y, n, greatest(1e-7::double, least((1 - 1e-7)::double, {_SIG('z / t')})) as p from {name}_n c join {grid} g on {on}) group by all) group by all"""  # noqa: E731
    step = "((10 - 0.05::double) / 399)"
    lo, hi = "greatest(0.05::double, t - (10 - 0.05::double) / 400)", "least(10::double, t + (10 - 0.05::double) / 400)"
    return f"""{name}_n as (select repeat, fold, logit as z, y, count(*) as n from {src} group by all), {name}_a as ({loss(f"(select 0.05::double + i * {step} as t from range(400) r(i))", "true")}),
    {name} as ({loss(f"(select repeat, fold, {lo} + i * (({hi} - {lo}) / 49) as t from {name}_a, range(50) r(i))", "c.repeat = g.repeat and c.fold = g.fold")})"""


def _grouped_isotonic_sql(name: str, src: str) -> str:
    """CTEs that end in {name}(repeat, fold, x, fitted): as _isotonic_sql(), of each group of src."""
    return f"""{name}_c as (select *, sum(s) over w as cs, sum(n) over w as cn from (select repeat, fold, logit as x, sum(y)::double as s, count(*) as n from {src} group by all) window w as (partition by repeat, fold order by x)),
    {name} as (select repeat, fold, x, max(least_mean) as fitted from (select b.repeat, b.fold, b.x, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)::double) over (partition by a.repeat, a.fold, a.x order by b.x desc) as least_mean
      from {name}_c a join {name}_c b on a.repeat = b.repeat and a.fold = b.fold and a.x <= b.x) group by all)"""


def _arms_sql(rows: str) -> str:
    """rows with p0, p1, p2: the probabilities of the three methods of their group."""
    return f"""(select r.*, t.t, {_SIG('r.logit')} as p0, {_SIG('r.logit / t.t')} as p1, case when l.x is null then u.fitted when u.x is null or u.x = l.x then l.fitted else l.fitted + (r.logit - l.x) / (u.x - l.x) * (u.fitted - l.fitted) end as p2
      from {rows} r join ct t on r.repeat = t.repeat and r.fold = t.fold asof left join ci l on r.repeat = l.repeat and r.fold = l.fold and r.logit >= l.x asof left join ci u on r.repeat = u.repeat and r.fold = u.fold and r.logit <= u.x)"""


_BIN = "cast(len(list_filter(list_transform(range(15), lambda i: i * (1.0::double / 15)), lambda x: x < p)) as int) - 1"
_GROUP_ECE = lambda src, by: f"(select {by}, sum(abs(sp - sy)) filter (b >= 0) / sum(n) as ece from (select {by}, {_BIN} as b, count(*) as n, sum(p) as sp, sum(y) as sy from {src} group by all) group by all)"
_ARM = " union all ".join(f"select repeat, fold, y, {k} as k, p{k} as p from held" for k in range(3))

_CROSS = f""", runs as (select case_id, logit, y, cast(i as int) as repeat, cast((row_number() over (partition by i, y order by {_hash("'crossfit:' || i || ':' || case_id")}, case_id) - 1) % 2 as int) as fold from b_cases c cross join range(5) r(i) where device = 'purchase'),
fits as (select case_id, logit, y, repeat, 1 - fold as fold, {_hash("'holdout:' || repeat || ':' || (1 - fold) || ':' || case_id")} / 4294967296.0::double < 0.3 as held from runs), used as (select * from fits where not held),
{_grouped_temperature_sql('ct', 'used')}, {_grouped_isotonic_sql('ci', 'used')}, held as materialized (select * from {_arms_sql('(select * from fits where held)')}),
arm as ({_ARM}), tried as (select * from {_GROUP_ECE('arm', 'repeat, fold, k')}), best as (select repeat, fold, arg_min(k, {{'a': round(ece, 9), 'b': k}}) as k from tried group by all),
fitp as materialized (select a.repeat, a.fold, y, case k when 0 then p0 when 1 then p1 else p2 end as p from {_arms_sql('fits')} a join best b on a.repeat = b.repeat and a.fold = b.fold),
cc as (select repeat, fold, p, sum(sum(y)) over w as tps, sum(sum(1 - y)) over w as fps from fitp group by repeat, fold, p window w as (partition by repeat, fold order by p desc)),
ck as (select *, coalesce(lead(fps) over w - fps <> fps - lag(fps) over w or lead(tps) over w - tps <> tps - lag(tps) over w, true) as keep, max(tps) over (partition by repeat, fold) as ap from cc window w as (partition by repeat, fold order by p desc)),
cut as (select repeat, fold, arg_min(p, {{'a': fps, 'b': -p}}) as threshold from ck where keep and tps / ap >= 0.9::double - 1e-12 group by all),
scored as materialized (select a.repeat, a.fold, a.y, b.k, a.t, c.threshold, case b.k when 0 then p0 when 1 then p1 else p2 end as p from {_arms_sql('runs')} a join best b on a.repeat = b.repeat and a.fold = b.fold join cut c on a.repeat = c.repeat and a.fold = c.fold) """


def _crossfit(spark, d):
    return B.cases(spark, d).where("device = 'purchase'")


@query(_CROSS + f"""select r.repeat, r.fold, count(*) as n, ['identity', 'temperature', 'isotonic'][k + 1] as method, round(t, 6) as temperature, round(threshold, 6) as threshold, round(count(*) filter (y = 1 and p >= threshold) / count(*) filter (y = 1), 6) as sensitivity,
  round(count(*) filter (y = 0 and p < threshold) / count(*) filter (y = 0), 6) as specificity, round(max(ece), 6) as ece from scored r join {_GROUP_ECE('scored', 'repeat, fold')} e on r.repeat = e.repeat and r.fold = e.fold group by r.repeat, r.fold, k, t, threshold""")
def crossfit_site_score(spark, d):
    """A site's cases under calibrators fitted and chosen on the other fold."""
    return K.crossfit(_crossfit(spark, d), "case_id", "logit", "y")


@query(_CROSS + f""", parts as (select r.repeat, count(*) filter (y = 1 and p >= threshold) / count(*) filter (y = 1) as sensitivity, count(*) filter (y = 0 and p < threshold) / count(*) filter (y = 0) as specificity, max(ece) as ece
  from scored r join {_GROUP_ECE('scored', 'repeat')} e on r.repeat = e.repeat group by r.repeat)
select m as metric, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd from (select 'sensitivity' as m, sensitivity as v from parts union all select 'specificity', specificity from parts union all select 'ece', ece from parts) group by 1""")
def crossfit_summary(spark, d):
    return K.crossfit_summary(K.crossfit_scores(_crossfit(spark, d), "case_id", "logit", "y"), "y")


@query(", runs as (select case_id, logit, y, device as repeat, 0 as fold from b_cases where device <> 'signup'), " + _grouped_isotonic_sql("ci", "runs") + " select repeat as device, round(x, 6) as logit, round(fitted, 6) as fitted from ci")
def isotonic_by_group(spark, d):
    """The isotonic fit of each device at its own scores, all fitted in one pass."""
    c = B.cases(spark, d).where("device <> 'signup'")
    return interpolated(c.select("device", "logit").distinct(), "logit", isotonic_fits(c, "logit", "y", ["device"]), ["device"], "fitted").select("device", "logit", "fitted")


@query(", runs as (select logit, y, device as repeat, 0 as fold from b_cases), " + _grouped_temperature_sql("ct", "runs") + " select repeat as device, round(t, 6) as temperature from ct")
def temperature_by_group(spark, d):
    return fit_temperatures(B.cases(spark, d), "logit", "y", ["device"])


def _profiles_sql(parts: dict[str, str]) -> str:
    """CTEs of a profile for each named part of the cases (a condition): its calibrator, operating point (cut) and band."""
    rows = " union all ".join(f"select case_id, logit, y, '{name}' as repeat, 0 as fold, {_U('holdout', 'case_id')} < 0.3 as held from {src}" for name, src in parts.items())
    return f""", runs as ({rows}), used as (select * from runs where not held), {_grouped_temperature_sql('ct', 'used')}, {_grouped_isotonic_sql('ci', 'used')}, held as materialized (select * from {_arms_sql('(select * from runs where held)')}),
    arm as ({_ARM}), tried as (select * from {_GROUP_ECE('arm', 'repeat, fold, k')}), best as (select repeat, arg_min(k, {{'a': round(ece, 9), 'b': k}}) as k from tried group by all),
    fitp as materialized (select a.repeat, y, case k when 0 then p0 when 1 then p1 else p2 end as p from {_arms_sql('runs')} a join best b on a.repeat = b.repeat),
    cc as (select repeat, p, sum(sum(y)) over w as tps, sum(sum(1 - y)) over w as fps from fitp group by repeat, p window w as (partition by repeat order by p desc)),
    ck as (select *, coalesce(lead(fps) over w - fps <> fps - lag(fps) over w or lead(tps) over w - tps <> tps - lag(tps) over w, true) as keep, max(tps) over (partition by repeat) as ap from cc window w as (partition by repeat order by p desc)),
    cut as (select repeat, arg_min(p, {{'a': fps, 'b': -p}}) as threshold from ck where keep and tps / ap >= 0.9::double - 1e-12 group by all),
    band as (select repeat, threshold, lt, quantile_cont(abs(ln(q / (1 - q)) - lt), 1 - 0.85::double) as d, count(*) as fitted_on, sum(y)::bigint as fitted_positives from (select f.repeat, threshold, y, greatest(1e-7::double, least((1 - 1e-7)::double, p)) as q,
      ln(t2 / (1 - t2)) as lt from fitp f join (select *, least(greatest(threshold, 1e-6::double), (1 - 1e-6)::double) as t2 from cut) c on f.repeat = c.repeat) group by repeat, threshold, lt),
    prof as (select b.repeat, ['identity', 'temperature', 'isotonic'][k + 1] as method, k, t, threshold, 1 / (1 + exp(-(lt - d))) as band_low, 1 / (1 + exp(-(lt + d))) as band_high, fitted_on, fitted_positives from band b join best on b.repeat = best.repeat join ct on b.repeat = ct.repeat)"""


def _measured_sql(rows: str) -> str:
    """CTEs that end in meas: profiles measured on rows (repeat, part, fold, case_id, logit, y)."""
    return f""", mrows as materialized (select a.repeat, a.part, a.logit, a.y, case k when 0 then p0 when 1 then p1 else p2 end as p, threshold, band_low, band_high from {_arms_sql(rows)} a join prof f on a.repeat = f.repeat),
    meas as (select m.repeat, m.part, {_DIVIDED}, auroc, ece, coverage from (select repeat, part, {_CONFUSION}, avg(case when s <= band_low or s >= band_high then 1.0::double else 0 end) as coverage from (select *, p as s, threshold as t from mrows) group by all) m
      join {_auroc('repeat, part', '(select repeat, part, logit as s, y from mrows)')} a on m.repeat = a.repeat and m.part = a.part join {_GROUP_ECE('mrows', 'repeat, part')} e on m.repeat = e.repeat and m.part = e.part)"""


_ROUNDED = lambda names, t="": ", ".join(f"round({t}{n}, 6) as {n}" for n in names.split())
_RATES6 = "sensitivity specificity auroc ece"
#: The fingerprint of a set of names, as the operator makes it: leaves by the first three digits of a name's hash.
_SITE_PARTS = _SITE[: _SITE.index(_temperature_sql("ts", "src"))].rstrip().rstrip(",")


@query(_SITE_PARTS + _profiles_sql({"site": "cal", "source": "src"}) + _measured_sql("(select 'site' as repeat, 'evaluation' as part, 0 as fold, case_id, logit, y from ev union all select 'source', 'evaluation', 0, case_id, logit, y from ev union all select 'site', 'internal', 0, case_id, logit, y from b_cases where device = 'error')") + f"""
, nm as (select sha256(cast(case_id as varchar)) as s from ev), lf as (select substr(s, 1, 3) as leaf, sha256(string_agg(s, '' order by s)) as h, count(*) as n from nm group by 1)
select m.repeat as profile, m.part, method, round(t, 6) as temperature, {_ROUNDED('threshold band_low band_high')}, fitted_on, fitted_positives, tp, fp, tn, fn, {_ROUNDED(_RATES6)}, round(coverage, 6) as coverage,
  (select sha256(string_agg(leaf || h, '' order by leaf)) from lf) as fingerprint, (select sum(n)::bigint from lf) as evaluated from meas m join prof f on m.repeat = f.repeat""")
def site_profile(spark, d):
    """A site's own profile on its evaluation half, the source's there, and the site's on the internal test."""
    calibration, evaluation, source = _site(spark, d)
    return S.site_profile(calibration, evaluation, source, B.cases(spark, d).where("device = 'error'"), "case_id", "logit", "y")


_WHY = lambda r, n: [f"case when {r}.tp + {r}.fn < 30 then '{n}: too few positives' end", *[f"case when {r}.{k} < {v} then '{n}: {k} too low' end" for k, v in (("auroc", 0.85), ("sensitivity", 0.85), ("specificity", 0.5))], f"case when {r}.ece > 0.1 then '{n}: ece too high' end"]
_REASONS = ", ".join([
    "case when f.threshold <= 0.001 or f.threshold >= 0.999 then 'operating point out of range' end", "case when f.method = 'temperature' and (f.t <= 0.05 * 1.0001 or f.t >= 10 * 0.9999) then 'temperature at its bound' end", *_WHY("i", "internal"), *_WHY("m", "external"),
])


@query(_profiles_sql({"current": "(select * from b_cases where device in ('click', 'view'))", "candidate": "(select * from b_cases where device <> 'signup')"}) + _measured_sql("(select r as repeat, 'locked' as part, 0 as fold, case_id, logit, y from b_cases, (values ('current'), ('candidate')) v(r) where device = 'signup' union all select 'current', 'internal', 0, case_id, logit, y from b_cases where device = 'error')") + f"""
select m.repeat as profile, f.method, round(f.t, 6) as temperature, {_ROUNDED('threshold band_low band_high', 'f.')}, m.tp, m.fp, m.tn, m.fn, {_ROUNDED(_RATES6, 'm.')}, concat_ws('; ', {_REASONS}) as failures, m.repeat = 'candidate' and concat_ws('; ', {_REASONS}) = '' as accepted
from meas m join prof f on m.repeat = f.repeat cross join (select * from meas where part = 'internal') i where m.part = 'locked'""")
def recalibrate_site(spark, d):
    """The current profile and a candidate of other devices on locked cases, with every reason of the acceptance rule against serving each."""
    c = B.cases(spark, d)
    current = K.fit_profile(c.where("device in ('click', 'view')"), "case_id", "logit", "y")
    locked, internal = c.where("device = 'signup'"), c.where("device = 'error'")
    rows = S.recalibrated_evidence(c.where("device <> 'signup'"), locked, current, internal, "case_id", "logit", "y", "a", "f")
    return rows.withColumn("failures", F.array_join("failures", "; "))


_BOOT = f""", sub as (select subject, {_CONFUSION} from (select subject, prob as s, 0.5 as t, y from b_cases) group by subject),
rep as (select sub.*, i, len(list_filter([{', '.join(f'{c}::double' for c in K.POISSON)}], lambda c: c <= {_hash("'boot:' || subject || ':' || i")} / 4294967296.0::double)) as w from sub cross join range(1000) r(i)),
boot as (select i, sum(w * tp) / nullif(sum(w * (tp + fn)), 0) as sens, sum(w * tn) / nullif(sum(w * (tn + fp)), 0) as spec from rep where w > 0 group by i),
pt as (select sum(tp) / sum(tp + fn) as sens, sum(tn) / sum(tn + fp) as spec from sub) """


@query(_BOOT + """select 'sensitivity' as metric, round((select sens from pt), 6) as point, round(quantile_cont(sens, 0.025), 6) as low, round(quantile_cont(sens, 0.975), 6) as high, count(sens) as n_boot from boot
union all select 'specificity', round((select spec from pt), 6), round(quantile_cont(spec, 0.025), 6), round(quantile_cont(spec, 0.975), 6), count(spec) from boot""")
def cluster_bootstrap(spark, d):
    return K.bootstrap_rates(B.cases(spark, d), "y", "prob", 0.5, "subject")
