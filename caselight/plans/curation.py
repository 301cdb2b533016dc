"""Queries of duplicates, strata, snapshots and reports, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.functions import columns as C
from caselight.operators import curation as U
from caselight.operators import signatures as G
from caselight.operators import tables as O
from caselight.operators.store import written
from caselight.plans.catalog import _CODE, _SIDES, _U, KEY, _hash, query
from caselight.sources import bridge as B

#: Vectors with three variants, some of which exist: a copy, and two with noise of a hundredth and of three hundredths. Signatures are bit strings.
_SIGNED = f""", elements as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as j, unnest(embedding)::double as e from embeddings),
items as (select vec_id * 4 + v as id, vec_id, v, cast((label + case when {_hash("'label:' || (vec_id * 4 + v)")} % 9 = 0 then 1 else 0 end) as int) as label, md5(case when v < 2 then 'v' || vec_id else 'n' || (vec_id * 4 + v) end) as digest
  from embeddings, range(4) t(v) where v = 0 or {_hash("'variant:' || (vec_id * 4 + v)")} % 2 = 0),
plane as (select k, j, case when (cast('0x' || substr(md5('plane:' || k), cast(j // 4 as int) + 1, 1) as int) >> cast(3 - j % 4 as int)) & 1 = 1 then 1 else -1 end as s from range(256) a(k), range(64) b(j)),
dots as (select id, k, sum((e + case v when 2 then 0.01::double when 3 then 0.03::double else 0 end * ({_hash("'noise:' || id || ':' || i.j")} % 1001 - 500) / 500.0::double) * s) as d
  from (select id, v, e.j, e from items join elements e using (vec_id)) i join plane p on p.j = i.j group by 1, 2),
signed as materialized (select id, string_agg(case when d > 0 then '1' else '0' end, '' order by k)::bit as sig from dots group by 1),
pairs as materialized (select p.id as a, q.id as b, cast(bit_count(xor(p.sig, q.sig)) as int) as distance from signed p join signed q on p.id < q.id and bit_count(xor(p.sig, q.sig)) <= 12)"""
_NEAR = _SIGNED + """, near as (select b as k, list(a) as nb from pairs group by 1),
ord as (select v.id, row_number() over (order by v.id) as pos, coalesce(nb, []) as nb from signed v left join near n on v.id = n.k),
walk as (select cast(0 as bigint) as pos, cast([] as bigint[]) as reps union all select o.pos, case when list_has_any(o.nb, w.reps) then w.reps else list_append(w.reps, o.id) end from walk w join ord o on o.pos = w.pos + 1),
reps as (select reps from walk order by pos desc limit 1), led as (select id, case when list_contains(reps, id) then id else list_min(list_intersect(nb, reps)) end as leader from ord, reps) """


def _signed(spark, d):
    """Vectors and their variants with a signature of 256 bits each."""
    v = F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)]))
    rows = B.table(spark, d, "embeddings").select("vec_id", "label", "embedding", v.alias("v")).withColumn("id", F.col("vec_id") * 4 + F.col("v"))
    pick = lambda word: C.hash32(F.concat(F.lit(f"{word}:"), F.col("id").cast("string")))
    rows = rows.where((F.col("v") == 0) | (pick("variant") % 2 == 0))
    size = F.when(F.col("v") == 2, 0.01).when(F.col("v") == 3, 0.03).otherwise(0.0)
    noise = lambda j: size * (C.hash32(F.concat(F.lit("noise:"), F.col("id").cast("string"), F.lit(":"), j.cast("string"))) % 1001 - 500) / F.lit(500.0)
    vector = F.transform("embedding", lambda x, j: x.cast("double") + noise(j))
    name = F.when(F.col("v") < 2, F.concat(F.lit("v"), F.col("vec_id").cast("string"))).otherwise(F.concat(F.lit("n"), F.col("id").cast("string")))
    label = (F.col("label") + F.when(pick("label") % 9 == 0, 1).otherwise(0)).cast("int")
    return rows.select("id", label.alias("label"), F.md5(name.cast("binary")).alias("digest"), G.signature(vector).alias("bits"))


@query(_SIGNED + " select id, substr(sig::varchar, 1, 64) as w0, substr(sig::varchar, 193, 64) as w3, cast(bit_count(sig) as int) as ones from signed")
def hyperplane_signatures(spark, d):
    """Signatures of 256 bits; the first and the last word as text."""
    text = lambda k: F.lpad(F.bin(F.col("bits")[k]), 64, "0")
    ones = sum((F.bit_count(F.col("bits")[k]) for k in range(1, 4)), F.bit_count(F.col("bits")[0]))
    return _signed(spark, d).select("id", text(0).alias("w0"), text(3).alias("w3"), ones.cast("int").alias("ones"))


@query(_SIGNED + " select a, b, distance from pairs")
def hamming_theta_join(spark, d):
    return G.probed_pairs(_signed(spark, d), "id", "bits", 12)


@query(_NEAR + "select id, leader from led", recursive=True)
def near_duplicates(spark, d):
    return G.near_groups(_signed(spark, d), "id", "bits", 12)


@query(_NEAR + "select leader, count(*) as n, count(*) > 3 as suspicious from led group by 1 having count(*) > 1", recursive=True)
def suspicious_groups(spark, d):
    return U.flagged_groups(G.near_groups(_signed(spark, d), "id", "bits", 12), 3)


_GROUPED = _NEAR + """, good as (select leader from led group by 1 having count(*) between 2 and 3), mem as (select id, leader from led where leader in (select leader from good)),
touched as (select distinct digest from items join mem using (id)), free as (select id, min(id) over (partition by digest) as leader, count(*) over (partition by digest) as n from items where digest not in (select digest from touched)),
grp as (select id, leader from mem union all select id, leader from free where n > 1), told as (select leader, count(*) as n, count(distinct label) as labels from grp join items using (id) group by 1),
gone as (select id from grp join told using (leader) where labels > 1 or id <> leader) """


@query(_GROUPED + "select id, label, digest, 'S' || lpad(cast(row_number() over (order by id) - 1 as varchar), 5, '0') as subject from items where id not in (select id from gone)", recursive=True)
def dedup_apply(spark, d):
    """Conflicting groups go, of others the first row stays, and the rest is numbered anew."""
    signed = written(_signed(spark, d), "signed")
    return G.without_duplicates(G.near_groups(signed, "id", "bits", 12), signed.drop("bits"), "id", "digest", "label", most=3, guard=0.9)[0]


@query(_GROUPED + "select leader, n, labels from told where labels > 1", recursive=True)
def duplicate_conflicts(spark, d):
    signed = written(_signed(spark, d), "signed")
    return G.without_duplicates(G.near_groups(signed, "id", "bits", 12), signed.drop("bits"), "id", "digest", "label", most=3, guard=0.9)[1]


@query(""", n as (select grade, count(*) as n, row_number() over (order by grade desc) as pos from b_cases group by grade), t as (select sum(n) as t from n), w as (select pos, grade, 1 as b, n as acc from n where pos = 1 union all
  select n.pos, n.grade, case when w.acc < t * 0.15 then w.b else w.b + 1 end, case when w.acc < t * 0.15 then w.acc + n.n else n.n end from w join n on n.pos = w.pos + 1, t),
f as (select grade, case when b = (select max(b) from w) and b > 1 and (select arg_max(acc, pos) from w) < (select t * 0.15 from t) then b - 1 else b end as b from w) select cast(grade as int) as grade, cast(min(grade) over (partition by b) as int) as stratum from f""", recursive=True)
def collapse_rare_strata(spark, d):
    c = B.cases(spark, d)
    counts = c.groupBy("grade").agg(F.count("*").alias("n")).cache()
    least = counts.agg(F.sum("n")).first()[0] * 0.15
    labels = U.collapsed_strata(counts, "grade", least)
    return counts.select("grade", F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("grade")].alias("stratum"))


@query(f""", subj as (select subject, max(grade) as grade from b_cases where grade < 4 or h % 40 = 0 group by subject), n as (select grade, count(*) as n, row_number() over (order by grade desc) as pos from subj group by grade), w as (select pos, grade, 1 as b, n as acc from n where pos = 1 union all
  select n.pos, n.grade, case when w.acc < 7 then w.b else w.b + 1 end, case when w.acc < 7 then w.acc + n.n else n.n end from w join n on n.pos = w.pos + 1),
f as (select grade, case when b = (select max(b) from w) and b > 1 and (select arg_max(acc, pos) from w) < 7 then b - 1 else b end as b from w), st as (select grade, min(grade) over (partition by b) as stratum from f),
rk as (select subject, stratum, (row_number() over (partition by stratum order by {_U("split", "subject")}, subject) - 0.5) / count(*) over (partition by stratum) as sh from subj join st using (grade))
select subject, cast(stratum as int) as stratum, case when sh < 0.7 then 'train' when sh < 0.85 then 'val' else 'test' end as split from rk""", recursive=True)
def split_merged(spark, d):
    return U.split_merged(B.cases(spark, d).where("grade < 4 or h % 40 = 0"), "subject", "grade")


@query(f""", s as (select subject, avg(y) as sh from b_cases group by 1), f as (select subject, cast((row_number() over (partition by case when sh = 0 then 0 when sh <= 0.5 then 1 else 2 end order by {_U('groups', 'subject')}, subject) - 1) % 5 as int) as fold from s)
select subject, fold, case fold when 0 then 'test' when 1 then 'val' else 'train' end as role from f""")
def split_groups_kfold(spark, d):
    return U.grouped_folds(B.cases(spark, d), "subject", "y")


_SNAP = f""", snap as (select {_CODE("subject", "p.subject")} as subject_code, {_CODE("case", "p.case_id")} as case_code, {_CODE("visit", "coalesce(p.visit, '')")} as visit_code, p.side, strftime(p.created, '%Y-%m') as month, p.device, l.verdict,
  cast(l.verdict <> 'UNGRADABLE' as int) as human_gradable, case l.verdict when 'REFER' then 1 when 'ROUTINE' then 0 end as human_referable, cast(l.grade as int) as human_grade, cast(l.dme as int) as human_dme,
  case when l.verdict_id % 3 = 0 then 'drusen;scar' when l.verdict_id % 3 = 1 then 'scar' else '' end as findings, p.decision as model_decision, round(p.probability, 6) as model_probability, p.gradable as model_gradable, l.grader
  from b_predictions p join latest l on p.case_id = l.case_id where p.h % 13 <> 0 and p.case_id % 10 <> 0),
snp as (select *, case when cast('0x' || substr(subject_code, 1, 8) as bigint) / 4294967295.0::double < 0.2 then 'locked_test' else 'train' end as split from snap) """


def _snapshot(spark, d):
    """Some cases lack a subject, others an image; verdicts carry findings."""
    p = B.predictions(spark, d)
    v, k = B.verdicts(spark, d), F.col("verdict_id") % 3
    found = F.when(k == 0, F.array(F.lit("drusen"), F.lit("scar"))).when(k == 1, F.array(F.lit("scar"))).otherwise(F.array().cast("array<string>"))
    known = p.withColumn("subject", F.when(F.col("h") % 13 != 0, F.col("subject")))
    return U.snapshot(known, v.withColumn("findings", found), KEY, p.where("case_id % 10 <> 0"))


@query(_SNAP + "select subject_code, case_code, visit_code, side, month, device, verdict, human_gradable, human_referable, human_grade, human_dme, findings, model_decision, model_probability, model_gradable, split from snp")
def snapshot_export(spark, d):
    return _snapshot(spark, d)


@query(_SNAP + """select count(*) as images, count(distinct subject_code) as subjects, count(distinct visit_code) as visits, string_agg(distinct month, ',' order by month) as months, count(*) filter (split = 'locked_test') as locked,
  count(distinct subject_code) filter (split = 'locked_test') as locked_subjects, count(human_grade) as graded, count(human_referable) as with_label, count(human_dme) as with_dme, count(*) filter (verdict = 'REFER') as refer, count(*) filter (verdict = 'ROUTINE') as routine,
  count(*) filter (verdict = 'UNGRADABLE') as ungradable, 'drusen=' || count(*) filter (findings = 'drusen;scar') || ',scar=' || count(*) filter (findings <> '') as findings, (select count(distinct grader) from latest) as graders from snp""")
def dataset_card(spark, d):
    return U.dataset_card(_snapshot(spark, d), O.latest_verdict(B.verdicts(spark, d)).select("grader"))


@query(_SNAP + """select 'local' as origin, case when split = 'locked_test' then 'local test' when cast('0x' || substr(subject_code, 9, 8) as bigint) / 4294967295.0::double < 0.2 then 'val' else 'train' end as role, count(*) as n from snp group by all
union all select 'base', case when sp = 0 then 'base test' when sp = 1 then 'val' else 'train' end, count(*) from (select cast('0x' || substr(md5(subject), 1, 8) as bigint) % 5 as sp from b_cases) group by all""")
def training_masks(spark, d):
    from caselight.functions.columns import hash32

    sp = hash32(F.col("subject")) % 5
    base = B.cases(spark, d).select(F.col("subject").alias("subject_code"), F.when(sp == 0, "test").when(sp == 1, "val").otherwise("train").alias("split"))
    local = _snapshot(spark, d).select("subject_code", "split")
    return U.training_roles(base, local, "subject_code", "split").groupBy("origin", "role").agg(F.count("*").alias("n"))


@query(""", n as (select count(*) filter (verdict = 'UNGRADABLE') as u, least(count(*) filter (verdict = 'REFER'), count(*) filter (verdict = 'ROUTINE')) as r, count(grade) as g, count(dme) as f from latest)
select step, have, cast(need as int) as need, have >= need as ready from (select 'quality' as step, u as have, 20 as need from n union all select 'referral', r, 30 from n union all select 'grades', g, 30 from n union all select 'finding', f, 30 from n)""")
def learning_progress(spark, d):
    return U.learning_progress(O.latest_verdict(B.verdicts(spark, d)))


@query(""", r as (select h % 100 / 100.0::double as p0, v % 100 / 100.0::double as p1, case when h % 10 > 0 then y end as h0, cast(v % 3 = 0 as int) as h1 from b_predictions where gradable = 0),
q as (select *, p0 >= 0.5 or p1 >= 0.5 as nm, h0 is not null as fu, case when p0 >= 0.5 and (p0 >= p1 or p1 < 0.5) then h0 when p1 >= 0.5 then h1 end as f, (p0 >= 0.5 and h0 = 1) or (p1 >= 0.5 and h1 = 1) as an from r)
select count(*) as rejected, count(*) filter (nm) as named, count(*) filter (nm and fu) as checked, count(*) filter (nm and fu and f = 1) as first_confirmed, count(*) filter (nm and fu and an) as any_confirmed from q""")
def reason_agreement(spark, d):
    return U.reason_agreement(_rejected(spark, d), ["focus", "light"], 0.5)


def _rejected(spark, d):
    p = B.predictions(spark, d).where("gradable = 0")
    return p.select((F.col("h") % 100 / 100.0).alias("p_focus"), (F.col("v") % 100 / 100.0).alias("p_light"), F.when(F.col("h") % 10 > 0, F.col("y")).alias("has_focus"), (F.col("v") % 3 == 0).cast("int").alias("has_light"))


@query(""", r as (select 'focus' as cause, h % 100 / 100.0::double as p, case when h % 10 > 0 then y end as has from b_predictions where gradable = 0 union all select 'light', v % 100 / 100.0::double, cast(v % 3 = 0 as int) from b_predictions where gradable = 0)
select cause, count(*) as named, count(has) as checked, count(*) filter (has = 1) as confirmed, round(count(*) filter (has = 1) / nullif(count(has), 0), 6) as precision from r where p >= 0.5 group by 1""")
def reason_precision(spark, d):
    return U.reason_precision(_rejected(spark, d), ["focus", "light"], 0.5)


@query("""select event_id, (event_id % 9 < 7 and cast('0x' || substr(md5(cast(event_id as varchar)), 1, 8) as bigint) % 4 = 0) or (event_id % 9 < 7 and cast('0x' || substr(md5(cast(event_id as varchar)), 1, 8) as bigint) % 4 = 2 and user_id % 256 < 128) or event_id % 9 = 8 as allowed from events""")
def ip_range_join(spark, d):
    from caselight.functions.columns import hash32

    e, part = B.table(spark, d, "events"), lambda x: x.cast("string")
    v4 = F.concat_ws(".", F.lit("10"), part(hash32(F.col("event_id")) % 4), part(F.col("user_id") % 256), part(F.col("event_id") % 256))
    ip = F.when(F.col("event_id") % 9 == 8, "::1").when(F.col("event_id") % 9 == 7, "nowhere").when(F.col("event_id") % 2 == 0, F.concat(F.lit("::ffff:"), v4)).otherwise(v4)
    return U.allowed_clients(e.select("event_id", ip.alias("ip")), "ip", ["10.0.0.0/16", "10.2.0.0/17"]).select("event_id", "allowed")


@query(_SIDES + """select o.visit, 'DiagnosticReport' as kind, case when final then 'final' else 'preliminary' end as status, v.decision as conclusion, max(subject) as subject, string_agg(o.case_id, ',' order by o.case_id) as observations from outcomes o join visits v on o.visit = v.visit group by o.visit, final, v.decision""")
def fhir_export(spark, d):
    o = O.effective_outcomes(B.predictions(spark, d), B.verdicts(spark, d))
    reports, _ = U.visit_reports(o, O.visit_decisions(o))
    field = lambda p: F.get_json_object("report", p)
    ids = F.array_join(F.transform(F.from_json(field("$.contained"), "array<struct<id:string>>"), lambda x: F.substring(x["id"], 5, 40)), ",")
    return reports.select("visit", field("$.resourceType").alias("kind"), field("$.status").alias("status"), field("$.conclusionCode[0].text").alias("conclusion"), F.substring(field("$.subject.reference"), 9, 100).alias("subject"), ids.alias("observations"))


@query("select doc_id, sha256(coalesce(text, '')) as sha from documents")
def encrypted_blob_put_get(spark, d):
    rows = B.table(spark, d, "documents").select("doc_id", F.lit("raw").alias("kind"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return U.decrypted(U.encrypted(rows, KEY, "doc_id", "kind", "content"), KEY).select("doc_id", F.sha2("content", 256).alias("sha"))


@query("select event_type as kind, count(*) filter (ts < timestamp '2024-01-31' - interval 20 day) as purged, count(*) filter (ts >= timestamp '2024-01-31' - interval 20 day) as kept from events group by 1")
def retention_purge(spark, d):
    return U.purged(B.cases(spark, d), "created", 20, F.lit("2024-01-31").cast("timestamp"), "device")[1]


@query(""", h as (select sha256(filename) as s from b_quality), l as (select substr(s, 1, 3) as leaf, sha256(string_agg(s, '' order by s)) as hash from h group by 1)
select sha256(string_agg(leaf || hash, '' order by leaf)) as fingerprint, (select count(*) from h) as n from l""")
def evaluation_fingerprint(spark, d):
    return U.set_fingerprint(B.quality(spark, d), "filename")
