"""Queries of the log's hash chain and of the registry, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.operators import audit as A
from caselight.operators.store import written
from caselight.plans.catalog import query
from caselight.sources import bridge as B

_CHAIN = """, lg as (select event_id, event_id // 256 as block, row_number() over (partition by event_id // 256 order by event_id) as pos, concat_ws('|', event_id, event_type, user_id, props) as body from events),
ch as (select event_id, block, pos, repeat('0', 64) as prev_hash, sha256(repeat('0', 64) || body) as entry_hash from lg where pos = 1 union all
  select l.event_id, l.block, l.pos, c.entry_hash, sha256(c.entry_hash || l.body) from ch c join lg l on l.block = c.block and l.pos = c.pos + 1) """


def _log(spark, d):
    e = B.table(spark, d, "events")
    return e.select("event_id", "event_type", "user_id", "props", F.concat_ws("|", "event_id", "event_type", "user_id", "props").alias("body"))


@query(_CHAIN + "select event_id, block, prev_hash, entry_hash from ch", recursive=True)
def chain_append(spark, d):
    return A.chain(_log(spark, d), "event_id", "body").select("event_id", "block", "prev_hash", "entry_hash")


@query(_CHAIN + """, hd as (select block, count(*) as entries, arg_max(entry_hash, event_id) as head from ch group by block), h1 as (select block, block // 256 as up, row_number() over (partition by block // 256 order by block) as pos, head from hd),
c1 as (select block, up, pos, sha256(repeat('0', 64) || head) as entry_hash from h1 where pos = 1 union all select h.block, h.up, h.pos, sha256(c.entry_hash || h.head) from c1 c join h1 h on h.up = c.up and h.pos = c.pos + 1),
u1 as (select up as block, count(*) as entries, arg_max(entry_hash, block) as head from c1 group by up),
h2 as (select block, row_number() over (order by block) as pos, head from u1), c2 as (select block, pos, sha256(repeat('0', 64) || head) as entry_hash from h2 where pos = 1 union all select h.block, h.pos, sha256(c.entry_hash || h.head) from c2 c join h2 h on h.pos = c.pos + 1)
select cast(0 as int) as level, block, entries, head from hd union all select 1, block, entries, head from u1 where (select max(block) from hd) > 0 union all select 2, 0, count(*), arg_max(entry_hash, block) from c2 having (select max(block) from u1) > 0""", recursive=True)
def chain_heads(spark, d):
    return A.heads(A.chain(_log(spark, d), "event_id", "body"), "event_id")


@query(""", kept as (select event_id, event_id // 256 as block from events where event_id % 1499 <> 7), last as (select event_id // 256 as block, max(event_id) as id from events group by 1)
select event_id as seq, 'altered' as problem from kept where event_id % 997 = 0 union all select k.event_id, 'broken link' from (select *, lag(event_id) over (partition by block order by event_id) as before from kept) k
  where exists (select 1 from events e where e.event_id % 1499 = 7 and e.event_id // 256 = k.block and e.event_id < k.event_id and (k.before is null or e.event_id > k.before))
union all select block * 256, 'end missing' from last where id % 1499 = 7""")
def chain_verify(spark, d):
    chained = written(A.chain(_log(spark, d), "event_id", "body"), "chain")
    stored = A.heads(chained, "event_id")
    tampered = chained.where("event_id % 1499 <> 7").withColumn("body", F.when(F.col("event_id") % 997 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return A.verify(tampered, "event_id", "body", stored)


@query(_CHAIN + """, hd as (select block, count(*) as entries, arg_max(entry_hash, event_id) as head from ch group by block), h1 as (select block, block // 256 as up, row_number() over (partition by block // 256 order by block) as pos, head from hd),
c1 as (select block, up, pos, sha256(repeat('0', 64) || head) as entry_hash from h1 where pos = 1 union all select h.block, h.up, h.pos, sha256(c.entry_hash || h.head) from c1 c join h1 h on h.up = c.up and h.pos = c.pos + 1)
select 'whole' as log, true as ok, (select count(*) from lg) as entries, arg_max(entry_hash, block) as head, 0 as problems from c1 union all
select 'rewritten', false, (select count(*) from lg), (select arg_max(entry_hash, block) from c1), 1""", recursive=True)
def chain_verified(spark, d):
    """The whole log, and one of which a block was rewritten together with its own head: the level above gives it away."""
    chained = written(A.chain(_log(spark, d), "event_id", "body"), "chain")
    heads = written(A.heads(chained, "event_id"), "all-heads")
    forged = written(A.chain(_log(spark, d).withColumn("body", F.when(F.col("event_id") == 300, F.lit("forged")).otherwise(F.col("body"))), "event_id", "body"), "forged")
    own = A.heads(forged, "event_id").where("level = 0")
    parts = (("whole", chained, heads), ("rewritten", forged, own.unionByName(heads.where("level > 0"))))
    rows = [A.verified(log, "event_id", "body", h).select(F.lit(name).alias("log"), "*") for name, log, h in parts]
    return rows[0].unionByName(rows[1])


@query(""", old as (select event_id as seq, event_id as case_id from events where event_id % 3 = 0), miss as (select case_id from b_predictions where case_id not in (select case_id from old))
select seq, case_id, 'prediction' as action, false as legacy from old union all select (select max(seq) from old) + row_number() over (order by case_id), case_id, 'prediction', true from miss""")
def anchor_append(spark, d):
    """The log with the missing entries appended, twice over: the second run appends none."""
    log = B.table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("seq"), F.col("event_id").alias("case_id"), F.lit("prediction").alias("action"))
    once = A.anchored(B.predictions(spark, d), log, "case_id", "prediction")
    again = A.anchored(B.predictions(spark, d), once, "case_id", "prediction")
    return once.join(again.select("seq"), "seq", "left_semi")


@query("select case_id, 'prediction' as action, true as legacy from b_predictions p where case_id not in (select event_id from events where event_id % 3 = 0)")
def anchor_legacy(spark, d):
    log = B.table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("case_id"), F.lit("prediction").alias("action"))
    return A.missing_entries(B.predictions(spark, d), log, "case_id", "prediction")


@query("select case_id, decision, cast(null as varchar) as visit from b_predictions where h % 2 = 0 union all select case_id, decision, visit from b_predictions where h % 2 = 1")
def additive_migration(spark, d):
    p = B.predictions(spark, d)
    return A.aligned(p.where("h % 2 = 0").select("case_id", "decision"), p.where("h % 2 = 1").select("visit", "case_id", "decision"))


@query("select verdict_id, case when verdict_id % 101 = 0 then 'deleted' else 'updated' end as problem from b_verdicts where verdict_id % 101 = 0 or (verdict_id % 103 = 0 and grader <> 'g0')")
def append_only_check(spark, d):
    v = B.verdicts(spark, d).select("verdict_id", "case_id", "verdict", "grader", "grade")
    new = v.where("verdict_id % 101 <> 0").withColumn("grader", F.when(F.col("verdict_id") % 103 == 0, "g0").otherwise(F.col("grader")))
    return A.append_only(v, new, "verdict_id")


@query(""", ev as (select event_type as kind, user_id as version, event_id as seq, case cast(floor(value * 100) as bigint) % 40 when 0 then 'promoted' when 1 then 'rolled back' else 'registered' end as action from events),
sw as (select * from ev where action <> 'registered'), l as (select kind, max(seq) as at, arg_max(version, seq) as active from sw group by 1), b as (select s.kind, arg_max(s.version, s.seq) as replaced from sw s join l on s.kind = l.kind and s.seq < l.at and s.version <> l.active group by 1)
select v.kind, version, case when version = active then 'active' when was then 'retired' else 'candidate' end as status, case when version = active then replaced end as replaced from (select kind, version, bool_or(action <> 'registered') as was from ev group by 1, 2) v left join l on v.kind = l.kind left join b on v.kind = b.kind""")
def registry_status(spark, d):
    step = F.floor(F.col("value") * 100).cast("long") % 40
    e = B.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("version"), F.col("event_id").alias("seq"), F.when(step == 0, "promoted").when(step == 1, "rolled back").otherwise("registered").alias("action"))
    return A.registry_status(e)


@query("""select case_id, case when h % 9 = 0 or h % 7 = 0 then 'no approver or reason' when is_demo = 1 then 'unknown version' when y = 0 and h % 4 > 0 then 'worse than the active version' end as problem from b_predictions""")
def promotion_check(spark, d):
    p, h = B.predictions(spark, d), F.col("h")
    asked = p.select("case_id", F.col("device").alias("kind"), F.col("case_id").alias("version"), F.when(h % 9 == 0, " ").otherwise("someone").alias("approver"), F.when(h % 7 > 0, "better").alias("reason"), F.when(h % 4 == 0, "needed").alias("override"))
    versions = p.where("is_demo = 0").select(F.col("device").alias("kind"), F.col("case_id").alias("version"), (F.col("y") == 1).alias("not_worse"))
    return A.check_promotions(asked, versions).select("case_id", "problem")
