"""Queries of the file sources over files that Spark writes from the given tables, and of functions of columns, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caselight.functions import columns as C
from caselight.operators import curation as U
from caselight.operators.store import folder
from caselight.plans.catalog import _SIG6, query
from caselight.sources import bridge as B
from caselight.sources import files as S


def _place(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _label_files(spark, d) -> str:
    """Label tables in CSV: some grades are missing, some files are in subfolders."""
    c, path = B.cases(spark, d), _place(spark, "labels")
    name = F.concat_ws("/", F.when(F.col("case_id") % 3 == 0, "sub"), F.concat("subject", F.lit("_"), F.col("case_id").cast("string"), F.lit(".png")))
    c.select(name.alias("id_code"), F.when(F.col("case_id") % 7 != 0, F.col("grade")).alias("diagnosis"), "device").write.option("header", True).csv(path)
    return path


_LABELS = "select case when case_id % 3 = 0 then 'sub/' else '' end || subject || '_' || case_id || '.png' as filename, cast(grade as int) as grade, y as referable, device, subject from b_cases where case_id % 7 <> 0"


@query(_LABELS)
def labels_load(spark, d):
    return S.load_labels(spark, _label_files(spark, d), "id_code", "diagnosis", subject=("prefix", "filename"))


@query(_LABELS + " and gradable = 1")
def filter_ungradable(spark, d):
    c = B.cases(spark, d).where("gradable = 0")
    name = F.concat_ws("/", F.when(F.col("case_id") % 3 == 0, "sub"), F.concat("subject", F.lit("_"), F.col("case_id").cast("string"), F.lit(".png")))
    return S.load_labels(spark, _label_files(spark, d), "id_code", "diagnosis", c.select(name.alias("filename")), ("prefix", "filename"))


@query("select device || '/' || case_id as image_id, cast(grade as int) as grade, case when device = 'click' then side end as side from b_cases")
def labels_partition_prefix(spark, d):
    c = B.cases(spark, d).select(F.col("case_id").cast("string").alias(" image_id "), "grade", F.lit(1).alias("Unnamed: 2"), "side", "device")
    keep = lambda v: c.where(F.col("device") == v).drop("device", *([] if v == "click" else ["side"]))
    devices = [r.device for r in c.select("device").distinct().collect()]  # kinds of events
    return S.assemble({f"{v}/": keep(v) for v in sorted(devices)}, "image_id")


@query("""select 'graded' as part, count(*) as n, sum(grade)::bigint as total from b_cases where grade < 4 union all select 'quality', count(*), count(*) filter (gradable = 1 and grade < 4) from b_cases""")
def labels_write(spark, d):
    """Grade 4 stands for the code of a grade that is none, 5."""
    path = _place(spark, "written")
    c = B.cases(spark, d).select("case_id", F.when(F.col("grade") == 4, 5).otherwise(F.col("grade")).alias("raw_grade"), F.col("gradable").alias("human_quality"))
    S.write_labels(c, path)
    graded, quality = (spark.read.parquet(f"{path}/{x}") for x in ("graded", "quality"))
    return graded.agg(F.lit("graded").alias("part"), F.count("*").alias("n"), F.sum("raw_grade").alias("total")).unionByName(quality.agg(F.lit("quality").alias("part"), F.count("*").alias("n"), F.sum("quality").alias("total")))


@query("select user_id, arg_max(event_type, {'a': case when event_id % 2 = 0 then 1 else 0 end, 'b': event_id}) as event_type, arg_max(event_id, {'a': case when event_id % 2 = 0 then 1 else 0 end, 'b': event_id}) as event_id from events group by 1")
def quality_report_merge(spark, d):
    e = B.table(spark, d, "events").select("user_id", "event_type", "event_id")
    return S.merge_keep_last(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("""select doc_id, case when doc_id % 3 = 0 then 'missing' when doc_id % 3 = 1 then 'exact' else 'repaired' end as how, case when doc_id % 3 = 1 then 'd/' || doc_id || '.png' when doc_id % 3 = 2 then 'd/' || doc_id || '.jpeg' end as found from documents""")
def resolve_filenames(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", F.concat(F.lit("x\\y/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("name"))
    end = F.when(F.col("doc_id") % 3 == 1, ".png").otherwise(".jpeg")
    files = docs.where("doc_id % 3 > 0").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), end).alias("path"))
    return S.resolve_filenames(docs, files, "name").select("doc_id", "how", "found")


def _text_files(spark, d) -> str:
    """One text file for each language, of the ids of its documents."""
    path = _place(spark, "texts")
    ids = B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("value"), "lang")
    ids.repartition(1).write.partitionBy("lang").text(path)
    return path


def _lang():
    return F.regexp_extract("path", "/lang=([^/]*)/", 1)


@query("select lang, count(distinct lang) as files, sum(length(cast(doc_id as varchar)) + 1)::bigint as bytes from documents where lang is not null group by lang")
def file_manifest(spark, d):
    rows = S.manifest(spark, _text_files(spark, d)).where(F.col("path").endswith(".txt")).withColumn("lang", _lang())
    return rows.where("lang not like '\\_\\_%'").groupBy("lang").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query("select distinct lang, case lang when 'en' then 'changed' else 'missing' end as problem from documents where lang in ('en', 'fr')")
def file_manifest_verify(spark, d):
    now = S.manifest(spark, _text_files(spark, d)).where(F.col("path").endswith(".txt"))
    stored = now.withColumn("sha256", F.when(_lang() == "en", F.lit("0" * 64)).otherwise(F.col("sha256")))
    return S.verify_manifest(stored, now.where(_lang() != "fr")).select(_lang().alias("lang"), "problem")


@query("select device, printf('%.3f ± %.3f', avg(grade), stddev_pop(grade)) as grade from b_cases group by device")
def experiments_log(spark, d):
    """Runs are appended to a log in two batches and read back."""
    path, runs = _place(spark, "runs"), B.cases(spark, d).select("device", "grade", "case_id")
    for part in (0, 1):
        S.append_run(runs.where(F.col("case_id") % 2 == part), path)
    return S.experiments(spark.read.json(path), "device", ["grade"])


@query("""select doc_id, replace(source || '/' || lang || '/' || doc_id, '/', '__') || '.png' as flat, doc_id as number from documents where source is not null and lang is not null""")
def names_of_files(spark, d):
    path = F.concat_ws("\\", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpeg")))
    docs = B.table(spark, d, "documents").where("source is not null and lang is not null")
    return docs.select("doc_id", C.flat_name(path).alias("flat"), C.trailing_number(path).alias("number"))


@query(f""", z as (select case_id, grade, {_SIG6('logit + 2')} as p0, {_SIG6('logit + h % 3 - 1')} as p1, {_SIG6('logit - 2')} as p2, {_SIG6('logit - 4')} as p3 from b_cases)
select case_id, (grade > 0)::int || ',' || (grade > 1)::int || ',' || (grade > 2)::int || ',' || (grade > 3)::int as code, cast((p0 > 0.5)::int + (least(p0, p1) > 0.5)::int + (least(p0, p1, p2) > 0.5)::int + (least(p0, p1, p2, p3) > 0.5)::int as int) as decoded, round(least(p0, p1, p2, p3), 6) as lowest from z""")
def ordinal_codes(spark, d):
    z, h = F.col("logit"), F.col("h")
    p = F.array(*[C.sigmoid(x) for x in (z + 2, z + h % 3 - 1, z - 2, z - 4)])
    code = F.array_join(F.transform(C.ordinal_encode(F.col("grade"), 5), lambda x: x.cast("string")), ",")
    return B.cases(spark, d).select("case_id", code.alias("code"), C.grade_decode(p).cast("int").alias("decoded"), F.element_at(C.enforce_monotonic(p), 4).alias("lowest"))


@query("select true as same, count(*) as n from b_quality")
def fingerprint_match(spark, d):
    """The stored fingerprint of the evaluation set against the set in another order; another set would be an error."""
    q = B.quality(spark, d)
    found = U.set_fingerprint(q, "filename").first()
    U.same_set(q.repartition(3).orderBy(F.desc("filename")), "filename", found.fingerprint)
    return q.agg(F.lit(True).alias("same"), F.count("*").alias("n"))
