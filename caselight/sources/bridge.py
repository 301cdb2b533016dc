"""Views that give the tables of cases, predictions and verdicts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.functions.columns import hash32, rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_of(table(spark, sf_dir, "events"))


def cases_of(events: DataFrame) -> DataFrame:
    """Scored cases: the subject is the user, the device the event's type, a visit a subject's day. events may be a stream."""
    e = events.select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") * 100).cast("long").alias("v"), (hash32(F.col("event_id")) % 10000).alias("h"))
    v = F.col("v")
    e = e.withColumn("grade", F.when(v < 1500, 0).when(v < 4000, 1).when(v < 8000, 2).when(v < 14000, 3).otherwise(4))
    subject = F.concat(F.lit("S"), F.col("user_id").cast("string"))
    logit = (F.col("grade") * 2000 + F.col("h") - 7000).cast("double") / F.lit(1000.0)
    return e.select(
        F.col("event_id").alias("case_id"), F.col("event_id").alias("row_id"), subject.alias("subject"),
        F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("side"),
        F.concat(subject, F.lit(":"), F.col("ts").cast("date").cast("string")).alias("visit"), F.col("event_type").alias("device"), F.col("ts").cast("timestamp").alias("created"), "grade",
        (F.col("grade") >= 2).cast("int").alias("y"), "h", "v", logit.alias("logit"), rounded(1 / (1 + F.exp(-logit))).alias("prob"), F.when(v % 20 == 0, 0).otherwise(1).alias("gradable"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_of(cases(spark, sf_dir))


def predictions_of(scored: DataFrame) -> DataFrame:
    p, h = F.col("prob"), F.col("h")
    decision = F.when((F.col("gradable") == 0) | (p > 0.35) & (p < 0.65), "MANUAL_REVIEW").when(p >= 0.5, "REFER").otherwise("ROUTINE")
    return scored.select(
        "*", decision.alias("decision"), F.when(F.col("gradable") == 0, None).otherwise(p).alias("probability"), (h % 50 == 0).cast("int").alias("is_demo"),
        F.when(h % 40 == 1, 0).when(h % 40 == 2, None).otherwise(1).alias("validated"), (h % 900).cast("double").alias("latency_ms"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts_of(predictions(spark, sf_dir))


def verdicts_of(preds: DataFrame) -> DataFrame:
    """0 to 3 revisions a case; later rows win."""
    p = preds.where("h % 3 = 0").select("case_id", "created", "y", "grade", F.explode(F.sequence(F.lit(0), F.least(F.lit(2), (F.col("h") % 4).cast("int")))).alias("revision"))
    p = p.withColumn("verdict_id", F.col("case_id") * 10 + F.col("revision")).withColumn("g", hash32(F.col("verdict_id")))
    g, y = F.col("g"), F.col("y") == 1
    verdict = F.when(g % 17 == 0, "UNGRADABLE").when(g % 10 < 8, F.when(y, "REFER").otherwise("ROUTINE")).otherwise(F.when(y, "ROUTINE").otherwise("REFER"))
    return p.select(
        "verdict_id", F.col("verdict_id").alias("row_id"), "case_id", "revision", F.col("created").alias("case_created"), F.concat(F.lit("g"), (g % 5).cast("string")).alias("grader"),
        verdict.alias("verdict"), F.when(g % 4 == 0, F.col("grade")).alias("grade"), F.when(g % 5 == 0, F.col("y")).alias("dme"),
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human rejection beside a model's score."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    score = ((1 - F.col("quality")) * 5000 + hash32(F.col("doc_id")) % 10000).cast("double") / F.lit(15000.0)
    return j.select(
        F.col("doc_id").alias("item"), F.concat(F.lit("d/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("_x.jpg")).alias("filename"), F.col("source").alias("subject"),
        (1 - F.col("quality")).alias("reject"), F.col("toxic").alias("reason_flag"), score.alias("p_ungradable"), F.col("n_chars").cast("double").alias("blur_var"),
    )


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.md5(F.col("text").cast("binary")).alias("content_md5"), (hash32(F.col("source")) % 5).alias("grade"), "source", "lang")
