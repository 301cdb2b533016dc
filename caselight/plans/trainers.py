"""Queries of the trainers; what they learn has no form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.functions import columns as C
from caselight.operators import metrics as M
from caselight.operators import trainers as T
from caselight.plans.catalog import query
from caselight.sources import bridge as B


def _vectors(spark, d):
    return B.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") % 5).alias("grade"))


@query()
def ordinal_trainer(spark, d):
    v = _vectors(spark, d)
    scored = T.score_ordinal(v, "embedding", T.fit_ordinal(v, "embedding", "grade"))
    return scored.select("vec_id", "grade", C.grade_decode(F.col("cumulative")).alias("predicted"))


@query()
def oof_cross_validate(spark, d):
    v = _vectors(spark, d).withColumn("y", (F.col("grade") >= 2).cast("int"))
    return T.oof_scores(v, "vec_id", "embedding", "y")


@query("select case_id, round(logit / 2.0::double, 6) as score from b_cases")
def score_fn(spark, d):
    return T.score_batches(B.cases(spark, d).select("case_id", "logit"), lambda: lambda part: part["logit"] / 2.0).select("case_id", "score")


@query()
def oof_report_by_fold(spark, d):
    v = _vectors(spark, d).withColumn("y", (F.col("grade") >= 2).cast("int"))
    return M.confusion(T.oof_scores(v, "vec_id", "embedding", "y"), "y", "score", 0.5, ["fold"])
