"""A site's own profile, and recalibration that ends in the whole acceptance rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.operators import calibration as K
from caselight.operators.curation import set_fingerprint
from caselight.operators.gates import acceptance_failures

MEASURED = ["tp", "fp", "tn", "fn", "sensitivity", "specificity", "auroc", "ece"]


def measured(df: DataFrame, z: str, y: str, stored: DataFrame, profile: str, part: str) -> DataFrame:
    """One row: a stored profile (one row of calibration.PROFILE) with what it was fitted on, measured on df."""
    own = stored.select("method", "temperature", "band_low", "band_high", F.col("n").alias("fitted_on"), F.col("positives").alias("fitted_positives"))
    return K.profile_report(df, z, y, stored).crossJoin(F.broadcast(own)).select(
        F.lit(profile).alias("profile"), F.lit(part).alias("part"), "method", "temperature", "threshold", "band_low", "band_high", "fitted_on", "fitted_positives", *MEASURED, "coverage"
    )


def site_profile(calibration: DataFrame, evaluation: DataFrame, source: DataFrame, internal: DataFrame, key: str, z: str, y: str, target: float = 0.9, coverage: float = 0.85) -> DataFrame:
    """Three rows: the profile fitted on a site's calibration half (method, operating point, band), measured on its evaluation half; the source's profile there, for
    contrast; and the site's profile on the internal test, which is reported and not gated. Each row names the evaluation half by the fingerprint of its keys."""
    site, home = (K.fit_profile(part, key, z, y, target, coverage) for part in (calibration, source))
    rows = measured(evaluation, z, y, site, "site", "evaluation").unionByName(measured(evaluation, z, y, home, "source", "evaluation"))
    rows = rows.unionByName(measured(internal, z, y, site, "site", "internal"))
    return rows.crossJoin(F.broadcast(set_fingerprint(evaluation.select(F.col(key).cast("string").alias(key)), key).select("fingerprint", F.col("n").alias("evaluated"))))


def recalibrated_evidence(
    train: DataFrame, locked: DataFrame, current: DataFrame, internal: DataFrame, key: str, z: str, y: str, checkpoint: str, fingerprint: str, served: tuple[str, str] | None = None, target: float = 0.9
) -> DataFrame:
    """(profile, ..., failures, accepted): the current profile and a candidate fitted on the train part, both measured on the locked part, which becomes the external
    test of the acceptance rule; the internal test is the current evidence's. accepted: the candidate has no failure; the current profile stays stored whatever comes out.

    checkpoint and fingerprint are those of the evidence, served those of the model in service (the same if None). An error if a part has too few cases of a class.
    """
    K.assert_enough(train, locked, y)
    candidate = K.fit_profile(train, key, z, y, target)
    struct = F.struct("tp", "fn", "auroc", "sensitivity", "specificity", "ece")
    inside = measured(internal, z, y, current, "current", "internal").select(struct.alias("internal"))
    out = None
    for name, stored in (("current", current), ("candidate", candidate)):
        row = measured(locked, z, y, stored, name, "locked").withColumn("external", struct).crossJoin(F.broadcast(inside))
        row = row.withColumns({"checkpoint_sha256": F.lit(checkpoint), "preprocess_fingerprint": F.lit(fingerprint), "operating_point": F.col("threshold")})
        failures = acceptance_failures(row, *(served or (checkpoint, fingerprint)), external_required=True)
        row = row.select("profile", "method", "temperature", "threshold", "band_low", "band_high", *MEASURED, failures.alias("failures"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("accepted", (F.col("profile") == "candidate") & (F.size("failures") == 0))
