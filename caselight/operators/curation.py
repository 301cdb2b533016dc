"""Duplicates, strata, roles of rows in training, snapshots and reports on them."""

from __future__ import annotations

import ipaddress
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.columns import code_share, hash_uniform, locked_split, pseudonym
from caselight.operators.reports import assert_no_leakage
from caselight.operators.store import written
from caselight.operators.tables import hamming_pairs, hash_ranks, latest_verdict


def near_groups(df: DataFrame, key: str, bits: str, distance: int) -> DataFrame:
    """(key, leader): in order of key a row joins the first leader within the distance, else becomes one. Not transitive.

    A row is settled once its earlier neighbours are: one leader among them makes it a member, none makes it a leader. Each
    round settles all such rows at once, so there are as many rounds as the longest chain of neighbours, not as rows.
    """
    led = near_walk(written(hamming_pairs(df, key, bits, distance).select("a", "b"), "pairs"))
    return df.select(key).join(led.withColumnRenamed("b", key), key, "left").withColumn("leader", F.coalesce("leader", key))


def near_walk(pairs: DataFrame) -> DataFrame:
    """(b, leader) of the members among the rows of pairs (a, b) with a < b, a stored table: see near_groups()."""
    state = written(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().withColumn("state", F.lit("open")), "state")
    while state.where("state = 'open'").limit(1).count():
        seen = pairs.join(state.select(F.col("k").alias("a"), F.col("state").alias("s")), "a").groupBy("b").agg(F.bool_or(F.col("s") == "leader").alias("led"), F.bool_and(F.col("s") == "member").alias("free"))
        now = F.when(F.col("state") != "open", F.col("state")).when(F.col("led"), "member").when(F.coalesce("free", F.lit(True)), "leader").otherwise("open")
        state = written(state.join(seen, state.k == seen.b, "left").select("k", now.alias("state")), "state")
    leaders, members = state.where("state = 'leader'").select(F.col("k").alias("a")), state.where("state = 'member'").select(F.col("k").alias("b"))
    return pairs.join(leaders, "a", "left_semi").join(members, "b", "left_semi").groupBy("b").agg(F.min("a").alias("leader"))


def flagged_groups(groups: DataFrame, most: int = 8) -> DataFrame:
    """(leader, n, suspicious) for groups of two and more; those over the limit are flagged, not removed."""
    return groups.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").withColumn("suspicious", F.col("n") > most)


def deduplicated(near: DataFrame, content: DataFrame, key: str, digest: str, most: int = 8, guard: float = 0.25) -> DataFrame:
    """Rows of content that stay: leaders of near groups, and the first of exact groups that no near group touches. An error if more than `guard` would go."""
    flagged = flagged_groups(near, most)
    members = near.join(flagged.where("not suspicious").select("leader"), "leader", "left_semi")
    exact = content.join(members.select(key), key, "left_anti").groupBy(digest).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    out = members.where(F.col(key) != F.col("leader")).select(key)
    copies = content.join(members.select(key), key, "left_anti").join(exact, digest).where(F.col(key) != F.col("first")).select(key)
    gone = written(out.unionByName(copies), "gone")
    if gone.count() > guard * content.count():
        raise ValueError("more rows than the guard allows would go")
    return content.join(gone, key, "left_anti")


def collapsed_strata(counts: DataFrame, grade: str, least: int) -> dict[int, int]:
    """Grade -> label of its stratum: from the top down grades are merged until a stratum has enough rows; what is left joins the last one. counts has a row for each grade."""
    groups: list[tuple[list[int], int]] = []
    for g, n in sorted(((r[0], r[1]) for r in counts.select(grade, "n").collect()), reverse=True):
        if groups and groups[-1][1] < least:
            groups[-1] = ([*groups[-1][0], g], groups[-1][1] + n)
        else:
            groups.append(([g], n))
    if len(groups) > 1 and groups[-1][1] < least:
        tail = groups.pop()
        groups[-1] = (groups[-1][0] + tail[0], groups[-1][1] + tail[1])
    return {g: min(gs) for gs, _ in groups for g in gs}


def split_merged(df: DataFrame, subject: str, grade: str, ratios: tuple[float, float] = (0.70, 0.85), seed: str = "split") -> DataFrame:
    """(subject, stratum, split) as split_by_subject(), but strata with too few subjects for every part are merged with their neighbours
    first (one stratum is none); an error if a subject came out in two parts."""
    worst = df.groupBy(subject).agg(F.max(grade).alias("stratum"))
    counts = worst.groupBy("stratum").agg(F.count("*").alias("n"))  # a row for each grade
    merged = collapsed_strata(counts.where("stratum is not null"), "stratum", max(3, math.ceil(2 / (1 - ratios[0]))))
    pairs = [F.lit(x) for kv in merged.items() for x in kv]
    own = F.create_map(*pairs)[F.col("stratum")] if pairs else F.col("stratum")
    ranked = hash_ranks(worst.withColumn("stratum", own).withColumn("u", hash_uniform(seed, F.col(subject))), "stratum", "u", subject)
    share = (F.col("rank") - 0.5) / F.col("size")
    part = F.when(share < ratios[0], "train").when(share < ratios[1], "val").otherwise("test")
    return assert_no_leakage(ranked.select(subject, "stratum", part.alias("split")), subject, "split")


def grouped_folds(df: DataFrame, subject: str, y: str, k: int = 5, seed: str = "groups") -> DataFrame:
    """(subject, fold, role): subjects by hash rank within the bucket of their share of positives; fold 0 is test, 1 is val."""
    share = df.groupBy(subject).agg(F.avg(F.col(y).cast("double")).alias("share"))
    bucket = F.when(F.col("share") == 0, 0).when(F.col("share") <= 0.5, 1).otherwise(2)
    ranked = hash_ranks(share.withColumn("bucket", bucket).withColumn("u", hash_uniform(seed, F.col(subject))), "bucket", "u", subject)
    fold = ((F.col("rank") - 1) % k).cast("int")
    return ranked.withColumn("fold", fold).select(subject, "fold", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train").alias("role"))


def training_roles(base: DataFrame, local: DataFrame, code: str, split: str) -> DataFrame:
    """Base and local rows with their role: locked local rows are a test set of their own and never train."""
    role = F.when(F.col(split) == "locked_test", "local test").when(code_share(F.col(code), 9) < 0.2, "val").otherwise("train")
    rows = base.withColumn("origin", F.lit("base")).withColumn("role", F.when(F.col(split) == "test", "base test").otherwise(F.col(split)))
    return rows.unionByName(local.withColumn("origin", F.lit("local")).withColumn("role", role), allowMissingColumns=True)


def snapshot(preds: DataFrame, verdicts: DataFrame, key_hex: str, available: DataFrame | None = None) -> DataFrame:
    """Reviewed cases under pseudonyms: month instead of date, nothing of graders, labels from the latest verdict, the model's answer beside.

    Cases join by their ids and are hashed afterwards. Cases without a subject, and those not in `available` (case_id of the images that
    retention has left), are left out. A verdict's array `findings` is joined by semicolons.
    """
    v = latest_verdict(verdicts).select("case_id", "verdict", F.col("grade").alias("human_grade"), F.col("dme").alias("human_dme"))
    if "findings" in verdicts.columns:
        v = v.join(verdicts.groupBy("case_id").agg(F.max_by("findings", F.struct("case_created", "row_id")).alias("findings")), "case_id")
    else:
        v = v.withColumn("findings", F.array().cast("array<string>"))
    rows = preds.where(F.col("subject").isNotNull()).join(v, "case_id")
    if available is not None:
        rows = rows.join(available.select("case_id").distinct(), "case_id", "left_semi")
    code = lambda kind, c: pseudonym(key_hex, kind, c).alias(f"{kind}_code")
    label = F.when(F.col("verdict") == "REFER", 1).when(F.col("verdict") == "ROUTINE", 0)
    out = rows.select(
        code("subject", F.col("subject")), code("case", F.col("case_id")), code("visit", F.coalesce("visit", F.lit(""))), "side", F.date_format("created", "yyyy-MM").alias("month"), "device", "verdict",
        (F.col("verdict") != "UNGRADABLE").cast("int").alias("human_gradable"), label.alias("human_referable"), "human_grade", "human_dme", F.coalesce(F.array_join("findings", ";"), F.lit("")).alias("findings"),
        F.col("decision").alias("model_decision"), F.col("probability").alias("model_probability"), F.col("gradable").alias("model_gradable"),
    )
    return out.withColumn("split", locked_split(F.col("subject_code")))


def dataset_card(rows: DataFrame, graders: DataFrame | None = None) -> DataFrame:
    """One row that describes a snapshot; graders is a table with their names, of which only the number is told."""
    counts = rows.agg(
        F.count("*").alias("images"), F.countDistinct("subject_code").alias("subjects"), F.countDistinct("visit_code").alias("visits"),
        F.array_join(F.array_sort(F.collect_set("month")), ",").alias("months"), F.count_if(F.col("split") == "locked_test").alias("locked"), F.countDistinct(F.when(F.col("split") == "locked_test", F.col("subject_code"))).alias("locked_subjects"),
        F.count("human_grade").alias("graded"), F.count("human_referable").alias("with_label"), F.count("human_dme").alias("with_dme"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("REFER", "ROUTINE", "UNGRADABLE")],
    )
    found = rows.select(F.explode(F.split("findings", ";")).alias("f")).where("f <> ''").groupBy("f").agg(F.count("*").alias("n"))  # a row for each known code
    found = found.agg(F.array_join(F.array_sort(F.collect_list(F.concat("f", F.lit("="), F.col("n").cast("string")))), ",").alias("findings"))
    n = graders.agg(F.countDistinct("grader").alias("graders")) if graders is not None else rows.sparkSession.createDataFrame([(None,)], "graders long")
    return counts.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(n))


def learning_progress(rows: DataFrame, needs: tuple[int, int, int, int] = (20, 30, 30, 30)) -> DataFrame:
    """(step, have, need, ready) from reviewed cases (verdict, grade, dme)."""
    n = rows.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("UNGRADABLE", "REFER", "ROUTINE")], F.count("grade").alias("grade"), F.count("dme").alias("dme"))
    have = {"quality": F.col("UNGRADABLE"), "referral": F.least("REFER", "ROUTINE"), "grades": F.col("grade"), "finding": F.col("dme")}
    steps = F.array(*[F.struct(F.lit(s).alias("step"), h.alias("have"), F.lit(k).alias("need")) for (s, h), k in zip(have.items(), needs, strict=True)])
    return n.select(F.explode(steps).alias("s")).select("s.*", (F.col("s.have") >= F.col("s.need")).alias("ready"))


def reason_agreement(df: DataFrame, causes: list[str], threshold: float) -> DataFrame:
    """One row: of rejected rows with all labels, how often a cause was named, the first one was right, and any was. Columns p_<cause> and has_<cause>."""
    named = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"p_{c}")).alias("m"), F.lit(k).alias("k"), (F.col(f"has_{c}") == 1).alias("ok")) for k, c in enumerate(causes)]), lambda s: -s["m"] >= threshold))
    full = F.lit(True)
    for c in causes:
        full = full & F.col(f"has_{c}").isNotNull()
    rows = df.select(named.alias("named"), full.alias("full"))
    has = F.size("named") > 0
    sure = has & F.col("full")
    return rows.agg(F.count("*").alias("rejected"), F.count_if(has).alias("named"), F.count_if(sure).alias("checked"), F.count_if(sure & F.try_element_at("named", F.lit(1))["ok"]).alias("first_confirmed"), F.count_if(sure & F.exists("named", lambda s: s["ok"])).alias("any_confirmed"))


def reason_precision(df: DataFrame, causes: list[str], threshold: float) -> DataFrame:
    """(cause, named, checked, confirmed, precision) of rejected rows: how often each cause was named, and of those with its label how often rightly."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cause"), (F.col(f"p_{c}") >= threshold).alias("named"), F.col(f"has_{c}").alias("has")) for c in causes])).alias("c")
    rows = df.select(each).select("c.*").where("named")
    g = rows.groupBy("cause").agg(F.count("*").alias("named"), F.count("has").alias("checked"), F.count_if(F.col("has") == 1).alias("confirmed"))
    return g.withColumn("precision", F.try_divide(F.col("confirmed"), F.col("checked").cast("double")))


def address(c: Column) -> Column:
    """An IPv4 address (also one mapped into IPv6) as a number; null if it is none."""
    v4 = F.regexp_extract(F.lower(F.trim(c)), r"^(?:::ffff:)?(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", 0)
    parts = F.transform(F.split(F.element_at(F.split(v4, ":"), -1), r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("long"))
    ok = (F.size(parts) == 4) & F.forall(parts, lambda x: F.coalesce(x <= 255, F.lit(False)))
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def allowed_clients(log: DataFrame, ip: str, networks: list[str]) -> DataFrame:
    """Adds allowed: in one of the networks of either version or a loopback; what can't be read is refused, a wrong network is an error."""
    known = [ipaddress.ip_network(x) for x in [*networks, "127.0.0.0/8", "::1/128"]]
    spans = [(int(n.network_address), int(n.broadcast_address)) for n in known if n.version == 4]
    wide = [n for n in known if n.version == 6]

    @F.pandas_udf("boolean")
    def in_wide(values: pd.Series) -> pd.Series:
        def one(value: str | None) -> bool:
            try:
                at = ipaddress.IPv6Address(value.strip()) if value and ":" in value else None
            except ValueError:
                at = None
            return at is not None and at.ipv4_mapped is None and any(at in n for n in wide)

        return values.map(one)

    at = address(F.col(ip))
    hit = F.lit(False)
    for lo, hi in spans:
        hit = hit | F.coalesce(at.between(lo, hi), F.lit(False))
    return log.withColumn("allowed", hit | F.coalesce(in_wide(F.col(ip)), F.lit(False)))


def visit_reports(cases: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, rejects): one DiagnosticReport as JSON for each visit; visits that mix subjects are rejected.

    cases: visit, case_id, subject, side, outcome, origin, probability, and if they have them grader, model_version, suspected and
    finding_status. decisions: visit, decision, final, and reasons (an array) if they have them.
    """
    has = lambda c: c in cases.columns
    side = F.when(F.col("side") == "left", "8966001").when(F.col("side") == "right", "18944008")  # fixed values: SNOMED CT codes of the left and right eye
    site = F.when(side.isNotNull(), F.struct(F.array(F.struct(F.lit("http://snomed.info/sct").alias("system"), side.alias("code"))).alias("coding")))
    text = lambda x: F.struct(x.alias("text"))
    human = F.col("origin") == "grader"
    method = F.when(human, "grader").otherwise(F.concat(F.lit("model "), F.coalesce(F.col("model_version") if has("model_version") else F.lit(None).cast("string"), F.lit("unknown"))))
    part = F.struct(text(F.lit("probability")).alias("code"), F.round("probability", 4).alias("value"), F.lit(None).cast("string").alias("finding"))
    parts = F.when(F.col("probability").isNotNull(), F.array(part)).otherwise(F.array().cast("array<struct<code:struct<text:string>,value:double,finding:string>>"))
    if has("suspected") and has("finding_status"):
        advice = F.when(F.col("finding_status") == "validated", "finding").otherwise("finding, advice only")
        more = F.struct(text(advice).alias("code"), F.lit(None).cast("double").alias("value"), F.when(F.col("suspected"), "suspected").otherwise("not suspected").alias("finding"))
        parts = F.concat(parts, F.when(F.col("suspected").isNotNull(), F.array(more)).otherwise(F.array().cast("array<struct<code:struct<text:string>,value:double,finding:string>>")))
    performer = F.when(human & F.col("grader").isNotNull(), F.array(F.struct(F.col("grader").alias("display")))) if has("grader") else F.lit(None).cast("array<struct<display:string>>")
    seen = F.struct(
        F.col("case_id"), F.lit("Observation").alias("resourceType"), F.concat(F.lit("obs-"), F.col("case_id").cast("string")).alias("id"), F.when(human, "final").otherwise("preliminary").alias("status"),
        text(F.lit("triage")).alias("code"), text(F.col("outcome")).alias("valueCodeableConcept"), text(method).alias("method"), site.alias("bodySite"), parts.alias("component"), performer.alias("performer"),
    )
    g = cases.where(F.col("visit").isNotNull()).groupBy("visit").agg(F.countDistinct("subject").alias("subjects"), F.max("subject").alias("subject"), F.array_sort(F.collect_list(seen)).alias("contained"))
    why = F.col("reasons") if "reasons" in decisions.columns else F.array().cast("array<string>")
    ok = g.where("subjects <= 1").join(decisions.select("visit", "decision", "final", why.alias("why")), "visit")
    report = F.struct(
        F.lit("DiagnosticReport").alias("resourceType"), F.concat(F.lit("visit-"), "visit").alias("id"), F.when(F.col("final"), "final").otherwise("preliminary").alias("status"), text(F.lit("screening")).alias("code"),
        F.array(F.struct(F.lit("urn:visit").alias("system"), F.col("visit").alias("value"))).alias("identifier"), F.when(F.col("subject").isNotNull(), F.struct(F.concat(F.lit("Patient/"), "subject").alias("reference"))).alias("subject"),
        F.transform("contained", lambda o: o.dropFields("case_id")).alias("contained"), F.transform("contained", lambda o: F.struct(F.concat(F.lit("#"), o["id"]).alias("reference"))).alias("result"),
        F.array_join(F.concat(F.array("decision"), "why"), "; ").alias("conclusion"), F.array(text(F.col("decision"))).alias("conclusionCode"),
    )
    return ok.select("visit", F.to_json(report).alias("report")), g.where("subjects > 1").select("visit", "subjects")


def encrypted(df: DataFrame, key_hex: str, case: str, kind: str, content: str) -> DataFrame:
    """(case, kind, blob): AES-GCM; case ids must be alphanumeric and kinds known, else an error when the row is read."""
    good = F.col(case).cast("string").rlike("^[A-Za-z0-9]+$") & F.col(kind).isin("raw", "preview", "gradcam")
    blob = F.when(good, F.aes_encrypt(F.col(content), F.unhex(F.lit(key_hex)))).otherwise(F.raise_error(F.lit("case id or kind not allowed")).cast("binary"))
    return df.select(case, kind, blob.alias("blob"))


def decrypted(df: DataFrame, key_hex: str) -> DataFrame:
    return df.withColumn("content", F.aes_decrypt("blob", F.unhex(F.lit(key_hex)))).drop("blob")


def migrated(df: DataFrame, key_hex: str, case: str, kind: str, content: str) -> DataFrame:
    """(case, kind, blob) of plain rows; an error when a row is read that doesn't decrypt to what it was."""
    # The digest of the original travels beside the blob, so that the check compares with what was read.
    rows = df.select(case, kind, F.sha2(F.col(content), 256).alias("_sha"), F.aes_encrypt(F.col(content), F.unhex(F.lit(key_hex))).alias("_blob"))
    same = F.sha2(F.aes_decrypt("_blob", F.unhex(F.lit(key_hex))), 256) == F.col("_sha")
    checked = F.when(same, F.col("_blob")).otherwise(F.raise_error(F.lit("a blob doesn't decrypt to its content")).cast("binary"))
    good = F.col(case).cast("string").rlike("^[A-Za-z0-9]+$") & F.col(kind).isin("raw", "preview", "gradcam")
    return rows.select(case, kind, F.when(good, checked).otherwise(F.raise_error(F.lit("case id or kind not allowed")).cast("binary")).alias("blob"))


def older_than(df: DataFrame, created: str, days: int, now: Column) -> Column:
    return F.col(created) < now - F.make_dt_interval(F.lit(days))


def purged(df: DataFrame, created: str, days: int, now: Column, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, counts): rows older than `days` go; counts has kind, purged and kept. Rows without a date stay."""
    old = F.coalesce(older_than(df, created, days, now), F.lit(False))
    counts = df.groupBy(F.col(kind).alias("kind")).agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))
    return df.where(~old), counts


def purge_files(df: DataFrame, target: str, created: str, days: int, now: Column, kind: str) -> int:
    """Writes what stays to a new folder and returns how many rows went. To put it in the old folder's place is the caller's."""
    kept, counts = purged(df, created, days, now, kind)
    kept.write.mode("errorifexists").parquet(target)
    return counts.agg(F.coalesce(F.sum("purged"), F.lit(0))).first()[0]


#: Hexadecimal digits of a name's hash by which names are dealt to the leaves of a set's fingerprint.
LEAF_DIGITS = 3


def set_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """(fingerprint, n): the root of a tree of SHA-256 hashes over the sorted names, with a leaf for each first digits of a name's hash.

    A leaf sorts one part in 4096 of the names; repeated names count."""
    sha = F.sha2(F.col(name).cast("binary"), 256)
    leaves = df.select(sha.alias("s")).groupBy(F.substring("s", 1, LEAF_DIGITS).alias("leaf")).agg(F.sort_array(F.collect_list("s")).alias("names"))
    hashed = leaves.select("leaf", F.size("names").alias("n"), F.sha2(F.array_join("names", "").cast("binary"), 256).alias("h"))
    root = hashed.agg(F.array_sort(F.collect_list(F.struct("leaf", "h"))).alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return root.select(F.sha2(F.array_join(F.transform("all", lambda x: F.concat(x["leaf"], x["h"])), "").cast("binary"), 256).alias("fingerprint"), "n")


def same_set(df: DataFrame, name: str, expected: str) -> None:
    """An error unless the rows are the ones whose fingerprint was stored."""
    if set_fingerprint(df, name).first().fingerprint != expected:
        raise ValueError("the evaluation set is not the one measured before")
