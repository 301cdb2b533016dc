"""Label tables, image folders, manifests and reports in files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.functions.columns import hash_uniform, norm_path, side_from_id
from caselight.operators.gates import subject_of

#: Images are measured at this size, whatever their own.
WORKING_SIZE = 512


def load_labels(spark: SparkSession, path: str, filename: str, grade: str, rejected: DataFrame | None = None, subject: tuple[str, str] | None = None) -> DataFrame:
    """CSV labels as (filename, grade, referable, other columns); rows that lack either go, a grade outside 0-4 is an error, files in rejected go.

    subject is a mode of gates.subject_of() and its column; it adds the column subject, and what can't tell one is an error."""
    df = spark.read.option("header", True).csv(path).withColumnsRenamed({filename: "filename", grade: "grade"})
    df = df.dropna(subset=["filename", "grade"]).withColumn("grade", F.expr("try_cast(grade as int)"))
    bad = df.where(~F.coalesce(F.col("grade").between(0, 4), F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"grades outside 0-4: {[r.filename for r in bad]}")
    df = df.withColumn("referable", (F.col("grade") >= 2).cast("int"))
    if subject is not None:
        df = df.withColumn("subject", subject_of(df, *subject))
    return df if rejected is None else df.join(rejected.select("filename").distinct(), "filename", "left_anti")


def assemble(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """The union of partitions whose names may collide: header blanks are stripped, unnamed columns go, keys get the partition's prefix; a key twice is an error."""
    out = None
    for prefix, part in parts.items():
        named = [(c, c.strip()) for c in part.columns if c.strip() and not c.strip().startswith("Unnamed")]
        part = part.select(*[F.col(f"`{c}`").alias(n) for c, n in named]).where(F.col(key).isNotNull()).withColumn(key, F.concat(F.lit(prefix), F.col(key)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no partitions")
    twice = out.groupBy(key).count().where("count > 1").limit(6).collect()
    if twice:
        raise ValueError(f"keys twice: {[r[0] for r in twice]}")
    return out


def merge_keep_last(previous: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Both reports, the new row where both have a key; of several in one report the last by `order` stays, or without it the one of the largest content."""
    both = previous.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "_batch")]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_batch", *([order] if order else []), *columns)).alias("_r")).select(key, "_r.*")


def resolve_filenames(labels: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Adds found (the file's path) by name, else by name without suffix; null if neither exists. files: path."""
    base = lambda c: F.element_at(F.split(norm_path(c), "/"), -1)
    stem = lambda c: F.regexp_replace(base(c), r"\.[^.]*$", "")
    by_name = files.groupBy(base(F.col("path")).alias("_name")).agg(F.min("path").alias("_exact"))
    by_stem = files.groupBy(stem(F.col("path")).alias("_stem")).agg(F.min("path").alias("_near"))
    j = labels.withColumn("_name", base(F.col(column))).withColumn("_stem", stem(F.col(column))).join(by_name, "_name", "left").join(by_stem, "_stem", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "repaired").otherwise("missing")
    return j.withColumn("found", F.coalesce("_exact", "_near")).withColumn("how", how).drop("_name", "_stem", "_exact", "_near")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(stored: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): files of the manifest that are missing or changed."""
    now = files.select("path", F.col("sha256").alias("_now"))
    j = stored.join(now, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_now")))
    return j.select("path", F.when(F.col("_now").isNull(), "missing").otherwise("changed").alias("problem"))


def _measures(height: int, width: int, channels: int, data: bytes) -> tuple[float, ...]:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    step = max(1, -(-max(height, width) // WORKING_SIZE))
    p = pixels[::step, ::step].astype(np.float32)
    b, g, r = (p[..., k] for k in (0, 1, 2)) if channels >= 3 else (p[..., 0],) * 3
    gray = 0.114 * b + 0.587 * g + 0.299 * r
    field = gray > 10
    share = float(field.mean())
    edge = np.zeros_like(gray)
    if min(gray.shape) > 2:
        edge[1:-1, 1:-1] = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1]
    inside = field if field.any() else np.ones_like(field)
    red = float(((r - g) / np.maximum(r + g + b, 1))[inside].mean())
    n, m = max(1, gray.shape[0] // 8), max(1, gray.shape[1] // 8)
    corner = float(np.mean([gray[:n, :m].mean(), gray[:n, -m:].mean(), gray[-n:, :m].mean(), gray[-n:, -m:].mean()])) / 255
    h4, w4 = gray.shape[0] // 4, gray.shape[1] // 4
    centre = float(gray[h4 : gray.shape[0] - h4, w4 : gray.shape[1] - w4].mean()) / 255
    return share, float(edge[inside].var()), float(gray[inside].mean()), red, corner, centre


def image_stats(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """(path, readable, fov_fraction, blur_var, mean_intensity, red, corner, centre, content_md5) of each image below a folder; unreadable ones keep a row."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # images are large
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    if done is not None:
        images = images.join(done.select(F.col("path").alias("origin")), "origin", "left_anti")

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(o, True, *_measures(h, w, c, d)) if h > 0 else (o, False, *[None] * 6) for o, h, w, c, d in part[["origin", "height", "width", "nChannels", "data"]].itertuples(index=False)]
            out = pd.DataFrame(rows, columns=["path", "readable", "fov_fraction", "blur_var", "mean_intensity", "red", "corner", "centre"])
            yield out.assign(content_md5=part["_md5"].to_numpy())

    digest = F.when(F.col("height") > 0, F.md5("data"))
    schema = "path string, readable boolean, fov_fraction double, blur_var double, mean_intensity double, red double, corner double, centre double, content_md5 string"
    return images.withColumn("_md5", digest).mapInPandas(measure, schema)


def _area(n: int, m: int) -> np.ndarray:
    """m x n weights that average n pixels over m equal stretches."""
    edges = np.linspace(0, n, m + 1)
    share = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
    return np.maximum(share, 0) / (n / m)


def _shrunk(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.rint(_area(plane.shape[0], height) @ plane @ _area(plane.shape[1], width).T)


def _difference_hash(height: int, width: int, channels: int, data: bytes, size: int = 16) -> str:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    b, g, r = (_shrunk(pixels[..., k if channels >= 3 else 0], 256, 256) for k in (0, 1, 2))
    small = _shrunk(np.rint(0.114 * b + 0.587 * g + 0.299 * r), size, size + 1)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def image_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, pixel_md5, dhash, h0-h3) of each readable image below a folder: a digest of the decoded pixels and 256 bits, whether a cell of a 16 x 17 grid is
    brighter than its left neighbour, as hex and as four longs. Unreadable images have no row; image_stats counts them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # images are large
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    images = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data", F.md5("image.data").alias("pixel_md5"))

    def fingerprint(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bits = [_difference_hash(*row) for row in part[["height", "width", "nChannels", "data"]].itertuples(index=False)]
            yield pd.DataFrame({"path": part["origin"], "pixel_md5": part["pixel_md5"], "dhash": bits})

    words = [F.conv(F.substring("dhash", 1 + 16 * k, 16), 16, -10).cast("long").alias(f"h{k}") for k in range(4)]
    return images.mapInPandas(fingerprint, "path string, pixel_md5 string, dhash string").select("*", *words)


def assemble_multisource(parts: dict[str, DataFrame], sites: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(image_id, subject, split, side, raw_grade, site, other columns): a union of splits whose columns differ. parts: image_id, patient_id (else the id's first
    piece), raw_grade or left_grade and right_grade, of which the id's side picks one. sites: image_id, site; unknown where missing. An id that names no side is
    an error, and so is one without a file where files (image_id) are given."""
    out = None
    for split, part in parts.items():
        side = side_from_id(F.col("image_id"))
        subject = F.col("patient_id") if "patient_id" in part.columns else F.element_at(F.split("image_id", "_"), 1)
        grade = F.col("raw_grade") if "raw_grade" in part.columns else F.when(side == "left", F.col("left_grade")).otherwise(F.col("right_grade"))
        others = [c for c in part.columns if c not in ("image_id", "patient_id", "raw_grade", "left_grade", "right_grade")]
        part = part.select("image_id", F.format_string("S%04d", subject.cast("long")).alias("subject"), F.lit(split).alias("split"), side.alias("side"), grade.alias("raw_grade"), *others)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no splits")
    bad = out.where("side is null").limit(5).collect()
    if bad:
        raise ValueError(f"ids that name no side: {[r.image_id for r in bad]}")
    if files is not None:
        gone = out.join(files.select("image_id").distinct(), "image_id", "left_anti").limit(5).collect()
        if gone:
            raise ValueError(f"no file for: {[r.image_id for r in gone]}")
    named = sites.groupBy("image_id").agg(F.max("site").alias("site"))
    return out.join(named, "image_id", "left").withColumn("site", F.coalesce("site", F.lit("unknown")))


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def experiments(runs: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """By group each column as mean ± population deviation over runs, three decimals."""
    return runs.groupBy(by).agg(*[F.format_string("%.3f ± %.3f", F.avg(c), F.stddev_pop(c)).alias(c) for c in columns])


def write_labels(df: DataFrame, path: str) -> None:
    """Graded labels (raw_grade 0-4) and quality labels side by side; a missing grade doesn't make a picture bad."""
    df.where(F.col("raw_grade").between(0, 4)).write.mode("overwrite").parquet(f"{path}/graded")
    good = (F.col("human_quality") == 1) & ~F.col("raw_grade").eqNullSafe(5)
    df.withColumn("quality", F.coalesce(good, F.lit(False)).cast("int")).write.mode("overwrite").parquet(f"{path}/quality")



#: Fixed values of demonstration tables: weights of grades, devices and age groups, and the share of ungradable pictures.
DEMO_GRADES, DEMO_DEVICES, DEMO_AGES, DEMO_UNGRADABLE = (0.55, 0.18, 0.14, 0.08, 0.05), {"camera_a": 0.6, "camera_b": 0.4}, {"18-39": 0.2, "40-59": 0.45, "60+": 0.35}, 0.06


def synthetic_labels(spark: SparkSession, subjects: int, seed: str = "demo") -> DataFrame:
    """(subject, side, filename, grade, device, sex, age_group, gradable): a demonstration table of two rows a subject, the same for a seed."""
    u = lambda what, *c: hash_uniform(f"{seed}:{what}", *c)

    def weighed(x: Column, weights: dict) -> Column:
        out, upto = F.lit(None), 0.0
        for value, w in weights.items():
            upto += w
            out = F.coalesce(out, F.when(x < upto, F.lit(value)))
        return F.coalesce(out, F.lit(list(weights)[-1]))

    one = spark.range(subjects).select(F.format_string("D%06d", "id").alias("subject"))
    s = F.col("subject")
    base = one.select(s, weighed(u("grade", s), dict(enumerate(DEMO_GRADES))).alias("worst"), weighed(u("device", s), DEMO_DEVICES).alias("device"), weighed(u("age", s), DEMO_AGES).alias("age_group"), F.when(u("sex", s) < 0.5, "F").otherwise("M").alias("sex"))
    rows = base.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    grade = F.greatest(F.lit(0), F.col("worst") - (u("side", s, F.col("side")) < 0.5).cast("int"))
    gradable = (u("quality", s, F.col("side")) >= DEMO_UNGRADABLE).cast("int")
    return rows.select("subject", "side", F.concat("subject", F.lit("_"), "side", F.lit(".png")).alias("filename"), grade.alias("grade"), "device", "sex", "age_group", gradable.alias("gradable"))
