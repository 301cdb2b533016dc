"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, stored
from .license_texts import TEMPLATES

CUES = r"(?i)licen[sc]|copyright|spdx|rights\s+reserved|public\s+domain|permission\s+is|redistribut|mozilla public|warranty"
FILES = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
LEAST = 0.6
#: Non-empty lines of the windows that are compared besides single lines, for headers that go over several lines.
SPANS = (2, 4, 8)
#: Signs that begin a line of a comment and are no part of a header.
COMMENT = r"^\s*(?:[#*;%/<>!-]+|rem\b|dnl\b|\(\*)+\s*|\s*(?:\*/|-->|\*\))\s*$"


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def match_lines(lines: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """(line, n) of distinct pieces of text with their counts to (line, n, license, score): the best template, if its cosine is enough.

    Weights are term counts times ln((1 + pieces) / (1 + pieces with the term)) + 1, over all pieces.
    """
    sums = lines.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    counted = lambda df, key: df.select(*key, F.explode(_terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    # A piece is known by the hash of its text from here on; terms are counted within it before anything moves.
    tf = F.explode(F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("tf"))))
    own = lines.select(F.md5("line").alias("id"), "n", _terms(F.col("line")).alias("terms")).select("id", "n", tf.alias("t")).select("id", "n", "t.term", "t.tf")
    own = stored(own, "terms")
    df = stored(own.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("uses")), "document-frequencies")
    idf = F.log((F.lit(float(sums[0])) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    # A term that most pieces have is one row of df; lookup() sends it to the pieces instead of all pieces to it.
    own = lookup(own, df, "term", "uses", own.count()).withColumn("w", F.col("tf") * idf).select("id", "term", "w")
    kinds = counted(templates.select("template", "license", "text"), ["template", "license"]).join(df, "term", "left").withColumn("v", F.col("tf") * idf)
    kinds = kinds.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("template")))).select("template", "license", "term", "v", "norm")
    norms = own.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("line_norm"))
    # The templates are a list given with the library or by the caller: some thousand terms.
    dots = own.join(F.broadcast(kinds), "term").groupBy("id", "template", "license", "norm").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "id").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("line_norm")), 9))
    best = scored.groupBy("id").agg(F.max(F.struct("score", "license")).alias("best")).where(F.col("best.score") >= least)
    return lines.withColumn("id", F.md5("line")).join(best, "id").select("line", "n", F.col("best.license").alias("license"), F.col("best.score").alias("score"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it within other functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(text: Column, path: Column) -> Column:
    """What of a text is compared with the templates: each line with a cue, sentences with one within long lines, windows of SPANS lines
    that begin at most one line before a cue, and the whole text of a licence file."""
    none = F.array().cast("array<string>")
    bare = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, COMMENT, ""))), lambda x: x != "")

    def of_lines(lines: Column) -> Column:
        single = F.filter(lines, lambda x: x.rlike(CUES))
        long = F.flatten(F.transform(F.filter(single, lambda x: F.length(x) > 120), lambda x: F.filter(F.split(x, r"(?<=[.;!?])\s+"), lambda s: s.rlike(CUES))))
        # Places of lines with a cue, and those just before them.
        cued = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(CUES), i)), lambda i: i.isNotNull())
        at = F.filter(F.array_distinct(F.concat(cued, F.transform(cued, lambda i: i - 1))), lambda i: i >= 0)
        window = lambda n: lambda i: F.when(i + n <= F.size(lines), F.array_join(F.slice(lines, i + 1, F.lit(n)), " "))
        windows = _let(at, lambda starts: F.array_compact(F.flatten(F.array(*[F.transform(starts, window(n)) for n in SPANS]))))
        return F.when(F.size(lines) > 0, F.concat(single, F.array_distinct(F.concat(long, windows)))).otherwise(none)

    found = F.when(text.rlike(CUES), _let(bare, of_lines))
    return F.concat(F.coalesce(found, none), F.when(path.rlike(FILES) & (F.trim(text) != ""), F.array(F.trim(text))).otherwise(none))


def nearest_ancestor(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """(dir) and (dir, license, score) of licence files to (dir, license, score) from the nearest directory at or above dir."""
    parts = F.split("dir", "/")
    depths = F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")
    above = F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/").alias("above")
    up = dirs.where("dir is not null").distinct().select("dir", depths).select("dir", "depth", above)
    named = files.groupBy(F.col("dir").alias("above")).agg(F.max(F.struct("score", "license")).alias("best"))
    near = up.join(named, "above").groupBy("dir").agg(F.max(F.struct("depth", "best")).alias("near"))
    return near.select("dir", F.col("near.best.license").alias("license"), F.col("near.best.score").alias("score"))


def scan_licenses(docs: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, path, license, score, origin, n_lines) of every row of docs.

    Lines, long lines' sentences and windows of lines with a licence cue, and the whole text of licence files, are compared with the
    templates; the best one wins, ties by name. Rows without one inherit from the licence file in the nearest directory at or above
    theirs; origin is own, inherited or null. n_lines is the number of pieces that match a template. Null text counts as empty; a
    null path inherits nothing; null ids and repeated rows stay. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    if templates is None:
        templates = spark.createDataFrame([(k, *t) for k, t in enumerate(TEMPLATES)], "template int, license string, text string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(None).cast("string"))
    lines = F.coalesce(pieces(text, F.coalesce(path, F.lit(""))), F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), lines.alias("lines"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "lines")  # stored: the numbers stay as they are
    exploded = rows.select("row", F.explode("lines").alias("line"))
    matched = stored(match_lines(stored(exploded.groupBy("line").agg(F.count("*").alias("n")), "distinct-lines"), templates, least), "matched")
    found = lookup(exploded, matched, "line", "n", exploded.count()).where("license is not null")
    found = found.groupBy("row").agg(F.max(F.struct("score", "license")).alias("best"), F.count("*").alias("n_lines"))
    dir_of = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), "")
    scanned = rows.drop("lines").join(found, "row", "left").withColumn("dir", dir_of)
    files = scanned.where(F.col("path").rlike(FILES) & F.col("best").isNotNull()).select("dir", F.col("best.license").alias("license"), F.col("best.score").alias("score"))
    by_dir = rows.groupBy(dir_of.alias("dir")).agg(F.count("*").alias("n_rows"))
    above = nearest_ancestor(by_dir.select("dir"), files).join(by_dir, "dir").select("dir", F.struct("license", "score").alias("above"), "n_rows")
    joined = lookup(scanned, stored(above, "inherited"), "dir", "n_rows", rows.count())
    origin = F.when(F.col("best").isNotNull(), "own").when(F.col("above").isNotNull(), "inherited")
    return joined.select(
        "doc_id", "path", F.coalesce("best.license", "above.license").alias("license"), F.coalesce("best.score", "above.score").alias("score"),
        origin.alias("origin"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
    )
