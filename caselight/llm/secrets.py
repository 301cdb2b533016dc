"""Secret scans with a trigram inverted index: Boolean trigram queries from each rule, intersected postings, verified candidates."""

from __future__ import annotations

import math
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SIEVE_BITS, bit_set, in_bucket, stored

#: Kind, pattern, whether letters match in either case, the group whose length counts, its least length.
RULES: tuple[tuple[str, str, bool, int, int], ...] = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 16),
    ("hex", r"[0-9a-f]+", False, 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 20),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 40),
)
BASE = ("assign", "access", "hex")
#: Rules without a mandatory trigram scan all texts; a text without this has no match of the least length.
SIEVES = {"hex": "[0-9a-f]{32}"}
#: Bitmaps of candidates that are broadcast at most, of 4 KB for each rule: 28 MB. Bits beyond their number are shared.
MOST_BUCKETS = 1024
#: Documents of one shard of the postings; the number of shards grows with the input.
SHARD = 20_000


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-cased trigrams: every match has all trigrams of some alternative. Empty: some match may have none."""
    done: list[tuple[tuple[str, ...], str]] = [((), "")]
    cut = lambda found: [((*runs, now), "") for runs, now in found]

    def walk(tokens, found):
        for op, arg in tokens:
            if op is sre.LITERAL:
                found = [(runs, now + chr(arg).lower()) for runs, now in found]
            elif op is sre.SUBPATTERN:
                found = walk(arg[-1], found)
            elif op is sre.BRANCH:
                found = [x for branch in arg[1] for x in walk(branch, found)]
            elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
                found = found + walk(arg[2], found)
            else:
                found = cut(found)
        return found

    out = {frozenset(run[k : k + 3] for run in runs for k in range(len(run) - 2)) for runs, _ in cut(walk(sre_parse.parse(pattern), done))}
    return [] if frozenset() in out else sorted(out, key=sorted)


def spans(text: Column, kind: str, pattern: str, either_case: bool, group: int, least: int) -> Column:
    """array<struct<start,rank,end,kind>> of the leftmost non-overlapping matches whose group is long enough, in code points."""
    gap = ("(?si)" if either_case else "(?s)") + rf"\G(.*?)({pattern})"  # \G: after the last match no other start is tried
    part = lambda k: F.regexp_extract_all(text, F.lit(gap), k)
    rank = [r[0] for r in RULES].index(kind)
    found = F.arrays_zip(
        F.transform(part(1), F.length).alias("gap"), F.transform(part(2), F.length).alias("hit"), F.transform(part(group + 2), F.length).alias("part")
    )
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + m["gap"]
        end = start + m["hit"]
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(m["part"] >= least, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.aggregate(found, state, step, lambda s: s["out"])


def postings(rows: DataFrame, trigrams: list[str], shards: int) -> DataFrame:
    """(shard, lists): the inverted index of the rules' trigrams, a map of trigram to the ids of one shard's documents."""
    low = rows.where("id is not null").select("id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    found = low.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", F.explode(present).alias("trigram"))
    lists = found.groupBy("shard", "trigram").agg(F.collect_list("id").alias("ids"))
    return lists.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))


def candidates(rows: DataFrame, shards: int) -> DataFrame:
    """(id, rules): the documents whose trigrams fulfil the query of a rule that has one."""
    queries = {r[0]: trigram_query(r[1]) for r in RULES}
    queries = {kind: q for kind, q in queries.items() if q}
    trigrams = sorted({t for q in queries.values() for alternative in q for t in alternative})
    none = F.expr("cast(array() as array<bigint>)")
    ids = lambda t: F.coalesce(F.element_at("lists", F.lit(t)), none)

    def meet(alternative: frozenset[str]) -> Column:
        out, *more = [ids(t) for t in sorted(alternative)]
        for other in more:
            out = F.array_intersect(out, other)
        return out

    index = postings(rows, trigrams, shards)
    hits = index.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("rule"), F.array_distinct(F.flatten(F.array(*[meet(a) for a in q]))).alias("ids")) for kind, q in queries.items()])).alias("hit"))
    return hits.select(F.col("hit.rule").alias("rule"), F.explode("hit.ids").alias("id")).groupBy("id").agg(F.collect_set("rule").alias("rules"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) of every row: found is the array of (start, rank, end, kind) of all rules, by start and then rule.

    Candidates come back to the rows as bitmaps of bounded size, so that no text is shuffled; a row whose bit another document set
    is verified in vain. Null and empty texts have no spans. Rows with a null id aren't in the index and are scanned by every
    rule. Repeated rows give repeated results. Other columns are ignored. Empty table: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = stored(candidates(rows, max(1, math.ceil(docs.count() / SHARD))), "candidates")
    kinds = [r[0] for r in RULES if trigram_query(r[1])]
    buckets = max(1, min(MOST_BUCKETS, math.ceil(found.count() * 16 / SIEVE_BITS)))
    place = F.pmod(F.xxhash64("id"), F.lit(buckets * SIEVE_BITS))
    bit = lambda kind: F.bitmap_construct_agg(F.when(F.array_contains("rules", kind), place % SIEVE_BITS)).alias(kind)
    bitmaps = found.groupBy(in_bucket(F.col("id"), buckets).alias("bucket")).agg(*map(bit, kinds))
    joined = rows.withColumn("bucket", in_bucket(F.col("id"), buckets)).join(F.broadcast(bitmaps), "bucket", "left")
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    parts = []
    for kind, pattern, either, group, least in RULES:
        wanted = bit_set(kind, F.col("id"), buckets) | F.col("id").isNull() if kind in kinds else F.col("text").rlike(SIEVES.get(kind, pattern))
        parts.append(F.when(wanted, spans(F.col("text"), kind, pattern, either, group, least)).otherwise(empty))
    return joined.select(F.col("id").alias("doc_id"), F.array_sort(F.flatten(F.array(*parts))).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from find_secrets()."""
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
