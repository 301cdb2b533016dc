"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversations, decontaminate, exactdedup, html, licenses, mixing, pieces, pii, quality, secrets, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a setting of the session; the one used without it is no secret and serves tests."""
    return pii.anonymise(_table(spark, sf_dir, "documents"), spark.conf.get("spark.caselight.pii.key", "no secret"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in directories source/lang/k of 50 ids each; those of which half the lines or more speak of a licence are its LICENSE files."""
    docs = _table(spark, sf_dir, "documents")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    cued = F.col("text").rlike(licenses.CUES) & (F.size(F.filter(lines, lambda x: x.rlike(licenses.CUES))) * 2 >= F.size(lines))
    name = F.concat(F.when(cued, "LICENSE-").otherwise(""), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt"))
    folder = F.coalesce(F.floor(F.col("doc_id") / 50).cast("string"), F.lit("null"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), folder, name)
    return licenses.scan_licenses(docs.withColumn("path", path))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model is a file of the driver; its bytes (half a MB) go to the tasks."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return pieces.digest(pieces.encode(_table(spark, sf_dir, "documents"), model, keep=["doc_id"]))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_after_damage(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_html, op4_decontamination, op5_pii, op6_toxicity, op7_mixing, op8_licenses, op9_secrets, op10_exact_dedup, op11_sentencepiece, op12_collocations, op13_conversations)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _gaps(kind: str, rank: int, pattern: str, flags: str, group: int, least: int) -> str:
    """Spans of one rule by the lengths of gaps and matches, as DuckDB SQL."""
    cut = lambda k: f"regexp_extract_all(text, '(?{flags}s)(.*?)({pattern})', {k})"
    return f"""select doc_id, '{kind}' as kind, {rank} as rnk, 'len' as l, generate_subscripts(hits, 1) as i, gaps, hits, parts, {least} as least
        from (select doc_id, {cut(1)} as gaps, {cut(2)} as hits, {cut(group + 2)} as parts from documents)"""


_SPANS = f"""
with raw as ({_gaps("assign", 0, _ASSIGN, "i", 2, 8)} union all {_gaps("access", 1, "AKIA[A-Z0-9]+", "", 0, 16)} union all {_gaps("hex", 2, "[0-9a-f]{32,}", "", 0, 32)}
  union all {_gaps("private_key", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 0, 1)} union all {_gaps("github", 4, "gh[pousr]_[A-Za-z0-9]+", "", 0, 40)}
  union all {_gaps("slack", 5, "xox[abprs]-[A-Za-z0-9-]+", "", 0, 20)} union all {_gaps("google", 6, "AIza[A-Za-z0-9_-]+", "", 0, 39)}
  union all {_gaps("jwt", 7, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", "", 0, 40)}),
spans as (select doc_id, kind, rnk, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) as st,
  length(hits[i]) as n from raw where length(parts[i]) >= least),
named as (select doc_id, kind, rnk, cast(st as bigint) as st, kind || ':' || cast(cast(st as bigint) as varchar) || ':' || cast(cast(st as bigint) + n as varchar) as s from spans),
agg as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  coalesce(string_agg(s, ',' order by st, rnk) filter (rnk < 3), '') as base, string_agg(s, ',' order by st, rnk) as spans from named group by 1)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans from documents d left join agg a on d.doc_id = a.doc_id"""

_PHRASES = f"""
with docs as (select row_number() over () as d, coalesce(lang, 'und') as lang, {_LOWER} as text from documents),
pieces as (select d, lang, generate_subscripts(parts, 1) as p, unnest(parts) as piece from (select d, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') as parts from docs)),
words as (select lang, d, p, generate_subscripts(w, 1) as k, unnest(w) as w from (select d, lang, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces)),
grams as (select lang, w as w1, lead(w) over s as w2, lead(w, 2) over s as w3 from words window s as (partition by d, p order by k)),
f as (select lang, w1 as phrase, 1 as size, w1, null as w2, null as w3, count(*) as f from grams group by all
  union all select lang, w1 || ' ' || w2, 2, w1, w2, null, count(*) from grams where w2 is not null group by all
  union all select lang, w1 || ' ' || w2 || ' ' || w3, 3, w1, w2, w3, count(*) from grams where w3 is not null group by all),
n as (select lang, count(*) as n from words group by lang),
c as (select * from f where size > 1 and f >= 10),
o as (select lang, phrase, max(o) as o from (select lang, w1 || ' ' || w2 as phrase, f as o from c where size = 3 union all select lang, w2 || ' ' || w3, f from c where size = 3) group by all),
cuts as (select lang, phrase, f as a, 1 as k, w1 as lp, case when size = 2 then w2 else w2 || ' ' || w3 end as rp from c union all select lang, phrase, f, 2, w1 || ' ' || w2, w3 from c where size = 3),
scored as (select t.lang, t.phrase, t.a, k, x.f as l, y.f as r, 1000000::hugeint * t.a * t.a // (x.f::hugeint * y.f) as score
  from cuts t join f x on x.lang = t.lang and x.phrase = t.lp join f y on y.lang = t.lang and y.phrase = t.rp),
weakest as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as i from scored) where i = 1),
kept as (select w.* from weakest w left join o on o.lang = w.lang and o.phrase = w.phrase where o.o is null or 100 * o.o < 50 * w.a)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from kept join n using (lang)) where rank <= 2000"""

ORACLES = {
    "op12_collocations": _PHRASES,
    "op9_secrets": _SPANS,
    "op10_exact_dedup": f"""select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
        from (select doc_id, {_LOWER} as norm from documents) window w as (partition by norm)""",
}
