"""Collocations against plain counting."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from caselight.llm import collocations, queries

SCHEMA = "doc_id long, text string, lang string, phrase string, shard long"


def plain(rows, first=2000, least=10):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[k : k + size]) for k in range(len(words) - size + 1))
    out = {}
    for (lang, *words), a in f.items():
        if len(words) == 1 or a < least:
            continue
        longer = [b for (other, *w), b in f.items() if other == lang and len(w) > len(words) and b >= least and any(w[k : k + len(words)] == words for k in range(len(w)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, *words[:k]], f[lang, *words[k:]]
            cuts.append((int(Fraction(1_000_000 * a * a, left * right)), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:first]))


def made(seed, count):
    r, out = random.Random(seed), []
    words = ["new", "York", "city", "the", "of", "Ü", "a", "b", "x y", *[f"w{k}" for k in range(30)]]
    for _ in range(count):
        text = "".join(r.choice(words[: r.choice([6, 12, 39])]) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "  "]) for _ in range(r.randint(0, 60)))
        out.append((text, r.choice(["en", "en", "fr", None, "und"])))
    return out + [(None, "en"), ("", None), ("new York city " * 400, "en"), out[0], out[0], ("NEW york", "en")]


@pytest.mark.parametrize(("shards", "bits", "first"), [(1, 1 << 27, 2000), (3, 1 << 27, 2000), (3, 1 << 16, 5), (4, 64, 2000)])
def test_collocations_equal_plain_counts(spark, monkeypatch, shards, bits, first):
    """Whatever the number of shards; bitmaps of 64 bits let nearly everything through and change nothing."""
    monkeypatch.setattr(collocations, "BITS", bits)
    rows = made(shards, 120)
    df = spark.createDataFrame([(k, *r, "x", 7) for k, r in enumerate(rows)], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(df, first=first, shards=shards).collect())
    assert got == plain(rows, first) and len(got) > 5


def test_products_beyond_64_bits(spark, monkeypatch):
    """Scores of huge counts are exact."""
    a, left, right = 3_000_000_019, 3_000_000_500, 4_000_000_007
    table = spark.createDataFrame([("en", "", 0, 10**12), ("en", "p", 1, left), ("en", "q", 1, right), ("en", "p q", 2, a)], "lang string, phrase string, size int, f long")
    monkeypatch.setattr(collocations, "count_phrases", lambda *x: table)
    (row,) = collocations.collocations(table).collect()
    assert (row.a, row.l, row.r, row.score) == (a, left, right, 1_000_000 * a * a // (left * right))


def test_no_rows_and_no_phrases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "a b c", "en", "x", 1), (2, None, None, "x", 1)], SCHEMA)).collect() == []


def test_the_query_over_the_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang").collect()]
    f = sorted(tuple(r) for r in queries.op12_collocations(spark, folder).collect())
    want = {r[:3]: r for r in plain_fast(rows)}
    assert {r[:3] for r in f} == want.keys() and all(want[r[:3]] == r for r in f)


def plain_fast(rows):
    """As plain(), with the longer phrases looked up from inside."""
    f, n, outer = Counter(), Counter(), {}
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[k : k + size]) for k in range(len(words) - size + 1))
    for (lang, *w), b in f.items():
        if len(w) == 3 and b >= 10:
            for inner in ((lang, *w[:2]), (lang, *w[1:])):
                outer[inner] = max(outer.get(inner, 0), b)
    found = {}
    for key, a in f.items():
        lang, *words = key
        if len(words) > 1 and a >= 10 and 100 * outer.get(key, 0) < 50 * a:
            cuts = [(1_000_000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
            s, _, left, right = min(cuts)
            found.setdefault(lang, []).append((-s, -a, " ".join(words).encode(), left, right))
    return [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:2000])]
