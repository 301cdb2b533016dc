"""Main text of web pages: a suffix array of each host's token streams finds the boilerplate, markup what no repeat can tell."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, if_small, lookup, stored

#: Tokens of the shortest repeat that counts as boilerplate.
LEAST_RUN = 6
#: Tokens to which suffixes are sorted. Longer repeats are the union of the repeats of the suffixes within them.
DEPTH = 16
#: Share of a block's tokens that repeats must cover for the block to go.
COVERED = 0.8
#: Elements that are never main text, elements that begin a block, and words of class, id or role that mark other parts.
NEVER = frozenset("head nav footer aside form dialog menu noscript button select".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HOLDERS = frozenset("article aside body blockquote details dialog div dl figure footer form head header main menu nav ol p section span table ul".split())
PARTS = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|ad-\w+|\w+-ads?|sponsor(?:ed|s)?|promo(?:tion|ted)?s?|cookies?(?:-\w+)?|consent|gdpr|(?:\w+-)?notice|popup|modal|"
    r"newsletter(?:-\w+)?|subscribe|signup|sidebar(?:-\w+)?|related(?:-(?:posts?|articles?|links?|stories|news))?|recommend(?:ed|ations)|share(?:-\w+)?|sharing|"
    r"social(?:-\w+)?|(?:\w+-)?comments?|comments?-\w+|respond|disqus(?:_\w+)?|breadcrumbs?|(?:\w+-)?menu|nav(?:bar|igation)?|topbar|toolbar|(?:\w+-)?footer|login|pagination|pager|skip-link)",
    re.I,
)
TOP = re.compile(r"(?:\w+-)?(?:header|masthead|banner)", re.I)
HINTS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|svg|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ARTICLE, OPEN, PART = range(3)


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks: within the article, outside it, or in a part that is no main text by its markup."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open holders and their zones
    words: list[str] = []
    zone, at = OPEN, 0

    def flush() -> None:
        if words and (text := " ".join("".join(words).split())):
            out.append((zone, text))
        words.clear()

    for m in MARKUP.finditer(page):
        if m.start() > at:
            words.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        if tag not in HOLDERS and tag not in NEVER:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if zone != (stack[k - 1][1] if k else OPEN):
                        flush()
                    del stack[k:]
                    break
        else:
            if tag in BLOCKS and stack and stack[-1][0] == "p":
                stack.pop()
            if tag == "body":
                stack.clear()
            now = stack[-1][1] if stack else OPEN
            hints = [w for a, b, c in HINTS.findall(m[4]) for w in (a or b or c).split()] if "=" in m[4] and tag != "body" else []
            if tag in NEVER or tag == "header" and now != ARTICLE or any(PARTS.fullmatch(w) or now != ARTICLE and TOP.fullmatch(w) for w in hints):
                kind = PART
            else:
                kind = ARTICLE if now != PART and (tag in ("article", "main")) else now
            if kind != now:
                flush()
            if not m[4].endswith("/"):
                stack.append((tag, kind))
        zone = stack[-1][1] if stack else OPEN
    if at < len(page):
        words.append(entities.unescape(page[at:]))
    flush()
    return out


def stream_of(found: list[tuple[int, str]]) -> list[str]:
    """The tokens outside the article, in page order; a break stands for the article."""
    out: list[str] = []
    for zone, text in found:
        if zone != ARTICLE:
            out += text.split()
        elif out[-1:] != ["\x1e"]:
            out.append("\x1e")
    return [t if t == "\x1e" or t.isprintable() else "".join(c if c >= " " else "?" for c in t) for t in out]


def body_of(found: list[tuple[int, str]]) -> tuple[int, int]:
    """What tells a page's main text from another's: hashes of its longest block, and of the least of that block's five-token windows."""
    own = [t for z, t in found if z == ARTICLE] or [t for z, t in found if z == OPEN] or [""]
    longest = max(own, key=len)
    tokens = longest.split()
    windows = (" ".join(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4)))
    return xxhash.xxh3_64_intdigest(longest) >> 1, min(xxhash.xxh3_64_intdigest(w) for w in windows) >> 1


def shared_tokens(a: str, b: str) -> int:
    """The length in tokens of the longest common prefix of two suffixes."""
    n = 0
    for x, y in zip(a.split(" "), b.split(" "), strict=False):
        if x != y:
            break
        n += 1
    return n


def longest_runs(batches: Iterator[pa.RecordBatch], least: int = LEAST_RUN) -> Iterator[pa.RecordBatch]:
    """Of suffixes in order (host, suffix, lo, hi, low, high: the least and largest hashes of the bodies that have it): the longest
    beginning of each that a suffix of another body shares, by its neighbours. It has at least `least` tokens, as the suffix's
    group may go on in another task."""
    waiting: list[list] = []  # suffixes since the last one of another body, with what they share with the current one
    done: dict[tuple[str, str], None] = {}
    last: tuple | None = None
    before = 0  # tokens shared with the last suffix of another body

    def flush() -> None:
        for host, suffix, best, _ in waiting:
            done[host, " ".join(suffix.split(" ")[:best])] = None
        waiting.clear()

    def batch() -> pa.RecordBatch:
        hosts, runs = zip(*done, strict=True) if done else ((), ())
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(runs, pa.string())], ["host", "run"])

    for b in batches:
        for host, suffix, lo, hi, low, high in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            common = shared_tokens(last[1], suffix) if last and last[0] == host else 0
            other = last is not None and (lo, hi) != last[2:4] and (low, high) != last[4:]
            several = lo < hi and low < high
            for row in waiting:
                row[3] = min(row[3], common)
                if other:
                    row[2] = max(row[2], row[3])
            before = common if other else min(before, common)
            if other or common < least:
                flush()
            size = suffix.count(" ") + 1
            waiting.append([host, suffix, size if several else max(least, before), size])
            last = (host, suffix, lo, hi, low, high)
        if len(done) > 50_000:
            yield batch()
    flush()
    yield batch()


class Merged(dict):
    """Rows by key with the least and largest hashes of their bodies, given out in batches."""

    def add(self, key: tuple, lo: int, hi: int, low: int, high: int) -> None:
        old = self.get(key)
        self[key] = (lo, hi, low, high) if old is None else (min(old[0], lo), max(old[1], hi), min(old[2], low), max(old[3], high))

    def batch(self, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        keys, bodies = zip(*self, strict=True) if self else [()] * len(types), zip(*self.values(), strict=True) if self else [()] * 4
        arrays = [pa.array(v, t) for v, t in zip(keys, types, strict=True)] + [pa.array(v, pa.int64()) for v in bodies]
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, [*names, "lo", "hi", "low", "high"])


def key_of(tokens: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(tokens)) - (1 << 63)


def heads_of(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of streams (host, stream, body, window): the first `least` tokens of each suffix, as a key."""
    made, names, types = Merged(), ["host", "head"], [pa.string(), pa.int64()]
    for b in batches:
        for host, stream, body, window in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            tokens = stream.split(" ")
            for k in range(len(tokens) - least + 1):
                made.add((host, key_of(tokens[k : k + least])), body, body, window, window)
            if len(made) > 200_000:
                yield made.batch(names, types)
    yield made.batch(names, types)


def suffixes_of(batches: Iterator[pa.RecordBatch], least: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Of streams (host, stream, body, window): their suffixes to `depth` tokens, each with the key of its head."""
    made, names, types = Merged(), ["host", "head", "suffix"], [pa.string(), pa.int64(), pa.string()]
    for b in batches:
        for host, stream, body, window in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            tokens = stream.split(" ")
            for k in range(len(tokens) - least + 1):
                made.add((host, key_of(tokens[k : k + least]), " ".join(tokens[k : k + depth])), body, body, window, window)
            if len(made) > 50_000:
                yield made.batch(names, types)
    yield made.batch(names, types)


def repeats(streams: DataFrame, least: int = LEAST_RUN, depth: int = DEPTH, small: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(host, stream, body, window) of token streams to (host, run), the long substrings that pages of another main text share, and
    (host, head), the keys of their beginnings.

    The streams of a host are concatenated by sorting all their suffixes together. Suffixes whose first `least` tokens no page of
    another main text has are left out by counting first; the others are range-partitioned by host and tokens, so that a host of
    any size is dealt to many tasks, sorted, and each is compared with its neighbours. Equal suffixes are merged where they are
    read and wherever they are counted, however many pages have them. Runs longer than `depth` are the union of the runs within.
    """
    bodies = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("low").alias("low"), F.max("high").alias("high")]
    four = "lo long, hi long, low long, high long"
    own = streams.select("host", "stream", "body", "window")
    heads = own.mapInArrow(lambda b: heads_of(b, least), f"host string, head long, {four}").groupBy("host", "head").agg(*bodies)
    heads = stored(heads.where("lo < hi and low < high").select("host", "head"), "heads")
    suffixes = own.mapInArrow(lambda b: suffixes_of(b, least, depth), f"host string, head long, suffix string, {four}")
    order = suffixes.join(if_small(heads, small), ["host", "head"], "left_semi").select("host", "suffix", "lo", "hi", "low", "high")
    array = order.repartitionByRange("host", "suffix").sortWithinPartitions("host", "suffix")
    runs = array.mapInArrow(lambda b: longest_runs(b, least), "host string, run string").distinct()
    return stored(runs, "suffix-array"), heads


def covered_by(tokens: list[str], runs: dict[int, int], least: int = LEAST_RUN, depth: int = DEPTH) -> list[tuple[int, int]]:
    """(start, length) of the longest run of the dictionary at each place of a stream. runs has keys of runs, and of heads, to their lengths."""
    out = []
    for k in range(len(tokens) - least + 1):
        longest = runs.get(key_of(tokens[k : k + least]))
        if longest is not None:
            size = next((n for n in range(min(longest, len(tokens) - k), least, -1) if key_of(tokens[k : k + n]) in runs), least)
            out.append((k, size))
    return out


def dictionary(runs: DataFrame, least: int = LEAST_RUN) -> dict[str, dict[int, int]]:
    """By host: the keys of runs, and of their heads to the length of the longest run that begins so. runs has a checked number of rows."""
    out: dict[str, dict[int, int]] = {}
    for host, run in runs.toLocalIterator():
        tokens = run.split(" ")
        own, head = out.setdefault(host, {}), key_of(tokens[:least])
        own.setdefault(key_of(tokens), len(tokens))
        own[head] = max(own.get(head, 0), len(tokens))
    return out


def unique_blocks(found: list[tuple[int, str]], runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text of the blocks that stay, and how many go as repeats and as parts that markup names."""
    place, at, inside = [], 0, False
    for zone, text in found:
        n = len(text.split()) if zone != ARTICLE else int(not inside)
        inside = zone == ARTICLE
        place.append((at, at + n))
        at += n
    covered = np.zeros(at + 1, dtype=np.int64)
    for start, run in runs:
        covered[start] += 1
        covered[start + run] -= 1
    covered = np.cumsum(covered) > 0
    kept, repeated, marked = [], 0, 0
    for (zone, text), (a, z) in zip(found, place, strict=True):
        if zone == ARTICLE:
            kept.append(text)
        elif covered[a:z].mean() >= COVERED:
            repeated += 1
        elif zone == PART:
            marked += 1
        else:
            kept.append(text)
    return "\n".join(kept), repeated, marked


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars, repeat_blocks, marked_blocks) of every row of pages.

    Of the blocks outside article and main elements, those go that runs of at least LEAST_RUN tokens cover to COVERED, if pages of
    the host with another main text have these runs too; of the rest, those go that markup names as menus, footers, adverts, forms,
    comments and the like; unique blocks stay. What stands in an article is main text (but for such parts in it). Runs come from
    the sorted suffixes of each host's token streams (see repeats()). Pages whose longest block is the same, or has the same least
    window, count as copies of one main text, and what only they share is no boilerplate.

    Null html is empty text; a null url is a host of its own; repeated rows and null ids stay; other columns are ignored. Empty
    table: no rows. Up to `small` runs are sent to all tasks; beyond, places are joined with the heads of runs, and pages with them.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 500)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    hosted = rows.select("page_id", "url", host.alias("host"), "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(" ".join(stream_of(found)), *body_of(found)) for found in map(blocks, b.column(1).to_pylist())]
            arrays = [pa.array([x[k] for x in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["host", "stream", "body", "window"])

    streams = stored(hosted.select("host", "html").mapInArrow(parse, "host string, stream string, body long, window long"), "streams")
    runs, heads = repeats(streams, small=small)
    result = "page_id long, url string, text string, repeat_blocks int, marked_blocks int"

    def judge(b: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int32(), pa.int32())
        arrays = [pa.array([x[k] for x in made], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["page_id", "url", "text", "repeat_blocks", "marked_blocks"])

    if runs.limit(small + 1).count() <= small:
        held = spark.sparkContext.broadcast(dictionary(runs))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = []
                for h, page in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    found = blocks(page)
                    made.append(unique_blocks(found, covered_by(stream_of(found), held.value.get(h, {}))))
                yield judge(b, made)

        judged = hosted.mapInArrow(keep, result)
    else:

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, streams = [], b.column(1).to_pylist()
                for stream in streams:
                    tokens = stream.split(" ")
                    keys.append([key_of(tokens[k : k + LEAST_RUN]) for k in range(len(tokens) - LEAST_RUN + 1)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.list_(pa.int64()))], ["host", "sid", "keys"])

        def keep_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
                yield judge(b, [unique_blocks(blocks(page), [(k, LEAST_RUN) for k in starts or ()]) for page, starts in found])

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [" ".join(stream_of(blocks(page))) for page in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], ["page_id", "url", "host", "html", "stream"])

        sid = F.md5(F.concat_ws("\n", "host", "stream"))
        distinct = streams.withColumn("sid", sid).groupBy("sid").agg(F.first("host").alias("host"), F.first("stream").alias("stream"), F.count("*").alias("n"))
        distinct = stored(distinct, "distinct-streams")
        each = distinct.select("host", "stream", "sid").mapInArrow(places, "host string, sid string, keys array<long>")
        hits = each.select("host", "sid", F.posexplode("keys").alias("start", "head")).join(if_small(heads, small), ["host", "head"])
        found = hits.groupBy("sid").agg(F.collect_list("start").alias("starts")).join(distinct.select("sid", "n"), "sid")
        paged = hosted.mapInArrow(named, "page_id long, url string, host string, html string, stream string").withColumn("sid", sid)
        joined = lookup(paged.select("page_id", "url", "html", "sid"), stored(found, "found"), "sid", "n", streams.count())
        judged = joined.select("page_id", "url", "html", "starts").mapInArrow(keep_joined, result)
    return judged.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "repeat_blocks", "marked_blocks")
