"""Column expressions that the operators share. All but the exact binomial interval and the *_c functions run in the JVM."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash32(c: Column) -> Column:
    """An unsigned 32-bit hash of a value's text, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def hash_uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that depends on seed and key only, not on partitions or order."""
    return hash32(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])) / F.lit(4294967296.0)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def logit(p: Column) -> Column:
    clipped = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return F.log(clipped / (1 - clipped))


@F.pandas_udf(T.DoubleType())
def _log_c(x: pd.Series) -> pd.Series:
    return pd.Series([math.nan if v != v else math.log(v) for v in x.tolist()], dtype=float)


@F.pandas_udf(T.DoubleType())
def _exp_c(x: pd.Series) -> pd.Series:
    return pd.Series([math.exp(v) for v in x.tolist()], dtype=float)


def logit_c(p: Column) -> Column:
    """logit() by the C library's logarithm. The JVM's may differ in the last bit, which decides for cases on the edge of a band; null becomes NaN."""
    clipped = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return _log_c(clipped / (1 - clipped))


def sigmoid_c(z: Column) -> Column:
    """sigmoid() by the C library's exponential, for few rows."""
    return 1 / (1 + _exp_c(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def apply_temperature(z: Column, t: Column) -> Column:
    return sigmoid(z / F.coalesce(F.nullif(t, F.lit(0.0)), F.lit(1.0)))


def normalise_side(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("l", "os", "left"), "left").when(low.isin("r", "od", "right"), "right")


def norm_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def flat_name(c: Column) -> Column:
    """A path as one file name: folders joined by two underscores, the suffix replaced."""
    return F.concat(F.replace(F.regexp_replace(norm_path(c), r"\.[^./]*$", ""), F.lit("/"), F.lit("__")), F.lit(".png"))


def trailing_number(c: Column) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, r"(\d+)\.\w+$", 1), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long"))


def iso_week(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))


def ordinal_encode(grade: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: (grade > i).cast("int"))


def enforce_monotonic(values: Column) -> Column:
    """The running minimum of an array."""
    return F.transform(values, lambda _, i: F.array_min(F.slice(values, 1, i + 1)))


def grade_decode(values: Column, cut: float = 0.5) -> Column:
    return F.size(F.filter(enforce_monotonic(values), lambda p: p > cut))


def prob_display(p: Column) -> Column:
    return F.when(p >= 0.995, ">0.99").when(p <= 0.005, "<0.01").otherwise(F.format_string("%.2f", p))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high); null without cases."""
    p, d = F.try_divide(k, n), 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high")))


def hmac_sha256(key_hex: str, message: Column) -> Column:
    """HMAC by two nested digests over the padded key."""
    key = bytes.fromhex(key_hex).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))), 256)


def pseudonym(key_hex: str, kind: str, value: Column) -> Column:
    return F.substring(hmac_sha256(key_hex, F.concat(F.lit(kind + ":"), value.cast("string"))), 1, 16)


def code_share(code: Column, start: int = 1) -> Column:
    return F.conv(F.substring(code, start, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def locked_split(code: Column, share: float = 0.2) -> Column:
    return F.when(code_share(code) < share, "locked_test").otherwise("train")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(norm_path(path), "/"), -1)


def stem_prefix(path: Column) -> Column:
    """The part of a file's name before its first underscore, without the suffix."""
    return F.element_at(F.split(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), "_"), 1)


def side_from_id(c: Column) -> Column:
    """left or right by an id's end (_l1, _r2); null if it names neither."""
    mark = F.regexp_extract(c, r"_([lr])\d+$", 1)
    return F.when(mark == "l", "left").when(mark == "r", "right")


def month_of(iso: Column) -> Column:
    return F.substring(iso, 1, 7)


def level_index(c: Column, levels: list[float]) -> Column:
    """The place of a raw sub-score among its levels, worst first; -1 if it is null or none of them."""
    found = F.array_position(F.array(*[F.lit(float(v)) for v in levels]), c.try_cast("double"))
    return F.coalesce(found - 1, F.lit(-1)).cast("int")


def json_field(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def encode_findings(codes: Column, separator: str | None = None) -> Column:
    """Distinct codes in order, as a JSON list or joined by a separator; null stays null."""
    clean = F.array_sort(F.array_distinct(F.array_compact(codes)))
    return F.to_json(clean) if separator is None else F.array_join(clean, separator)


def decode_findings(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_safe(c: Column, kind: T.DataType) -> Column:
    """NaN and infinite numbers become null, in nested values too. kind: the column's type."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: json_safe(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[json_safe(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def _beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    solid = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / solid(1 - (a + b) * x / (a + 1))
    c, h = np.ones_like(x), d
    for m in range(1, 2000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / solid(1 + step * d), solid(1 + step / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return np.where(swap, 1 - front * h, front * h)


def _beta_quantile(share: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (lo + hi) / 2
        less = _beta_share(a, b, mid) < share
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return (lo + hi) / 2


def clopper_pearson(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """struct(low, high): the exact binomial interval of k of n; null without cases. Meant for tables of groups."""

    @F.pandas_udf("low double, high double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        ok = (k.notna() & n.notna() & (n > 0) & (k >= 0) & (k <= n)).to_numpy()
        kk, nn = (v.to_numpy(dtype=float, na_value=np.nan) for v in (k, n))
        low, high = np.where(ok, 0.0, np.nan), np.where(ok, 1.0, np.nan)
        inner, outer = ok & (kk > 0), ok & (kk < nn)
        if inner.any():
            low[inner] = _beta_quantile(alpha / 2, kk[inner], nn[inner] - kk[inner] + 1)
        if outer.any():
            high[outer] = _beta_quantile(1 - alpha / 2, kk[outer] + 1, nn[outer] - kk[outer])
        return pd.DataFrame({"low": low, "high": high})

    return F.when(n > 0, interval(k, n))
