"""What the operators of this subpackage share: tables in the shared folder, checked broadcasts, lookups that survive hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast after they have been counted. Rows are ids or short keys, so this is some tens of MB at most.
BROADCAST_ROWS = 400_000
#: A key is hot when it holds more than one in so many rows; so there are fewer than this many hot keys, whatever the input.
HOT_SHARE = 1000
#: Bytes of texts that a task cuts into words at a time, about.
SLICE_CHARS = 8_000_000
#: Bits of one bitmap of a sieve, and bitmaps at most: 32 MB for keys without number.
SIEVE_BITS, SIEVE_BUCKETS = 32_768, 8_192
#: Characters that separate words, as a Java pattern.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where spark.checkpoint.dir is unset, a local master (tests) gets a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends here and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(first place, part) of a column of texts, in parts of about `limit` bytes."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.searchsorted(size // limit, np.arange(int(size[-1]) // limit + 2)) if len(size) else np.zeros(1, dtype=np.int64)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if high > low:
            yield low, texts.slice(low, high - low)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get few rows at a time, so that very long texts don't fill their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The runs of characters that are no blanks, in order; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it has few rows; else joins shuffle. df should be a stored table, it is counted here."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lookup(rows: DataFrame, classes: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of rows to classes by key, where few keys may hold a large part of the rows.

    classes has one row for each key and the number of its rows in weight. Keys with more than total / HOT_SHARE rows, of
    which there are fewer than HOT_SHARE, are broadcast; no other key has enough rows to slow a task.
    """
    hot = F.col(weight) * HOT_SHARE > total
    names = [c for c in classes.columns if c != key]
    some = classes.where(hot)
    others = classes.where(~hot)
    near = rows.join(F.broadcast(some.withColumn("_hot", F.lit(True))), key, "left")
    near_hot = near.where(F.col("_hot")).drop("_hot")
    rest = near.where(F.col("_hot").isNull()).drop("_hot", *names).join(others, key, "left")
    return near_hot.unionByName(rest.select(*near_hot.columns))


def sieve(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Bitmaps of the hashes of stored keys, as (bucket, bits) of 4 KB each, and their number: at most SIEVE_BUCKETS, whatever the keys."""
    buckets = max(1, min(SIEVE_BUCKETS, math.ceil(keys.count() * 16 / SIEVE_BITS)))
    place = F.pmod(F.xxhash64(key), F.lit(buckets * SIEVE_BITS))
    found = keys.select(F.floor(place / SIEVE_BITS).alias("bucket"), (place % SIEVE_BITS).alias("bit"))
    return found.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), buckets


def bit_set(bits: str, key: Column, buckets: int) -> Column:
    """Whether a bucket's bitmap (a column's name) has the key's bit: never false for a key that went into it."""
    bit = F.pmod(F.xxhash64(key), F.lit(buckets * SIEVE_BITS)) % SIEVE_BITS
    byte = F.conv(F.hex(F.substring(F.col(bits), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def in_bucket(key: Column, buckets: int) -> Column:
    return F.floor(F.pmod(F.xxhash64(key), F.lit(buckets * SIEVE_BITS)) / SIEVE_BITS)


def _sieved(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    bitmaps, buckets = sieve(keys, key)
    named = bitmaps.withColumnRenamed("bucket", "__bucket").withColumnRenamed("bits", "__bits")
    joined = rows.withColumn("__bucket", in_bucket(F.col(key), buckets)).join(F.broadcast(named), "__bucket", "left")
    return joined.withColumn("__may", bit_set("__bits", F.col(key), buckets)).drop("__bucket", "__bits")


def among(rows: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows whose key is in keys (a stored table of distinct keys). Beyond the limit only rows that a sieve lets through are shuffled."""
    if keys.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(keys), key, "left_semi")
    return _sieved(rows, keys, key).where("__may").drop("__may").join(keys, key, "left_semi")


def without(rows: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows whose key is not in keys (a stored table of distinct keys); rows with a null key stay. As among(), most rows stay in place."""
    if keys.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(keys), key, "left_anti")
    marked = _sieved(rows, keys, key)
    far = marked.where(~F.col("__may")).drop("__may")
    return far.unionByName(marked.where("__may").drop("__may").join(keys, key, "left_anti").select(*far.columns))
