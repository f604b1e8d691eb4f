"""Rendezvous sharding over weighted shards, with DataFrame functions only.

Every shard bids for every record: its weight over an exponential variate that is a hash of the
record's key and the shard's number. The largest bid wins. A new shard only adds bids, so the
records that move are those it wins; taking one away moves its own records only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.llm.store import dropped, written

#: A shard's rows are numbered by bucket, the first hexadecimal digits of the key's MD5, and in ranges of about so many rows.
BUCKET_DIGITS, RANGE_ROWS = 3, 1_000_000


def bid(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Minus weight-scaled exponential variate: 13 hexadecimal digits of an MD5 make the uniform one."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(shard))).cast("binary")), 1, 13), 16, 10)
    return F.log((digits.cast("double") + 0.5) / float(1 << 52)) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the winning shard; shards of weight 0 win nothing. Ties go to the higher number.
    A null key bids as the empty string, so null keys share a shard."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct(bid(key, s, w).alias("bid"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("no shard has a weight")
    return (F.greatest(*bids) if len(bids) > 1 else bids[0])["shard"]


def sharded(docs: DataFrame, shards: int = 24, key_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id, size, text_crc32, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. ``slot`` numbers a shard's rows from 0
    without gaps, by hash bucket, id, checksum and size, equal rows in any order: rows are dealt out in ranges of
    that order, which split equal keys and equal rows too, so no task holds a whole shard or key.
    ``grown_shard`` is the shard if one of weight 1 were added. Repeated rows share a shard and get
    slots of their own; null keys share a shard. Texts of any length are read once and never shuffled. Other
    columns are not read. Empty table: empty result.
    """
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key_col).cast("long").alias("id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key_col), weights).alias("shard"),
        shard_of(F.col(key_col), [*weights, 1.0]).alias("grown_shard"),
        F.substring(F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("")).cast("binary")), 1, BUCKET_DIGITS).alias("b"),
    )
    rows = written(rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "shards")
    order = ["b", "id", "text_crc32", "size", "tie"]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    dealt = written(rows.repartitionByRange(ranges, "shard", *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = dealt.withColumn("r", F.row_number().over(Window.partitionBy("shard", "range").orderBy(*order)) - 1).join(bases, ["shard", "range"])
    dropped(rows)
    return placed.select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("r")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, key_col: str = "doc_id", weights: Sequence[float] | None = None) -> None:
    """The rows themselves, in one folder per shard: each task appends to the shards it has rows for."""
    weights = list(weights or [1.0] * shards)
    docs.withColumn("shard", shard_of(F.col(key_col), weights)).write.partitionBy("shard").parquet(path)
