"""Numbers for rows in an order, without a task that sees them all; rows dealt to tasks by their number."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.sources.scratch import stored


def numbered(rows: DataFrame, order: list[Column], name: str = "pos", start: int = 0) -> DataFrame:
    """``rows`` with ``name``, their place by ``order``, which differs between rows. Rows are dealt in ranges and counted
    there; a range starts where the ranges before it end."""
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()), "ranges")
    counts = sorted((r["_piece"], r["count"]) for r in dealt.groupBy("_piece").count().collect())  # a number for each range
    before = [0, *accumulate(n for _, n in counts)]
    table = rows.sparkSession.createDataFrame([(p, b + start) for (p, _), b in zip(counts, before, strict=False)], "_piece int, _before long")
    local = F.row_number().over(Window.partitionBy("_piece").orderBy(*order)) - 1
    return dealt.withColumn(name, local).join(F.broadcast(table), "_piece").withColumn(name, F.col(name) + F.col("_before")).drop("_piece", "_before")


def spread(rows: DataFrame, *keys: str, each: int) -> DataFrame:
    """``rows`` dealt by a hash of ``keys`` into a task for about ``each`` of them. Rows of few bytes that cost much
    would else share the few tasks that their bytes make up. Equal keys stay together."""
    parts = -(-rows.count() // each)
    return rows.repartition(parts, *keys) if parts > 1 else rows
