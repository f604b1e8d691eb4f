"""Registered queries of what is stored, streamed and served: indexes, logs, limits; see ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.operators.cache_log import CLEAR, PUT, REMOVE, CacheLog
from casefile.operators.knn_index import VectorIndex
from casefile.plans.catalog import _SQL_DISTANCE, query, table
from casefile.sources.scratch import scratch_path

# --- nearest neighbours ---------------------------------------------------------------------------


def _sql_nearest(vectors: str, k: int) -> str:
    return f"""
WITH v AS MATERIALIZED ({vectors})
SELECT query_id, rank, id, round(dist, 6) AS distance FROM (
  SELECT query_id, id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM (
    SELECT q.id AS query_id, d.id AS id, {_SQL_DISTANCE} AS dist FROM v d, v q WHERE q.id % 100 = 0)) WHERE rank <= {k}
"""


def _indexed(rows: DataFrame, k: int) -> DataFrame:
    """Two thirds of the rows indexed, the rest appended; every row whose id is divisible by 100 asks."""
    index = VectorIndex.build(rows.filter("id % 3 > 0"), "id", "embedding", scratch_path(rows.sparkSession, "vectors"))
    index.append(rows.filter("id % 3 = 0"), "id", "embedding")
    return index.search(rows.filter("id % 100 = 0"), "id", "embedding", k).withColumn("distance", F.round("distance", 6))


@query(_sql_nearest("SELECT vec_id AS id, embedding FROM embeddings", 5))
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), 5)


_ORDER_VECTOR = "[o_totalprice / 1000, o_custkey::DOUBLE / 10, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE / 10]"


@query(_sql_nearest(f"SELECT o_orderkey AS id, {_ORDER_VECTOR} AS embedding FROM orders", 7))
def knn_indexed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double") / 10
    price = F.col("o_totalprice").cast("double") / 1000
    return _indexed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(price, F.col("o_custkey").cast("double") / 10, day).alias("embedding")), 7)


# --- cache ----------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT CASE WHEN event_id % 1000 = 77 THEN NULL ELSE user_id::VARCHAR END AS key, event_id % 3 AS batch, event_id AS seq,
    CASE WHEN event_id % 1000 = 77 THEN 'clear' WHEN event_id % 5 = 0 THEN 'remove' ELSE 'put' END AS op, event_id AS value FROM events),
l AS (SELECT key, row(batch, seq) AS place, op, value FROM c WHERE key IS NOT NULL AND row(batch, seq) > coalesce((SELECT max(row(batch, seq)) FROM c WHERE op = 'clear'), row(-1, -1)))
SELECT key, max(value) FILTER (place = newest) AS value FROM (SELECT *, max(place) OVER (PARTITION BY key) AS newest FROM l) WHERE place = newest AND op = 'put' GROUP BY key
""")
def cache_log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of changes, a replay of the second, and a compaction between them."""
    n = F.col("event_id")
    op = F.when(n % 1000 == 77, CLEAR).when(n % 5 == 0, REMOVE).otherwise(PUT)
    changes = table(spark, sf_dir, "events").select(F.when(n % 1000 != 77, F.col("user_id").cast("string")).alias("key"), n.alias("seq"), op.alias("op"), n.alias("value"))
    log = CacheLog(spark, scratch_path(spark, "cache"), "bigint")
    for batch in (0, 1, 1, 2):
        log.apply(batch, changes.filter(n % 3 == batch))
        if batch == 1:
            log.compact()
    return log.entries()
