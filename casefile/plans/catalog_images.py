"""Registered queries of the image kernels, over rasters made from the vectors; see ``catalog``."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile.operators import drawing, images, jpeg
from casefile.operators.numbering import spread
from casefile.plans.catalog import query, table
from casefile.sinks import documents
from casefile.sources import checkpoints
from casefile.sources.scratch import scratch_path

# --- rasters: 16 x 16 gray pixels, each of a vector's 64 values four times ---------------------------

_SQL_CELLS = "SELECT vec_id AS id, list_transform(range(1, 65), lambda k: greatest(0, least(255, floor(embedding[k]::DOUBLE * 512 + 128)))::INT) AS p FROM embeddings"
_SQL_RASTER = f"SELECT id, p, list_transform(range(0, 256), lambda i: p[i // 32 * 8 + i % 16 // 2 + 1]) AS px FROM ({_SQL_CELLS})"


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, image)`` as Spark's image source would give them."""
    cells = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 512 + 128))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", cells.alias("p"))
    at = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.element_at("p", (F.floor(i / 32) * 8 + F.floor(i % 16 / 2) + 1).cast("int")))
    data = F.unhex(F.array_join(F.transform(at, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    image = F.struct(F.col("vec_id").cast("string").alias("origin"), F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))
    return rows.select(F.col("vec_id").alias("id"), image.alias("image"))


_SQL_NEAR = "px[greatest(i // 16 - 1, 0) * 16 + i % 16 + 1] + px[least(i // 16 + 1, 15) * 16 + i % 16 + 1] + px[i // 16 * 16 + greatest(i % 16 - 1, 0) + 1] + px[i // 16 * 16 + least(i % 16 + 1, 15) + 1]"
_SQL_CORNERS = " + ".join(f"px[{y} * 16 + {x} + 1]" for y in ("greatest(i // 16 - 1, 0)", "least(i // 16 + 1, 15)") for x in ("greatest(i % 16 - 1, 0)", "least(i % 16 + 1, 15)"))
_SQL_SHRUNK = "[0, 1, 3, 5, 7, 8, 10, 12, 14, 16]"


@query(f"""
WITH r AS MATERIALIZED ({_SQL_RASTER}),
d AS (SELECT id, list_transform(range(0, 72), lambda i: list_avg(px[i // 9 * 32 + ({_SQL_SHRUNK})[i % 9 + 1] + 1 : i // 9 * 32 + ({_SQL_SHRUNK})[i % 9 + 2]])) AS s FROM r),
c AS (SELECT id, string_agg(printf('#%02x%02x%02x', v, v, v), ',' ORDER BY n, v) AS colors FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, v DESC) AS place FROM (SELECT id, v, count(*) AS n FROM (SELECT id, unnest(px) AS v FROM r) GROUP BY id, v)) WHERE place <= 5 GROUP BY id)
SELECT r.id, round(65536 * list_aggregate(list_transform(range(0, 256), lambda i: {_SQL_NEAR} - 4 * px[i + 1]), 'var_pop'))::BIGINT AS blur, round(list_avg(px) / 255, 9) AS brightness,
  round(least(1.0, list_aggregate(px, 'stddev_pop') / 128), 9) AS contrast,
  round(list_avg(list_transform(range(0, 256), lambda i: greatest(0, least(255, 8 * px[i + 1] - ({_SQL_NEAR}) - ({_SQL_CORNERS}))))) / 255, 9) AS sharpness,
  array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN s[i // 8 * 9 + i % 8 + 1] > s[i // 8 * 9 + i % 8 + 2] THEN 1 ELSE 0 END), '') AS dhash,
  colors, len(list_filter(px, lambda v: v % 2 = 1)) AS ones,
  array_to_string(list_transform(range(0, 4), lambda k: len(list_filter(range(0, 128), lambda i: px[2 * i + 1] % 2 * 2 + px[2 * i + 2] % 2 = k))), ',') AS pairs,
  CASE WHEN list_aggregate(px, 'var_pop') >= 50 THEN array_to_string(list_transform(p, lambda v: CASE WHEN v > list_avg(p) THEN 1 ELSE 0 END), '') END AS block
FROM r JOIN d USING (id) JOIN c USING (id)
""")
def image_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality numbers, difference hash, colours, lowest bits and block hash of every raster."""
    bits = lambda c: F.lpad(F.bin(c), 64, "0")
    r = images.measured(_rasters(spark, sf_dir))
    return r.select(
        F.col("path").cast("long").alias("id"), F.round(F.col("blur") * 65536).cast("long").alias("blur"), *(F.round(c, 9).alias(c) for c in ("brightness", "contrast", "sharpness")), bits("dhash").alias("dhash"),
        F.array_join("colors", ",").alias("colors"), F.col("bits")[0]["ones"].alias("ones"), F.array_join(F.col("bits")[0]["pairs"], ",").alias("pairs"), bits(F.get("blocks", F.lit(0))["hash"]).alias("block"),
    )


@query(f"""
WITH c AS (SELECT id, (k - 1) // 8 AS i, (k - 1) % 8 AS j, p[k] AS v FROM (SELECT id, p, unnest(range(1, 65)) AS k FROM ({_SQL_CELLS}))),
b AS (SELECT u, i, sum(cos(pi() * u * (2 * n + 1) / 64)) AS w FROM range(8) a(u), range(8) e(i), range(32) f(n) WHERE n // 4 = i GROUP BY u, i),
h AS (SELECT id, u, j, sum(w * v) AS t FROM c JOIN b USING (i) GROUP BY id, u, j),
l AS (SELECT id, h.u, b.u AS v, sum(t * w) AS x FROM h JOIN b ON h.j = b.i GROUP BY id, h.u, b.u),
m AS (SELECT id, median(x) AS middle FROM l WHERE u + v > 0 GROUP BY id)
SELECT id, string_agg(CASE WHEN x > middle + 1e-7 THEN '1' ELSE '0' END, '' ORDER BY u, v) AS phash FROM l JOIN m USING (id) GROUP BY id
""")
def image_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.measured(_rasters(spark, sf_dir)).select(F.col("path").cast("long").alias("id"), F.lpad(F.bin("phash"), 64, "0").alias("phash"))


# --- drawing --------------------------------------------------------------------------------------


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in "rgb"]))
def _weighed(content: pd.Series) -> pd.DataFrame:
    """Sums of a PNG file's channels, each pixel by its place from 1; files as ``preprocess.png`` writes them."""
    out = []
    for data in content:
        width, height = (int.from_bytes(data[a : a + 4], "big") for a in (16, 20))
        size = int.from_bytes(data[33:37], "big")
        x = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(height, -1)[:, 1:].reshape(-1, 3).astype(np.int64)
        out.append(tuple((x * np.arange(1, width * height + 1)[:, None]).sum(axis=0).tolist()))
    return pd.DataFrame(out, columns=["r", "g", "b"])


_SQL_PIXELS = f"SELECT id, i, i // 16 AS y, i % 16 AS x, px[i + 1] AS v FROM (SELECT id, px, unnest(range(0, 256)) AS i FROM ({_SQL_RASTER}))"
_SQL_BOX = ["id % 12 - 2 AS x1, id % 7 AS y1, id % 12 + 8 AS x2, id % 7 + 9 AS y2", "2 AS x1, 3 AS y1, 2 + id % 20 AS x2, 12 AS y2"]
_SQL_OUTLINE = "(y BETWEEN y1 AND y2 AND x BETWEEN x1 AND x2 AND NOT (y BETWEEN y1 + 3 AND y2 - 3 AND x BETWEEN x1 + 3 AND x2 - 3))"


def _boxed_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id").cast("int")
    box = lambda x1, y1, x2, y2, name: F.struct(*(v.cast("int").alias(c) for v, c in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))), F.lit(name).alias("class_name"))
    boxes = F.array(box(n % 12 - 2, n % 7, n % 12 + 8, n % 7 + 9, "car"), box(F.lit(2), F.lit(3), 2 + n % 20, F.lit(12), "dog"))
    return _rasters(spark, sf_dir).withColumn("boxes", boxes)


@query(f"""
SELECT id, sum((i + 1) * CASE WHEN dog THEN 0 WHEN car THEN 255 ELSE v END)::BIGINT AS r, sum((i + 1) * CASE WHEN dog THEN 255 WHEN car THEN 0 ELSE v END)::BIGINT AS g, sum((i + 1) * CASE WHEN dog OR car THEN 0 ELSE v END)::BIGINT AS b
FROM (SELECT id, i, v, car, {_SQL_OUTLINE} AS dog FROM (SELECT id, i, y, x, v, car, {_SQL_BOX[1]} FROM (SELECT *, {_SQL_OUTLINE} AS car FROM (SELECT *, {_SQL_BOX[0]} FROM ({_SQL_PIXELS}))))) GROUP BY id
""")
def drawn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing.drawn(_boxed_rasters(spark, sf_dir)).select(F.col("path").cast("long").alias("id"), _weighed("content").alias("s")).select("id", "s.*")


@query(f"""
WITH p AS MATERIALIZED ({_SQL_PIXELS}), b AS (SELECT *, 0 AS n, 'car' AS class_name, {_SQL_BOX[0]} FROM p UNION ALL SELECT *, 1, 'dog', {_SQL_BOX[1]} FROM p),
k AS (SELECT id, n, class_name, v, greatest(0, x1 - 4) AS l, greatest(0, y1 - 4) AS t, least(16, x2 + 4) AS r, least(16, y2 + 4) AS u, x, y FROM b)
SELECT id, n, class_name, (r - l)::INT AS width, (u - t)::INT AS height, sum(v * ((y - t) * (r - l) + x - l + 1))::BIGINT AS total FROM k WHERE x >= l AND x < r AND y >= t AND y < u GROUP BY id, n, class_name, l, t, r, u
""")
def box_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drawing.crops(_boxed_rasters(spark, sf_dir), margin=4)
    return found.select(F.col("path").cast("long").alias("id"), "n", "class_name", "width", "height", _weighed("content")["r"].alias("total"))


@query(f"""
WITH h AS (SELECT id, i, v, v / greatest(1, max(v) OVER (PARTITION BY id))::DOUBLE AS s, max(v) OVER (PARTITION BY id) = 0 AS dark FROM ({_SQL_PIXELS})),
c AS (SELECT id, i, v, CASE WHEN dark THEN 0 ELSE floor(greatest(0, least(1, 3 * s - 1)) * 255) END AS r, CASE WHEN dark THEN 0 ELSE floor((1 - abs(2 * s - 1)) * 255) END AS g, CASE WHEN dark THEN 0 ELSE floor(greatest(0, least(1, 1 - 3 * s)) * 255) END AS b FROM h)
SELECT id, sum((i + 1) * r)::BIGINT AS r, sum((i + 1) * g)::BIGINT AS g, sum((i + 1) * b)::BIGINT AS b,
  sum((i + 1) * floor(v + 0.5 * (r - v)))::BIGINT AS over_r, sum((i + 1) * floor(v + 0.5 * (g - v)))::BIGINT AS over_g, sum((i + 1) * floor(v + 0.5 * (b - v)))::BIGINT AS over_b FROM c GROUP BY id
""")
def heat_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drawing.heat_maps(_rasters(spark, sf_dir)).select(F.col("path").cast("long").alias("id"), _weighed("heat").alias("h"), _weighed("overlay").alias("o"))
    return found.select("id", "h.*", *(F.col(f"o.{c}").alias(f"over_{c}") for c in "rgb"))


# --- documents with pictures ----------------------------------------------------------------------


@query("""
SELECT c_custkey AS id, form, CASE form WHEN 'pdf' THEN '%PDF' ELSE 'PK' || chr(3) || chr(4) END AS magic, c_custkey || '.' || form AS name, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS pictures
FROM customer, (SELECT unnest(['docx', 'pdf']) AS form)
""")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as Word and PDF files; two of three hold a picture."""
    bits = jpeg.encoded(np.add.outer(np.arange(24), np.arange(32))[..., None] * [4, 2, 1])
    shown = F.when(F.col("c_custkey") % 3 != 0, F.lit(base64.b64encode(bits).decode())).otherwise("not a picture")
    block = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    blocks = F.array(block("h1", F.col("c_name")), block("paragraph", F.col("c_mktsegment")), block("image", shown))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", each=5_000).select("c_custkey", blocks.alias("blocks"))
    made = [documents.rendered(rows, "c_custkey", "blocks", form).withColumn("form", F.lit(form)) for form in ("docx", "pdf")]
    held = F.size(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"/Subtype /Image|word/media/image1\.jpg"), F.lit(0)))
    pictures = F.when(F.col("form") == "docx", held / 2).otherwise(held).cast("int")  # a Word file names a part twice
    return made[0].unionByName(made[1]).select(F.split_part("name", F.lit("."), F.lit(1)).cast("long").alias("id"), "form", F.decode(F.substring("content", 1, 4), "ISO-8859-1").alias("magic"), "name", pictures.alias("pictures"))


# --- a stored checkpoint --------------------------------------------------------------------------


@query("""
SELECT CASE doc_id % 8 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'no object' WHEN 3 THEN 'missing: image_path' WHEN 4 THEN 'wrong kind: success_count' WHEN 5 THEN 'wrong kind: reports' ELSE 'entry' END AS state,
  CASE WHEN doc_id % 8 IN (0, 6, 7) THEN CASE WHEN doc_id % 8 = 7 THEN '' ELSE 'completed' END END AS status, count(*) AS n, sum(CASE WHEN doc_id % 8 IN (0, 6) THEN quality ELSE 0 END)::BIGINT AS successes,
  count(*) FILTER (doc_id % 8 IN (0, 6)) AS reports FROM labels GROUP BY 1, 2
""")
def checkpoint_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as a checkpoint, some of them broken, and loaded again."""
    n, name = F.col("doc_id"), F.concat(F.lit("img"), F.col("doc_id").cast("string"))
    line = lambda *c: F.to_json(F.struct(*c))
    image, good = name.alias("image_path"), F.col("quality").cast("int").alias("success_count")
    whole = line(image, F.lit("completed").alias("status"), good, F.array(name).alias("reports"))
    lines = (
        F.when(n % 8 == 1, F.left(whole, F.lit(20))).when(n % 8 == 2, F.concat(F.lit("["), whole, F.lit("]"))).when(n % 8 == 3, line(good)).when(n % 8 == 4, line(image, F.lit("two").alias("success_count")))
        .when(n % 8 == 5, line(image, F.lit("one").alias("reports"))).when(n % 8 == 7, line(image)).otherwise(whole)
    )
    path = scratch_path(spark, "checkpoint")
    table(spark, sf_dir, "labels").select(lines.alias("value")).write.text(f"{path}/entries")
    spark.range(1).select(F.lit('{"created_at":"2024-01-01"}').alias("value")).coalesce(1).write.text(f"{path}/header.json")
    found = checkpoints.load(spark, path)
    entries = found.entries.select(F.lit("entry").alias("state"), "status", "success_count", F.size("reports").alias("reports"))
    rejected = found.rejected.select(F.col("reason").alias("state"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("success_count"), F.lit(0).alias("reports"))
    return entries.unionByName(rejected).groupBy("state", "status").agg(F.count("*").alias("n"), F.sum("success_count").alias("successes"), F.sum("reports").alias("reports"))
