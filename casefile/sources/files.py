"""File scans: images, Markdown, JSON stores, video frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of images.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp", ".avif", ".gif", ".ico", ".heic", ".heif", ".raw", ".cr2", ".nef", ".arw", ".orf", ".rw2"]
CACHE_ENTRY = T.StructType([
    T.StructField(n, T.StringType()) for n in ("image_hash", "image_path", "image_name", "model", "analysis_mode", "ocr_engine", "report_path", "created_at")
] + [T.StructField("file_size", T.LongType()), T.StructField("dimensions", T.StringType())] + [
    T.StructField(n, T.StringType()) for n in ("ocr_result", "yolo_result", "quality_result", "exif_data")
])
CHECKPOINT_ENTRY = T.StructType([
    T.StructField("image_path", T.StringType()), T.StructField("image_name", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("success_count", T.IntegerType()), T.StructField("failed_count", T.IntegerType()),
    T.StructField("reports", T.ArrayType(T.StringType())), T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("updated_at", T.StringType()),
])


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def image_files(spark: SparkSession, folder: str, suffixes: Sequence[str] = IMAGE_SUFFIXES, content: bool = False, ordered: bool = False) -> DataFrame:
    """``(path, modificationTime, length, name, suffix)`` of images below a folder; contents are read only
    on request, an order by path is made only on request. A missing folder: empty."""
    schema = "path string, modificationTime timestamp, length long" + (", content binary" if content else "")
    if not _exists(spark, folder):
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        found = found if content else found.drop("content")
    named = found.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).withColumn("name", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))
    named = named.filter(F.col("suffix").isin(*suffixes))
    return named.orderBy("path") if ordered else named


def landed(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """A stream of the files that arrive in a folder, each once: ``(path, modificationTime, length, content, name)``.
    A name that has come before is not taken again, as Spark's file source remembers paths."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = found.option("maxFilesPerTrigger", files_a_trigger).load(folder)
    return found.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of what Spark can decode; the rest is dropped."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, path, mtime, document)``: one row per Markdown file of the folder itself."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("id"), "path", F.col("modificationTime").cast("string").alias("mtime"), F.decode("content", "UTF-8").alias("document"))


def json_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON store; missing: empty, what does not parse: nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def keyframes(frames: DataFrame, frame: str, fps: str, stem: str, every: int = 30) -> DataFrame:
    """Every n-th frame, named by its second; of several in one second the last stays."""
    from casefile.functions.numeric import frame_stamp

    kept = frames.filter(F.col(frame) % every == 0)
    kept = kept.withColumn("name", F.concat(F.col(stem), F.lit("_"), frame_stamp(F.col(frame), F.col(fps)), F.lit(".jpg")))
    return kept.groupBy("name").agg(F.max(frame).alias(frame))
