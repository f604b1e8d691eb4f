"""Batch roll-ups: counts, histograms, objects, verdicts, places, scores, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions import text


def run_counts(df: DataFrame, success: str = "success") -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(success).alias("successful"), (F.count("*") - F.count_if(success)).alias("failed"))


def entity_counts(entities: DataFrame, distinct: bool = False) -> DataFrame:
    """``(type, n, n_valid)``; values are counted each time, or once where ``distinct``."""
    e = entities.dropDuplicates(["type", "normalized"]) if distinct else entities
    return e.groupBy("type").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))


def top_values(entities: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """``(type, n, values)``: the first ``k`` values of each type in the given order. A type's rows are
    reduced to k per task before they meet."""
    first = F.slice(F.array_sort(F.collect_list(F.struct(*order, "value"))), 1, k)
    parts = entities.groupBy("type", F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), first.alias("v"))
    both = parts.groupBy("type").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("v"))), 1, k).alias("v"))
    return both.select("type", "n", F.transform("v", lambda x: x["value"]).alias("values"))


def with_rest(values: Column, n: Column, glue: str = ", ") -> Column:
    """The values shown, and how many more there are."""
    more = n - F.size(values)
    return F.concat(F.array_join(values, glue), F.when(more > 0, F.concat(F.lit(" e mais "), more.cast("string"))).otherwise(""))


def object_totals(df: DataFrame, text_col: str) -> DataFrame:
    """``(name, n)`` from lines ``- Nx name``: split at the first x, lines without a number skipped,
    texts that say the detector did not run skipped."""
    ran = df.filter(F.col(text_col).isNotNull() & ~F.contains(F.col(text_col), F.lit("YOLO não executado")))
    lines = ran.select(F.explode(F.transform(F.split(text_col, "\n"), text.stripped)).alias("line"))
    part = lines.select(F.regexp_extract("line", r"^- ([^x]*)x(.*)$", 1).alias("n"), F.regexp_extract("line", r"^- ([^x]*)x(.*)$", 2).alias("name"))
    counted = part.select(F.trim("n").try_cast("bigint").alias("n"), F.trim("name").alias("name")).filter("n is not null")
    return counted.groupBy("name").agg(F.sum("n").alias("n"))


def forensic_histogram(df: DataFrame, text_col: str) -> DataFrame:
    """``(verdict, n)``: of texts with the forensic section, one verdict a line: prefix and rest of line."""
    lines = df.filter(F.contains(F.col(text_col), F.lit("DADOS FORENSES AUTOMATIZADOS"))).select(F.explode(F.transform(F.split(text_col, "\n"), text.stripped)).alias("line"))
    key = F.lit(None).cast("string")
    for mark, prefix in (("Veredicto Clone:", "Clone: "), ("Veredicto Ghost:", "Ghost: "), ("Veredicto ELA:", "ELA: ")):
        rest = F.trim(F.substring_index("line", mark, -1))
        key = F.when(F.contains("line", F.lit(mark)), F.concat(F.lit(prefix), rest)).otherwise(key)
    return lines.select(key.alias("verdict")).filter("verdict is not null").groupBy("verdict").agg(F.count("*").alias("n"))


def places(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, lat, lon, url)`` of texts whose GPS line parses."""
    found = df.select(F.col(id_col), text.gps_field(F.col(text_col)).alias("g")).filter("g is not null").select(id_col, "g.*")
    return found.withColumn("url", text.map_link(F.col("lat"), F.col("lon")))


def score_summary(df: DataFrame, score: Column) -> DataFrame:
    return df.select(score.alias("s")).agg(F.avg("s").alias("avg_score"), F.max("s").alias("max_score"), F.min("s").alias("min_score"), F.count("s").alias("n"))


def class_summary(df: DataFrame, label: str, value: str) -> DataFrame:
    """``(label, n, mean)``, most first."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).orderBy(F.desc("n"), label)


def cache_statistics(df: DataFrame, model: str, mode: str, size: str) -> DataFrame:
    """Entries and MiB in all, by model and by mode, in one pass over grouping sets."""
    sets = df.groupingSets([[], [F.col(model)], [F.col(mode)]], F.col(model), F.col(mode))
    return sets.agg(F.count("*").alias("entries"), (F.sum(size) / (1024 * 1024)).alias("mib"), F.grouping_id().alias("level"))


def model_times(df: DataFrame, model: str, seconds: str, hit: Column) -> DataFrame:
    """Mean time of calls that no cache answered."""
    return df.filter(~hit).groupBy(model).agg(F.round(F.avg(seconds), 2).alias("avg_seconds"), F.count("*").alias("n")).orderBy(model)


def per_day(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def severity_counts(anomalies: Column) -> Column:
    """Map of severity to number in an array of anomalies."""
    names = F.transform(anomalies, lambda a: a["severity"])
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda s: F.struct(s, F.size(F.filter(names, lambda n: n == s)))))


def consolidated_names(df: DataFrame, image: str, model: str) -> DataFrame:
    """Distinct images, and the sorted names of the models (a small set) in one string."""
    return df.agg(F.count_distinct(image).alias("images"), F.array_join(F.array_sort(F.collect_set(model)), ", ").alias("models"))


def duplicate_counts(pairs: DataFrame, same: str = "same_md5") -> DataFrame:
    """Exact pairs, and near ones."""
    return pairs.agg(F.count_if(same).alias("exact"), F.count_if(~F.col(same)).alias("near"))


def cache_hits(df: DataFrame, hit: str = "cache_hit") -> DataFrame:
    return df.agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))


def map_total(counts: Column) -> Column:
    """Sum of a map's values; null or empty: 0."""
    return F.aggregate(F.coalesce(F.map_values(counts), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
