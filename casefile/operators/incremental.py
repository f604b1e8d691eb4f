"""Work that is already done: cache lookups, resumed runs, upserts, index diffs, job signatures."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.functions.checks import entry_complete


def task_grid(items: DataFrame, models: DataFrame) -> DataFrame:
    """Every item with every model; the planner broadcasts the models where their size, which it checks, allows."""
    return items.crossJoin(models)


def cache_key(image_hash: Column, model: Column, mode: Column, engine: Column) -> Column:
    return F.concat_ws("_", image_hash, model, mode, engine)


def cached_lookup(tasks: DataFrame, cache: DataFrame, keys: Sequence[str], live: Column) -> DataFrame:
    """``tasks`` with the cache's columns and ``cache_hit``; entries that are not live count as misses."""
    hits = cache.filter(live).withColumn("_hit", F.lit(True))
    return tasks.join(hits, list(keys), "left").withColumn("cache_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def pending(tasks: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tasks.join(cache, list(keys), "left_anti")


def first_intermediate(cache: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key, the first row in order whose value is not empty."""
    full = cache.filter(F.coalesce(F.col(value), F.lit("")) != "")
    return full.groupBy(key).agg(F.min_by(value, order).alias(value))


def resume(items: DataFrame, entries: DataFrame, key: str, files: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skipped, pending, stale): items with a complete entry, items without, and completed entries whose reports are gone."""
    done = entry_complete(F.col("status"), F.col("reports"), files)
    complete = entries.filter(F.coalesce(done, F.lit(False)))
    stale = entries.filter((F.col("status") == "completed") & ~F.coalesce(done, F.lit(False)))
    return items.join(complete, key, "left_semi"), items.join(complete, key, "left_anti"), stale


def reset_reason(saved: str | None, signature: str, version_ok: bool, error: str | None) -> str | None:
    """Why a checkpoint cannot be resumed; None if it can."""
    if error:
        return "load_error"
    if not version_ok:
        return "version"
    return "signature" if saved is not None and saved != signature else None


def job_signature(config: dict) -> str:
    """SHA-256 of the configuration as compact JSON with sorted keys and sorted distinct formats."""
    own = dict(config)
    if "export_formats" in own:
        own["export_formats"] = sorted(set(own["export_formats"]))
    return hashlib.sha256(json.dumps(own, sort_keys=True, ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()


def latest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last in order: an upsert as a query."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def capped_history(rows: DataFrame, order: Sequence[Column], most: int = 10_000) -> DataFrame:
    """The newest rows: each task keeps ``most`` before they meet; no full sort."""
    return rows.orderBy(*order).limit(most)


def index_diff(new: DataFrame, old: DataFrame, key: str = "id", stamp: str = "mtime") -> DataFrame:
    """``new`` with ``action``: insert, update (other stamp, compared as text) or skip. Nothing is deleted."""
    known = old.select(key, F.col(stamp).cast("string").alias("_old"), F.lit(True).alias("_known"))
    both = new.join(known, key, "left")
    action = F.when(F.col("_known").isNull(), "insert").when(~F.col(stamp).cast("string").eqNullSafe(F.col("_old")), "update").otherwise("skip")
    return both.withColumn("action", action).drop("_old", "_known")


def override(base: DataFrame, custom: DataFrame, key: str) -> DataFrame:
    """``base`` with rows of ``custom`` in place of those with equal keys, and its new ones."""
    return base.join(custom, key, "left_anti").unionByName(custom)


def imported(rows: DataFrame, builtin: DataFrame, key: str) -> DataFrame:
    """``rows`` as custom ones; a key that a built-in has gets ``_imported``."""
    own = builtin.select(key).distinct().withColumn("_b", F.lit(True))
    both = rows.join(own, key, "left").withColumn(key, F.when(F.col("_b"), F.concat(F.col(key), F.lit("_imported"))).otherwise(F.col(key)))
    return both.withColumn("is_custom", F.lit(True)).drop("_b")


def sidecar(reports: DataFrame, payloads: DataFrame, path: str = "path") -> DataFrame:
    """Markdown reports with the JSON file of equal stem, where there is one."""
    stem = lambda df: df.withColumn("stem", F.regexp_replace(path, r"\.[^./]*$", ""))
    return stem(reports).join(stem(payloads).withColumnRenamed(path, "payload_path"), "stem", "left")


def by_prefix(reports: DataFrame, images: DataFrame, name: str, stem: str) -> DataFrame:
    """Reports with the image whose stem is their name up to the last underscore."""
    return reports.withColumn(stem, F.regexp_replace(name, "_[^_]*$", "")).join(images, stem)


def model_pairs(analyses: DataFrame, image: str, model: str, a: str, b: str, content: str) -> DataFrame:
    """Answers of two models side by side, per image."""
    side = lambda m, n: analyses.filter(F.col(model) == m).select(image, F.col(content).alias(n))
    return side(a, "content_a").join(side(b, "content_b"), image)
