"""Rules over EXIF metadata held as a map of strings: anomalies, and a verdict by the worst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.lexicon import CRITICAL_EDITORS, EDITORS, EXIF_TIME_FORMATS
from casefile.operators.timeline import parsed


def _anomaly(when: Column, kind: str, severity: str | Column, field: str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(F.lit(kind).alias("type"), level.alias("severity"), F.lit(field).alias("field")))


def anomalies(exif: Column, now: Column, has_gps: Column) -> Column:
    """Array of (type, severity, field), in the order of the rules. ``now`` is given, so results repeat."""
    tag = lambda n: F.nullif(F.try_element_at(exif, F.lit(n)), F.lit(""))
    software, make, model = tag("Software"), tag("Make"), tag("Model")
    original, changed, digitized = (parsed(tag(n), EXIF_TIME_FORMATS) for n in ("DateTimeOriginal", "DateTime", "DateTimeDigitized"))
    level = F.lit(None).cast("string")
    for part in reversed(EDITORS):
        level = F.when(F.contains(F.lower(software), F.lit(part)), "critical" if part in CRITICAL_EDITORS else "warning").otherwise(level)
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    gap = lambda a, b: F.abs(seconds(a) - seconds(b)) > 3600
    known = F.coalesce(tag("DateTimeOriginal"), tag("DateTime")).isNotNull()
    rotation = tag("Orientation").try_cast("int")
    nothing = make.isNull() & model.isNull()
    return F.array_compact(F.array(
        _anomaly(level.isNotNull(), "editing_software", level, "Software"),
        _anomaly(gap(changed, original), "timestamp_mismatch", "warning", "DateTime/DateTimeOriginal"),
        _anomaly(gap(digitized, original), "timestamp_mismatch", "warning", "DateTimeOriginal/DateTimeDigitized"),
        *(_anomaly(known & (at > now), "future_timestamp", "critical", f) for at, f in ((original, "DateTimeOriginal"), (changed, "DateTime"), (digitized, "DateTimeDigitized"))),
        _anomaly(has_gps & nothing, "gps_no_camera", "warning", "GPS/Make/Model"),
        _anomaly(rotation > 1, "orientation_flag", "info", "Orientation"),
        _anomaly((F.size(exif) > 0) & nothing & software.isNull(), "missing_basic_fields", "warning", "Make/Model/Software"),
    ))


def verdict(exif: Column, found: Column) -> Column:
    has = lambda s: F.exists(found, lambda a: a["severity"] == s)
    return F.when(exif.isNull() | (F.size(exif) == 0), "stripado").when(has("critical"), "suspeito").when(has("warning"), "inconclusivo").otherwise("consistente")


def judge(df: DataFrame, exif: str, now: Column, gps: str | None = None) -> DataFrame:
    """``df`` with ``anomalies``, ``exif_verdict``; without EXIF that is the only anomaly."""
    tags = F.coalesce(F.col(exif), F.create_map().cast("map<string,string>"))
    has_gps = F.col(gps) if gps else F.exists(F.map_keys(tags), lambda k: F.contains(F.lower(k), F.lit("gps")))
    found = F.when(F.size(tags) == 0, F.array(F.struct(F.lit("no_exif").alias("type"), F.lit("warning").alias("severity"), F.lit("EXIF").alias("field")))).otherwise(anomalies(tags, now, has_gps))
    return df.withColumn("anomalies", found).withColumn("exif_verdict", verdict(F.col(exif), F.col("anomalies")))
