"""Loading a stored checkpoint: entries that hold are filled up with defaults, others are set apart with a reason.

A checkpoint is a folder with ``header.json``, one object, and ``entries``, files of one JSON object a line.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.sources.files import CHECKPOINT_ENTRY

#: The version of the format.
VERSION = 1

#: What a field may be: its kind, as JSON has it, and whether an entry without it holds.
_KINDS = {"string": "STRING", "int": "BIGINT", "array<string>": "ARRAY<STRING>"}
_NEEDED = ("image_path",)


@dataclass(frozen=True)
class Checkpoint:
    header: dict
    entries: DataFrame
    rejected: DataFrame
    error: str | None


def _kind(field) -> str:
    return _KINDS[field.dataType.simpleString()]


def reason(line: Column) -> Column:
    """Why a line is no entry; null if it is one: not JSON, no object, a needed field missing, a field of another kind."""
    parsed = F.try_parse_json(line)
    out = F.lit(None).cast("string")
    for field in reversed(CHECKPOINT_ENTRY.fields):
        kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field.name}", "variant"))
        fits = (kind == _kind(field)) | (kind == "ARRAY<VOID>") & F.lit(_kind(field).startswith("ARRAY")) | (kind == "VOID")
        out = F.when(~F.coalesce(fits, F.lit(True)), f"wrong kind: {field.name}").otherwise(out)
        if field.name in _NEEDED:
            out = F.when(kind.isNull() | (kind == "VOID"), f"missing: {field.name}").otherwise(out)
    shape = F.schema_of_variant(parsed)
    return F.when(parsed.isNull(), "not JSON").when(~shape.startswith("OBJECT"), "no object").otherwise(out)


def _filled(line: Column, created: str) -> list[Column]:
    entry = F.from_json(line, CHECKPOINT_ENTRY)
    default = {"string": F.lit(""), "int": F.lit(0), "array<string>": F.array().cast("array<string>")}
    own = {"updated_at": F.lit(created)}
    return [F.coalesce(entry[f.name], own.get(f.name, default[f.dataType.simpleString()])).alias(f.name) for f in CHECKPOINT_ENTRY.fields]


def _header(spark: SparkSession, path: str) -> tuple[dict, str | None]:
    try:
        found = spark.read.text(f"{path}/header.json", wholetext=True).first()
    except PySparkException as error:
        return {}, None if "PATH_NOT_FOUND" in str(error) else str(error)
    try:
        header = json.loads(found[0]) if found else None
    except json.JSONDecodeError as error:
        return {}, str(error)
    return (header, None) if isinstance(header, dict) else ({}, "the header is no JSON object")


def load(spark: SparkSession, path: str, now: str = "") -> Checkpoint:
    """Everything below ``path``. Without a header file there is no checkpoint: no entries and no error. ``error`` says why one
    that exists cannot be resumed, and is what ``incremental.reset_reason`` takes; then there are no entries."""
    header, error = _header(spark, path)
    created = header.get("created_at", now)
    header = {"version": VERSION, "job_signature": "", "job_config": {}, "created_at": created, "updated_at": created} | header
    try:
        lines = spark.read.text(f"{path}/entries") if error is None else None
    except PySparkException:
        lines = None
    if lines is None:
        lines = spark.createDataFrame([], "value string")
    judged = lines.filter(F.trim("value") != "").withColumn("reason", reason(F.col("value")))
    return Checkpoint(header, judged.filter("reason is null").select(*_filled(F.col("value"), created)), judged.filter("reason is not null").select("reason", F.col("value").alias("line")), error)
