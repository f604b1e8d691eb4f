"""The dataflow core: normalize, extract, classify, compare, order in time; one row per item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.functions.text import normalized
from casefile.operators import classify, consistency, entities, timeline


def process(df: DataFrame, id_col: str, ocr: str, llm: str, exif: str) -> DataFrame:
    """``(id, normalized_text, entities, classification, validation)`` without any shuffle."""
    texts = df.select(F.col(id_col), F.coalesce(F.col(ocr), F.lit("")).alias("_o"), F.coalesce(F.col(llm), F.lit("")).alias("_m"))
    both = F.concat(F.col("_o"), F.lit("\n"), F.col("_m"))
    return texts.select(
        id_col, normalized(F.col("_o")).alias("normalized_text"), entities.entity_array(both).alias("entities"),
        classify.classification(both).alias("classification"), consistency.consistency(F.col("_o"), F.col("_m")).alias("validation"),
    )


def timelines(df: DataFrame, id_col: str, ocr: str, llm: str, exif: str) -> DataFrame:
    o, m, x = (F.coalesce(F.col(c), F.lit("")) for c in (ocr, llm, exif))
    rows = df.select(F.col(id_col), o.alias("ocr"), F.concat_ws("\n", o, m, x).alias("everything"))
    return timeline.merged(rows, id_col, "ocr", "everything")
