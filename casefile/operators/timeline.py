"""Timelines: timestamps found in texts, parsed where a format fits, ordered and deduplicated."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.functions import text
from casefile.functions.lexicon import RECORDER_PATTERNS, TIMESTAMP_FORMATS, TIMESTAMP_PATTERNS


def _shape(fmt: str) -> str:
    """What a format accepts: as many digits as it has letters, and its other characters."""
    parts = re.findall(r"'([^']*)'|([A-Za-z]+)|([^A-Za-z']+)", fmt)
    return "^" + "".join(rf"\d{{{len(letters)}}}" if letters else re.escape(quoted or other) for quoted, letters, other in parts) + "$"


def parsed(ts: Column, formats: list[str] | None = None) -> Column:
    """The first format that fits by shape, without time zone; null if none does, or if there is no such time."""
    t, out = text.stripped(ts), F.lit(None).cast("timestamp_ntz")
    for f in reversed(formats or TIMESTAMP_FORMATS):
        out = F.when(t.rlike(_shape(f)), F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz")).otherwise(out)
    return out


def _events(t: Column, patterns: list[str]) -> Column:
    """(timestamp, seq, description) of the first match of each spelling; seq: place among all matches, pattern by pattern."""
    def row(m: Column) -> Column:
        near = text.stripped(text.context(t, m["start"], F.length(m["value"]), 50, 100))
        near = F.left(F.regexp_replace(near, r"(?U)\s+", " "), F.lit(150))
        return F.struct(m["value"].alias("timestamp"), near.alias("description"))

    def first_of_each(events: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(events, lambda e: e["timestamp"]))
        return F.array_compact(F.zip_with(events, F.slice(before, 1, F.size(events)), lambda e, last: F.when(~e["timestamp"].eqNullSafe(last), e)))

    every = F.flatten(F.array(*(F.transform(text.matches(t, p), row) for p in patterns)))
    placed = F.transform(every, lambda e, i: F.struct(e["timestamp"].alias("timestamp"), i.alias("seq"), e["description"].alias("description")))
    return text.bound(F.array_sort(placed), first_of_each)


def _extracted(df: DataFrame, id_col: str, text_col: str, patterns: list[str], source: str) -> DataFrame:
    """Spellings are deduplicated within their text's array, so nothing is shuffled; times are parsed a row each."""
    rows = df.select(id_col, F.explode(_events(F.col(text_col), patterns)).alias("e"))
    return rows.select(id_col, "e.seq", "e.timestamp", parsed(F.col("e.timestamp")).alias("parsed"), "e.description", F.lit(source).alias("source"))


def extract(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, seq, timestamp, parsed, description, source)``: each spelling once per row of ``df``; order by
    ``parsed`` (nulls last), then ``seq``."""
    return _extracted(df, id_col, text_col, TIMESTAMP_PATTERNS, "text")


def extract_recorder(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Timestamps of a recorder's overlay, each spelling once per row of ``df``; order by ``seq``, that of pattern and place."""
    return _extracted(df, id_col, text_col, RECORDER_PATTERNS, "dvr_timestamp")


def merged(df: DataFrame, id_col: str, first_col: str, all_col: str) -> DataFrame:
    """Both kinds, recorder events after text events of the same time, not deduplicated across; ``pos`` numbers them."""
    both = extract(df, id_col, all_col).withColumn("k", F.lit(0)).unionByName(extract_recorder(df, id_col, first_col).withColumn("k", F.lit(1)))
    order = Window.partitionBy(id_col).orderBy(F.asc_nulls_last("parsed"), "k", "seq")
    return both.withColumn("pos", F.row_number().over(order) - 1).drop("k", "seq")


def consolidated(events: DataFrame, item_ord: str, event_ord: str) -> DataFrame:
    """All items' events by spelling of the timestamp, then item, then event."""
    return events.orderBy("timestamp", item_ord, event_ord)
