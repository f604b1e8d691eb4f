"""Keyword classification: most hits win, earlier labels win ties."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions import text
from casefile.functions.lexicon import CONTEXT_TAGS, DOCUMENT_TYPES, THREATS


_TABLES = {"kind": DOCUMENT_TYPES, "threat": THREATS, "tag": CONTEXT_TAGS}
_LABELS = [(table, label) for table, labels in _TABLES.items() for label in labels]
_WORDS = sorted({w for labels in _TABLES.values() for words in labels.values() for w in words})


def _branches(words: list[str]) -> str:
    """The words as one pattern that shares beginnings and takes the longest that fits: after each beginning one
    character decides where to go on."""
    ends, heads = "" in words, sorted({w[0] for w in words if w})
    parts = []
    for h in heads:
        tails = [w[1:] for w in words if w.startswith(h)]
        shared = os.path.commonprefix(tails)
        parts.append(re.escape(h + shared) + _branches([t[len(shared) :] for t in tails]))
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)})" + ("?" if ends else "")


#: At any place, the longest keyword that starts there; matches may overlap.
_PATTERN = f"(?=({_branches(_WORDS)}))"


def _meaning(word: str) -> list[str]:
    """The keywords that stand where this one does: itself and those it starts with, as ``label number:word``."""
    return [f"{i:02d}:{w}" for i, (table, label) in enumerate(_LABELS) for w in dict.fromkeys(_TABLES[table][label]) if word.startswith(w)]


def _classified(low: Column) -> Column:
    """One scan finds all keywords; labels are then counted among the few that were found."""
    meanings = F.create_map(*(x for w in _WORDS for x in (F.lit(w), F.array(*map(F.lit, _meaning(w))))))
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(_PATTERN), F.lit(1)))
    hits = F.transform(F.array_distinct(F.flatten(F.transform(found, lambda w: F.element_at(meanings, w)))), lambda m: F.substring(m, 1, 2).cast("int"))

    def result(h: Column) -> Column:
        own = lambda table: [(i, label) for i, (t, label) in enumerate(_LABELS) if t == table]
        count = lambda i: F.size(F.filter(h, lambda x: x == i))

        def best(table: str, default: str) -> Column:
            ranked = F.greatest(*(F.struct(count(i).alias("n"), F.lit(-i).alias("o"), F.lit(label).alias("k")) for i, label in own(table)))
            return F.when(F.size(h) == 0, F.struct(F.lit(0).alias("n"), F.lit(0).alias("o"), F.lit(default).alias("k"))).otherwise(
                text.bound(ranked, lambda r: F.struct(r["n"].alias("n"), r["o"].alias("o"), F.when(r["n"] > 0, r["k"]).otherwise(default).alias("k")))
            )

        tags = F.array_compact(F.array(*(F.when(F.array_contains(h, i), F.lit(label)) for i, label in own("tag"))))
        parts = F.struct(best("kind", "indefinido").alias("kind"), best("threat", "nenhuma").alias("threat"), tags.alias("tags"))
        sure = lambda p: F.least(F.lit(1.0), (p["kind"]["n"] + p["threat"]["n"] + F.size(p["tags"])) / F.lit(5.0))
        return text.bound(parts, lambda p: F.struct(p["kind"]["k"].alias("document_type"), p["threat"]["k"].alias("threat_type"), p["tags"].alias("context_tags"), sure(p).alias("confidence")))

    return text.bound(hits, result)


def classification(t: Column) -> Column:
    """Struct (document_type, threat_type, context_tags, confidence). Null text: as empty."""
    return text.bound(F.lower(F.coalesce(t, F.lit(""))), _classified)


def classify(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the classification's columns."""
    return df.select("*", classification(F.col(text_col)).alias("_c")).select(*df.columns, "_c.*")


def histogram(df: DataFrame, label: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows per label, most first, ties by label; ``exclude`` drops default labels on request."""
    # a filter on the label would be pushed below it, and the classification be made twice
    counted = df.groupBy(label).agg(F.count_if(~F.col(label).isin("", *exclude)).alias("n")).filter("n > 0")
    return counted.orderBy(F.desc("n"), label)
