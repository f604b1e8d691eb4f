"""Agreement of two accounts of one item: words, numbers and entities of the first in the second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.lexicon import STOPWORDS, WORD_LETTERS
from casefile.functions.text import bound
from casefile.operators.entities import normalized_values


def significant_words(text: Column) -> Column:
    """Distinct words of four letters and more that are not stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b[{WORD_LETTERS}]{{4,}}\b"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, STOPWORDS)))


def consistency(first: Column, second: Column, entities: bool = True) -> Column:
    """Struct (score, inconsistencies (sorted), verdict). A text that is empty or a ``[status]``, and
    one without significant words, are not judged. Words, entities and differences are found once each."""
    none = F.array().cast("array<string>")

    def found(a: Column, b: Column) -> Column:
        numbers = F.array_distinct(F.regexp_extract_all(a, F.lit(r"(?U)\b\d{3,}\b"), F.lit(0)))
        odd = F.transform(F.filter(numbers, lambda n: ~F.contains(b, n)), lambda n: F.concat(F.lit("number:"), n))
        if entities:
            gone = F.array_except(normalized_values(a), normalized_values(b))
            odd = F.concat(odd, F.transform(gone, lambda v: F.concat(F.lit("entity:"), v)))
        share = bound(F.struct(significant_words(a).alias("w"), F.lower(b).alias("low")), lambda x: F.size(F.filter(x["w"], lambda w: F.contains(x["low"], w))) / F.nullif(F.size(x["w"]), F.lit(0)))
        return F.struct(F.array_sort(odd).alias("odd"), share.alias("share"))

    def judged(x: Column) -> Column:
        verdict = F.when((x["share"] >= 0.7) & (F.size(x["odd"]) <= 1), "consistente").when(x["share"] >= 0.4, "parcialmente_consistente").otherwise("inconsistente")
        fit = x["share"].isNotNull()
        return F.struct(
            F.coalesce(x["share"], F.lit(0.0)).alias("score"), F.when(fit, x["odd"]).otherwise(none).alias("inconsistencies"), F.when(fit, verdict).otherwise("nao_avaliado").alias("verdict")
        )

    def compared(t: Column) -> Column:
        a, b = t["a"], t["b"]
        skip = (a == "") | a.startswith("[") | (b == "") | b.isNull()
        return bound(F.when(F.coalesce(~skip, F.lit(False)), found(a, b)).otherwise(F.struct(none.alias("odd"), F.lit(None).cast("double").alias("share"))), judged)

    return bound(F.struct(first.alias("a"), second.alias("b")), compared)


def compare(df: DataFrame, first: str, second: str, entities: bool = True) -> DataFrame:
    return df.withColumn("_v", consistency(F.col(first), F.col(second), entities)).select("*", "_v.*").drop("_v")
