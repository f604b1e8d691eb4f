"""A corpus from raw documents to packed token sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)``: ``docs`` is what the stage before it kept, read back
from Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm import alike, packing, quality_cnn, quality_rules, secrets
from casefile.llm.batches import whole
from casefile.llm.queries import good_labels, quality_labels, tokenizer_path
from casefile.llm.store import by_count, cleared, written


def rowed(docs: DataFrame) -> DataFrame:
    """``(row, doc)`` for each row of ``docs``: a key, file and place as every reader of a stored table
    sees them, and the row's columns as a struct, so none of them can clash. Only a table that is not read
    from Parquet is written first. Files: fewer than 2**23, of fewer than 2**40 rows."""
    doc = whole(docs)
    try:
        placed = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), doc)
    except AnalysisException:
        return written(docs.select(F.monotonically_increasing_id().alias("row"), doc), "rows")
    files = sorted(r[0] for r in placed.select("file").distinct().collect())
    number = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "file string, number long")
    return placed.join(F.broadcast(number), "file").select((F.shiftleft("number", 40) + F.col("at")).alias("row"), "doc")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a rule rejects go, each by its own verdict: other rows of the same id stay.

    Null and empty texts fail the base rules; a null language is a stratum of its own; repeated rows
    share a verdict. Texts of any length are measured whole. Other columns are carried and not read,
    whatever their names. Empty table: empty result.
    """
    return quality_rules.kept_docs(docs, good_labels(spark, sf_dir))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score under one half go. The model learns from the labelled rows of ``docs`` itself: the
    raw table is gone by then, so bad examples are those that the rules have left.

    Null and empty texts get the score of an empty text, null ids are scored like others, repeated rows
    share a score. Whole texts are scored. Other columns are carried and not read, whatever their names.
    Without labels of both classes all rows share one side. Empty table: empty result.
    """
    return quality_cnn.kept_docs(docs, quality_labels(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked by a similarity of 0.8 or more of their shingles of five
    words, one row stays: that with the smallest id, a null id only where no row of the group has one.

    Ties of id go to the first stored row. Null and word-less texts are one group. Rows are removed by
    place, never by id, so unique rows of a repeated id stay. Texts of any length are compared whole.
    Other columns are carried and not read, whatever their names. Empty table: empty result.
    """
    rows = rowed(docs)
    kept = []
    with cleared(kept):
        found = alike.near_copies(rows.select("row", "doc.doc_id", "doc.text"), "row")
        gone = written(found.filter("row <> keeper").select("row"), "gone")
        kept.append(gone)
    # up to 2 million places (some 50 MB) are broadcast, so texts stay where they are; more are merged
    return rows.join(by_count(gone, 2_000_000), "row", "left_anti").select("doc.*")


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by the names of their kinds.

    Null texts stay null, empty ones empty; whole texts are scanned; repeated rows and ties of place come
    out alike. Other columns are carried, but for ``n_chars``, which counts the new text. Empty table:
    empty result.
    """
    return secrets.redacted_docs(docs, secrets.chain_of(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens, one row per piece.

    Null and empty texts are the closing id alone; texts beyond 2048 tokens are cut; repeated rows are
    packed each. Other columns are not read. Empty table: empty result.
    """
    return packing.pack_documents(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("secret_scans", secret_scan_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained model decides in two stages, which SQL cannot express; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
