"""Tables that cut lineage, written to the folder all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where it is unset (tests, local
mode) a temporary folder of this process takes its place.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_noting: list[list[DataFrame]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; a private temporary one where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        path = tempfile.mkdtemp(prefix="casefile-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own["dir"] = "file://" + path
    return _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: later readers never recompute what made it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._casefile_path = path
    for made in _noting:
        made.append(out)
    return out


@contextmanager
def cleared(keep: list[DataFrame]) -> Iterator[None]:
    """Tables written meanwhile are deleted at the end, but for those that stand in ``keep`` by then: what
    is kept must have been written, not be read from the others."""
    made: list[DataFrame] = []
    _noting.append(made)
    try:
        yield
    finally:
        _noting.pop()
    for df in made:
        if not any(df is k for k in keep):
            dropped(df)


def by_count(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` hinted for a join: broadcast where it has at most ``most`` rows (of a few numbers and a
    path each, some 20 MB), merged beyond. Files of repetitive rows are small, so their size is no guide."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def sample_by_hash(df: DataFrame, keys: list[str], most: int, seed: int = 5, size_col: str | None = None, most_bytes: int | None = None) -> list[Row]:
    """At most ``most`` rows of ``df`` that differ in ``keys``, the first by a hash of those, on the driver; with
    ``size_col``, about ``most_bytes`` of it in all. A threshold on the hash, from the number of different keys, bounds
    what tasks send, too: about ``most`` rows and a quarter over all of them, however many tasks there
    are and however often a key repeats."""
    rows = df.withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    mean = F.avg(size_col) if size_col else F.lit(0.0)
    n, each = rows.agg(F.approx_count_distinct("_h", 0.02), mean).first()
    share = (1.25 * most + 50) / max(n, 1)
    if most_bytes and each:
        share = min(share, most_bytes / (n * each))
    part = F.pmod(F.col("_h"), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))
    return rows.filter(part).dropDuplicates(["_h"]).orderBy("_h").limit(most).collect()


def deleted(spark: SparkSession, path: str) -> None:
    """Delete what stands under ``path`` in the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_casefile_path", None)
    if path:
        deleted(df.sparkSession, path)
