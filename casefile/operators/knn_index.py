"""A stored index for exact nearest neighbours.

Rows lie in clusters around centers that a bounded sample gives. For each cluster the index keeps how many
rows it has and how near and far they are from the center. A search first probes the clusters nearest to a
query for a k-th distance, then visits only clusters that neither the triangle inequality nor the plane half way
to the query's own center can rule out. Near clusters are one cell of about ``CELL`` rows; the queries that visit a
cell meet it in tasks of bounded size, by matrix products. New rows are appended; nothing is rebuilt.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.operators import knn_blocks
from casefile.operators.numbering import spread
from casefile.sources.scratch import stored

#: Rows of the sample that gives the centers; most centers (their distances are a matrix on each executor).
SAMPLE, MOST_CENTERS = 16_384, 4_096
#: Rows of a cell and queries of a block, which meet in one task; rows that one task appends; most tasks of a shuffle.
CELL, BLOCK, APPENDED, MOST_TASKS = 16_384, 8_192, 65_536, 4_096
#: Bounds allow for rounding, relative to the distances compared; and that of squares, relative to the lengths of the vectors.
SLACK, ROUNDING = 1e-6, 1e-13


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _apart(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances of all rows to all centers."""
    square = (rows**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1) - 2 * rows @ centers.T
    return np.sqrt(np.maximum(square, 0))


def _fitted(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """``n`` centers of the sample: its first different rows, moved to the means of what is nearest."""
    centers = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])][:n]
    for _ in range(rounds):
        own = np.concatenate([_apart(sample[lo : lo + 2048], centers).argmin(axis=1) for lo in range(0, len(sample), 2048)])
        size = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, sample)
        centers = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centers)
    return centers


def _usable(vector: str):
    """Rows that can be indexed: a vector, without missing or non-finite parts."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            yield batch.slice(lo, 256)


def _sent(asked: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``asked`` (query_id, qv, reach) at every cell that ``chosen`` names for its vectors and reaches."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            row, cell = np.nonzero(chosen(_matrix(part.column("qv")), part.column("reach").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in part.columns), pa.array(cell.astype(np.int32))], [*part.schema.names, "cell"])

    kind = asked.schema["query_id"].dataType.simpleString()
    return asked.mapInArrow(send, f"query_id {kind}, qv array<double>, reach double, cell int")


def _near_order(points: np.ndarray) -> np.ndarray:
    """All points in an order in which neighbours are near: halves by the widest coordinate, and halves of these."""
    out, left = [], [np.arange(len(points))]
    while left:
        own = left.pop()
        if len(own) < 3:
            out.append(own)
            continue
        own = own[np.argsort(points[own, np.ptp(points[own], axis=0).argmax()], kind="stable")]
        left += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.concatenate(out)


@dataclass(frozen=True)
class _Cells:
    """Clusters with rows, put together to cells of about ``CELL`` rows; a larger cluster is a cell in several pieces."""

    centers: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    order: np.ndarray
    start: np.ndarray
    pieces: np.ndarray

    @classmethod
    def of(cls, centers: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> _Cells:
        used = np.flatnonzero(n > 0)
        order = used[_near_order(centers[used])] if len(used) else used
        start, size = [], []
        for i, c in enumerate(order):
            if not size or size[-1] + n[c] > CELL:
                start.append(i)
                size.append(0)
            size[-1] += int(n[c])
        return cls(centers, n, low, high, order, np.array(start, np.int64), -(-np.array(size, np.int64) // CELL))

    def probed(self, vectors: np.ndarray, k: int) -> np.ndarray:
        """Whether the clusters nearest to a query, as many as have ``k`` rows, stand in a cell."""
        away = np.where(self.n > 0, _apart(vectors, self.centers), np.inf)
        near = np.argsort(away, axis=1, kind="stable")
        full = np.cumsum(self.n[near], axis=1)
        mask = np.zeros(away.shape, bool)
        np.put_along_axis(mask, near, (full - self.n[near] < k) & (self.n[near] > 0), axis=1)
        return self.cells(mask)

    def visited(self, vectors: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which clusters can hold rows within reach, how near and how far from the center these are) for each query."""
        middle = self.centers.mean(axis=0)
        q, c, reach = vectors - middle, self.centers - middle, reach[:, None]
        q_size, c_size = (q**2).sum(axis=1)[:, None], (c**2).sum(axis=1)
        square = np.maximum(q_size + c_size - 2 * q @ c.T, 0)
        error = ROUNDING * (q_size + c_size + self.high**2 + np.abs(middle).max() ** 2 * 1e-3)
        least, most = np.sqrt(np.maximum(square - error, 0)), np.sqrt(square + error)
        room = np.where(np.isfinite(reach), reach + SLACK * (1 + reach + most), np.inf)
        near, far = least - room, most + room
        mask = (self.n > 0) & (near <= self.high) & (far >= self.low)
        # a row is as near to its own center as to the query's: it stands beyond the plane half way between them
        own = square.argmin(axis=1)
        between = np.sqrt(_apart(c[own], c) ** 2 + ROUNDING * (c_size[own][:, None] + c_size))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (square - square[np.arange(len(own)), own][:, None] - 8 * error.max(axis=1)[:, None]) / (2 * between)
        return mask & ~(np.isfinite(plane) & (plane > room)), near, far

    def cells(self, mask: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(mask[:, self.order], self.start, axis=1) if len(self.start) else mask[:, :0]


@dataclass(frozen=True)
class VectorIndex:
    """An index under ``path``: ``centers``, ``rows`` and ``sizes``; an append adds a batch to the latter two and reads only that."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, vector_col: str, path: str, clusters: int | None = None) -> VectorIndex:
        """Fit centers on at most ``SAMPLE`` rows (the first by a hash of the id) and index every row. By default as
        many clusters as the square root of the rows, at most ``MOST_CENTERS``. Without any usable row: ValueError."""
        rows = docs.filter(_usable(vector_col))
        n = rows.count()
        part = min(1.0, 1.2 * SAMPLE / max(n, 1))
        some = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(part * (1 << 30))).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
        sample = np.array([r[0] for r in some.select(F.col(vector_col).cast("array<double>")).collect()], np.float64)
        wanted = clusters or min(MOST_CENTERS, max(1, round(n**0.5)))
        if not len(sample):
            raise ValueError("no row has a vector that can be indexed")
        centers = _fitted(sample, wanted)
        spark = docs.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
        index = cls(spark, path)
        index.append(docs, id_col, vector_col)
        return index

    def centers(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/centers").orderBy("cluster").collect()
        return np.array([r.center for r in found], np.float64)

    def append(self, docs: DataFrame, id_col: str, vector_col: str) -> None:
        """Index more rows. Ids are not looked up: what stands there already is not replaced."""
        rows = docs.filter(_usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        centers = self.centers()

        middle = centers.mean(axis=0)
        c = centers - middle
        square = (c**2).sum(axis=1)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    vectors = _matrix(part.column("vector"))
                    near = (vectors - middle) @ (-2 * c.T)
                    near += square
                    own = near.argmin(axis=1)
                    away = np.sqrt(((vectors - centers[own]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(away)], ["id", "vector", "cluster", "away"])

        kind = rows.schema["id"].dataType.simpleString()
        batch = uuid.uuid4().hex
        spread(rows, "id", each=APPENDED).mapInArrow(place, f"id {kind}, vector array<double>, cluster int, away double").write.parquet(f"{self.path}/rows/{batch}")
        # the batch counts once its sizes stand: an append that fails before leaves nothing that a search reads
        own = self.spark.read.parquet(f"{self.path}/rows/{batch}").groupBy("cluster").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
        own.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")

    def rows(self) -> DataFrame:
        batches = [r.batch for r in self.spark.read.parquet(f"{self.path}/sizes").select("batch").distinct().collect()]
        if not batches:  # nothing but rows that cannot be indexed so far
            return self.spark.read.parquet(f"{self.path}/rows/*").limit(0)
        return self.spark.read.parquet(*(f"{self.path}/rows/{b}" for b in sorted(batches)))

    def _sizes(self, clusters: int) -> tuple[np.ndarray, ...]:
        n, low, high = np.zeros(clusters, np.int64), np.zeros(clusters), np.zeros(clusters)
        sizes = self.spark.read.parquet(f"{self.path}/sizes").groupBy("cluster").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        for r in sizes.collect():  # a row for each center
            n[r.cluster], low[r.cluster], high[r.cluster] = r.n, r.low, r.high
        return n, low, high

    def _cells(self) -> _Cells:
        centers = self.centers()
        return _Cells.of(centers, *self._sizes(len(centers)))

    def _compared(self, cells: _Cells, seen: DataFrame, k: int) -> DataFrame:
        """``(query_id, rank, id, distance)``: the ``k`` nearest rows of the cells in which a query is ``seen`` (query_id, qv, reach, cell)."""
        asked = {r["cell"]: r["count"] for r in seen.groupBy("cell").count().collect()}  # a number for each cell
        plan = [(i, int(p), -(-asked[i] // BLOCK)) for i, p in enumerate(cells.pieces) if i in asked]
        spark, tasks = self.spark, max(1, min(MOST_TASKS, sum(p * b for _, p, b in plan)))
        size = spark.createDataFrame(plan, "cell int, pieces int, blocks int")
        of = np.repeat(np.arange(len(cells.start)), np.diff(np.append(cells.start, len(cells.order))))
        cluster = spark.createDataFrame([(int(c), int(i)) for c, i in zip(cells.order, of, strict=True)], "cluster int, cell int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        q = seen.join(F.broadcast(size), "cell").select("query_id", "qv", "reach", "cell", own("query_id", "blocks").alias("block"), every("pieces").alias("piece"))
        d = self.rows().join(F.broadcast(cluster), "cluster").join(F.broadcast(size), "cell").select("id", "vector", "cell", own("id", "pieces").alias("piece"), every("blocks").alias("block"))
        schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {d.schema['id'].dataType.simpleString()}, distance double"
        dealt = lambda x: x.repartition(tasks, "cell", "piece", "block").groupBy("cell", "piece", "block")
        met = dealt(q).cogroup(dealt(d)).applyInArrow(lambda a, b: knn_blocks.within(a, b, k), schema)
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")

    def _bounded(self, cells: _Cells, queries: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
        """``(query_id, qv, reach)``. ``reach``: the k-th distance among probed rows, infinite if they are fewer."""
        asked = queries.filter(_usable(query_vector)).select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("qv"))
        asked = asked.withColumn("reach", F.lit(float("inf")))
        best = self._compared(cells, _sent(asked, lambda v, _: cells.probed(v, k)), k)
        reach = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.sqrt(F.max("distance"))).otherwise(float("inf")).alias("reach"))
        return stored(asked.drop("reach").join(reach, "query_id").select("query_id", "qv", "reach"), "reach")

    def search(self, queries: DataFrame, query_id: str, query_vector: str, k: int = 5) -> DataFrame:
        """``(query_id, rank, id, distance)``: exactly the ``k`` nearest rows by squared distance, ties by id, as all rows
        would give them. Queries and rows without a usable vector find nothing; ids of queries are unique."""
        cells = self._cells()
        asked = self._bounded(cells, queries, query_id, query_vector, k)
        return self._compared(cells, _sent(asked, lambda v, reach: cells.cells(cells.visited(v, reach)[0])), k)

    def visits(self, queries: DataFrame, query_id: str, query_vector: str, k: int = 5) -> DataFrame:
        """``(query_id, qv, reach, cluster, near, far)``: the rows that can be among the ``k`` nearest lie in these
        clusters, between ``near`` and ``far`` from the center. ``reach``: the k-th distance among probed rows."""
        cells = self._cells()
        asked = self._bounded(cells, queries, query_id, query_vector, k)

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                mask, near, far = cells.visited(_matrix(part.column("qv")), part.column("reach").to_numpy(zero_copy_only=False))
                row, own = np.nonzero(mask)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in part.columns), pa.array(own.astype(np.int32)), pa.array(near[mask]), pa.array(far[mask])], [*part.schema.names, "cluster", "near", "far"])

        kind = asked.schema["query_id"].dataType.simpleString()
        return asked.mapInArrow(visit, f"query_id {kind}, qv array<double>, reach double, cluster int, near double, far double")

    def _met(self, queries: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
        seen = self.visits(queries, query_id, query_vector, k).alias("q")
        return seen.join(self.rows().alias("r"), (F.col("q.cluster") == F.col("r.cluster")) & F.col("r.away").between(F.col("q.near"), F.col("q.far")))

    def visited_share(self, queries: DataFrame, query_id: str, query_vector: str, k: int = 5) -> float:
        """Pairs of query and row that the bounds cannot rule out, as a share of all; a search compares the rest of their cells, too."""
        met = self._met(queries, query_id, query_vector, k).count()
        return met / max(1, self.rows().count() * queries.filter(_usable(query_vector)).count())
