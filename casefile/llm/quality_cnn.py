"""Byte-level convolutional quality classifier, in numpy.

A text's UTF-8 bytes are embedded, and learned filters slide over overlapping chunks that cover
all of it. Each filter is max-pooled within a chunk; the mean and the maximum over the chunks make
the document's vector, which a logistic layer turns into one probability. Only the fit is bounded:
it takes at most ``max_rows`` labelled rows, and no more of them than have ``MAX_BYTES`` in all;
their texts are whole. Scores always read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile.llm.batches import sliced, text_in, tidy, whole
from casefile.llm.store import sample_by_hash

#: Bounds of the sample that is learned from: rows, and bytes of all their texts. A text of over a quarter of that is left out.
MAX_ROWS, MAX_BYTES = 2000, 16 << 20


@dataclass(frozen=True)
class Shape:
    embed: int = 4
    width: int = 8
    filters: int = 16
    stride: int = 2  # bytes; filters are an even number of bytes wide
    cell: int = 32  # positions in a cell; a chunk is `chunk` cells, the next starts `step` cells later
    chunk: int = 4
    step: int = 3


@dataclass
class Model:
    shape: Shape
    embed: np.ndarray  # 256 x embed
    conv: np.ndarray  # width * embed x filters
    bias: np.ndarray  # filters
    dense: np.ndarray  # 2 * filters
    offset: float


def _positions(data: bytes, s: Shape) -> np.ndarray:
    """Bytes under the filter at each of its positions; short texts are padded with zero bytes."""
    x = np.frombuffer(data, np.uint8)
    short = s.width - len(x)
    x = np.pad(x, (0, short if short > 0 else (-(len(x) - s.width)) % s.stride))
    return np.lib.stride_tricks.sliding_window_view(x, s.width)[:: s.stride]


def _chunk_starts(cells: int, s: Shape) -> np.ndarray:
    """First cells of the chunks: the last chunk is the first to reach the end."""
    return np.arange(0, max(1, cells - s.chunk + s.step), s.step)


class Scorer:
    """A model with its filters unrolled into one table per byte pair under the filter."""

    def __init__(self, m: Model):
        s, code = m.shape, np.arange(65536)
        self.m = m
        self.tables = []
        for j in range(0, s.width, 2):
            lo, hi = m.conv[j * s.embed : (j + 1) * s.embed], m.conv[(j + 1) * s.embed : (j + 2) * s.embed]
            self.tables.append((m.embed @ lo)[code & 255] + (m.embed @ hi)[code >> 8])  # little-endian pairs
        self.tables[0] += m.bias

    def _cells(self, pairs: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each cell, not below 0."""
        s, w = self.m.shape, self.m.shape.width // 2
        n = len(pairs) - w + 1
        out = np.zeros((-(-n // s.cell) * s.cell, s.filters), np.float32)  # zeros pad: the maximum is rectified anyway
        np.take(self.tables[0], pairs[:n], axis=0, out=out[:n], mode="clip")
        for j in range(1, w):
            out[:n] += self.tables[j][pairs[j : j + n]]
        out, half = out.reshape(-1, s.cell * s.filters), s.cell
        while half > 1:
            half //= 2
            out = np.maximum(out[:, : half * s.filters], out[:, half * s.filters :])
        return np.maximum(out, 0)

    def __call__(self, text: str | None, block: int = 1 << 14) -> float:
        """Probability of label 1, from all bytes of the text; null and empty texts score as one window of zeros."""
        s, data = self.m.shape, (text or "").encode("utf-8", "surrogatepass")
        data += bytes(max(s.width - len(data), len(data) & 1))
        pairs, w = np.frombuffer(data, "<u2"), s.width // 2
        n = len(pairs) - w + 1
        cells = np.concatenate([self._cells(pairs[lo : lo + block + w - 1]) for lo in range(0, n, block)])
        starts = _chunk_starts(len(cells), s)
        pool = cells[starts]
        for k in range(1, s.chunk):
            np.maximum(pool, cells[np.minimum(starts + k, len(cells) - 1)], out=pool)
        z = float(np.concatenate([pool.mean(axis=0, dtype=np.float64), pool.max(axis=0)]) @ self.m.dense + self.m.offset)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fitted(texts: list[bytes], labels: list[int], shape: Shape | None = None, epochs: int = 8, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the logistic loss. Fixed seed: equal input, equal model."""
    s, rng = shape or Shape(), np.random.default_rng(seed)
    f32 = np.float32
    m = Model(
        s, rng.normal(0, 0.5, (256, s.embed)).astype(f32), rng.normal(0, 0.25, (s.width * s.embed, s.filters)).astype(f32),
        np.zeros(s.filters, f32), np.zeros(2 * s.filters, f32), 0.0,
    )
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart: the smoothed share of label 1
        m.offset = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return m
    params = [m.embed, m.conv, m.bias, m.dense, np.zeros(1, f32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    windows = [_positions(t, s) for t in texts]
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 32):
            grads = [np.zeros(p.shape) for p in params]
            for d in order[at : at + 32]:
                pos = windows[d]
                resp = m.embed[pos].reshape(len(pos), -1) @ m.conv + m.bias
                starts = _chunk_starts(-(-len(pos) // s.cell), s) * s.cell
                arg = np.stack([a + resp[a : a + s.chunk * s.cell].argmax(axis=0) for a in starts])
                raw = np.take_along_axis(resp, arg, axis=0)
                pool = np.maximum(raw, 0)
                top, n = pool.argmax(axis=0), len(starts)
                vec = np.concatenate([pool.mean(axis=0), pool.max(axis=0)])
                z = float(vec @ m.dense + params[4][0])
                dz = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[d]) / 32
                grads[3] += dz * vec
                grads[4][0] += dz
                dpool = np.tile(dz * m.dense[: s.filters] / n, (n, 1))
                dpool[top, np.arange(s.filters)] += dz * m.dense[s.filters :]
                dpool *= raw > 0
                under = pos[arg]  # chunks x filters x width
                seen = m.embed[under].reshape(n, s.filters, -1)
                grads[1] += np.einsum("nf,nfk->kf", dpool, seen)
                grads[2] += dpool.sum(axis=0)
                back = np.einsum("nf,kf->nfk", dpool, m.conv).reshape(-1, s.embed)
                for e in range(s.embed):
                    grads[0][:, e] += np.bincount(under.ravel(), back[:, e], 256)
            step += 1
            lr = rate * (1 - 0.9 * epoch / epochs)
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                if p is params[3]:
                    g = g + 1e-4 * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(f32)
    m.offset = float(params[4][0])
    return m


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> tuple[list[bytes], list[int]]:
    """At most ``max_rows`` labelled rows that differ, the first by a hash, with their whole texts.

    ``labels`` holds ``id`` and ``label`` (0, 1); null and other labels are ignored.
    """
    known = labels.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull()).select("id", F.col("label").cast("int").alias("label"))
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.octet_length(text).alias("size")).filter(F.col("size") <= MAX_BYTES // 4)
    # the ids are chosen first, so no text is shuffled or sorted
    chosen = sample_by_hash(known, ["id", "label"], max_rows)
    if not chosen:
        return [], []
    own = docs.sparkSession.createDataFrame([(r.id, r.label) for r in chosen], "id long, label int")
    found = sample_by_hash(rows.join(F.broadcast(own), "id"), ["id", "label", "t"], max_rows, size_col="size", most_bytes=MAX_BYTES)
    found.sort(key=lambda r: (r.id, r.label, bytes(r.t)))
    return [bytes(r.t) for r in found], [r.label for r in found]


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carried: bool = False) -> DataFrame:
    """``(id, score)`` for every row of ``docs``; if ``carried``, also ``doc``, the row's columns as a struct.
    The model (a few kB) travels with the tasks."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(docs) if carried else F.col(text_col).cast("string").alias("t"))
    at = docs.columns.index(text_col) if carried else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in sliced(batches):
            p = pa.array([score(t) for t in text_in(batch.column(1), at)], pa.float64())
            keep = [0, 1] if carried else [0]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), p], names=[*(batch.schema.names[i] for i in keep), "score"])

    return rows.mapInArrow(tidy(each), T.StructType([f for f in rows.schema if f.name != "t"] + [T.StructField("score", T.DoubleType())]))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, learn_from: DataFrame | None = None, carried: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``held_out``, ``score``, ``predicted`` (1 if score >= 0.5);
    if ``carried``, also ``doc``, the row's columns as a struct.

    The labelled texts are those of ``learn_from``, or of ``docs`` where it is not given.
    Rows whose crc32(id) leaves 1 modulo 3 are never learned from. Without labels of both classes
    every text gets the same score. Null ids are scored, and count as not held out; repeated rows
    each keep a row; other columns are not read. Empty table: empty result.
    """
    texts = docs if learn_from is None else learn_from
    model = fitted(*training_rows(texts.filter(~held_out(id_col)), labels.filter(~held_out("id")), id_col, text_col, max_rows))
    p = scored(docs, model, id_col, text_col, carried)
    return p.select("id", F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *["doc"] * carried)


def kept_docs(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with a score of one half or more, with their columns: one narrow pass."""
    return quality_scores(docs, labels, carried=True, **options).filter("predicted = 1").select("doc.*")
