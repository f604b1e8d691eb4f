"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors, cosine >= c is squared distance <= 2 - 2c. A fixed rotation spreads each vector's
length over all axes; the rotated vector is cut into blocks of few dimensions, and each block gets
a part of the squared distance in proportion to its dimensions. A linked pair keeps within the
part in at least one block. Each block is range-joined: its leading coordinates make a grid with
cells twice the block's radius wide, and a vector stands in all cells that half the radius reaches
into, so a pair meets in the cell of the point half way between its members.

First only the blocks meet, in 16-bit fixed point with the rounding added to the budget: they tell
which vectors have a candidate in a cell. Then whole vectors follow to those cells alone, and the
union of candidates is verified there in double precision. A pair is taken in the first block whose
part it keeps within, at the cell of its middle, so it counts once. Tasks return link counts and
star edges, a number linear in their vectors, never the pairs. Equal vectors are one node with a
count. Crowded cells are split into chunks that meet pairwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile.llm.graph import components
from casefile.llm.store import dropped, written

COSINE = 0.93
BLOCK_DIMS, GRID_DIMS, CHUNK = 16, 2, 4096
_SLACK = 1e-6
#: Steps of the fixed point numbers for coordinates from -1 to 1.
_STEPS = 32000


@cache
def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def _blocks(dim: int) -> list[tuple[int, int]]:
    n = max(1, round(dim / BLOCK_DIMS))
    edges = [dim * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=-1, keepdims=True)  # no overflow or underflow in the norm
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _turned(u: np.ndarray) -> np.ndarray:
    """Rotated rows; each row's sums are its own, so a vector comes out alike in every batch."""
    turn, out = _rotation(u.shape[1]), np.empty_like(u)
    step = max(1, (1 << 22) // u.shape[1] ** 2)
    for at in range(0, len(u), step):
        out[at : at + step] = (u[at : at + step, None, :] * turn).sum(axis=2)
    return out


def _budget(dim: int, lo: int, hi: int, cosine: float) -> float:
    return max(0.0, 2 - 2 * cosine) * (hi - lo) / dim + _SLACK


def _keyed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(id, label, key, vec): vec and key are null for rows that link with nothing."""
    for batch in batches:
        ids, labels, lists = batch.columns
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        values = np.asarray(pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False), kind) + np.dtype(kind).type(0)  # no negative zeros
        starts = np.concatenate(([0], np.cumsum(sizes)))
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
        some = np.concatenate(([0], np.cumsum(values != 0)))
        good = (sizes > 0) & (bad[starts[1:]] == bad[starts[:-1]]) & (some[starts[1:]] > some[starts[:-1]])
        good &= ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
        vecs = [values[a:b].tobytes() if ok else None for a, b, ok in zip(starts, starts[1:], good, strict=False)]
        keys = [v and hashlib.md5(v, usedforsecurity=False).digest() for v in vecs]
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "label", "key", "vec"])


_SEATS = "label string, dim int, spot long, node long, q binary"


def _spot(block: int, cells: np.ndarray) -> np.ndarray:
    """A block and up to two cell numbers (below 2**23 in size) as one number."""
    out = np.full(len(cells), block, np.int64)
    for k in range(GRID_DIMS):
        out = out << 24 | (cells[:, k] + (1 << 23) if k < cells.shape[1] else 0)
    return out


def _seated(batches: Iterator[pa.RecordBatch], cosine: float, kind: str, whole: bool) -> Iterator[pa.RecordBatch]:
    """Each node in every block's cells that half the radius reaches into; ``whole``: with the block's numbers."""
    for batch in batches:
        size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
        for dim in np.unique(size).tolist():
            own = batch.take(pa.array(np.flatnonzero(size == dim)))
            x = _turned(_unit(np.frombuffer(b"".join(own.column(2).to_pylist()), kind).reshape(-1, dim)))
            for b, (lo, hi) in enumerate(_blocks(dim)):
                r = np.sqrt(_budget(dim, lo, hi, cosine))
                lead = x[:, lo : min(hi, lo + GRID_DIMS)]
                low, high = (np.floor((lead + side * (r / 2 + _SLACK)) / (2 * r)).astype(np.int64) for side in (-1, 1))
                q = np.round(x[:, lo:hi] * _STEPS).astype("<i2")
                for turn in product((0, 1), repeat=lead.shape[1]):  # a reach of one radius spans two cells at most
                    at = np.where(turn, high, low)
                    new = np.flatnonzero(((low != high) | (np.array(turn) == 0)).all(axis=1))
                    numbers = pa.array([row.tobytes() for row in q[new]] if whole else [None] * len(new), pa.binary())
                    picked = own.take(pa.array(new))
                    yield pa.RecordBatch.from_arrays([picked.column(0), pa.array(np.full(len(new), dim), pa.int32()), pa.array(_spot(b, at[new])), picked.column(1), numbers], names=["label", "dim", "spot", "node", "q"])


def _sides(part: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows to compare with one another: of one chunk, or of two. The left ones in slices."""
    left, right = (np.flatnonzero(part == k) for k in (i, j))
    for at in range(0, len(left), 512):
        yield left[at : at + 512], right


def _candidates(group: pa.Table, cosine: float) -> pa.Table:
    """The nodes of a cell whose block is near another node's."""
    dim, spot, i, j = (group.column(c)[0].as_py() for c in ("dim", "spot", "i", "j"))
    lo, hi = _blocks(dim)[spot >> 24 * GRID_DIMS]
    q = np.frombuffer(b"".join(group.column("q").to_pylist()), "<i2").reshape(-1, hi - lo)
    x = (q / np.float32(_STEPS)).astype(np.float32)
    square = (x * x).sum(axis=1)
    far = (np.sqrt(_budget(dim, lo, hi, cosine)) + np.sqrt(hi - lo) / _STEPS) ** 2 + 1e-5  # rounding of both, and of single precision
    part, hit = group.column("part").to_numpy(), np.zeros(len(q), bool)
    for a, b in _sides(part, i, j):
        near = square[a][:, None] + square[b] - 2 * (x[a] @ x[b].T) <= far
        if i == j:
            near[np.arange(len(a)), np.searchsorted(b, a)] = False
        hit[a] |= near.any(axis=1)
        hit[b] |= near.any(axis=0)
    return group.filter(pa.array(hit)).select(["label", "dim", "spot", "i", "j", "part", "node"])


_FOUND = pa.schema([("edge", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])


def _linked(group: pa.Table, cosine: float, kind: str) -> pa.Table:
    """(edge, a, b): star edges of what is linked here, and for each node the vectors it is linked to."""
    dim, spot, i, j = (group.column(c)[0].as_py() for c in ("dim", "spot", "i", "j"))
    block, spans = spot >> 24 * GRID_DIMS, _blocks(dim)
    u = _unit(np.frombuffer(b"".join(group.column("vec").to_pylist()), kind).reshape(-1, dim))
    x = _turned(u)
    lo, hi = spans[block]
    budget = [_budget(dim, *s, cosine) for s in spans]
    wide, grid = 2 * np.sqrt(budget[block]), slice(lo, min(hi, lo + GRID_DIMS))
    node, n, part = (group.column(c).to_numpy() for c in ("node", "n", "part"))
    p_all, q_all, counts = [], [], np.zeros(len(node))
    root = np.arange(len(node))
    for left, right in _sides(part, i, j):
        a, b = np.nonzero(u[left] @ u[right].T >= cosine - 1e-9)
        a, b = left[a], right[b]
        own = a < b if i == j else np.ones(len(a), bool)
        a, b = a[own], b[own]
        for at in range(0, len(a), 1 << 16):
            p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            keep = np.einsum("ij,ij->i", u[p], u[q]) >= cosine
            keep &= (_spot(block, np.floor((x[p][:, grid] + x[q][:, grid]) / 2 / wide).astype(np.int64)) == spot)
            p, q = p[keep], q[keep]
            gap = (x[p] - x[q]) ** 2
            keep = gap[:, lo:hi].sum(axis=1) <= budget[block]
            for k in range(block):  # a pair of an earlier block is that block's
                keep &= gap[:, slice(*spans[k])].sum(axis=1) > budget[k]
            p, q = p[keep], q[keep]
            counts += np.bincount(p, n[q], len(node)) + np.bincount(q, n[p], len(node))
            new = root[p] != root[q]  # only edges that may still join something are kept
            p_all.append(p[new])
            q_all.append(q[new])
            if sum(map(len, p_all)) > 4 * len(node):
                root = _roots(root, np.concatenate(p_all), np.concatenate(q_all))
                p_all, q_all = [], []
    if p_all:
        root = _roots(root, np.concatenate(p_all), np.concatenate(q_all))
    moved, some = root != np.arange(len(node)), np.flatnonzero(counts)
    edge = np.repeat([True, False], [moved.sum(), len(some)])
    a, b = np.concatenate([node[moved], node[some]]), np.concatenate([node[root[moved]], counts[some].astype(np.int64)])
    return pa.Table.from_arrays([pa.array(edge), pa.array(a), pa.array(b)], schema=_FOUND)


def _roots(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Components with further edges: the smaller root wins, then roots are followed."""
    while True:
        low, after = np.minimum(root[p], root[q]), root.copy()
        for ends in (p, q):
            np.minimum.at(after, root[ends], low)
            np.minimum.at(after, ends, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: ``id, n_links, component_id, kept``.

    Vectors link when their labels are equal and their cosine in double precision is at least
    ``cosine`` (above 0). Null labels, ids and vectors, zero vectors and those with null or non-finite components link
    with nothing and are components of their own; so do vectors of different length. ``kept`` marks the smallest id of each
    component. Repeated rows count as vectors of their own. Vectors of any length are compared whole.
    Other columns are not read. Empty table: empty result.
    """
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind, numbers = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(numbers).alias("v"))
    rows = written(rows.mapInArrow(lambda b: _keyed(b, kind), "id long, label string, key binary, vec binary"), "vectors")
    # a vector travels once, to the node of its equals; ids and counts are joined by key
    nodes = rows.filter("key is not null").groupBy("label", "key").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    nodes = written(nodes, "nodes")
    place = ["label", "dim", "spot"]
    seats = lambda whole: nodes.select("label", "node", "vec").mapInArrow(lambda b: _seated(b, cosine, kind, whole), _SEATS)
    crowd = seats(False).groupBy(*place).agg(F.count("*").alias("here")).filter("here > 1")  # a vector alone in its cell has no pair there
    crowd = written(crowd.select(*place, F.ceil(F.col("here") / CHUNK).cast("int").alias("parts")), "cells")
    met = seats(True).join(crowd, place).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(*place, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "q")
    meeting = [*place, "i", "j"]
    near = met.groupBy(*meeting).applyInArrow(lambda g: _candidates(g, cosine), "label string, dim int, spot long, i int, j int, part int, node long")
    near = written(near, "near")
    whole = near.hint("merge").join(nodes.select("node", "n", "vec"), "node")
    found = written(whole.groupBy(*meeting).applyInArrow(lambda g: _linked(g, cosine, kind), "edge boolean, a long, b long"), "linked")
    dropped(near)
    dropped(crowd)
    roots = components(found.filter("edge"), "a", "b").select(F.col("node"), "root")
    counts = found.filter("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    per = nodes.select("label", "key", "node", "n").join(counts, "node", "left").join(roots, "node", "left")
    per = per.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    out = rows.drop("vec").join(per, ["label", "key"], "left")
    component = F.coalesce("root", "id")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
