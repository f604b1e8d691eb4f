"""Nearest rows of a block of queries among a part of the rows, by matrix products; the distances that decide are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds allow for rounding, relative to the squared lengths of both vectors (their parts may be single-precision).
SLACK = 1e-6


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat values, start of each row, its length); length -1: a null vector, or one with a null part."""
    c = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = c.flatten()
    start = np.cumsum(size) - size
    missing = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    bad = c.is_null().to_numpy(zero_copy_only=False) | (missing[start + size] > missing[start])
    return pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), start, np.where(bad, -1, size)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed up part by part as the column expression does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        gap = (a[:, j] - b[:, j]).astype(np.float64)
        out += gap * gap
    return out


def _first(q: np.ndarray, d: np.ndarray, away: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of each query by distance (NaN last), then id."""
    order = np.lexsort((rank[d], away, q))
    q, d, away = q[order], d[order], away[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], d[place < k], away[place < k]


def _nearest(asked: np.ndarray, rows: np.ndarray, rank: np.ndarray, k: int, step: int = 2048, most: np.ndarray | None = None, origin: np.ndarray | float = 0.0) -> tuple[np.ndarray, ...]:
    """(query, row, distance) of the ``k`` nearest of all ``asked``. Each step keeps what may be nearer than the k-th so far.
    ``most``: a squared distance for each query beyond which nothing is sought; ``origin``: a point near all, for sharper bounds."""
    q64 = asked.astype(np.float64) - origin
    most = np.full(len(asked), np.inf) if most is None else most
    reach, far = most, 1e-14 * np.abs(origin).max()
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    with np.errstate(invalid="ignore", over="ignore"):
        q_size = (q64**2).sum(axis=1)
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step].astype(np.float64) - origin
            size = (part**2).sum(axis=1)
            near = q_size[:, None] + size - 2 * q64 @ part.T
            if lo == 0 and len(part) >= k and not np.isfinite(most).all():
                reach = np.fmin(most, np.partition(near, k - 1, axis=1)[:, k - 1])
            bound = reach + 2 * SLACK * (q_size + size.max()) + far * np.sqrt(q_size + size.max())
            q, d = np.nonzero((near <= np.where(np.isfinite(bound), bound, np.inf)[:, None]) | ~np.isfinite(near))
            d += lo
            found = q, d, _exact(asked[q], rows[d])
            best = _first(*(np.concatenate(p) for p in zip(best, found, strict=True)), rank, k)
            n = np.bincount(best[0], minlength=len(asked))
            last = np.cumsum(n)[n >= k] - 1
            reach = most.copy()
            reach[n >= k] = np.fmin(reach[n >= k], best[2][last])
    return best


def nearest(queries: pa.Table, rows: pa.Table, k: int, step: int = 1024) -> pa.Table:
    """``(query_id, id, distance)`` of ``queries`` (query_id, qv) among ``rows`` (id, dv). Vectors of different lengths, null
    ones and those with null parts are at a null distance from each other, which is the farthest."""
    (q_flat, q_start, q_len), (d_flat, d_start, d_len) = _vectors(queries["qv"]), _vectors(rows["dv"])
    rank = np.empty(len(d_len), np.int64)
    order = pc.sort_indices(rows["id"].combine_chunks(), null_placement="at_start").to_numpy()
    rank[order] = np.arange(len(order))
    q, d, away, known = [], [], [], []
    for length in np.unique(q_len):
        asked, same = np.flatnonzero(q_len == length), np.flatnonzero((d_len == length) & (length >= 0))
        at = np.arange(max(length, 0))
        if len(same):
            of = d_flat[d_start[same][:, None] + at]
            for lo in range(0, len(asked), step):
                own = asked[lo : lo + step]
                a, b, c = _nearest(q_flat[q_start[own][:, None] + at], of, rank[same], k)
                q, d, away, known = [*q, own[a]], [*d, same[b]], [*away, c], [*known, np.ones(len(a), bool)]
        far = np.flatnonzero((d_len != length) | (length < 0))
        far = far[np.argsort(rank[far])][:k]
        q, d = [*q, np.repeat(asked, len(far))], [*d, np.tile(far, len(asked))]
        away, known = [*away, np.zeros(len(asked) * len(far))], [*known, np.zeros(len(asked) * len(far), bool)]
    joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    q, d, away, known = joined(q, np.int64), joined(d, np.int64), joined(away, np.float64), joined(known, bool)
    return pa.table({"query_id": queries["query_id"].take(pa.array(q)), "id": rows["id"].take(pa.array(d)), "distance": pa.array(away, mask=~known)})


def within(queries: pa.Table, rows: pa.Table, k: int, step: int = 1024) -> pa.Table:
    """``(query_id, id, distance)`` of ``queries`` (query_id, qv, reach) among ``rows`` (id, vector), no farther than ``reach``. All vectors
    are of one length, without missing parts."""
    q, d, away = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if queries.num_rows and rows.num_rows:
        flat = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        asked, of, reach = flat(queries["qv"]), flat(rows["vector"]), queries["reach"].to_numpy()
        most, rank = (reach * (1 + SLACK) + SLACK) ** 2, np.empty(len(of), np.int64)
        rank[pc.sort_indices(rows["id"].combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(len(of))
        for lo in range(0, len(asked), step):
            a, b, c = _nearest(asked[lo : lo + step], of, rank, k, most=most[lo : lo + step], origin=of.mean(axis=0))
            inside = c <= most[lo + a]
            q, d, away = [*q, lo + a[inside]], [*d, b[inside]], [*away, c[inside]]
    q, d = pa.array(np.concatenate(q)), pa.array(np.concatenate(d))
    return pa.table({"query_id": queries["query_id"].take(q), "id": rows["id"].take(d), "distance": np.concatenate(away)})
