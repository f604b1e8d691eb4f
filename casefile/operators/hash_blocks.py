"""Hashes of two blocks of rows that are near each other, by exclusive or and counted bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def near(left: pa.Table, right: pa.Table, most: int, step: int = 64) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """(rows of ``left``, rows of ``right``, distance) of all pairs with ``hash`` within ``most`` bits; none is null. A step's
    distances fit a core's cache."""
    a, b = (t["hash"].to_numpy().view(np.uint64) for t in (left, right))
    at, of, away = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
    for lo in range(0, len(a), step):
        distance = np.bitwise_count(a[lo : lo + step, None] ^ b)
        i, j = np.nonzero(distance <= most)
        at.append((lo + i).astype(np.int32))
        of.append(j.astype(np.int32))
        away.append(distance[i, j])
    return left.take(pa.array(np.concatenate(at))), right.take(pa.array(np.concatenate(of))), np.concatenate(away)
