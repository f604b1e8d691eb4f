"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into segments. Two fingerprints that differ in at most ``t`` bits
differ in at most ``t // segments`` bits of some segment. For each segment a covering code is the
set of anchors: a Hamming code on the first 2**r - 1 bits, every pattern on the rest, so each
value lies within one bit, the covering radius, of its home anchor. Replicating one member of a
pair to its home and the other to all anchors within radius plus threshold makes every near pair
meet. So does replicating both to all anchors within radius plus half the threshold: the anchor
that covers the point half way between them is that near to both. The second takes a tenth of
the replicas (33 a fingerprint, not 343), so it is what is done here. The exact distance is
tested inside the join, anchor by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.batches import tidy
from casefile.llm.graph import components
from casefile.llm.store import written

SHINGLE_WORDS = 4
MAX_BITS = 4
SEGMENTS = 2


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = 42) -> bytes:
    """Eight bytes, most significant first; no words (or a null text): zero."""
    return _marks(text, words, seed)[0]


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """Eight bytes, most significant first, for every shingle in order; no words (or a null text): none."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and split know ASCII only
    if not data:
        return np.empty((0, 8), np.uint8)
    joined, n = b" ".join(data), max(1, len(data) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[-n:] - 1).tolist()
    pieces = map(joined.__getitem__, map(slice, starts, stops))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, pieces, repeat(seed))), np.uint8).reshape(n, 8)


def majority(h: np.ndarray) -> bytes:
    """The fingerprint of shingle hashes: a bit is 1 if set in over half of them; of none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # a very long text is counted in slices
        ones += np.unpackbits(h[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def _marks(text: str | None, words: int, seed: int = 42, sketch: int = 0) -> tuple[bytes, bytes]:
    """The fingerprint, and the ``sketch`` smallest different shingle hashes."""
    h = shingle_hashes(text, words, seed)
    low = np.unique(h.view(">u8").ravel())[:sketch].astype("<u8").tobytes() if sketch and len(h) else b""
    return majority(h), low


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, sketch: int = 0) -> DataFrame:
    """``(id, fp, sketch)`` for every row; fp is the fingerprint's bit pattern as a signed long, sketch
    the smallest shingle hashes (empty where none are asked for)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_marks(t, words, sketch=sketch) for t in batch.column(1).to_pylist()]
            fps = np.frombuffer(b"".join(m[0] for m in marks), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array([m[1] for m in marks], pa.binary())], names=["id", "fp", "sketch"])

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return ids.mapInArrow(tidy(each), "id long, fp long, sketch binary")


@cache
def _error_patterns(r: int, reach: int) -> dict[int, list[tuple[int, int]]]:
    """By syndrome of the Hamming code of length 2**r - 1: the error patterns of at most ``reach``
    bits with that syndrome, each with its weight. Bit i of a pattern has column i + 1."""
    out: dict[int, list[tuple[int, int]]] = {s: [] for s in range(1 << r)}
    n = (1 << r) - 1
    for weight in range(reach + 1):
        for bits in combinations(range(n), weight):
            s = e = 0
            for i in bits:
                s, e = s ^ (i + 1), e | 1 << i
            out[s].append((e, weight))
    return out


@cache
def _plan(segments: int, max_bits: int) -> list[tuple[int, int, int, int]]:
    """Per segment: first bit, width, Hamming parameter r, segment threshold."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(lo, hi - lo, (hi - lo + 1).bit_length() - 1, max_bits // segments) for lo, hi in zip(edges, edges[1:], strict=False)]


def _syndromes(x: np.ndarray, r: int) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for bit in range(r):
        mask = sum(1 << i for i in range((1 << r) - 1) if (i + 1) >> bit & 1)
        s |= (np.bitwise_count(x & np.uint64(mask)).astype(np.int64) & 1) << bit
    return s


def anchors(values: np.ndarray, r: int, width: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the value, anchor) for all anchors within ``near`` bits of each value."""
    n = (1 << r) - 1
    s, table = _syndromes(values, r), _error_patterns(r, near)
    rows, out = [], []
    for syndrome in np.unique(s):
        own = np.flatnonzero(s == syndrome)
        masks = []
        for e, weight in table[int(syndrome)]:
            for extra in range(near - weight + 1):
                masks += [e | sum(1 << n + i for i in bits) for bits in combinations(range(width - n), extra)]
        masks = np.array(masks, np.uint64)
        rows.append(np.repeat(own, len(masks)))
        out.append((values[own][:, None] ^ masks[None, :]).ravel())
    return (np.concatenate(rows), np.concatenate(out)) if rows else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _stand(batches: Iterator[pa.RecordBatch], segments: int, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Every fingerprint at all anchors within covering radius plus half the threshold, segment by
    segment. ``turn``: the bit, if any, that leads from the value to its home; ``home``: this is its home."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False)
            for k, (first, width, r, t) in enumerate(_plan(segments, max_bits)):
                part = (fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << width) - 1)
                s = _syndromes(part, r)
                turn = np.where(s > 0, np.uint64(1) << (np.maximum(s, 1) - 1).astype(np.uint64), np.uint64(0))
                rows, at = anchors(part, r, width, 1 + (t + 1) // 2)
                home = at == (part ^ turn)[rows]
                key = (at | np.uint64(k << 60)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(fp[rows]), pa.array((turn << np.uint64(first)).view(np.int64)[rows]), pa.array(home)], names=["anchor", "fp", "turn", "home"]
                )


def links(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """``(a, b)`` with a < b: all pairs of the different values in ``distinct.fp`` that differ in at
    most ``max_bits`` bits. ``segments`` changes cost only, never the pairs."""
    seats = distinct.select("fp").mapInArrow(lambda b: _stand(b, segments, max_bits), "anchor long, fp long, turn long, home boolean")
    x, y = seats.select("anchor", F.col("fp").alias("a"), "turn", "home"), seats.select(F.col("anchor").alias("there"), F.col("fp").alias("b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(apart) <= max_bits)
    # a pair that can meet at the home of its smaller member meets there only
    away, k = F.lit(False), F.shiftrightunsigned("anchor", 60)
    for i, (first, width, _, t) in enumerate(_plan(segments, max_bits)):
        mask = ((1 << width) - 1) << first
        from_home = F.bit_count(apart.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).bitwiseXOR(F.col("turn")))
        away = away | ((k == i) & (from_home > 1 + (t + 1) // 2))
    # merged, never broadcast: the planner takes the replicas' size for that of the file under them
    met = x.hint("merge").join(y, (F.col("anchor") == F.col("there")) & near & (F.col("home") | away))
    return met.select("a", "b").distinct()


def _alike(batches: Iterator[pa.RecordBatch], least: float, size: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches show a Jaccard similarity of at least ``least``: among the smallest
    hashes of both texts together, the share that both have. Exact up to ``size`` different shingles."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            union = np.union1d(a, b)[:size]
            both = np.intersect1d(a, b, assume_unique=True)
            keep.append(len(union) == 0 or np.isin(both, union, assume_unique=True).sum() >= least * len(union))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, segments: int = SEGMENTS,
    words: int = SHINGLE_WORDS, similarity: float | None = None, sketch: int = 192,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fp``, ``component_id`` (smallest id reachable by links).

    With ``similarity``, fingerprints that differ link only if their texts' shingles are that alike
    (Jaccard, from sketches of bounded size), so ``max_bits`` may be wide without joining strangers.
    Null and word-less texts have fingerprint zero and are linked like others. Equal fingerprints
    are one node, so copies never become pairs. Repeated ids each keep a row; a null id has a
    fingerprint, and names a component only if no other member has an id. Other columns of ``docs``
    are not read. Empty table: empty result.
    """
    marked = written(fingerprints(docs, id_col, text_col, words, sketch if similarity else 0), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("id").alias("low"), F.min("sketch").alias("sketch")), "nodes")
    near = links(nodes, max_bits, segments)
    if similarity:
        a, b = (nodes.select(F.col("fp").alias(x), F.col("sketch").alias(f"s_{x}")) for x in "ab")
        near = near.join(a, "a").join(b, "b").select("a", "b", "s_a", "s_b").mapInArrow(lambda x: _alike(x, similarity, sketch), "a long, b long")
    roots = components(near, "a", "b").select(F.col("node").alias("fp"), "root")
    grouped = written(nodes.drop("sketch").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "grouped")
    lowest = written(grouped.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")  # the join below can then split a large component
    by_fp = grouped.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return marked.select("id", "fp").join(by_fp, "fp").select("id", "fp", "component_id")
