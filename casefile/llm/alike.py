"""Near copies by the similarity of their shingles, for whole corpora.

SimHash fingerprints and their anchors (``simhash``) propose pairs first, and so do hubs, nodes of
equal minimum hashes; what passes the test on whole sets links most of each group, with a number of
pairs linear in its texts. Fingerprints within a few bits alone would miss pairs near the limit: of
those of similarity 0.80 to 0.85, 4 % differ in four bits or fewer. So a prefix filter completes the links:
under any one order of all shingles, two sets of similarity 4/5 or more share ``c`` among the first
``n // 5 + c`` of each, and pairs that share fewer need no test; ``c`` grows with the sets, so a
passage in common makes no candidates. Pairs within one component are left out, as only components are asked for: so one node
of each prefix shingle is tested with the others at it first, which gathers most of what is still to be linked, and all pairs
meet only between the parts that are left. Where prefixes meet, parity bitmaps that travel with them drop what cannot be similar
inside the join, and so do the shingles before this one, at which a pair has met already; what passes is tested on whole sets.
The order puts shingles that several texts have last, the most frequent at the end, by counts over
a fixed share of all texts, so that how many texts meet at a shingle does not grow with their
number; it decides the cost and never the pairs. Texts with equal sets are one node. Parts of a group
that no link joins cost the product of their nodes, each pair a few rows however much it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casefile.llm.graph import components
from casefile.llm.simhash import links, majority, shingle_hashes
from casefile.llm.batches import sliced, tidy
from casefile.llm.store import by_count, dropped, written

WORDS = 5
#: Similarity P / Q.
P, Q = 4, 5
#: One text of so many is counted for the order of shingles; a shingle is common if ``COMMON`` of them have it; and so
#: many common shingles, the most frequent ones, are told apart, by counts up to ``TOP``. All are of cost only, never of the pairs.
COUNTED_OF, COMMON, MOST_COMMON, TOP = 4, 4, 2_000_000, 4095
#: Bits of the parity bitmap that travels with each prefix row, in words of 64; and of the one that sets of
#: more than ``WIDE_FROM`` shingles have besides, for which the first is too small to tell much.
FOLD_WORDS, WIDE_WORDS, WIDE_FROM = 8, 32, 1000
#: A set of n shingles must share 1 + n // SHARE_OF of its prefix, which is longer by as many.
SHARE_OF = 32
#: Prefix shingles that are matched in one task.
MATCHED = 2_000_000
#: A row of the last join has so many of its node's shingles before its own; a pair that shares one of them has met there.
BEFORE = 8
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingle hashes of a text, ascending; none for a null or word-less text."""
    return np.unique(shingle_hashes(text, words).view(">u8").ravel().astype(np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Two sets at or above the similarity; two empty ones are."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return (P + Q) * both >= P * (len(a) + len(b))


def fold(s: np.ndarray, words: int = FOLD_WORDS) -> np.ndarray:
    """A bitmap of one size for all sets, each bit the parity of its shingles, as signed words. Two sets'
    maps differ in at most as many bits as the sets in shingles."""
    size = 64 * words
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1 == 1).view(np.int64)


def _short(s: np.ndarray) -> np.ndarray:
    """The 40 bits of shingle hashes by which common ones are known; the few others that share them pass as common, too."""
    return s >> np.uint64(24)


def common_shingles(rows: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Short hashes that ``COMMON`` or more of the counted texts have, ascending, and how many have each (up to ``TOP``).

    Short hashes travel in four bytes by parts of the hash space, which tell the rest; the driver gets the common ones alone,
    ``MOST_COMMON`` at most."""
    counted = rows.filter(F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(COUNTED_OF)) == 0).select(F.coalesce("t", F.lit("")).alias("t"))
    size = counted.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    more = max(0, (size // 6 // MATCHED).bit_length() - 8)  # 256 parts, and twice as many while they are too large

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            h = np.sort(np.concatenate([np.empty(0, np.uint64), *(_short(shingle_set(t, words)) for t in batch.column(0).to_pylist())]))
            own, starts = np.unique(h >> np.uint64(32 - more), return_index=True)
            packed = [x.tobytes() for x in np.split(h.astype(np.uint32), starts[1:])][: len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "h"])

    def tallied(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        h, n = np.unique(np.frombuffer(b"".join(group.column("h").to_pylist()), np.uint32), return_counts=True)
        h, n = h[n >= COMMON].astype(np.int64), n[n >= COMMON]
        return pa.table({"h": (key[0].as_py() >> more << 32) + h, "n": np.minimum(n, TOP).astype(np.int32)})

    packed = counted.mapInArrow(tidy(dealt), "part int, h binary")
    common = written(packed.groupBy("part").applyInArrow(tallied, "h long, n int"), "common")
    least, told = TOP + 1, 0
    for n, many in sorted(map(tuple, common.groupBy("n").count().collect()), reverse=True):
        told += many
        if told > MOST_COMMON:
            break
        least = n
    found = common.filter(F.col("n") >= least).orderBy("h").toArrow()
    dropped(common)
    return found.column("h").to_numpy().astype(np.uint64), found.column("n").to_numpy().astype(np.uint16)


def in_order(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """An ascending set in the order of prefixes, the same for all sets: rare shingles by hash, then common ones, those that more have later."""
    h, n = common
    if not len(h) or not len(s):
        return s
    short = _short(s)
    at = np.minimum(np.searchsorted(h, short), len(h) - 1)
    often = np.where(h[at] == short, n[at], 0)
    return s[np.argsort(often, kind="stable")]


def _marked(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int) -> DataFrame:
    """``(row, id, key, n, fp, fold, wide, mins, prefix)``; key: of the whole set."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    names = ["key", "n", "fp", "fold", "wide", "mins", "prefix"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for t in batch.column(2).to_pylist():
                h = shingle_hashes(t, words)
                s = np.unique(h.view(">u8").ravel().astype(np.uint64))
                least = [(s * m).min().view(np.int64) for m in _TURNS] if len(s) else []
                prefix = in_order(s, common)[: len(s) * (Q - P) // Q + 1 + len(s) // SHARE_OF]
                wide = fold(s, WIDE_WORDS).tobytes() if len(s) > WIDE_FROM else None
                out.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), int.from_bytes(majority(h), "big", signed=True), fold(s), wide, least, prefix.tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols, kinds)], names=["row", "id", *names])

    return rows.mapInArrow(tidy(each), "row long, id long, key binary, n long, fp long, fold array<long>, wide binary, mins array<long>, prefix binary")


def _matched(nodes: DataFrame) -> DataFrame:
    """``(h, node)`` of every prefix shingle that two nodes or more have. They travel packed, by parts of the
    hash space, and only once; a shingle that all nodes have is no harder than others."""
    spark = nodes.sparkSession
    total = nodes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // MATCHED))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) // 8
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            node = np.repeat(batch.column(0).to_numpy(), sizes)
            part = ((h >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, node, cuts = h[order], node[order], np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
            own = np.flatnonzero(np.diff(cuts))
            packed = ([x[cuts[k] : cuts[k + 1]].tobytes() for k in own] for x in (h, node))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "h", "node"])

    def met(group: pa.Table) -> pa.Table:
        h, node = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("h", "node"))
        order = np.argsort(h, kind="stable")
        h, node = h[order], node[order]
        same = np.concatenate(([False], h[1:] == h[:-1], [False]))
        keep = same[1:] | same[:-1]
        return pa.table({"h": h[keep], "node": node[keep]})

    return nodes.select("node", "prefix").mapInArrow(tidy(dealt), "part int, h binary, node binary").groupBy("part").applyInArrow(met, "h long, node long")


def _apart(x: str, y: str):
    """Bits that differ in two array columns of words."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, n: t + n)


def _meeting(shared: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``(h, node, root, n, f0, f1, ..., before)`` of every shared shingle that nodes of different roots have; before: the
    last ``BEFORE`` of these below ``h`` that the node has."""
    rooted = written(shared.hint("merge").join(roots.hint("merge"), "node"), "rooted_shingles")
    parted = written(rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h"), "parted")
    at = rooted.join(parted.hint("merge"), "h", "left_semi").hint("merge").join(nodes.select("node", "n", "fold").hint("merge"), "node")
    last = Window.partitionBy("node").orderBy("h").rowsBetween(-BEFORE, -1)
    folds = (F.col("fold")[i].alias(f"f{i}") for i in range(FOLD_WORDS))
    out = written(at.select("h", "node", "root", "n", *folds, F.collect_list("h").over(last).alias("before")), "meeting")
    for done in (rooted, parted):
        dropped(done)
    return out


def _met(at: DataFrame) -> DataFrame:
    """``(a, b)`` of all nodes of different roots that meet at a shingle and may be similar, at the first where they meet and
    at those that come over ``BEFORE`` of either's shingles after the one before."""
    a, b = at.alias("x"), at.alias("y")
    total = F.col("x.n") + F.col("y.n")
    meet = (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    apart = sum((F.bit_count(F.col(f"x.f{i}").bitwiseXOR(F.col(f"y.f{i}"))) for i in range(FOLD_WORDS)), F.lit(0))
    meet &= ((P + Q) * apart <= (Q - P) * total) & ((P + Q) * F.least("x.n", "y.n") >= P * total)
    meet &= ~F.arrays_overlap("x.before", "y.before")
    return a.hint("merge").join(b, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _starred(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``(a, b)`` of one node of each shingle, drawn by hash, and each node of another root there."""
    rooted = written(shared.hint("merge").join(roots.hint("merge"), "node"), "rooted_shingles")
    drawn = F.xxhash64("h", "node")
    hubs = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("node", drawn).alias("hub"), F.min_by("root", drawn).alias("its"))
    hubs = written(hubs.filter("low < high").select("h", "hub", "its"), "hubs")
    pairs = rooted.hint("merge").join(hubs.hint("merge"), "h").filter("root <> its").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    out = written(pairs.distinct(), "star")
    for done in (rooted, hubs):
        dropped(done)
    return out


def _sharing(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """The pairs whose prefixes, which ``ends`` have by ``node``, share as many shingles as those of similar sets."""

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                both = np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)
                keep.append(len(both) > n // SHARE_OF)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    a, b = (ends.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"prefix_{x}")) for x in "ab")
    known = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b").select("a", "b", F.least("n_a", "n_b").alias("n"), "prefix_a", "prefix_b")
    return known.mapInArrow(tidy(enough), "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "ends")


def _tested(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, prefixes: bool = False) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose whole sets are similar. ``pairs`` may hold some twice. With ``prefixes``, pairs
    whose prefixes share too little are left out before their sets are made."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                apart = 0 if x is None or y is None else int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum())
                keep.append((P + Q) * apart <= (Q - P) * n)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "s"])

    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("fold").alias(f"fold_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    n = F.col("n_a") + F.col("n_b")
    known = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b").filter(((P + Q) * F.least("n_a", "n_b") >= P * n) & ((P + Q) * _apart("fold_a", "fold_b") <= (Q - P) * n))
    pairs = written(known.select("a", "b", n.alias("n"), "wide_a", "wide_b").mapInArrow(tidy(close), "a long, b long"), "pairs")
    ends = _ends(pairs)
    if prefixes:
        known = nodes.join(by_count(ends.withColumnRenamed("row", "node"), 2_000_000), "node", "left_semi")
        loose, before = pairs, ends
        pairs = written(_sharing(loose, known), "pairs")
        ends = _ends(pairs)
        for done in (loose, before):
            dropped(done)
    # up to 2 million places (some 50 MB) are broadcast, so texts stay where they are; more are merged
    sets = written(rows.select("row", "t").join(by_count(ends, 2_000_000), "row", "left_semi").mapInArrow(tidy(each), "row long, s array<long>"), "sets")
    a, b = (sets.select(F.col("row").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    links = written(pairs.hint("merge").join(a, "a").hint("merge").join(b, "b").filter((P + Q) * both >= P * (F.size("s_a") + F.size("s_b"))).select("a", "b"), "links")
    for done in (pairs, ends, sets):
        dropped(done)
    return links


def _rooted(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``nodes`` with ``root``, the smallest node that the pairs reach."""
    roots = components(pairs, "a", "b").withColumnRenamed("root", "found")
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("found", "node")).drop("found")


def near_copies(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: ``row``, ``keeper``, the row that stays for its component.

    ``row_col`` tells rows apart and must be stored, not made on reading. Two rows are linked if the
    Jaccard similarity of their sets of shingles is 4/5 or more; a text of fewer words is one
    shingle, null and word-less texts are copies of one another. Of a component the row with the
    smallest id stays, ids before nulls, and of rows with one id the smallest row. Texts of any
    length are compared whole. Empty table: empty result.
    """
    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    marked = written(_marked(rows, common_shingles(rows, words), words), "marks")
    best = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")).alias("best"))
    same = written(marked.groupBy("key").agg(F.min("row").alias("node"), best.alias("best")), "same")
    copies = written(marked.select("row", "key").join(same.select("key", "node").hint("merge"), "key").filter("row <> node").select("row"), "copies")
    nodes = marked.join(by_count(copies, 2_000_000), "row", "left_anti").withColumnRenamed("row", "node")

    # texts of equal fingerprints meet at the first of them, others as their fingerprints do
    groups = written(nodes.groupBy("fp").agg(F.min("node").alias("a")), "groups")
    equal = nodes.join(groups, "fp").filter("a < node").select("a", F.col("node").alias("b"))
    x, y = groups.select(F.col("fp").alias("a"), F.col("a").alias("one")), groups.select(F.col("fp").alias("b"), F.col("a").alias("two"))
    close = links(groups).join(x, "a").join(y, "b").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    turns = nodes.select("node", F.posexplode("mins").alias("turn", "least"))
    hubs = turns.groupBy("turn", "least").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last")
    star = turns.join(hubs.drop("last"), ["turn", "least"]).filter("a < node").select("a", F.col("node").alias("b"))
    first = _tested(equal.unionByName(close).unionByName(star).distinct(), nodes, rows, words)
    roots = written(_rooted(same.select("node"), first), "rooted")

    shared = written(_matched(nodes), "shared")
    second = first.unionByName(_tested(_starred(shared, roots), nodes, rows, words, prefixes=True))
    roots = written(_rooted(same.select("node"), second), "rooted")
    links_ = second.unionByName(_tested(_met(_meeting(shared, nodes, roots)).distinct(), nodes, rows, words, prefixes=True))

    rooted = written(_rooted(same, links_), "rooted")
    keepers = written(rooted.groupBy("root").agg(F.min("best")["row"].alias("keeper")), "keepers")
    by_key = rooted.select("key", "root").join(keepers, "root").select("key", "keeper")
    return marked.select("row", "key").join(by_key, "key").select("row", "keeper")
