"""A trie of conversations that share their first turns, with subtree totals by leaf-peeling.

Turns travel as hashes and word counts. A prefix's key is its length and the exclusive or of 128-bit
hashes of (place, turn), so keys are running sums and a long conversation may be split over tasks. A
node is named by its smallest member and its depth; nodes of one member are a path down the trie, and
paths, not single nodes, pass messages: a path that has heard from all child paths sends its totals to
the node it hangs on, until only the root's path is left. Rounds are as many as paths nest, which takes
conversations that extend each other: at most the square root of twice the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.llm.batches import tidy
from casefile.llm.store import cleared, dropped, written

#: Families of conversations, and how many turns they may share.
FAMILY, SHARED = 20, 4
KEY = ["depth", "p1", "p2"]


def _words(text: Column) -> Column:
    return F.size(F.split(text, r"[^\x20\x09-\x0D]+", -1)) - 1


def _earlier(df: DataFrame, total: Column, name: str, last_first: bool = False) -> DataFrame:
    """``(conv_id, part, name)``: ``total`` over the conversation's rows in earlier parts (later ones with
    ``last_first``); a window over totals, one a conversation and part."""
    order = F.desc("part") if last_first else F.asc("part")
    before = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("conv_id", "part").agg(total.alias("_t"))
    return sums.select("conv_id", "part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias(name))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, part, pos, k1, k2, words)``: turns numbered from 1 by turn (null first), then content. Rows are
    dealt in ranges, so that a conversation of any length is many parts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), role, text).alias("k2"), _words(text).cast("long").alias("words")
    )
    order = [F.asc_nulls_first("turn"), F.col("k1"), F.col("k2")]
    ranged = written(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    rows = ranged.withColumn("_n", local).join(_earlier(ranged, F.count("*"), "_before"), ["conv_id", "part"])
    return rows.select("conv_id", "part", (F.col("_n") + F.col("_before")).alias("pos"), "k1", "k2", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences ``(conv_id, part, depth, length, k1, k2, words)`` and all conversations ``(conv_id, length)``: a few first
    turns of the family's first conversation, then the own ones after as many."""
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).alias("h")
    every = own.select("conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("family"), h)
    firsts = own.filter(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("family"), F.col("n").alias("family_n"))
    taken = F.least("h", F.coalesce("family_n", F.lit(0)))
    every = every.join(firsts, "family", "left").select("conv_id", "family", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    tail = turns.join(every, "conv_id").filter("pos > h").select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "length", "k1", "k2", "words")
    heads = turns.filter((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("pos") < SHARED)).select(F.col("conv_id").alias("family"), "pos", "k1", "k2", "words")
    shared = every.join(heads, "family").filter("pos <= taken").select("conv_id", F.lit(-1).alias("part"), F.col("pos").alias("depth"), "length", "k1", "k2", "words")
    return tail.unionByName(shared), every.select("conv_id", "length")


def keyed(turns: DataFrame) -> DataFrame:
    """Sequences with the prefix's key ``(depth, p1, p2)`` and its parent's ``(q1, q2)``."""
    g = turns.withColumn("g1", F.xxhash64("depth", "k1", "k2")).withColumn("g2", F.xxhash64(F.lit(2), "depth", "k1", "k2"))
    running = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = g.withColumn("r1", F.bit_xor("g1").over(running)).withColumn("r2", F.bit_xor("g2").over(running))
    sums = g.groupBy("conv_id", "part").agg(F.bit_xor("g1").alias("t1"), F.bit_xor("g2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "part", *(F.coalesce(F.bit_xor(f"t{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)))
    p = [F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)]
    out = rows.join(sums, ["conv_id", "part"]).select("conv_id", "part", "depth", "length", "words", *(p[i].alias(f"p{i + 1}") for i in (0, 1)), "g1", "g2")
    return out.select("*", *(F.col(f"p{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"q{i}") for i in (1, 2))).drop("g1", "g2")


def _digests(ends: DataFrame) -> DataFrame:
    """``(depth, p1, p2, ends_sha256)``: a node's ids in order through one running digest, however many they are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], [*KEY, "ends_sha256"])
        for batch in batches:
            cols = np.stack([batch.column(c).to_numpy() for c in KEY])
            ids = batch.column("conv_id").cast(pa.string()).to_pylist()
            cuts = np.flatnonzero(np.concatenate([[True], (cols[:, 1:] != cols[:, :-1]).any(axis=0)])) if len(ids) else []
            out = []
            for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                own, part = tuple(cols[:, lo].tolist()), ",".join(ids[lo:hi]).encode()
                if own == key:
                    state.update(b"," + part)
                else:
                    if key is not None:
                        out.append(done())
                    key, state = own, hashlib.sha256(part)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if key is not None:
            yield done()

    dealt = ends.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return dealt.mapInArrow(tidy(each), "depth long, p1 long, p2 long, ends_sha256 string")


def peeled(paths: DataFrame) -> DataFrame:
    """``(path, leaves, saved)`` of whole subtrees from ``(path, parent, leaves, saved)`` of paths alone (root: null parent).

    Leaf-peeling: paths without remaining children are done and send their totals to the parent, which
    adds them up and counts the senders off. A round reads only what is not done yet.
    """
    children = paths.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("remaining"))
    waiting = written(paths.join(children, "path", "left").na.fill(0, ["remaining"]), "waiting")
    finished = None
    while True:
        done = written(waiting.filter("remaining = 0"), "done")
        if done.isEmpty():
            return finished if finished is not None else done.select("path", "leaves", "saved")
        totals = done.select("path", "leaves", "saved")
        finished = totals if finished is None else finished.unionByName(totals)
        sent = done.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("_n"), F.sum("leaves").alias("_l"), F.sum("saved").alias("_s")).na.fill(0)
        heard = waiting.filter("remaining > 0").join(sent, "path", "left").na.fill(0, ["_n", "_l", "_s"])
        before = waiting
        waiting = written(heard.select("path", "parent", (F.col("leaves") + F.col("_l")).alias("leaves"), (F.col("saved") + F.col("_s")).alias("saved"), (F.col("remaining") - F.col("_n")).alias("remaining")), "waiting")
        dropped(before)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations ``(conv_id, turn, role, text)``:
    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    Null roles and texts are empty; rows without conv_id belong to no conversation; a null turn comes
    first, turns of one number by their content, repeated rows are turns of their own. Other columns are not
    read, whatever their names. Empty table: empty result.
    """
    kept: list[DataFrame] = []
    with cleared(kept):
        turns = written(placed_turns(conversations), "placed")
        sequences, every = rebuilt(turns)
        rows = written(keyed(written(sequences, "sequences")), "prefixes")
        every = written(every, "every")
        root_id = every.agg(F.min("conv_id")).first()[0]
        root = every.agg(F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "q1", "q2")), F.min("conv_id").alias("conv_id"), F.lit(-2).alias("part"),
                         F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("words")).filter("conv_id is not null")
        least = F.min(F.struct("conv_id", "part"))
        nodes = rows.groupBy(*KEY).agg(F.first("q1").alias("q1"), F.first("q2").alias("q2"), least.alias("_m"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
        nodes = nodes.select(*KEY, "q1", "q2", "_m.*", "n_convs", "words").unionByName(root, allowMissingColumns=True)
        nodes = written(nodes, "nodes")
        # the root's children, which may be as many as conversations, need no join to find it
        inner = nodes.filter("depth > 1").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "conv_id")
        parents = nodes.filter("depth > 0").select(*KEY, F.col("conv_id").alias("parent_conv_id"))
        first = nodes.filter("depth = 1").select("conv_id", F.lit(1).cast("long").alias("depth"), F.lit(root_id).cast("long").alias("parent_conv_id"))
        links = inner.join(parents, KEY).select("conv_id", (F.col("depth") + 1).alias("depth"), "parent_conv_id")
        links = written(links.unionByName(first), "links")
        kids = links.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
        tops = links.filter("conv_id <> parent_conv_id").select(F.col("conv_id").alias("path"), F.col("parent_conv_id").alias("parent"), (F.col("depth") - 1).alias("at"))
        own = nodes.join(kids, ["conv_id", "depth"], "left").na.fill(0, ["n_children"]).withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
        own = written(own.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "own")
        alone = own.groupBy(F.col("conv_id").alias("path")).agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
        totals = peeled(alone.join(tops.select("path", "parent"), "path", "left").select("path", "parent", "leaves", "saved"))
        hung = totals.join(tops, "path").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        loaded = own.join(hung, ["conv_id", "depth"], "left").na.fill(0, ["_l", "_s"]).withColumn("leaf", F.col("leaf") + F.col("_l")).withColumn("own", F.col("own") + F.col("_s"))
        loaded = written(loaded.drop("_l", "_s"), "loaded")
        below = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        later = _earlier(loaded, F.sum("leaf"), "_leaf", last_first=True).join(_earlier(loaded, F.sum("own"), "_own", last_first=True), ["conv_id", "part"])
        summed = loaded.withColumn("n_leaves", F.sum("leaf").over(below)).withColumn("saved_tokens", F.sum("own").over(below)).join(later, ["conv_id", "part"])
        empty = every.filter("length = 0").select(*(F.lit(0).cast("long").alias(c) for c in KEY), "conv_id")
        digests = _digests(rows.filter("depth = length").select(*KEY, "conv_id").unionByName(empty))
        out = summed.join(digests, KEY, "left").join(links, ["conv_id", "depth"], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("_leaf")).alias("n_leaves"),
            (F.col("saved_tokens") + F.col("_own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
        kept.append(written(out, "trie"))
    return kept[0]
