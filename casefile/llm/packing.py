"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Packing needs only how many pieces there are of each length: at most ``capacity`` numbers, however
many documents. On that histogram the reduction examines every length and fixes sequences that dominate any alternative
(a piece alone, or with the one piece that is at least as good as whatever could stand in its
place); the rest is packed best-fit decreasing. Both work on whole runs of equal lengths at once,
so the plan is a short list of patterns, each with a count. Pieces then find their place by their
rank among the pieces of their length, which is counted in buckets, never in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.llm.batches import byte_slices, freed, tidy
from casefile.llm.store import written

CAPACITY, END_ID = 2048, 0
RANK_BUCKETS = 4096

#: A text whose spaces are not all single, between two characters other than white space, is encoded
#: whole; so is one with white space other than space and line feed, or with what may be a special token.
_WHOLE = r"  |\n | \n|^ | $|<\||[\t\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _byte_of() -> dict[str, int]:
    """Byte-level BPE's printable stand-in for each byte: itself where printable, else 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordCoder:
    """Token ids of texts by way of their different words.

    Byte-level BPE never merges across the split before a single space that stands between two
    characters other than white space, so a text's ids are those of its words put together. A
    batch's different words are found by hashing in Arrow, each is encoded once, and the ids are
    gathered. Words go through the compiled merge loop of tiktoken, whose ranks are the
    tokenizer file's own ids; a file whose merges are not in id order goes through tokenizers alone.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model, byte_of = json.loads(self.tokenizer.to_str())["model"], _byte_of()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(map(byte_of.__getitem__, w)): i for w, i in model["vocab"].items() if w not in special}
        merged = [ranks.get(bytes(byte_of[c] for part in m for c in part)) for m in (x if isinstance(x, list) else x.split(" ") for x in model["merges"])]
        #: Fixed value: the published pre-tokenization pattern of byte-level BPE.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = None
        if None not in merged and merged == sorted(merged):
            self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, words: list[str]) -> pa.ListArray:
        coded = list(map(self.fast or self.whole, words))
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))))).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.fromiter(chain.from_iterable(coded), np.uint32, offsets[-1])))

    def __call__(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        odd = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        cut = pc.split_pattern(plain, " ")
        words, starts = cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = words.dictionary_encode()
        first = starts[:-1]  # a text's first word has no space before it
        index = coded.indices.to_numpy().copy()
        opening = words.take(pa.array(first)).to_pylist()
        known = [" " + w for w in coded.dictionary.to_pylist()]
        index[first] = len(known) + np.arange(len(first))
        ids = self._ids(known + opening)
        sizes = np.diff(ids.offsets.to_numpy())[index]
        ends = np.concatenate(([0], np.cumsum(sizes)))[starts]
        flat = ids.take(pa.array(index)).flatten().to_numpy()
        plains = iter(np.split(flat, ends[1:-1]) if len(first) else [])
        return [np.array(self.whole(t.as_py()), np.uint32) if o else next(plains) for t, o in zip(texts, odd, strict=True)]


@cache
def _coder(path: str) -> WordCoder:
    coder = WordCoder(path)
    freed()  # the file's text and tables are large, what is kept of them is not
    return coder


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole capacities, the first shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: every text's ids and the closing id, cut to capacity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = _coder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            rows = []
            for lo, hi in byte_slices(texts):
                for doc, coded in zip(ids[lo:hi], coder(texts.slice(lo, hi - lo)), strict=True):
                    data = coded.astype("<u4").tobytes() + end
                    rows += [(doc, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut_points(len(data) // 4, capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(tidy(each), "id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """How many pieces are left of each length, lengths in order."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {k: n for k, n in histogram.items() if n > 0}
        self.sizes = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def largest(self, room: int, but: int | None = None) -> int | None:
        """Largest size of at most ``room``; one piece of size ``but`` is taken already."""
        i = bisect.bisect_right(self.sizes, room) - 1
        if i >= 0 and self.sizes[i] == but and self.left[but] == 1:
            i -= 1
        return self.sizes[i] if i >= 0 else None


def reduced(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences that some best packing contains, as (lengths, count), and what is left.

    Every length j is examined, the longest first, undecided ones again while others get fixed. Nothing fits beside a piece of
    length j: {j} is fixed. Else let k be the longest piece that fits. {j, k} is fixed if it fills the
    sequence, or if whatever else can stand beside j is no longer than k: k can then be swapped for
    it in any packing. That is so if no two pieces fit beside j together, or if no three do and the
    longest two that fit are no longer than k. Otherwise j's alternatives are open, and it is left.
    """
    stock, fixed, again = _Stock(histogram), [], True
    while again:
        again = False
        for j in sorted(stock.left, reverse=True):
            while j in stock.left and (found := _dominating(stock, j, capacity - j)):
                k, n = found
                fixed.append(((j,) if k is None else (j, k), n))
                stock.take(j, n)
                if k is not None:
                    stock.take(k, n)
                again = True
    return fixed, dict(stock.left)


def _dominating(stock: _Stock, j: int, room: int) -> tuple[int | None, int] | None:
    """What dominates all else beside a piece of length j: (k or None, number of times), or None if that is open."""
    k = stock.largest(room, j)
    if k is None:
        return None, stock.left[j] if j > room else 1
    if k != room:
        small = [s for s in stock.sizes[:4] for _ in range(min(3, stock.left[s] - (s == j)))][:3]
        two, three = len(small) > 1 and sum(small[:2]) <= room, len(small) > 2 and sum(small) <= room
        if two and (three or k < _best_pair(stock, room, j)):
            return None
    # while both last, each repetition meets the same sizes and so the same grounds
    return k, stock.left[j] // 2 if j == k else min(stock.left[j], stock.left[k])


def _best_pair(stock: _Stock, room: int, j: int) -> int:
    """Longest sum of two pieces that fits in ``room``, or more where that takes a piece twice: then less is fixed."""
    sizes = np.array(stock.sizes)
    small = sizes[: np.searchsorted(sizes, room - sizes[0], "right")]
    return int((small + sizes[np.searchsorted(sizes, room - small, "right") - 1]).max()) if len(small) else 0


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, whole runs at a time: (lengths, count) of each pattern."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((pattern, n))

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                pattern, have = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
                # a sequence that still has room for this size is its own tightest fit
                each, used = min(room // size, n), 1
                if each:
                    used = min(have, n // each)
                put(room - each * size, pattern + (size,) * each, used)
                if have > used:
                    put(room, pattern, have - used)
                n -= each * used
            else:
                each = min(capacity // size, n)
                used = n // each
                put(capacity - each * size, (size,) * each, used)
                n -= each * used
    return [p for own in by_room.values() for p in own]


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): pieces of that length and of those
    ranks stand at that offset of consecutive sequences."""
    fixed, rest = reduced(histogram, capacity)
    used, plan, sequence = dict.fromkeys(histogram, 0), [], 0
    for pattern, n in fixed + best_fit(rest, capacity):
        at = 0
        for size in pattern:
            plan.append((size, used[size], used[size] + n, sequence, at))
            used[size] += n
            at += size
        sequence += n
    return plan


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (from :func:`pieces`) with ``sequence_id`` and ``offset``.

    The plan is broadcast: its rows are bounded by the number of different lengths, not by the
    pieces. Ranks: rows of a length are counted by bucket of their hash and of the task they come from, so that a
    length that a third of all pieces share, or repeated rows, are still spread over many groups.
    """
    spark = found.sparkSession
    rows = written(found.withColumn("b", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(RANK_BUCKETS))), "pieces")
    counted = written(rows.groupBy("length", "b").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(packing_plan(histogram, capacity), "length long, lo long, hi long, sequence long, offset long")
    before = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "b").orderBy("id", "piece", "ids_crc32")
    ranked = rows.withColumn("r", F.row_number().over(own) - 1).join(bases, ["length", "b"]).withColumn("rank", F.col("base") + F.col("r"))
    at = F.broadcast(plan.withColumnRenamed("length", "of"))
    placed = ranked.join(at, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the closing id alone. Only documents longer than the capacity are cut.
    Repeated rows are packed each; rows alike in all respects are told apart by nothing, and take
    places of their own. Other columns are not read. Empty table: empty result.
    """
    return packed(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), capacity)
