"""Removal of repeated passages by a logarithmic family of suffix arrays, spread over buckets.

Texts are packed into chunks and cut into blocks: runs of windows (``WINDOW`` bytes each) that share their
smallest 16-byte gram, the anchor. Equal windows have equal anchors, so an anchor's blocks meet in one
bucket and nothing else need meet. A first round sends anchors alone and learns which stand in more than
one document; only their blocks follow. In a bucket, blocks come in batches of ascending document ids.
Each batch gets the suffix array of its windows, is merge-scanned against the levels that stand, and adds
the windows that are new as a level; levels of one size class merge, so their number stays logarithmic.
Every window's smallest document then goes back to the chunks, which cut their texts.

A chunk sends equal blocks once. An anchor with very many different blocks (where a passage ends that
many documents share) is hot: its blocks are cut into single windows, which spread by their own hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.batches import byte_slices, freed, tidy
from casefile.llm.store import cleared, written

WINDOW, GRAM = 50, 16
#: Windows of a block; bytes of a chunk; bytes hashed at once; windows of a batch; text of a bucket;
#: different blocks of an anchor from which it is hot.
MOST_WINDOWS, CHUNK, SEGMENT, BATCH, BUCKET, HOT = 128, 8 << 20, 1 << 20, 1 << 18, 6 << 20, 60_000
#: Most tasks of a shuffle; a chunk or a bucket is at most one.
MOST_TASKS = 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LATE = np.iinfo(np.int64).max  # a null id counts as the largest
#: What seven bits say of a count: exact below 64, then in steps of a twelfth or less.
_COUNTS = np.concatenate([np.arange(64), (64 * 2 ** (np.arange(64) / 8)).astype(np.int64)])
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()  # a worker runs one task at a time


def _words(text: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each place as a number, without copying."""
    return np.ndarray((len(text) - 7,), order + "u8", text.data, 0, (1,))


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(31)
    x *= _ODD
    return x >> np.uint64(24)


def _packed(*columns: np.ndarray) -> bytes:
    return _ZIP.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


@dataclass
class Blocks:
    """Blocks of a chunk: first byte, windows, anchor (40 bits) and hash of all bytes."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _segment(text: np.ndarray, lo: int, hi: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of the windows that start in [lo, hi), and a function that hashes any stretch of bytes."""
    span = WINDOW - GRAM + 1
    local = text[lo : hi + WINDOW + GRAM]  # the chunk is padded
    words = _words(local, "<")
    n = hi - lo
    gram = words[: n + WINDOW].astype(np.uint64) * _ODD
    gram ^= gram >> np.uint64(29)
    gram = (gram ^ words[8 : n + WINDOW + 8].astype(np.uint64)) * _ODD
    gram ^= gram >> np.uint64(32)
    least, wide = gram, 1
    while wide * 2 <= span:
        least, wide = np.minimum(least[:-wide], least[wide:]), wide * 2
    least = np.minimum(least[: n + 1], least[span - wide : n + 1 + span - wide])[:n]
    # no window starts in the last bytes of a text
    edge = np.zeros(n + 1, np.int32)
    near = ends[(ends > lo) & (ends < hi + WINDOW)]
    np.add.at(edge, np.clip(near - WINDOW + 1 - lo, 0, n), 1)
    np.add.at(edge, np.clip(near - lo, 0, n), -1)
    whole = np.cumsum(edge[:-1]) == 0
    turn = np.concatenate([[True], (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])])
    at = np.flatnonzero(turn)
    size = np.diff(np.concatenate([at, [n]]))
    at, size = at[whole[at]], size[whole[at]]
    parts = -(-size // MOST_WINDOWS)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(at, parts) + nth * MOST_WINDOWS
    windows = np.minimum(np.repeat(size, parts) - nth * MOST_WINDOWS, MOST_WINDOWS)
    # hashes of stretches from sums of grams times powers of an odd number, shifted back to power 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gram * _powers(len(gram)))])

    def hashed(first: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (sums[first + count + WINDOW - GRAM] - sums[first]) * _backs(n)[first]

    return start + lo, windows, _spread(least[start]), hashed(start, windows), hashed


_made: dict[str, np.ndarray] = {}


def _series(name: str, ratio: int, n: int) -> np.ndarray:
    if len(_made.get(name, ())) < n:
        steps = np.full(max(n, SEGMENT + 2 * WINDOW), ratio, np.uint64)
        steps[0] = 1
        _made[name] = np.cumprod(steps)
    return _made[name][:n]


def _powers(n: int) -> np.ndarray:
    return _series("powers", int(_MIX), n)


def _backs(n: int) -> np.ndarray:
    return _series("backs", pow(int(_MIX), -1, 1 << 64), n)


def blocks_of(text: np.ndarray, ends: np.ndarray) -> Blocks:
    """Blocks of texts laid end to end; ``text`` has some zero bytes after the last."""
    found = [_segment(text, lo, min(lo + SEGMENT, int(ends[-1])), ends)[:4] for lo in range(0, int(ends[-1]) if len(ends) else 0, SEGMENT)]
    if not found:
        return Blocks(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return Blocks(*(np.concatenate(c) for c in zip(*found, strict=True)))


@dataclass
class Chunk:
    """Documents laid end to end."""

    text: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    known: np.ndarray

    @staticmethod
    def pack(ids: pa.Array, texts: pa.Array) -> bytes:
        raw = texts.cast(pa.large_binary()).to_pylist()
        number = ids.fill_null(_LATE).to_numpy(zero_copy_only=False)
        head = np.array([len(raw)], np.int64)
        sizes = np.array([len(t) for t in raw], np.int64)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return zstandard.compress(b"".join([head.tobytes(), sizes.tobytes(), number.astype(np.int64).tobytes(), known.tobytes(), *raw, bytes(2 * WINDOW)]), 3)

    @classmethod
    def unpack(cls, blob: bytes) -> Chunk:
        raw = zstandard.decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, ids = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
        return cls(np.frombuffer(raw, np.uint8, -1, 8 + 17 * n), np.cumsum(sizes), ids, np.frombuffer(raw, bool, n, 8 + 16 * n))

    def owner(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, start, "right")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _ordered(key: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Rows by ``key``, equal ones by ``then``; most keys are single, so only the ties are ordered by both."""
    order = np.argsort(key)
    new = _changes(key[order])
    tied = ~new
    tied[:-1] |= ~new[1:]
    at = np.flatnonzero(tied)
    order[at] = order[at][np.lexsort((then[order[at]], np.cumsum(new[at])))]
    return order


def _keyed(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and anchor in one number."""
    return (anchor % np.uint64(buckets)) << np.uint64(40) | anchor


def _anchor_rows(chunk: Chunk, buckets: int) -> Iterator[tuple[int, bytes]]:
    """A bucket's anchors, ascending, and for each how many different blocks it has, with 128 added if in two documents."""
    found = blocks_of(chunk.text, chunk.ends)
    if not len(found.start):
        return
    key = _keyed(found.anchor, buckets)
    order = _ordered(key, found.content)
    key = key[order]
    at = np.flatnonzero(_changes(key))
    doc = chunk.ids[chunk.owner(found.start[order])]
    differ = np.add.reduceat(_changes(key, found.content[order]).astype(np.int64), at)
    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    count = (np.searchsorted(_COUNTS, differ, "right") - 1 + 128 * several).astype(np.uint8)
    bucket = (key[at] >> np.uint64(40)).astype(np.int64)
    steps = found.anchor[order[at]]
    first = _changes(bucket)
    steps[1:] -= np.where(first[1:], np.uint64(0), steps[:-1])
    planes = np.concatenate([steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T, count[None]])
    cuts = np.append(np.flatnonzero(first), len(bucket)).tolist()
    for b, lo, hi in zip(bucket[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
        yield b, _packed(planes[:, lo:hi])


def _shared(rows: list[bytes]) -> list[bytes]:
    """For each chunk's anchors of one bucket: 0 where no other document has the anchor, 1 shared, 2 hot."""
    planes = [np.frombuffer(_UNZIP.decompress(blob), np.uint8).reshape(6, -1) for blob in rows]
    sizes = np.array([p.shape[1] for p in planes])
    planes = np.concatenate(planes, axis=1)
    count = planes[5]
    steps = np.zeros((len(count), 8), np.uint8)
    steps[:, :5] = planes[:5].T
    anchor = np.cumsum(steps.view("<u8")[:, 0])
    first = np.cumsum(sizes) - sizes
    anchor -= np.repeat(np.concatenate([np.zeros(1, np.uint64), anchor[first[1:] - 1]]), sizes)  # each row counts from 0
    order = np.argsort(anchor, kind="stable")
    at = np.flatnonzero(_changes(anchor[order]))
    times = np.diff(np.append(at, len(order)))
    code = ((times > 1) | np.logical_or.reduceat(count[order] > 127, at)).astype(np.uint8)
    code[(np.add.reduceat(_COUNTS[count[order] & 127], at) > HOT) & (code > 0)] = 2
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(code, times)
    return [_packed(part) for part in np.split(out, np.cumsum(sizes)[:-1])]


@dataclass
class Contents:
    """Different contents that a chunk sends, by bucket, and where each stands."""

    bucket: np.ndarray
    windows: np.ndarray
    low: np.ndarray  # smallest and largest document that holds it here
    high: np.ndarray
    first: np.ndarray  # its places in ``place``: from, to
    after: np.ndarray
    place: np.ndarray


def _contents(chunk: Chunk, codes: dict[int, bytes], buckets: int) -> Contents:
    found = blocks_of(chunk.text, chunk.ends)
    key = _keyed(found.anchor, buckets)
    order = np.argsort(key)  # the order in which replies come
    code = np.frombuffer(b"".join(_UNZIP.decompress(codes[b]) for b in sorted(codes)), np.uint8)
    code = code[np.cumsum(_changes(key[order])) - 1]
    some, hot = order[code == 1], order[code == 2]
    start, windows, content, key = found.start[some], found.windows[some], found.content[some], found.anchor[some]
    if len(hot):
        n = found.windows[hot]
        at = _stretches(found.start[hot], n)
        one = _window_hashes(chunk, np.sort(at))
        start, windows = np.concatenate([start, np.sort(at)]), np.concatenate([windows, np.ones(len(at), np.int64)])
        content, key = np.concatenate([content, one]), np.concatenate([key, _spread(one)])
    key = _keyed(key, buckets)
    order = _ordered(key, content)
    start, windows, content, key = (c[order] for c in (start, windows, content, key))
    bucket = (key >> np.uint64(40)).astype(np.int64)
    at = np.flatnonzero(_changes(key, content, windows))
    doc = chunk.ids[chunk.owner(start)] if len(start) else np.zeros(0, np.int64)
    low, high = (np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)) if len(at) else (doc, doc)
    return Contents(bucket[at], windows[at], low, high, at, np.append(at[1:], len(start)).astype(np.int64), start)


def _window_hashes(chunk: Chunk, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows at ascending places."""
    out, last = [], int(chunk.ends[-1])
    for lo in range(0, last, SEGMENT):
        own = at[np.searchsorted(at, lo) : np.searchsorted(at, lo + SEGMENT)]
        if len(own):
            hashed = _segment(chunk.text, lo, min(lo + SEGMENT, last), chunk.ends)[4]
            out.append(hashed(own - lo, np.ones(len(own), np.int64)))
    return np.concatenate(out)


def _content_rows(chunk: Chunk, codes: dict[int, bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
    """A bucket's contents, and where each stands: the reply names the places, so the chunk need not find them again."""
    sent = _contents(chunk, codes, buckets)
    cuts = np.append(np.flatnonzero(_changes(sent.bucket)), len(sent.bucket))
    size, times = sent.windows + WINDOW - 1, (sent.after - sent.first).astype(np.uint32)
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(cuts) - 1:
        # texts of some buckets are gathered at once
        z = max(a + 1, int(np.searchsorted(total[cuts], total[cuts[a]] + SEGMENT, "right")) - 1)
        own = slice(cuts[a], cuts[z])
        text = chunk.text[_stretches(sent.place[sent.first[own]], size[own])]
        for lo, hi in zip(cuts[a:z].tolist(), cuts[a + 1 : z + 1].tolist(), strict=True):
            place = sent.place[sent.first[lo] : sent.after[hi - 1]].astype(np.uint32)
            body = text[total[lo] - total[cuts[a]] : total[hi] - total[cuts[a]]]
            yield int(sent.bucket[lo]), _packed(np.array([hi - lo, len(place)]), sent.low[lo:hi], sent.high[lo:hi], times[lo:hi], place, sent.windows[lo:hi].astype(np.uint8), body)
        a = z


_DEPTHS = (*range(0, WINDOW - 7, 8), WINDOW - 8)


def suffix_array(text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places ordered by their ``WINDOW`` bytes, where a new window starts); eight bytes a round, ties alone go on."""
    words = _words(text, ">")
    key = words[places].astype(np.uint64)
    order = np.argsort(key)
    sa, new = places[order], _changes(key[order])
    for depth in _DEPTHS[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new[at])
        key = words[sa[at] + depth].astype(np.uint64)
        order = np.lexsort((key, group))
        sa[at] = sa[at[order]]
        new[at] |= _changes(group, key[order])
    return sa, new


class Level:
    """A sorted set of windows: places in its text, and the smallest document that holds each."""

    def __init__(self, text: np.ndarray, sa: np.ndarray, doc: np.ndarray):
        self.text, self.sa, self.doc = text, sa, doc
        self.words = _words(text, ">")
        self.keys = self.words[sa].astype(np.uint64)

    def __len__(self) -> int:
        return len(self.sa)

    def scan(self, text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among this level's windows, whether it stands there) of each window; both ascend."""
        words = _words(text, ">")
        key = words[places].astype(np.uint64)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        for depth in _DEPTHS[1:]:
            at = np.flatnonzero(hi > lo)
            if not len(at):
                break
            key = words[places[at] + depth].astype(np.uint64)
            left = self._bisect(depth, lo[at], hi[at], lambda v, k=key: v < k)
            hi[at] = self._bisect(depth, left, hi[at], lambda v, k=key: v <= k)
            lo[at] = left
        return lo, hi > lo

    def _bisect(self, depth: int, lo: np.ndarray, hi: np.ndarray, before) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = before(self.words[self.sa[np.minimum(mid, len(self.sa) - 1)] + depth].astype(np.uint64))
            open_ = lo < hi
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo

    def merged(self, other: Level) -> Level:
        """Both levels' windows; no window stands in both."""
        mine = np.arange(len(self)) + other.scan(self.text, self.sa)[0]
        sa, doc = np.empty(len(self) + len(other), np.int64), np.empty(len(self) + len(other), np.int64)
        theirs = np.ones(len(sa), bool)
        theirs[mine] = False
        sa[mine], doc[mine] = self.sa, self.doc
        sa[theirs], doc[theirs] = other.sa + len(self.text), other.doc
        return Level(np.concatenate([self.text, other.text]), sa, doc)


class IndexFamily:
    """Levels of geometrically growing size; batches come in ascending order of their documents."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, text: np.ndarray, places: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The smallest document with each window, as far as seen, this batch included; ``places`` ascend."""
        sa, new = suffix_array(text, places)
        row = np.searchsorted(places, sa)
        whose = doc[row]
        at = np.flatnonzero(new)
        first = np.minimum.reduceat(whose, at) if len(at) else whose
        fresh, own = np.ones(len(at), bool), sa[at]
        for level in self.levels:
            left = np.flatnonzero(fresh)
            place, there = level.scan(text, own[left])
            hit = left[there]
            first[hit] = np.minimum(first[hit], level.doc[place[there]])
            fresh[hit] = False
        out = np.empty(len(places), np.int64)
        out[row] = np.repeat(first, np.diff(np.append(at, len(sa))))
        if fresh.any():
            self.levels.append(Level(text, own[fresh], first[fresh]))
            while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
                newer, older = self.levels.pop(), self.levels.pop()
                self.levels.append(older.merged(newer))
        return out


def _matches(rows: list[bytes]) -> list[bytes]:
    """For each chunk's contents in one bucket: stretches of windows (content, from, to, smallest document) that a
    document of the chunk has to lose to a smaller one, and the places of these contents."""
    parts, places = [], []
    for blob in rows:
        raw = _UNZIP.decompress(blob)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        times, place = np.frombuffer(raw, np.uint32, n, 16 + 16 * n), np.frombuffer(raw, np.uint32, m, 16 + 20 * n)
        places.append((times, place))
        at = 16 + 20 * n + 4 * m
        parts.append((np.frombuffer(raw, np.int64, 2 * n, 16).reshape(2, -1), np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, -1, at + n)))
    low, high = np.concatenate([p[0] for p in parts], axis=1)
    windows = np.concatenate([p[1] for p in parts]).astype(np.int64)
    text = np.concatenate([p[2] for p in parts])
    n = np.array([len(p[1]) for p in parts])
    owner, nth = np.repeat(np.arange(len(rows)), n), _stretches(np.zeros(len(n), np.int64), n)
    del parts
    size = windows + WINDOW - 1
    begin = np.cumsum(size) - size
    member, start, count = _equal(text, begin, size, low)
    head = member[start]  # the member of each class with the smallest document
    order = np.argsort(low[head], kind="stable")
    again = _again(text, begin[head[order]], windows[head[order]])
    ends = np.cumsum(windows[head[order]])
    some = np.diff(np.concatenate([[0], np.cumsum(again)])[np.concatenate([[0], ends])])
    # a class of one document whose windows all stand once loses nothing
    left = (some > 0) | (np.maximum.reduceat(high[member], start)[order] > low[head[order]])
    again = again[np.repeat(left, windows[head[order]])]
    order, some = order[left], some[left]
    ends = np.cumsum(windows[head[order]])
    total = np.cumsum(np.maximum(some, windows[head[order]] >> 2))
    family, out = IndexFamily(), [[] for _ in rows]
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BATCH, "right")))
        own = order[lo:hi]
        n, width = windows[head[own]], size[head[own]]
        body = text[_stretches(begin[head[own]], width)]
        each = np.repeat(np.arange(len(own)), n)
        inner = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        first = low[head[own]][each]
        known = np.flatnonzero(again[ends[lo] - n[0] : ends[hi - 1]])
        if len(known):
            first[known] = family.add(body, (np.cumsum(width) - width)[each[known]] + inner[known], first[known])
        at = np.flatnonzero(_changes(each, first))
        till = np.append(at[1:], len(each)) - 1
        # every member of the class has the same stretches
        times = count[own[each[at]]]
        which = member[_stretches(start[own[each[at]]], times)]
        at, till = np.repeat(at, times), np.repeat(till, times)
        lost = first[at] < high[which]
        at, till, which = at[lost], till[lost], which[lost]
        piece = np.stack([nth[which], inner[at], inner[till], first[at]], axis=1)
        whose = owner[which]
        turn = np.argsort(whose, kind="stable")
        cuts = np.append(np.flatnonzero(_changes(whose[turn])), len(turn))
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[int(whose[turn[a]])].append(piece[turn[a:b]])
        lo = hi
    return [_reply(np.concatenate(p).T, *places[i]) if p else b"" for i, p in enumerate(out)]


def _reply(pieces: np.ndarray, times: np.ndarray, place: np.ndarray) -> bytes:
    content, lo, hi, first = pieces
    hit = np.zeros(len(times), bool)
    hit[content] = True
    nth = (np.cumsum(hit) - 1)[content]
    times, place = times[hit], place[np.repeat(hit, times)]
    return _packed(np.array([len(lo), len(times), len(place)]), first, nth.astype(np.uint32), times, place, lo.astype(np.uint8), hi.astype(np.uint8))


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places from each beginning on, one stretch after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _equal(text: np.ndarray, begin: np.ndarray, size: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """(members by class and smallest document, start of each class, members of each class) of equal stretches of
    text: grouped by hash, then compared byte by byte with the first of the group."""
    code = np.zeros(len(begin), np.uint64)
    total, lo = np.cumsum(size), 0
    letters = _spread(np.arange(1, 257, dtype=np.uint64))
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SEGMENT, "right")))
        from_, n = begin[lo], int(total[hi - 1] - begin[lo])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[text[from_ : from_ + n]] * _powers(n))])
        at = begin[lo:hi] - from_
        code[lo:hi] = (sums[at + size[lo:hi]] - sums[at]) * _backs(n)[at]
        lo = hi
    member = np.lexsort((low, code, size))
    new = _changes(size[member], code[member])
    group = np.cumsum(new) - 1
    first, differs = member[np.flatnonzero(new)[group]], np.zeros(len(member), bool)
    for lo in range(0, len(member), 1 << 14):
        own, other = member[lo : lo + (1 << 14)], first[lo : lo + (1 << 14)]
        same = text[_stretches(begin[own], size[own])] == text[_stretches(begin[other], size[own])]
        differs[lo : lo + (1 << 14)] = ~np.logical_and.reduceat(same, np.cumsum(size[own]) - size[own])
    new |= np.isin(group, group[differs])  # one hash, several texts: each on its own
    start = np.flatnonzero(new)
    return member, start, np.diff(np.append(start, len(member)))


def _again(text: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether another window of these stretches may equal it, for each window: those that have a slot of a table by their hash for
    themselves stand once, and need no place in a suffix array. Most do (83 % in the check tables)."""
    letters, slots, total, lo = _spread(np.arange(1, 257, dtype=np.uint64)), [np.zeros(0, np.uint32)], np.cumsum(windows + WINDOW - 1), 0
    bits = min(24, max(10, int(windows.sum()).bit_length() + 2))
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SEGMENT, "right")))
        n = windows[lo:hi]
        width = n + WINDOW - 1
        body = text[_stretches(begin[lo:hi], width)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[body] * _powers(len(body)))])
        at = _stretches(np.cumsum(width) - width, n)
        code = (sums[at + WINDOW] - sums[at]) * _backs(len(body))[at]
        code ^= code >> np.uint64(32)
        code *= _MIX
        slots.append((code >> np.uint64(64 - bits)).astype(np.uint32))
        lo = hi
    slot = np.concatenate(slots)
    return np.bincount(slot, minlength=1 << bits)[slot] > 1


def _cut(chunk: Chunk, codes: dict[int, bytes], runs: dict[int, bytes], buckets: int) -> np.ndarray:
    """Which bytes of the chunk go. The runs name their places, so what was sent is not made again: ``codes`` may be empty."""
    mark, blobs = np.zeros(len(chunk.text) + 1, np.int32), list(runs.values())
    for i in range(0, len(blobs), 256):
        parts, before = [], 0
        for blob in blobs[i : i + 256]:
            raw = _UNZIP.decompress(blob)
            m, n, k = np.frombuffer(raw, np.int64, 3).tolist()
            at = 24 + 12 * m
            parts.append((np.frombuffer(raw, np.int64, m, 24), np.frombuffer(raw, np.uint32, m, 24 + 8 * m).astype(np.int64) + before, np.frombuffer(raw, np.uint32, n, at),
                          np.frombuffer(raw, np.uint32, k, at + 4 * n), *np.frombuffer(raw, np.uint8, 2 * m, at + 4 * (n + k)).reshape(2, -1)))
            before += n
        first, nth, times, place, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
        times, place = times.astype(np.int64), place.astype(np.int64)
        each = times[nth]
        place = place[_stretches((np.cumsum(times) - times)[nth], each)]
        later = chunk.ids[chunk.owner(place)] > np.repeat(first, each)
        place = place[later]
        np.add.at(mark, place + np.repeat(lo, each)[later], 1)
        np.add.at(mark, place + np.repeat(hi, each)[later] + WINDOW, -1)
    return np.cumsum(mark[:-1], dtype=np.int32) > 0


def _removed(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def passages_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, spans, kept)``: each row's bytes, the maximal stretches ``(start, end)`` taken out of them and
    what is left (bytes: a cut may divide a character).

    A byte goes if some ``WINDOW`` bytes around it also stand in a document with a smaller id; copies within
    one id stay. A null id counts as the largest, a null text as empty; texts shorter than a window stay
    whole; repeated rows are cut alike. Texts of any length are read whole, other columns are not read,
    whatever their names. Empty table: empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name = [], 0, TaskContext.get().partitionId() << 33

        def chunk() -> pa.RecordBatch:
            table = pa.concat_tables([pa.Table.from_batches([b]) for b in held])
            blob = Chunk.pack(table["id"].combine_chunks(), table["text"].cast(pa.large_string()).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([blob], pa.binary())], ["chunk", "bytes", "blob"])

        for batch in batches:
            for lo, hi in byte_slices(batch.column("text"), CHUNK):
                part = batch.slice(lo, hi - lo)
                n = sum(map(len, part.column("text").cast(pa.binary()).to_pylist())) + part.num_rows
                if held and size + n > CHUNK:
                    yield chunk()
                    held, size, name = [], 0, name + 1
                held.append(part)
                size += n
        if held:
            yield chunk()

    chunks = written(rows.mapInArrow(tidy(pack), "chunk long, bytes long, blob binary"), "chunks")
    total, n_chunks = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    buckets = max(8, -(-total // BUCKET))

    def by(df: DataFrame, key: str) -> DataFrame:
        """In tasks of about one chunk or bucket each, so none grows with the input, whatever the session's partitions."""
        return df.repartition(min(MOST_TASKS, max(8, n_chunks if key == "chunk" else buckets)), key)


    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                yield _batch([(b, name, x) for b, x in _anchor_rows(Chunk.unpack(blob.as_py()), buckets)])

    def decide(each) -> callable:
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("chunk")
            names, bucket = table["chunk"].to_pylist(), table["bucket"][0].as_py()
            out = pa.Table.from_batches([_batch([(bucket, n, x) for n, x in zip(names, each(table["blob"].to_pylist()), strict=True) if x])])
            freed()
            return out

        return run

    def follow(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_batch([])])
        name, codes = left["chunk"][0].as_py(), _replies(right)
        out = pa.Table.from_batches([_batch([(b, name, x) for b, x in _content_rows(Chunk.unpack(left["blob"][0].as_py()), codes, buckets)])])
        freed()
        return out

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=out_schema)
        chunk = Chunk.unpack(left["blob"][0].as_py())
        gone = _cut(chunk, {}, _replies(right), buckets)
        begin = np.concatenate([[0], chunk.ends[:-1]]).tolist()
        spans, kept = [], []
        for lo, hi in zip(begin, chunk.ends.tolist(), strict=True):
            spans.append(_removed(gone[lo:hi]))
            kept.append(chunk.text[lo:hi][~gone[lo:hi]].tobytes() if spans[-1] else chunk.text[lo:hi].tobytes())
        size = np.diff(np.concatenate([[0], chunk.ends]))
        out = pa.Table.from_arrays([pa.array(chunk.ids, mask=~chunk.known), pa.array(size), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], schema=out_schema)
        freed()
        return out

    out_schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])
    answer = "bucket long, chunk long, blob binary"
    codes = written(by(chunks.mapInArrow(tidy(send), answer), "bucket").groupBy("bucket").applyInArrow(decide(_shared), answer), "codes")
    texts = by(chunks.select("chunk", "blob"), "chunk").groupBy("chunk")
    contents = texts.cogroup(by(codes, "chunk").groupBy("chunk")).applyInArrow(follow, answer)
    runs = written(by(contents, "bucket").groupBy("bucket").applyInArrow(decide(_matches), answer), "runs")
    return texts.cogroup(by(runs, "chunk").groupBy("chunk")).applyInArrow(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, chunk, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "chunk", "blob"])


def _replies(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["bucket"].to_pylist(), table["blob"].to_pylist(), strict=True))
