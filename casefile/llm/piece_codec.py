"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut into words (a run of space marks and what follows it); no piece crosses from other
characters into a space mark, which is checked when a model is loaded. The different words of a
batch are encoded together by length: words of equal length advance one character at a time as rows
of a matrix, substrings are looked up by probing the sorted hashes of the pieces, and each step takes
the vectorised maximum over the piece lengths and stores backpointers.

Unigram models: the maximum is that of the summed scores. BPE models have no additive score. But a
sequence of pieces is what their merges make exactly if each two neighbours are, so every prefix
of a word has one last piece that agrees with the piece before it: the maximum is taken over the
pieces that agree. Two pieces agree if, while each is merged on its own, nothing at their border
would be merged first; the pieces at the border at any time are the right ends of the left
piece and the left ends of the right one, which a table made at loading lists with the scores
that make and end them.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.batches import byte_slices, tidy

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_ODD = f"  |^ | $|{SPACE}"
_P = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a word from which on it is encoded alone, its numbers in lists: as a row of a matrix it would be the only one.
LONG_WORD = 256
#: Slots of the cache of pairs of pieces that agree or not.
_SLOTS = 1 << 20
#: Places of the table of marks, one for each end of a piece's hash.
_MARKS = 1 << 20
#: The types of pieces and models in a SentencePiece model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if (kind := tag & 7) == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    unknown: int = 0
    keys: np.ndarray = field(init=False)
    key_ids: np.ndarray = field(init=False)
    bytes_at: np.ndarray = field(init=False)

    def __post_init__(self):
        if any(SPACE in p.lstrip(SPACE) for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL):
            raise ValueError("a piece holds a space mark after another character")
        ids = np.flatnonzero(self.types == NORMAL)
        keys = np.array([_hash(self.pieces[i]) for i in ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        self.marked = np.zeros(_MARKS, bool)
        self.marked[keys & np.uint64(_MARKS - 1)] = True
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.bytes_at = np.full(256, self.unknown)
        for i in np.flatnonzero(self.types == BYTE):
            self.bytes_at[int(self.pieces[i][3:5], 16)] = i
        self.longest = max((len(self.pieces[i]) for i in ids), default=1)
        self.lowest = float(self.scores[ids].min()) if len(ids) else 0.0
        self.merges = Merges(self) if self.kind == BPE else None

    @classmethod
    def load(cls, data: bytes) -> PieceModel:
        pieces, scores, types, options = [], [], [], {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                types.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                options |= {"kind": trainer.get(3, UNIGRAM), "byte_fallback": bool(trainer.get(35, 0)), "unknown": trainer.get(40, 0)}
                if trainer.get(24, 0):
                    raise ValueError("space marks as suffixes are not supported")
            elif number == 3:
                form = dict(_fields(value))
                options["dummy_prefix"] = bool(form.get(3, 1))
                if form.get(2) or form.get(4, 1) or not form.get(5, 1):
                    raise ValueError("only identity normalization that keeps all spaces is supported")
        if USER in types or UNUSED in types or options.get("kind") not in (UNIGRAM, BPE):
            raise ValueError("user-defined or unused pieces, and word or character models, are not supported")
        return cls(pieces, np.array(scores), np.array(types), **options)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 if none. Most hashes without a piece fail at a table of marks, unsearched."""
        out, some = np.full(len(keys), -1), np.flatnonzero(self.marked[keys & np.uint64(_MARKS - 1)])
        if len(self.keys):
            own = keys[some]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == own, self.key_ids[at], -1)
        return out


def _hash(piece: str) -> np.uint64:
    x = _prefixes(np.array([[ord(c) for c in piece]], np.uint64))
    return _between(x, np.zeros(1, int), np.zeros(1, int), np.full(1, len(piece)), _powers(len(piece)))[0]


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _P))), dtype=np.uint64)


def _prefixes(chars: np.ndarray) -> np.ndarray:
    """Hash of each row's first 0, 1, ... characters."""
    out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
    for j in range(chars.shape[1]):
        out[:, j + 1] = out[:, j] * _P + chars[:, j] + np.uint64(1)
    return out


def _between(h: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Hash of characters lo to hi of rows of ``h``, mixed with their number."""
    n = hi - lo
    return (h[row, hi] - h[row, lo] * power[n]) ^ (n.astype(np.uint64) << np.uint64(57))


class Merges:
    """Which pieces of a BPE model may stand side by side."""

    def __init__(self, m: PieceModel):
        self.m, n = m, len(m.pieces)
        ids = [int(i) for i in np.flatnonzero(m.types == NORMAL)]
        self.ids = {m.pieces[i]: i for i in ids}
        if any(c not in self.ids for i in ids for c in m.pieces[i]):
            raise ValueError("a piece holds a character that is no piece")
        self.score = m.scores.astype(float)
        self.born = [float("inf") if len(p) == 1 else s for p, s in zip(m.pieces, self.score.tolist(), strict=True)]
        #: Of each piece the pieces at its ends while it is merged, itself first, each with the score of what ends it there.
        self.rights: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        self.lefts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for i in sorted(ids, key=lambda i: (len(m.pieces[i]) > 1, -self.score[i])):
            p, ended = m.pieces[i], -float("inf")
            if len(p) == 1:
                self.rights[i], self.lefts[i] = [(i, ended)], [(i, ended)]
                continue
            made = float(self.score[i])
            for cut in range(1, len(p)):
                x, y = self.ids.get(p[:cut], -1), self.ids.get(p[cut:], -1)
                if x >= 0 and y >= 0 and self.rights[x] and self.lefts[y] and self._agree(x, y, made):
                    self.rights[i] = [(i, ended), (y, made), *self.rights[y][1:]]
                    self.lefts[i] = [(i, ended), (x, made), *self.lefts[x][1:]]
                    break  # else the merges never make this piece
        self.made = np.array([bool(r) for r in self.rights])
        deep = max(map(len, self.rights + self.lefts), default=1)
        self.right, self.right_end = self._table(self.rights, deep)
        self.left, self.left_end = self._table(self.lefts, deep)
        self.births = np.array(self.born)
        self.sizes = np.array([len(p) for p in m.pieces])
        power = _powers(int(self.sizes.max(initial=1)))
        self.power, self.hash = power[self.sizes], np.zeros(n, np.uint64)
        for i in ids:
            self.hash[i] = _prefixes(np.array([[ord(c) for c in m.pieces[i]]], np.uint64))[0, -1]
        self.seen, self.answer = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)
        self.known: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _table(ends: list[list[tuple[int, float]]], deep: int) -> tuple[np.ndarray, np.ndarray]:
        ids, score = np.full((len(ends), deep), -1), np.full((len(ends), deep), -np.inf)
        for i, own in enumerate(ends):
            for k, (x, end) in enumerate(own):
                ids[i, k], score[i, k] = x, end
        return ids, score

    def _agree(self, a: int, b: int, made: float = -float("inf")) -> bool:
        """Whether nothing at the border of a and b is merged before ``made`` ends them. Of equal scores the left goes first."""
        for x, x_end in self.rights[a]:
            x_end = max(x_end, made)
            for y, y_end in self.lefts[b]:
                y_end = max(y_end, made)
                if self.born[y] > x_end and self.born[x] >= y_end:  # both are there at some time
                    k = self.ids.get(self.m.pieces[x] + self.m.pieces[y])
                    if k is not None and self.score[k] > x_end and self.score[k] >= y_end:
                        return False
        return True

    def agree_one(self, a: int, b: int) -> bool:
        if (found := self.known.get((a, b))) is None:
            if len(self.known) >= _SLOTS:
                self.known.clear()
            found = self.known[a, b] = self._agree(a, b)
        return found

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`_agree` for arrays of pieces, through a cache."""
        key = a.astype(np.int64) * len(self.sizes) + b
        slot = ((key.astype(np.uint64) * _P) >> np.uint64(44)).astype(np.int64) & (_SLOTS - 1)
        out, miss = self.answer[slot], np.flatnonzero(self.seen[slot] != key)
        if len(miss):
            new, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            own = miss[first]
            found = ~self._clash(a[own], b[own])
            self.seen[slot[own]], self.answer[slot[own]] = new, found
            out[miss] = found[back]
        return out

    def _clash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for i in range(self.right.shape[1]):
            left = np.flatnonzero((self.right[a, i] >= 0) & ~out)
            for k in range(self.left.shape[1]):
                left = left[(self.left[b[left], k] >= 0)]
                if not len(left):
                    break
                x, y, x_end, y_end = self.right[a[left], i], self.left[b[left], k], self.right_end[a[left], i], self.left_end[b[left], k]
                both = (self.births[y] > x_end) & (self.births[x] >= y_end)
                at, x, y, x_end, y_end = left[both], x[both], y[both], x_end[both], y_end[both]
                key = (self.hash[x] * self.power[y] + self.hash[y]) ^ ((self.sizes[x] + self.sizes[y]).astype(np.uint64) << np.uint64(57))
                found = self.m.find(key)
                score = np.where(found >= 0, self.score[found], -np.inf)
                out[at[(score > x_end) & (score >= y_end) & (found >= 0)]] = True
        return out


def _viterbi(chars: np.ndarray, m: PieceModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best segmentation of each row, of equally good ones that with the longest last piece: the number of its
    pieces, then row by row their ends and ids (-1 for a character without a piece)."""
    w, n = chars.shape
    h, power, rows = _prefixes(chars), _powers(n), np.arange(w)
    best, back, last = np.zeros((n + 1, w)), np.zeros((n + 1, w), np.int64), np.full((n + 1, w), -1)
    h = np.ascontiguousarray(h.T)
    for j in range(1, n + 1):
        sizes = np.arange(min(m.longest, j), 0, -1)
        lengths = sizes.astype(np.uint64)[:, None]
        ids = m.find(((h[j] - h[j - sizes] * power[sizes][:, None]) ^ (lengths << np.uint64(57))).ravel()).reshape(len(sizes), w)
        if m.merges:
            k, row = np.nonzero(ids >= 0)
            found, before = ids[k, row], last[j - sizes[k], row]
            ok = m.merges.made[found]
            inner = np.flatnonzero(ok & (before >= 0))  # before others stands nothing, or what merges with nothing
            ok[inner] = m.merges.agree(before[inner], found[inner])
            options = np.full((len(sizes), w), -np.inf)
            options[k[ok], row[ok]] = sizes[k[ok]]
            options[-1, ids[-1] < 0] = 1
        else:
            none = np.where(sizes == 1, m.lowest - _UNKNOWN_PENALTY, -np.inf)[:, None]
            options = best[j - sizes] + np.where(ids >= 0, m.scores[ids], none)
        k = options.argmax(axis=0)
        best[j], back[j], last[j] = options[k, rows], j - sizes[k], ids[k, rows]
    if m.merges and not np.isfinite(best[1:]).all():
        raise ValueError("no pieces of the model agree on a word")
    ends, ids, at = [], [], np.full(w, n)
    while at.any():  # all rows go back together; those at their start wait
        ends.append(at)
        ids.append(np.where(at > 0, last[at, rows], -2))
        at = np.where(at > 0, back[at, rows], 0)
    ends, ids = np.array(ends[::-1]).T, np.array(ids[::-1]).T
    own = ids > -2
    return own.sum(axis=1), ends[own], ids[own]


def _viterbi_long(word: str, m: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """(ends, ids) of one long word, as :func:`_viterbi`: substrings are looked up in slices, steps taken in lists."""
    n, step = len(word), 1 << 15
    chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    best, back, last = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    agree, scores = m.merges.agree_one if m.merges else None, m.scores.tolist()
    for lo in range(0, n, step):
        first, hi = max(0, lo - m.longest + 1), min(n, lo + step)
        h, power = _prefixes(chars[None, first:hi]), _powers(hi - first)
        ends = np.arange(lo + 1, hi + 1) - first
        table = []
        for size in range(min(m.longest, hi), 0, -1):
            own = np.maximum(ends - size, 0)
            found = m.find(_between(h, np.zeros(len(ends), int), own, ends, power))
            if m.merges:
                found = np.where(m.merges.made[found], found, -1)
            table.append(np.where(ends - size + first < 0, -1, found))
        at, k = np.nonzero(np.array(table).T >= 0)
        pieces, sizes = np.array(table).T[at, k].tolist(), (min(m.longest, hi) - k).tolist()
        cuts = np.searchsorted(at, np.arange(len(ends) + 1)).tolist()
        for i in range(len(ends)):
            j, top, where, which, single = lo + i + 1, -float("inf"), -1, -1, False
            for c in range(cuts[i], cuts[i + 1]):
                size, piece = sizes[c], pieces[c]
                single |= size == 1
                before = last[j - size]
                value = best[j - size] + scores[piece] if agree is None else float(size) if before < 0 or agree(before, piece) else -1.0
                if value > top:
                    top, where, which = value, j - size, piece
            if not single:
                value = best[j - 1] + m.lowest - _UNKNOWN_PENALTY if agree is None else 1.0
                if value > top:
                    top, where, which = value, j - 1, -1
            if agree is not None and top < 0:
                raise ValueError("no pieces of the model agree on a word")
            best[j], back[j], last[j] = top, where, which
    ends = [n]
    while back[ends[-1]]:
        ends.append(back[ends[-1]])
    return np.array(ends[::-1]), np.array([last[e] for e in ends[::-1]])


def _encoded(words: list[str], m: PieceModel) -> list[list[int]]:
    """Ids of each word (with its space marks), equal lengths together."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out: list[list[int]] = [[]] * len(words)
    for n in np.unique(size[size > 0]):
        own = np.flatnonzero(size == n)
        for at in range(0, len(own), max(1, (1 << 20) // int(n))):
            part = own[at : at + max(1, (1 << 20) // int(n))]
            chars = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n).astype(np.uint64)
            if n > LONG_WORD:
                found = [_viterbi_long(words[i], m) for i in part]
                counts, ends, ids = np.array([len(e) for e, _ in found]), np.concatenate([e for e, _ in found]), np.concatenate([x for _, x in found])
            else:
                counts, ends, ids = _viterbi(chars, m)
            stops, listed = np.cumsum(counts), ids.tolist()
            odd = {int(k) for k in np.searchsorted(stops, np.flatnonzero(ids < 0), "right")}
            before = 0
            for k, (i, stop) in enumerate(zip(part.tolist(), stops.tolist(), strict=True)):
                own_ids = listed[before:stop]
                out[i] = _fallback(own_ids, words[i], [0, *ends[before:stop].tolist()], m) if k in odd else own_ids
                before = stop
    return out


def _fallback(ids: list[int], word: str, edge: list[int], m: PieceModel) -> list[int]:
    """Characters without a piece, as byte pieces, or runs of them as one unknown."""
    out, was = [], False
    for piece, lo, hi in zip(ids, edge, edge[1:], strict=False):
        if piece >= 0:
            out.append(piece)
        elif m.byte_fallback:
            out += m.bytes_at[list(word[lo:hi].encode("utf-8", "surrogatepass"))].tolist()
        elif not was:
            out.append(m.unknown)
        was = piece < 0
    return out


def encode(texts: pa.StringArray, m: PieceModel) -> pa.ListArray:
    """Ids of each text; null and empty texts have none."""
    texts = texts.fill_null("")
    odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(texts, "")).to_numpy(zero_copy_only=False) | (not m.dummy_prefix)
    cut = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    coded = cut.flatten().dictionary_encode()
    words = [SPACE + w for w in coded.dictionary.to_pylist()]
    index = {w: i for i, w in enumerate(words)} if odd.any() else {}
    plain, plain_at = coded.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
    parts, p = [], 0
    for text, o in zip(texts.filter(pa.array(odd)).to_pylist() if odd.any() else [], odd[odd], strict=True):
        marked = ((SPACE if m.dummy_prefix and text else "") + text).replace(" ", SPACE)
        parts.append(np.array([index.setdefault(w, len(index)) for w in _WORD.findall(marked)], np.int64))
    words += list(index)[len(words) :]
    ids = _encoded(words, m)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))))
    order, odds = [], iter(parts)
    for o in odd:
        if o:
            order.append(next(odds))
        else:
            order.append(plain[plain_at[p] : plain_at[p + 1]])
            p += 1
    take = np.concatenate(order) if order else np.empty(0, np.int64)
    ends = np.cumsum(np.fromiter((sizes[x].sum() for x in order), np.int64, len(order)))
    return pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), flat.take(pa.array(take)).flatten())


def decode(ids: pa.ListArray, m: PieceModel) -> list[str]:
    """Text of each list: byte pieces are joined before they are decoded, control pieces vanish."""
    shown = [bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else p.replace(SPACE, " ").encode() for p, t in zip(m.pieces, m.types, strict=True)]
    parts = pa.array(shown, pa.binary()).take(ids.flatten())
    sizes = np.concatenate(([0], np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))))
    flat = memoryview(parts.buffers()[2] or b"")  # what take() gathered lies end to end
    at = sizes[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
    out = []
    for lo, hi in zip(at, at[1:], strict=False):
        data = bytes(flat[lo:hi])
        out.append((data[1:] if m.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace"))
    return out


@cache
def _model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel.load(f.read())


def tokenized(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids, round_trip)`` for every row: the text's pieces, and whether decoding them
    gives the text again. A null or empty text has no pieces. Whole texts, in slices of a batch that
    bound memory; the model file is a public one that every machine has at ``model_path``. Ties go to the
    longest last piece; repeated rows each keep a row; other columns are not read. Empty table: empty result."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model_path)
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), 16 << 20):
                texts = batch.column(1).slice(lo, hi - lo)
                ids = encode(texts, m)
                same = [a == (b or "") for a, b in zip(decode(ids, m), texts.to_pylist(), strict=True)]
                n = pc.list_value_length(ids).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), n, ids, pa.array(same, pa.bool_())], names=["id", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(tidy(each), "id long, n_tokens long, ids array<int>, round_trip boolean")
