"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

The method cuts a text into runs of key characters, and scores each long run under two
order-1 character models. A run whose log-likelihood ratio per character and in all speaks for
randomness is a span of kind ``markov``; of any other run its stretches that do are, so ordinary
characters around a key do not hide it. Pattern spans always stay.

Both models learn from labelled strings of all texts, which the base patterns label: what they match is
random, with strings of a seeded generator; words outside their spans are ordinary, and so are the
identifiers that words make in the usual manners (CamelCase, snake_case, kebab-case, path/names). Tasks count
transitions; the driver gets one number for each pair of symbols and class.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.batches import tidy

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
_HINTS = ("passw", "secret", "token", "api")

#: The method scores runs of so many characters on.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
LEAST_STEPS = 19  # of a stretch within a run
_SEPARATORS = "+/_=-"
_SYMBOLS = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
_CODE = np.full(128, len(_SYMBOLS), np.int64)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
#: A run is random from so much log-likelihood ratio on, per step and in all.
PER_STEP, TOTAL = 0.7, 16.0
#: A run with fewer steps than a stretch needs so much more in all for each of them.
SHORT = 1.0


@dataclass(frozen=True)
class Chain:
    """Log-likelihood ratio of each step, random over ordinary; row: the symbol before."""

    ratio: np.ndarray

    def score(self, run: str) -> tuple[float, int]:
        steps = self.steps(run)
        return float(steps.sum()), len(steps)

    def steps(self, run: str) -> np.ndarray:
        x = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
        return self.ratio[x[:-1], x[1:]]


def _stretch(r: np.ndarray) -> tuple[int, int] | None:
    """First and last character of a stretch of the steps ``r`` that is random by both limits; None
    only if no stretch of ``LEAST_STEPS`` is. Linear scans."""
    if len(r) < LEAST_STEPS or r[r > 0].sum() < TOTAL:
        return None
    total = np.concatenate(([0.0], np.cumsum(r)))
    over = total - PER_STEP * np.arange(len(total))
    # the longest stretch of the mean: from the first place not above the end's value
    first = np.searchsorted(-np.minimum.accumulate(over), -over, "left")
    j = int((np.arange(len(over)) - first).argmax())
    i = int(first[j])
    if j - i < LEAST_STEPS:
        return None
    if total[j] - total[i] < TOTAL:  # then it is short: no longer one has the mean, and one as short may have the sum
        best = max(((total[n:] - total[:-n]).max(), n) for n in range(LEAST_STEPS, j - i + 1))
        if best[0] < TOTAL:
            return None
        i = int((total[best[1] :] - total[: -best[1]]).argmax())
        j = i + best[1]
    part = total[i : j + 1]  # its ends that speak against randomness go
    rise = part - np.minimum.accumulate(part)
    b = int(rise.argmax())
    return i + int(part[: b + 1].argmin()), i + b


def stretches(run: str, chain: Chain) -> list[tuple[int, int]]:
    """(start, end) of the random stretches of a run, widened to the separators around them."""
    r, out, todo = chain.steps(run), [], [(0, len(run))]
    while todo:
        lo, hi = todo.pop()
        found = _stretch(r[lo : hi - 1]) if hi - lo > LEAST_STEPS else None
        if found:
            a, b = lo + found[0], lo + found[1] + 1
            while a > lo and run[a - 1] not in _SEPARATORS:
                a -= 1
            while b < hi and run[b] not in _SEPARATORS:
                b += 1
            out.append((a, b))
            todo += [(lo, a), (b, hi)]
    return sorted(out)


_N = len(_SYMBOLS) + 1  # the last for all other bytes
_BYTE = np.concatenate([_CODE, np.full(128, len(_SYMBOLS), np.int64)])
#: Kinds of counts: transitions of random strings; of words; first two symbols of words; last symbol of a word and first of the next.
_RANDOM, _WORD, _HEAD, _JOINT = range(4)
_UP = np.array([_SYMBOLS.find(c.upper()) for c in _SYMBOLS] + [_N - 1])
_LOW = np.array([_SYMBOLS.find(c.lower()) for c in _SYMBOLS] + [_N - 1])


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bincount(a * _N + b, minlength=_N * _N).reshape(_N, _N)


def transitions(text: str) -> np.ndarray:
    """Counts of each kind and pair of symbols in a text; words are runs of two symbols or more outside base spans."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    x, out = _BYTE[data], np.zeros((4, _N, _N), np.int64)
    spans_ = base_spans(text)
    if spans_:
        at = np.cumsum([0, *(len(c.encode("utf-8", "replace")) for c in text)]) if not text.isascii() else np.arange(len(text) + 1)
        x = x.copy()
        for lo, _, hi in spans_:
            own = x[at[lo] : at[hi]]
            value = _BYTE[data[at[lo] : at[hi]]]
            inside = (value[:-1] < _N - 1) & (value[1:] < _N - 1)
            out[_RANDOM] += _pairs(value[:-1][inside], value[1:][inside])
            own[:] = _N - 1
    word = x < _N - 1
    both = word[:-1] & word[1:]
    out[_WORD] = _pairs(x[:-1][both], x[1:][both])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    first, last = edge[::2], edge[1::2] - 1
    first, last = first[last > first], last[last > first]
    out[_HEAD] = _pairs(x[first], x[first + 1])
    out[_JOINT] = _pairs(x[last[:-1]], x[first[1:]])
    return out


def counted(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """:func:`transitions` of all texts together."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * _N * _N, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    total += transitions(t).ravel()
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(tidy(each), "cell long, n long")
    out = np.zeros(4 * _N * _N, np.int64)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most 4 numbers a pair of symbols
        out[r.cell] = r.n
    return out.reshape(4, _N, _N)


def random_strings(n: int = 6000, seed: int = 11) -> list[str]:
    """Labelled samples of the random class: keys of several alphabets and lengths."""
    rng = random.Random(seed)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.hexdigits[:16], string.ascii_letters + string.digits + "_-")
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 64))) for i in range(n)]


def _shown(n: np.ndarray) -> np.ndarray:
    n = n + 0.2
    return np.log(n / n.sum(axis=1, keepdims=True))


def trained(counts: np.ndarray) -> Chain:
    """The two models' ratio, from counts of :func:`transitions`. Of nine words three each also stand in CamelCase,
    snake_case and kebab-case identifiers and in paths, of three words each."""
    words, head, joint = (counts[k].astype(float) for k in (_WORD, _HEAD, _JOINT))
    ordinary, parts, joints = words.copy(), np.zeros_like(words), joint * 2 / 9
    camel = words - head
    np.add.at(camel, (_UP[:, None], _LOW[None, :]), head)
    np.add.at(parts, (_LOW[:, None], _LOW[None, :]), words)
    ordinary += (camel + parts + 2 * words) / 3
    np.add.at(ordinary, (np.arange(_N)[:, None], _UP[None, :]), joints)
    for mark, names in (("_", _LOW), ("-", np.arange(_N)), ("/", np.arange(_N))):
        k = _SYMBOLS.index(mark)
        np.add.at(ordinary, (names, k), joints.sum(axis=1))
        np.add.at(ordinary, (k, names), joints.sum(axis=0))
    # the generator's strings weigh no less than what the patterns found, whatever kinds of those there are
    made, found = sum(transitions_of(s) for s in random_strings()), counts[_RANDOM].astype(float)
    return Chain(_shown(made + found * min(1.0, made.sum() / max(found.sum(), 1.0))) - _shown(ordinary))


def transitions_of(run: str) -> np.ndarray:
    x = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
    return _pairs(x[:-1], x[1:])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, by start and then kind."""
    out = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spans(text: str, chain: Chain) -> list[tuple[int, int, int]]:
    """Base spans and the method's, by start and then kind. A run or stretch inside a base span adds nothing."""
    base = base_spans(text)
    out, seen, reach = list(base), 0, -1

    def covered(a: int, b: int) -> bool:
        """Asked for ascending starts: both lists are merged once."""
        nonlocal seen, reach
        while seen < len(base) and base[seen][0] <= a:
            reach, seen = max(reach, base[seen][2]), seen + 1
        return b <= reach

    for m in RUN.finditer(text):
        a, b = m.span()
        if covered(a, b):
            continue
        total, steps = chain.score(m[0])
        if total >= TOTAL + SHORT * max(0, LEAST_STEPS - steps) and total >= PER_STEP * steps:
            out.append((a, 3, b))
        else:
            out += [(a + x, 3, a + y) for x, y in stretches(m[0], chain) if not covered(a + x, a + y)]
    return sorted(out)


def as_text(found: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: Iterable[tuple[int, int, int]], mark: str = "[{}]") -> str:
    """``text`` with each span, overlapping ones together, replaced by the name of its kind."""
    out, at = [], 0
    for a, k, b in found:
        if a >= at:
            out += [text[at:a], mark.format(KINDS[k])]
        at = max(at, b)
    return "".join(out) + text[at:]


def chain_of(docs: DataFrame, text_col: str = "text") -> Chain:
    """The models, from all texts whole. Null and empty texts add nothing; an empty table leaves the ordinary
    model even."""
    return trained(counted(docs, text_col))


def scanned(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_markov``,
    ``base_sha256``, ``spans``.

    A null text is scanned as empty. Offsets are code points, ends exclusive. Ties of start go by
    kind. Texts of any length are scanned whole; other columns are not read.
    """
    names = ["id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                found = spans(t or "", chain)
                base = as_text(x for x in found if x[1] < 3)
                rows.append((*(sum(k == i for _, k, _ in found) for i in range(4)), hashlib.sha256(base.encode()).hexdigest(), as_text(found)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(tidy(each), "id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redacted_docs(docs: DataFrame, chain: Chain, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs``, all rows and columns, with every secret replaced by the name of its kind; where a
    column counts the text's characters, it counts the new text's. Null texts stay null."""
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redacted(t, spans(t, chain)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(tidy(each), docs.schema)
    return out.withColumn(chars_col, F.coalesce(F.char_length(text_col), F.col(chars_col)).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
