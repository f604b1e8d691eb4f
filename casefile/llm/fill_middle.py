"""Fill-in-the-middle transformation: a byte automaton finds units, characters and sentinels in one scan.

A unit is a word with the white space before it; white space at a text's end is a unit of its own. One
table drives the scan: its states are the places in the sentinels' trie, inside a word or between words;
continuation bytes of UTF-8 stay inside the word and count no character. Texts are cut into chunks that
all advance together, a byte a step; a chunk's state at its start is known from the few bytes before it,
since the table forgets what lies further back. Transitions are counted by chunk; a second pass scans
only the chunks that hold a cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.llm.batches import byte_slices, tidy

#: The sentinels of prefix, suffix and middle; white space.
SENTINELS = ("<P>", "<S>", "<M>")
SPACE = b" \t\n\v\f\r"
#: Bytes of a chunk, and of text in one lockstep scan.
CHUNK, MOST = 256, 8 << 20

ENDS, CHARS, FOUND = 0, 20, 40  # bits at which a chunk's counters start


@dataclass(frozen=True)
class Automaton:
    """State 0 lies between words, state 1 in a word outside any sentinel, the others in a sentinel's start."""

    sentinels: tuple[str, ...] = SENTINELS

    @cached_property
    def _trie(self) -> list[bytes]:
        return [b"", *sorted({s.encode()[:i] for s in self.sentinels for i in range(1, len(s.encode()))}, key=lambda p: (len(p), p))]

    @cached_property
    def classes(self) -> np.ndarray:
        """Class of each byte: 0 white space, 1 continuation, 2 other, from 3 on the sentinels' bytes."""
        out = np.full(256, 2, np.uint8)
        out[0x80:0xC0] = 1
        for i, b in enumerate(self._bytes):
            out[b] = 3 + i
        out[list(SPACE)] = 0
        return out

    @cached_property
    def _bytes(self) -> bytes:
        return bytes(sorted({b for s in self.sentinels for b in s.encode()}))

    @property
    def pad(self) -> int:
        """The class of what follows a text's last byte in its chunk: it changes nothing."""
        return 3 + len(self._bytes)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(next state, counts), both at ``state * (pad + 1) + class``."""
        wide, names = self.pad + 1, self._trie
        step, count = np.zeros((len(names) + 1, wide), np.uint8), np.zeros((len(names) + 1, wide), np.int64)
        for state in range(len(names) + 1):
            so_far = names[max(state - 1, 0)]
            for c in range(wide):
                if c == self.pad:
                    step[state, c] = state
                elif c == 0:
                    count[state, c] = (1 << CHARS) + (state > 0)
                elif c == 1:
                    step[state, c] = 1
                else:
                    seen = so_far + self._bytes[c - 3 : c - 2] if c > 2 else b""
                    whole = c > 2 and any(seen.endswith(s.encode()) for s in self.sentinels)
                    rest = next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in names)
                    step[state, c], count[state, c] = 1 + names.index(rest), (1 << CHARS) + (whole << FOUND)
        return step.ravel(), count.ravel()

    @cached_property
    def reach(self) -> int:
        """How many bytes settle the state whatever it was before."""
        step = self.table[0].reshape(-1, self.pad + 1)
        now, n = {frozenset(range(len(step)))}, 0
        while any(len(s) > 1 for s in now):
            now, n = {frozenset(int(step[x, c]) for x in s) for s in now for c in range(self.pad)}, n + 1
        return n


def _chunked(data: np.ndarray, ends: np.ndarray, auto: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes by step and chunk, state of each chunk at its start, first chunk of each text)."""
    starts = np.concatenate([[0], ends[:-1]])
    n = -(-(ends - starts) // CHUNK)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    at = starts[text] + (np.arange(first[-1]) - first[text]) * CHUNK
    padded = np.concatenate([auto.classes[data], np.full(CHUNK, auto.pad, np.uint8)])
    grid = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[at]
    left = ends[text] - at
    grid[np.arange(CHUNK) >= left[:, None]] = auto.pad
    step, wide = auto.table[0], auto.pad + 1
    state = np.zeros(len(at), np.uint8)
    for back in range(auto.reach, 0, -1):
        inside = at - back >= starts[text]
        state = np.where(inside, step[state.astype(np.intp) * wide + padded[np.maximum(at - back, 0)]], state)
    return np.ascontiguousarray(grid.T), state, first


def _scan(grid: np.ndarray, state: np.ndarray, auto: Automaton) -> np.ndarray:
    """Counted transitions of each chunk."""
    step, count = auto.table
    total, wide = np.zeros(grid.shape[1], np.int64), auto.pad + 1
    for row in grid:
        at = state.astype(np.intp) * wide + row
        total += count[at]
        state = step[at]
    return total


def _locate(grid: np.ndarray, state: np.ndarray, nth: np.ndarray, auto: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, characters) in each chunk before its ``nth`` end of a unit, counted from 1."""
    step, count = auto.table
    total, wide, low = np.zeros(grid.shape[1], np.int64), auto.pad + 1, (1 << CHARS) - 1
    place, chars = np.full(len(nth), -1), np.zeros(len(nth), np.int64)
    for i, row in enumerate(grid):
        at = state.astype(np.intp) * wide + row
        after = total + count[at]
        hit = (place < 0) & (after & low == nth)
        place[hit], chars[hit] = i, (total[hit] >> CHARS) & low
        total, state = after, step[at]
    return place, chars


def scan_texts(data: np.ndarray, ends: np.ndarray, auto: Automaton, choose) -> tuple[np.ndarray, ...]:
    """(units, sentinels seen, bytes before each cut, characters before each cut) of texts laid end to end.

    ``choose(units, sentinels)`` gives an array of two columns: after how many units the cuts lie."""
    low = (1 << CHARS) - 1
    grid, state, first = _chunked(data, ends, auto)
    total = _scan(grid, state, auto)
    sums = [np.concatenate([[0], np.cumsum((total >> bit) & low)]) for bit in (ENDS, CHARS, FOUND)]
    size = np.diff(np.concatenate([[0], ends]))
    units = sums[0][first[1:]] - sums[0][first[:-1]] + (size > 0)
    seen = sums[2][first[1:]] - sums[2][first[:-1]]
    cut = choose(units, seen)
    length = sums[1][first[1:]] - sums[1][first[:-1]]
    at, chars = np.where(cut == units[:, None], size[:, None], 0), np.where(cut == units[:, None], length[:, None], 0)
    inner = np.argwhere((cut > 0) & (cut < units[:, None]))
    if len(inner):
        text = inner[:, 0]
        nth = sums[0][first[text]] + cut[tuple(inner.T)]
        chunk = np.searchsorted(sums[0][1:], nth)
        place, before = _locate(np.ascontiguousarray(grid[:, chunk]), state[chunk], nth - sums[0][chunk], auto)
        at[tuple(inner.T)] = (chunk - first[text]) * CHUNK + place
        chars[tuple(inner.T)] = sums[1][chunk] - sums[1][first[text]] + before
    return units, seen, at, chars


SCHEMA = "id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


def transformed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, percent_spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)``: each text, or what a model learns filling from.

    The choices of a row hang on the seed and its id alone (null: as an empty one), so a rerun gives the
    same output. A null text counts as empty; empty texts, and texts that hold a sentinel, stay plain.
    Texts of any length are scanned whole, repeated rows come out alike, other columns are not read,
    whatever their names. Empty table: empty result. Sentinels: ASCII without white space.
    """
    auto, marks = Automaton(sentinels), [s.encode() for s in sentinels]
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), draw.alias("_d")).select("id", "text", *groups)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.binary())
        raw = texts.to_pylist()
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(t) for t in raw])
        h = np.stack([batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)])
        plain = np.zeros(len(raw), bool)

        def choose(units: np.ndarray, seen: np.ndarray) -> np.ndarray:
            plain[:] = (units == 0) | (seen > 0) | (h[2] % 100 >= percent)
            return np.sort(h[:2] % (units + 1), axis=0).T * ~plain[:, None]

        units, _, at, chars = scan_texts(data, ends, auto, choose)
        spm, out = h[3] % 100 < percent_spm, []
        for t, (a, b), p, s in zip(raw, at.tolist(), plain.tolist(), spm.tolist(), strict=True):
            if p:
                out.append(t)
            elif s:
                out.append(b"".join((marks[1], t[b:], marks[0], t[:a], marks[2], t[a:b])))
            else:
                out.append(b"".join((marks[0], t[:a], marks[1], t[b:], marks[2], t[a:b])))
        number = lambda v: pa.array(v, pa.int64(), mask=plain)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(units, pa.int64()), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
             number(chars[:, 0]), number(chars[:, 1] - chars[:, 0]), pa.array(out, pa.binary()).cast(pa.string())],
            ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column("text"), MOST):
                yield run(batch.slice(lo, hi - lo))

    return rows.mapInArrow(tidy(each), SCHEMA.format(id=rows.schema["id"].dataType.simpleString()))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that gave ``output``: each sentinel stands there once, since texts that hold one stay plain."""
    p, s, m = sentinels
    before = lambda t, mark: F.substring_index(t, mark, 1)
    after = lambda t, mark: F.substring_index(t, mark, -1)
    psm = F.concat(after(before(output, s), p), after(output, m), before(after(output, s), m))
    spm = F.concat(after(before(output, m), p), after(output, m), after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
