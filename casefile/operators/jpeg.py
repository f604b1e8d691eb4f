"""Baseline JPEG files of pixel arrays, with numpy alone: the coefficients of ``recompression``, coded.

Chroma is halved both ways. Code tables are made for each image from how often its symbols occur.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from casefile.operators.recompression import CHROMA, LUMA, coefficients, planes, table

#: Places of an 8 x 8 block in the order in which they are coded: along diagonals, turning at the edges.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
LONGEST, END_OF_BLOCK, ZEROS = 16, 0x00, 0xF0


def _blocks(plane: np.ndarray, quantized: np.ndarray, size: int) -> np.ndarray:
    """Coefficients by row and column of blocks, in coding order, the plane widened to multiples of ``size`` pixels."""
    h, w = plane.shape
    wide = np.pad(plane, ((0, -h % size), (0, -w % size)), mode="edge")
    found = coefficients(wide, quantized).astype(np.int64)
    return found.reshape(*found.shape[:2], 64)[..., ZIGZAG]


def _lengths(counts: np.ndarray) -> dict[int, int]:
    """Code length of each symbol that occurs, at most ``LONGEST``; a place is left over, since no code may be all ones."""
    shrunk = counts.astype(np.int64)
    while True:
        heap = [(1, -1, (256,))] + [(int(n), s, (s,)) for s, n in enumerate(shrunk) if n]
        heapq.heapify(heap)
        length = dict.fromkeys([256, *np.flatnonzero(shrunk).tolist()], 0)
        while len(heap) > 1:
            (n, a, x), (m, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                length[s] += 1
            heapq.heappush(heap, (n + m, a, x + y))
        if max(length.values()) <= LONGEST:
            return length
        shrunk = np.where(shrunk > 0, shrunk // 2 + 1, 0)  # flatter counts give shorter codes


def _code(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(the table as a file holds it, code and length of each symbol); codes ascend with length, the reserved one last."""
    length = _lengths(counts)
    longest = max(length.values())
    order = sorted((s for s in length if s != 256), key=lambda s: (length[s], s))
    sizes = {s: length[s] for s in order}
    # the reserved place must be the last of the longest codes: its length goes to the symbol that takes its place
    if length[256] < longest and order:
        sizes[order[-1]] = length[256]
        order.sort(key=lambda s: (sizes[s], s))
    codes, sized, code, before = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= sizes[s] - before
        codes[s], sized[s], before = code, sizes[s], sizes[s]
        code += 1
    numbers = [sum(v == n for v in sizes.values()) for n in range(1, LONGEST + 1)]
    return bytes(numbers) + bytes(order), codes, sized


def _category(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, place, symbol, value, whether a first coefficient) of all that is coded, in order; first coefficients as differences."""
    n = len(blocks)
    row, at = np.nonzero(blocks[:, 1:])
    at = at + 1
    begins = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    run = at - np.where(begins, 0, np.concatenate([[0], at[:-1]]) if len(at) else at) - 1
    value = blocks[row, at]
    zeros = run // 16
    of = np.repeat(np.arange(len(row)), zeros)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, row, at)
    ended = np.flatnonzero(last < 63)
    parts = [
        (np.arange(n), np.zeros(n, np.int64), _category(blocks[:, 0]), blocks[:, 0], np.ones(n, bool)),
        (row, 2 * at, run % 16 * 16 + _category(value), value, np.zeros(len(row), bool)),
        (row[of], 2 * at[of] - 1, np.full(len(of), ZEROS), np.zeros(len(of), np.int64), np.zeros(len(of), bool)),
        (ended, np.full(len(ended), 200), np.full(len(ended), END_OF_BLOCK), np.zeros(len(ended), np.int64), np.zeros(len(ended), bool)),
    ]
    found = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort((found[1], found[0]))
    return tuple(c[order] for c in found)


def _bits(codes: np.ndarray, sizes: np.ndarray) -> bytes:
    total = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = total[owner] - 1 - np.arange(total[-1])
    bits = (codes[owner] >> left & 1).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def encoded(x: np.ndarray, quality: int = 90) -> bytes:
    """RGB pixels as a JPEG file of that quality; at least one pixel and at most 65,535 either way."""
    h, w = x.shape[:2]
    tables = [table(LUMA, quality), table(CHROMA, quality)]
    parts = planes(x)
    luma = _blocks(parts[0], tables[0], 16)
    small = [_blocks(p, tables[1], 8) for p in parts[1:]]
    rows, cols = luma.shape[0] // 2, luma.shape[1] // 2
    units = np.concatenate([luma.reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows * cols, 4, 64), *(s.reshape(rows * cols, 1, 64) for s in small)], axis=1)
    for own in (slice(0, 4), slice(4, 5), slice(5, 6)):  # each plane's first coefficients follow one another
        first = units[:, own, 0].reshape(-1)
        units[:, own, 0] = np.diff(first, prepend=0).reshape(units[:, own, 0].shape)
    block, _, symbol, value, dc = _symbols(units.reshape(-1, 64))
    chroma = block % 6 >= 4
    code, size, files = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), b""
    for c in (0, 1):
        for ac in (0, 1):
            own = (chroma == bool(c)) & (dc != bool(ac))
            held, codes, sizes = _code(np.bincount(symbol[own], minlength=256))
            code[own], size[own] = codes[symbol[own]], sizes[symbol[own]]
            files += b"\xff\xc4" + struct.pack(">HB", 3 + len(held), ac << 4 | c) + held
    more = np.where(dc, symbol, symbol & 15)
    extra = np.where(value < 0, value + (1 << more) - 1, value)
    head = b"\xff\xd8\xff\xe0" + struct.pack(">H5sHBHHBB", 16, b"JFIF\0", 0x0101, 0, 1, 1, 0, 0)
    for c in (0, 1):
        head += b"\xff\xdb" + struct.pack(">HB", 67, c) + bytes(tables[c].astype(int).ravel()[ZIGZAG].tolist())
    head += b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    scan = b"\xff\xda" + struct.pack(">HB", 12, 3) + bytes([1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])
    return head + files + scan + _bits(code << more | extra, size + more) + b"\xff\xd9"
