"""Error levels and quality ghosts: what an image loses when it is compressed as JPEG again.

Compression loses at three places: chroma halves its size, coefficients of 8 x 8 cosine blocks are
rounded to multiples of a table, and pixels to whole numbers. All three are done in numpy, without the
lossless coding between them, so no codec is needed and every machine gets the same numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from casefile.operators.images import bounded_rgb, labelled, rgb

# The quantization tables of the JPEG standard's annex, luminance and chrominance, row by row.
LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]).reshape(8, 8)
CHROMA = np.array([
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]).reshape(8, 8)
# Error from which a pixel is suspicious; share of the image from which an area is a hotspot.
BRIGHT, HOTSPOT_SHARE = 50, 0.001
# Qualities tried for ghosts, longest side, block size, and the error differences that count.
GHOST_QUALITIES, GHOST_SIDE, GHOST_BLOCK = (90, 85, 80, 75, 70, 60), 768, 32
GHOST_LEAST_STD, GHOST_LEAST_GAP, GHOST_SHARE = 0.1, 3.0, 0.5

_K, _N = np.arange(8)[:, None], np.arange(8)[None, :]
_DCT = np.where(_K == 0, np.sqrt(1 / 8), np.sqrt(2 / 8) * np.cos(np.pi * _K * (2 * _N + 1) / 16))
_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def table(base: np.ndarray, quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def coefficients(plane: np.ndarray, quantized: np.ndarray) -> np.ndarray:
    """Rounded coefficients of a plane's 8 x 8 blocks, by row and column of blocks; the last ones repeat the edge."""
    h, w = plane.shape
    x = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = x.reshape(x.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
    return np.round(_DCT @ blocks @ _DCT.T / quantized)


def _rounded(plane: np.ndarray, quantized: np.ndarray) -> np.ndarray:
    """A plane after its blocks' coefficients are multiples of the table's."""
    h, w = plane.shape
    found = coefficients(plane, quantized) * quantized
    back = (_DCT.T @ found @ _DCT).transpose(0, 2, 1, 3).reshape(found.shape[0] * 8, -1)
    return np.clip(np.round(back + 128), 0, 255)[:h, :w]


def planes(x: np.ndarray) -> list[np.ndarray]:
    """Luma and the two halved chroma planes of RGB pixels, as whole numbers from 0 to 255."""
    h, w = x.shape[:2]
    ycc = x.astype(np.float64) @ _YCC.T
    out = [np.round(ycc[..., 0])]
    for c in (1, 2):
        even = np.pad(np.round(ycc[..., c] + 128), ((0, h % 2), (0, w % 2)), mode="edge")
        out.append(np.clip(np.round(even.reshape(even.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3))), 0, 255))
    return out


def _enlarged(small: np.ndarray) -> np.ndarray:
    """Twice the size both ways, as decoders do it: three parts of the nearer pixel and one of the next, edges repeated;
    up to two columns are only repeated."""
    if small.shape[1] <= 2:
        return small.repeat(2, 0).repeat(2, 1)
    x = small.astype(np.int64)
    above, below = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    rows = np.stack([3 * x + above, 3 * x + below], axis=1).reshape(2 * len(x), -1)
    left, right = np.concatenate([rows[:, :1], rows[:, :-1]], axis=1), np.concatenate([rows[:, 1:], rows[:, -1:]], axis=1)
    return np.stack([3 * rows + left + 8 >> 4, 3 * rows + right + 7 >> 4], axis=2).reshape(len(rows), -1).astype(np.float64)


def recompressed(x: np.ndarray, quality: int) -> np.ndarray:
    """RGB pixels as a JPEG of that quality with halved chroma gives them back."""
    h, w = x.shape[:2]
    luma, *chroma = planes(x)
    parts = [_rounded(luma, table(LUMA, quality))]
    parts += [_enlarged(_rounded(p, table(CHROMA, quality)))[:h, :w] - 128 for p in chroma]
    return np.clip(np.round(np.stack(parts, axis=2) @ np.linalg.inv(_YCC).T), 0, 255)


def error_levels(x: np.ndarray, quality: int = 95) -> tuple[float, float, float, float, list[tuple[int, int, int, int]]]:
    """(maximum, mean, standard deviation, percent of bright pixels, hotspots) of the channels' mean difference."""
    error = np.abs(x - recompressed(x, min(100, max(90, quality)))).mean(axis=2)
    bright = error > BRIGHT
    return float(error.max()), float(error.mean()), float(error.std()), float(bright.mean() * 100), hotspots(bright)


def hotspots(bright: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2) of areas of bright pixels, widened by four pixels, that are large enough. The area is that
    within the outline through the outer pixels' centers."""
    if not bright.any():
        return []
    wide = np.zeros_like(bright)
    ys, xs = np.nonzero(bright)
    for dy in range(-4, 5):
        for dx in range(-4, 5):
            y, x = ys + dy, xs + dx
            inside = (y >= 0) & (y < bright.shape[0]) & (x >= 0) & (x < bright.shape[1])
            wide[y[inside], x[inside]] = True
    label, n = labelled(wide, diagonal=True)
    around = np.pad(wide, 1)
    outer = wide & ~(around[:-2, 1:-1] & around[2:, 1:-1] & around[1:-1, :-2] & around[1:-1, 2:])
    size, rim = np.bincount(label[wide], minlength=n), np.bincount(label[outer], minlength=n)
    ys, xs = np.nonzero(wide)
    own, out = label[wide], []
    box = [np.full(n, 1 << 30), np.full(n, 1 << 30), np.zeros(n, int), np.zeros(n, int)]
    for at, f, v in zip(box, (np.minimum, np.minimum, np.maximum, np.maximum), (xs, ys, xs + 1, ys + 1), strict=True):
        f.at(at, own, v)
    for k in np.flatnonzero(size - rim / 2 - 1 >= HOTSPOT_SHARE * bright.size):
        out.append(tuple(int(b[k]) for b in box))
    return out


def ghosts(x: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(x, y, quality, gap) of blocks that lose far less at one quality than at the others."""
    x = bounded_rgb(x, GHOST_SIDE)
    h, w = (n // GHOST_BLOCK for n in x.shape[:2])
    if not h or not w:
        return []
    errors = []
    for q in GHOST_QUALITIES:
        gap = np.abs(x - recompressed(x, q)).mean(axis=2)[: h * GHOST_BLOCK, : w * GHOST_BLOCK]
        errors.append(gap.reshape(h, GHOST_BLOCK, w, GHOST_BLOCK).mean(axis=(1, 3)))
    e = np.stack(errors)
    mean, odd = e.mean(axis=0), e.std(axis=0) >= GHOST_LEAST_STD
    hit = (mean - e > GHOST_LEAST_GAP) & (e < GHOST_SHARE * mean) & odd
    first = hit.argmax(axis=0)
    return [(int(b * GHOST_BLOCK), int(a * GHOST_BLOCK), GHOST_QUALITIES[first[a, b]], float(mean[a, b] - e[first[a, b], a, b])) for a, b in zip(*np.nonzero(hit.any(axis=0)), strict=True)]


_ROW = "path string, max_error double, mean_error double, std_error double, bright_percent double, hotspots array<struct<x1:int,y1:int,x2:int,y2:int>>, ghosts array<struct<x:int,y:int,quality:int,gap:double>>"


def measured(images: DataFrame, quality: int = 95) -> DataFrame:
    """One row per image of Spark's ``image`` source: error levels, hotspots and ghosts; the rules over
    them are in ``images``. An image that compression leaves as it is has errors of 0."""

    def each(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                x = rgb(bytes(r.data), r.height, r.width, r.nChannels)
                *numbers, spots = error_levels(x, quality)
                rows.append((r.origin, *numbers, [dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)) for b in spots], [dict(zip(("x", "y", "quality", "gap"), g, strict=True)) for g in ghosts(x)]))
            yield pd.DataFrame(rows, columns=["path", "max_error", "mean_error", "std_error", "bright_percent", "hotspots", "ghosts"])

    return images.select("image.*").select("origin", "height", "width", "nChannels", "data").mapInPandas(each, _ROW)
