"""Images made fit for recognition: orientation, tilt, light, noise and size, in that order.

Each step is a function of RGB pixels; :func:`prepared` chains those that are asked for, inside one
Arrow UDF, so pixels never become rows. Pictures leave as PNG, which needs no codec but zlib.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from casefile.operators.images import quality_numbers, rgb
from casefile.operators.jpeg import encoded

# Light below and above which an image is corrected, and the bounds of the correction.
DARK, LIGHT, LEAST_FACTOR, MOST_FACTOR = 0.3, 0.7, 0.5, 2.0
# Contrast that is raised, blur that is sharpened, and by how much.
FLAT, BLURRY, BOOST = 0.3, 100.0, 1.5
# Shorter sides under which an image is enlarged, and how many times.
ENLARGE = [(320, 3), (640, 2)]
# Tilt in degrees that is looked for, and from which on it is corrected.
MOST_TILT, LEAST_TILT = 15.0, 0.5
# Strength, template and window of noise reduction.
NOISE, TEMPLATE, WINDOW = 6.0, 7, 21

#: Of each EXIF orientation: quarter turns counter-clockwise, then whether left and right change places.
_TURNS = {2: (0, True), 3: (2, False), 4: (2, True), 5: (1, True), 6: (3, False), 7: (3, True), 8: (1, False)}


def oriented(x: np.ndarray, orientation: int | None) -> np.ndarray:
    turns, mirrored = _TURNS.get(orientation or 1, (0, False))
    x = np.rot90(x, turns)
    return x[:, ::-1] if mirrored else x


def _luma(x: np.ndarray) -> np.ndarray:
    return x @ np.array([0.299, 0.587, 0.114])


def _mixed(base: np.ndarray, x: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(np.round(base + (x - base) * factor), 0, 255)


def enhanced(x: np.ndarray) -> tuple[np.ndarray, bool]:
    """Light towards the middle, contrast and sharpness raised, as the image's own numbers ask for it."""
    blur, light, contrast, _ = quality_numbers(_luma(x))
    before = x
    if light < DARK:
        x = _mixed(np.zeros_like(x), x, min(MOST_FACTOR, DARK / max(light, 0.1)))
    elif light > LIGHT:
        x = _mixed(np.zeros_like(x), x, max(LEAST_FACTOR, LIGHT / light))
    if contrast < FLAT:
        x = _mixed(np.full_like(x, np.floor(np.round(_luma(x)).mean() + 0.5)), x, BOOST)
    if 0 < blur < BLURRY:
        smooth = x.copy()
        parts = np.lib.stride_tricks.sliding_window_view(x, (3, 3), axis=(0, 1))
        if parts.size:
            smooth[1:-1, 1:-1] = (parts.sum(axis=(3, 4)) + 4 * x[1:-1, 1:-1]) / 13
        x = _mixed(smooth, x, BOOST)
    return x, x is not before


def tilt(x: np.ndarray) -> float:
    """Degrees by which the nearly horizontal edges are turned: the main axis of the gradients across them, of a
    picture smoothed so that steps along an edge do not count. 0 where there are too few."""
    y = _luma(x)
    for _ in range(2):
        p = np.pad(y, 1, mode="edge")
        y = sum(p[i : i + y.shape[0], j : j + y.shape[1]] for i in range(3) for j in range(3)) / 9
    if min(y.shape) < 2:
        return 0.0
    gy, gx = np.gradient(y)
    own = (np.hypot(gx, gy) > 20) & (np.abs(gx) < np.tan(np.radians(2 * MOST_TILT)) * np.abs(gy))
    if own.sum() < 100:
        return 0.0
    gx, gy = gx[own], gy[own]
    across = 0.5 * np.degrees(np.arctan2(2 * (gx * gy).sum(), (gx * gx - gy * gy).sum()))
    along = (across + 180) % 180 - 90
    return float(along) if abs(along) < MOST_TILT else 0.0


def rotated(x: np.ndarray, degrees: float) -> np.ndarray:
    """Turned around the center, bilinear, the rim repeated; size unchanged."""
    h, w = x.shape[:2]
    cy, cx, a = h // 2, w // 2, np.radians(degrees)
    ys, xs = np.mgrid[:h, :w].astype(np.float64)
    u = np.clip(np.cos(a) * (xs - cx) - np.sin(a) * (ys - cy) + cx, 0, w - 1)
    v = np.clip(np.sin(a) * (xs - cx) + np.cos(a) * (ys - cy) + cy, 0, h - 1)
    left, top = np.minimum(u.astype(int), max(w - 2, 0)), np.minimum(v.astype(int), max(h - 2, 0))
    right, low = np.minimum(left + 1, w - 1), np.minimum(top + 1, h - 1)
    p, q = (u - left)[..., None], (v - top)[..., None]
    return np.round((x[top, left] * (1 - p) + x[top, right] * p) * (1 - q) + (x[low, left] * (1 - p) + x[low, right] * p) * q)


def straightened(x: np.ndarray) -> np.ndarray:
    by = tilt(x)
    return rotated(x, by) if abs(by) >= LEAST_TILT else x


def denoised(x: np.ndarray) -> np.ndarray:
    """Non-local means: each pixel is the mean of those of its window whose surroundings are like its own."""
    reach, half = WINDOW // 2, TEMPLATE // 2
    wide = np.pad(x, ((reach, reach), (reach, reach), (0, 0)), mode="reflect" if min(x.shape[:2]) > reach else "edge")
    total, weight = np.zeros_like(x), np.zeros(x.shape[:2])
    for dy in range(WINDOW):
        for dx in range(WINDOW):
            moved = wide[dy : dy + x.shape[0], dx : dx + x.shape[1]]
            gap = ((x - moved) ** 2).mean(axis=2)
            sums = np.pad(np.pad(gap, half, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            box = sums[TEMPLATE:, TEMPLATE:] - sums[:-TEMPLATE, TEMPLATE:] - sums[TEMPLATE:, :-TEMPLATE] + sums[:-TEMPLATE, :-TEMPLATE]
            w = np.exp(-np.maximum(box, 0) / TEMPLATE**2 / NOISE**2)
            total += w[..., None] * moved
            weight += w
    return np.round(total / weight[..., None])


def _lanczos(n: int, size: int) -> np.ndarray:
    """Weights of ``n`` pixels for each of ``size``."""
    scale = max(1.0, n / size)
    gap = ((np.arange(size)[:, None] + 0.5) * n / size - 0.5 - np.arange(n)[None, :]) / scale
    w = np.where(np.abs(gap) < 3, np.sinc(gap) * np.sinc(gap / 3), 0)
    return w / w.sum(axis=1, keepdims=True)


def scaled(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Lanczos, over three pixels to each side."""
    rows = np.tensordot(_lanczos(x.shape[0], height), x, axes=(1, 0))
    return np.clip(np.round(np.tensordot(_lanczos(x.shape[1], width), rows, axes=(1, 1)).transpose(1, 0, 2)), 0, 255)


def enlarged(x: np.ndarray) -> np.ndarray:
    times = next((t for least, t in ENLARGE if min(x.shape[:2]) < least), 1)
    return x if times == 1 else scaled(x, x.shape[0] * times, x.shape[1] * times)


def thumbnail(x: np.ndarray, most: int) -> np.ndarray:
    h, w = x.shape[:2]
    return x if max(h, w) <= most else scaled(x, max(1, round(h * most / max(h, w))), max(1, round(w * most / max(h, w))))


def png(x: np.ndarray) -> bytes:
    h, w = x.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), x.astype(np.uint8).reshape(h, -1)], axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


STEPS = ("rotate", "deskew", "enhance", "denoise", "upscale")


def prepared(images: DataFrame, steps: tuple[str, ...] = STEPS, most: int | None = 2048, orientation: str | None = None, form: str = "png", quality: int = 90) -> DataFrame:
    """``(path, width, height, was_rotated, was_enhanced, content)`` per image of Spark's ``image`` source: the
    asked steps in their fixed order, flattened on white, at most ``most`` pixels on the longer side, as ``png`` or ``jpeg``.
    ``orientation``: a column with the EXIF orientation; null or unknown: upright."""

    def each(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                x = rgb(bytes(r.data), r.height, r.width, r.nChannels)
                turn = int(r.turn) if r.turn is not None and r.turn == r.turn and int(r.turn) in _TURNS and "rotate" in steps else 1
                x, lit = oriented(x, turn), False
                x = straightened(x) if "deskew" in steps else x
                if "enhance" in steps:
                    x, lit = enhanced(x)
                x = denoised(x) if "denoise" in steps else x
                x = enlarged(x) if "upscale" in steps else x
                x = thumbnail(x, most) if most else x
                rows.append((r.origin, x.shape[1], x.shape[0], turn != 1, lit, png(x) if form == "png" else encoded(np.clip(x, 0, 255), quality)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "was_rotated", "was_enhanced", "content"])

    turn = f"cast({orientation} as int) as turn" if orientation else "cast(null as int) as turn"
    return images.selectExpr("image.origin", "image.height", "image.width", "image.nChannels", "image.data", turn).mapInPandas(each, "path string, width int, height int, was_rotated boolean, was_enhanced boolean, content binary")


