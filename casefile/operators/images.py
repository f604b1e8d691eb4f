"""Image kernels in numpy behind Arrow UDFs; the rules over their numbers are Column expressions.

Pixels come from Spark's ``image`` source (BGR bytes) and never become rows. Each kernel bounds the
image first, so a task's memory is bounded by its batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.numeric import bit_entropy, chi_p_value, chi_square


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return x[..., 0] if channels == 1 else x[..., 2] * 0.299 + x[..., 1] * 0.587 + x[..., 0] * 0.114


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels as RGB, transparency flattened on white."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return x.repeat(3, axis=2)
    color = x[..., 2::-1]
    return color if channels == 3 else np.round((color * x[..., 3:] + 255 * (255 - x[..., 3:])) / 255)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means where it shrinks, nearest pixels where it grows."""
    for axis, size in ((0, height), (1, width)):
        n = x.shape[axis]
        at = np.arange(size) * n // size
        if size < n:
            sums = np.add.reduceat(x, at, axis=axis)
            counts = np.diff(np.append(at, n))
            x = sums / counts.reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            x = np.take(x, at, axis=axis)
    return x


def bounded(x: np.ndarray, most: int) -> np.ndarray:
    longest = max(x.shape)
    return x if longest <= most else resized(x, max(1, x.shape[0] * most // longest), max(1, x.shape[1] * most // longest))


def bounded_rgb(x: np.ndarray, most: int) -> np.ndarray:
    return x if max(x.shape[:2]) <= most else np.stack([bounded(x[..., c], most) for c in range(x.shape[2])], axis=2)


def as_long(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel().astype(bool)).view(">i8")[0])


def perceptual_hash(x: np.ndarray) -> int:
    """Low frequencies of a 32 x 32 cosine transform against their median; the constant one is left out of it. What equals
    the median but for rounding (mirrored coefficients of a symmetric image) is not above it."""
    k, n = np.arange(8)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * k * (2 * n + 1) / 64)
    low = basis @ resized(x, 32, 32) @ basis.T
    return as_long(low > np.median(low.ravel()[1:]) + 1e-7)


def difference_hash(x: np.ndarray) -> int:
    small = resized(x, 8, 9)
    return as_long(small[:, :-1] > small[:, 1:])


def block_hashes(x: np.ndarray, size: int = 16, stride: int = 8, least_variance: float = 50.0) -> list[tuple[int, int, int]]:
    """(x, y, hash) of blocks with some texture: 8 x 8 samples above their mean. All blocks are one strided view."""
    x = bounded(x, 1024)
    if min(x.shape) < size:
        return []
    blocks = np.lib.stride_tricks.sliding_window_view(x, (size, size))[::stride, ::stride]
    rows, cols = np.nonzero(blocks.var(axis=(2, 3)) >= least_variance)
    samples = blocks[rows, cols][:, :: size // 8, :: size // 8].reshape(len(rows), len(range(0, size, size // 8)) ** 2)
    hashes = np.packbits(samples > samples.mean(axis=1, keepdims=True), axis=1).view(">i8").ravel()
    return list(zip((cols * stride).tolist(), (rows * stride).tolist(), hashes.tolist(), strict=True))


def low_bits(data: bytes, channels: int, most: int = 500_000) -> list[tuple[int, int, list[int]]]:
    """Number of lowest bits, ones among them, and counts of the pairs 00, 01, 10, 11: of all channels one
    after the other, then of each. Pixels beyond ``most`` are thinned out evenly."""
    x = np.frombuffer(data, np.uint8).reshape(-1, channels) & 1
    x = x[:: max(1, -(-len(x) // most))]
    order = [0] if channels == 1 else [2, 1, 0]  # red, green, blue

    def counted(bits: np.ndarray) -> tuple[int, int, list[int]]:
        pairs = bits[: len(bits) // 2 * 2].reshape(-1, 2)
        return len(bits), int(bits.sum()), np.bincount(pairs[:, 0] * 2 + pairs[:, 1], minlength=4).tolist()

    return [counted(np.concatenate([x[:, c] for c in order])), *(counted(x[:, c]) for c in order)]


def labelled(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Numbers of the connected areas of a mask (elsewhere -1), and how many there are: labels spread to
    neighbours, and follow them by pointer jumping."""
    free = mask.size
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), free)
    but_last, but_first, every = slice(None, -1), slice(1, None), slice(None)
    steps = [((but_first, every), (but_last, every)), ((every, but_first), (every, but_last))]
    steps += [((but_first, but_first), (but_last, but_last)), ((but_first, but_last), (but_last, but_first))] * diagonal
    while True:
        spread = label.copy()
        for here, there in steps:
            spread[here] = np.minimum(spread[here], label[there])
            spread[there] = np.minimum(spread[there], label[here])
        after = np.where(mask, spread, free)
        after[mask] = after.ravel()[after[mask]]
        if (after == label).all():
            break
        label = after
    names, back = np.unique(label[mask], return_inverse=True)
    out = np.full(mask.shape, -1)
    out[mask] = back
    return out, len(names)


def _direction(x: np.ndarray) -> float:
    """Angle in degrees of the mean gradient, 0 to the right and 90 downwards; 0 where there is none to take."""
    if min(x.shape) < 2:
        return 0.0
    gy, gx = np.gradient(x)
    return float(np.degrees(np.arctan2(gy.mean(), gx.mean())) % 360)


def light_direction(x: np.ndarray) -> float:
    return _direction(bounded(x, 512))


def dark_regions(x: np.ndarray, limit: float = 60.0, least: int = 100, margin: int = 5) -> list[tuple[float, float, int, float]]:
    """(center x, center y, area, angle) of 4-connected dark areas; the angle is that of the box around the
    area, widened by a margin. One pass over the image serves all areas."""
    x = bounded(x, 512)
    label, n = labelled(x < limit)
    ys, xs = np.nonzero(label >= 0)
    own = label[ys, xs]
    area = np.bincount(own, minlength=n)
    cx, cy = np.bincount(own, xs, n) / np.maximum(area, 1), np.bincount(own, ys, n) / np.maximum(area, 1)
    first, last = np.full((2, n), 1 << 30), np.zeros((2, n), int)
    for k, at in enumerate((ys, xs)):
        np.minimum.at(first[k], own, at)
        np.maximum.at(last[k], own, at)
    out = []
    for k in np.flatnonzero(area >= least):
        (top, left), (bottom, right) = np.maximum(first[:, k] - margin, 0), last[:, k] + margin + 1
        out.append((float(cx[k]), float(cy[k]), int(area[k]), _direction(x[top:bottom, left:right])))
    return out


def quality_numbers(x: np.ndarray) -> tuple[float, float, float, float]:
    """Blur (variance of the Laplacian), brightness, contrast, sharpness (mean edge response)."""
    p = np.pad(x, 1, mode="edge")
    around = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
    edges = 8 * x - (around + p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:])
    return float((around - 4 * x).var()), float(x.mean() / 255), float(min(1.0, x.std() / 128)), float(np.clip(edges, 0, 255).mean() / 255)


def dominant_colors(data: bytes, channels: int, k: int = 5) -> list[str]:
    """Most frequent colours, least frequent of them first, as hexadecimal RGB."""
    x = np.frombuffer(data, np.uint8).reshape(-1, channels)
    x = x[:, [0, 0, 0]] if channels == 1 else x[:, [2, 1, 0]]
    values, counts = np.unique(x.astype(np.int64) @ np.array([65536, 256, 1]), return_counts=True)
    return [f"#{v:06x}" for v in values[np.argsort(counts, kind="stable")[-k:]]]


def clustered_colors(data: bytes, height: int, width: int, channels: int, k: int = 5, rounds: int = 30) -> list[str]:
    """Centers of k-means over a thumbnail, the largest cluster first. The start is fixed: the mean's
    nearest pixel, then always the pixel farthest from the centers so far."""
    x = bounded_rgb(rgb(data, height, width, channels), 150).reshape(-1, 3)
    centers = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()][None]
    while len(centers) < k:
        gap = ((x[:, None] - centers) ** 2).sum(axis=2).min(axis=1)
        if gap.max() == 0:
            break
        centers = np.concatenate([centers, x[gap.argmax()][None]])
    for _ in range(rounds):
        own = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.stack([x[own == c].mean(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
        if np.allclose(moved, centers):
            break
        centers = moved
    order = np.argsort(-np.bincount(own, minlength=len(centers)), kind="stable")
    return ["#" + "".join(f"{int(v):02x}" for v in centers[c]) for c in order]


_ROW = "path string, phash long, dhash long, blur double, brightness double, contrast double, sharpness double, colors array<string>, bits array<struct<n:long,ones:long,pairs:array<long>>>, blocks array<struct<x:int,y:int,hash:long>>, regions array<struct<cx:double,cy:double,area:int,angle:double>>"


def measured(images: DataFrame) -> DataFrame:
    """One row per image of Spark's ``image`` source: hashes, quality numbers, low-bit counts, blocks, dark regions."""

    def each(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                data, x = bytes(r.data), gray(bytes(r.data), r.height, r.width, r.nChannels)
                rows.append((r.origin, perceptual_hash(x), difference_hash(x), *quality_numbers(x), dominant_colors(data, r.nChannels), [{"n": n, "ones": o, "pairs": p} for n, o, p in low_bits(data, r.nChannels)],
                             [{"x": a, "y": b, "hash": h} for a, b, h in block_hashes(x)], [{"cx": a, "cy": b, "area": c, "angle": d} for a, b, c, d in dark_regions(x)]))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ("path", "phash", "dhash", "blur", "brightness", "contrast", "sharpness", "colors", "bits", "blocks", "regions")])

    return images.select("image.*").select("origin", "height", "width", "nChannels", "data").mapInPandas(each, _ROW)


def hidden_data_verdict(bits: Column) -> Column:
    """From the low bits of all channels together, then of each: near-random with an uneven pair
    distribution is probable; near-random, or two near-random channels, is suspicious."""
    entropy = F.transform(bits, lambda b: bit_entropy(b["ones"], b["n"]))
    p = chi_p_value(chi_square([bits[0]["pairs"][i].cast("double") for i in range(4)]))
    high = entropy[0]
    many = F.size(F.filter(F.slice(entropy, 2, 4), lambda e: e > 0.95)) >= 2
    return F.when((high > 0.99) & (p < 0.05), "provavel").when((high > 0.95) | many, "suspeito").otherwise("nenhum")


def recompression_verdict(mean: Column, std: Column, bright_percent: Column, hotspots: Column) -> Column:
    """Of an error-level image's statistics."""
    return (
        F.when((mean < 5) & (bright_percent < 0.5), "sem_indicios")
        .when((mean > 20) | ((bright_percent > 3) & (hotspots >= 2)), "suspeito")
        .when((std > 1.5 * mean) & (hotspots >= 1), "suspeito")
        .when(mean >= 5, "inconclusivo").otherwise("indeterminado")
    )


def ghost_verdict(regions: Column) -> Column:
    return F.when(regions >= 5, "suspeito").when(regions >= 1, "inconclusivo").otherwise("sem_indicios")


def quality_advice(blur: Column, brightness: Column, contrast: Column) -> Column:
    """Names of what is wrong, in order."""
    return F.array_compact(F.array(F.when(blur < 100, "blurry"), F.when(brightness < 0.3, "dark"), F.when(brightness > 0.7, "bright"), F.when(contrast < 0.3, "flat")))
