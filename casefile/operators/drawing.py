"""Boxes, crops, heat maps and overlays on pixel arrays; rows in, rows of PNG files out.

Pixels come from Spark's ``image`` source. Nothing is drawn with text: a box's label stays in its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from casefile.operators.images import gray, resized, rgb
from casefile.operators.preprocess import png

# Colours of classes, in the order in which classes appear; width of outlines; margin of crops.
COLORS = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255), (128, 0, 0), (0, 128, 0), (0, 0, 128)]
OUTLINE, MARGIN = 3, 10

Box = tuple[int, int, int, int]


def outlined(x: np.ndarray, box: Box, color: tuple[int, int, int], width: int = OUTLINE) -> None:
    """Draw a box, its corners included, ``width`` pixels inwards; what lies outside the image is cut off."""
    left, top, right, bottom = box
    rows, cols = np.arange(x.shape[0])[:, None], np.arange(x.shape[1])
    inside = (rows >= top) & (rows <= bottom) & (cols >= left) & (cols <= right)
    inner = (rows >= top + width) & (rows <= bottom - width) & (cols >= left + width) & (cols <= right - width)
    x[inside & ~inner] = color


def boxed(x: np.ndarray, boxes: list[tuple[Box, str]]) -> np.ndarray:
    """A copy with all boxes, in order; classes take colours in the order in which they appear."""
    out, colors = x.astype(np.uint8), {}
    for box, name in boxes:
        outlined(out, box, colors.setdefault(name, COLORS[len(colors) % len(COLORS)]))
    return out


def cropped(x: np.ndarray, box: Box, margin: int = MARGIN) -> np.ndarray:
    """The box and a margin, as far as the image reaches; empty where they do not meet."""
    left, top, right, bottom = box
    return x[max(0, top - margin) : max(0, min(x.shape[0], bottom + margin)), max(0, left - margin) : max(0, min(x.shape[1], right + margin))]


def heat_map(x: np.ndarray) -> np.ndarray:
    """Gray values as colours, the largest red and none blue; an image of zeros stays black."""
    top = x.max() if x.size else 0
    if top == 0:
        return np.zeros((*x.shape, 3), np.uint8)
    v = x / top
    ramp = (np.clip(3 * v - 1, 0, 1), 1 - np.abs(2 * v - 1), np.clip(1 - 3 * v, 0, 1))
    return (np.stack(ramp, axis=2) * 255).astype(np.uint8)


def blended(x: np.ndarray, over: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """``over``, brought to the size of ``x``, laid over it; fractions are cut off."""
    if over.shape[:2] != x.shape[:2]:
        over = np.stack([resized(over[..., c].astype(np.float64), *x.shape[:2]) for c in range(3)], axis=2)
    return (x + alpha * (over.astype(np.float64) - x)).astype(np.uint8)


_IMAGE = ["image.origin", "image.height", "image.width", "image.nChannels", "image.data"]


def _boxes(found) -> list[tuple[Box, str]]:
    return [] if found is None else [((b["x1"], b["y1"], b["x2"], b["y2"]), b["class_name"]) for b in found]


def drawn(images: DataFrame, boxes: str = "boxes") -> DataFrame:
    """``(path, content)``: each image with its boxes, an array of (x1, y1, x2, y2, class_name), as PNG; null: none."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(r.origin, png(boxed(rgb(bytes(r.data), r.height, r.width, r.nChannels), _boxes(r.boxes)))) for r in f.itertuples(index=False)], columns=["path", "content"])

    return images.selectExpr(*_IMAGE, f"`{boxes}` as boxes").mapInPandas(each, "path string, content binary")


def crops(images: DataFrame, boxes: str = "boxes", margin: int = MARGIN) -> DataFrame:
    """``(path, n, class_name, width, height, content)``: a PNG for each box, numbered from 0; boxes outside the image give none."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                x = rgb(bytes(r.data), r.height, r.width, r.nChannels)
                for n, (box, name) in enumerate(_boxes(r.boxes)):
                    part = cropped(x, box, margin)
                    if part.size:
                        out.append((r.origin, n, name, part.shape[1], part.shape[0], png(part)))
            yield pd.DataFrame(out, columns=["path", "n", "class_name", "width", "height", "content"])

    return images.selectExpr(*_IMAGE, f"`{boxes}` as boxes").mapInPandas(each, "path string, n int, class_name string, width int, height int, content binary")


def heat_maps(images: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``(path, heat, overlay)``: an image's heat map, and that laid over it, as PNG."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                shape = bytes(r.data), r.height, r.width, r.nChannels
                heat = heat_map(np.round(gray(*shape)))
                out.append((r.origin, png(heat), png(blended(rgb(*shape), heat, alpha))))
            yield pd.DataFrame(out, columns=["path", "heat", "overlay"])

    return images.selectExpr(*_IMAGE).mapInPandas(each, "path string, heat binary, overlay binary")
