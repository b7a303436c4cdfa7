"""Statistics of grey frames: arrays of whole numbers 0-255, row by row, with their width.

Entropy, contrast and sharpness are column expressions over the arrays.  Edge
and foreground density need neighbourhoods that grow along edges and wide
blurs; these run in numpy over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Grey levels of a histogram bin; the edge detector's two thresholds; the blur's width and the step from it
# that is foreground; the weights of a content score and what a blank frame is.
BIN, BINS = 4, 64
EDGE_LOW, EDGE_HIGH = 60, 160
BLUR_SIGMA, FOREGROUND_STEP = 9.0, 12
WEIGHTS = {"entropy": 0.35, "edges": 3.0, "foreground": 0.9, "contrast": 0.5}
BLANK_EDGES, BLANK_CONTRAST, BLANK_FACTOR = 0.003, 0.03, 0.5


# ---------------------------------------------------------------- column expressions


def _sum(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + f(x).cast("long"))


def entropy(grey: Column) -> Column:
    """Entropy of the 64-bin histogram in bits, over 6: 0 for a flat frame, 1 for an even spread."""
    bins = F.transform(grey, lambda x: F.floor(x / BIN).cast("int"))
    counts = F.transform(F.array_sort(F.array_distinct(bins)), lambda b: F.size(F.filter(bins, lambda x: x == b)).cast("double"))
    return -F.aggregate(counts, F.lit(0.0), lambda s, c: s + c / F.size(grey) * F.log2(c / F.size(grey))) / 6


def variance(values: Column) -> Column:
    """Population variance of whole numbers, from exact sums."""
    n, s, q = F.size(values).cast("double"), _sum(values).cast("double"), _sum(values, lambda x: x * x).cast("double")
    return F.greatest(F.lit(0.0), (n * q - s * s) / (n * n))


def contrast(grey: Column) -> Column:
    """Population standard deviation, over 255."""
    return F.sqrt(variance(grey)) / 255


def laplacian(grey: Column, width: Column) -> Column:
    """Sum of the four neighbours less four times each pixel; borders reflect without repeating their pixel."""
    w = width.cast("int")
    h = (F.size(grey) / w).cast("int")
    mirror = lambda i, n: F.when(n == 1, 0).when(i < 0, 1).when(i >= n, n - 2).otherwise(i)
    at = lambda y, x: F.get(grey, mirror(y, h) * w + mirror(x, w))

    def one(p: Column, i: Column) -> Column:
        y, x = F.floor(i / w).cast("int"), (i % w).cast("int")
        return at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - p * 4

    return F.transform(grey, one)


def sharpness(grey: Column, width: Column) -> Column:
    """Variance of the Laplacian."""
    return variance(laplacian(grey, width))


def content_score(entropy: Column, edges: Column, foreground: Column, contrast: Column) -> Column:
    """The weighted sum of the four, halved for a frame with hardly an edge or contrast."""
    parts = {"entropy": entropy, "edges": edges, "foreground": foreground, "contrast": contrast}
    total = sum((parts[k] * w for k, w in list(WEIGHTS.items())[1:]), parts["entropy"] * WEIGHTS["entropy"])
    return total * F.when((edges < BLANK_EDGES) & (contrast < BLANK_CONTRAST), BLANK_FACTOR).otherwise(1.0)


# ---------------------------------------------------------------- arrays


def resize_area(grey: np.ndarray, width: int) -> np.ndarray:
    """A frame no wider than ``width``: each pixel is the mean of the area it covers, rounded half to even."""
    h, w = grey.shape
    if w <= width:
        return grey

    def shares(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * (n / m)
        low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(n) + 1)
        return np.maximum(0, high - low) * (m / n)

    out = shares(h, max(1, int(h * width / w))) @ grey.astype(np.float64) @ shares(w, width).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _sobel(padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = padded.astype(np.int32)
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return dx, dy


def edge_density(grey: np.ndarray) -> float:
    """Share of pixels on edges: ridges of the gradient above the high threshold, and what joins them above the low one."""
    dx, dy = _sobel(np.pad(grey, 1, mode="edge"))
    size = np.abs(dx) + np.abs(dy)
    around = np.pad(size, 1)
    centre = around[1:-1, 1:-1]
    flat = np.abs(dy) < np.tan(np.pi / 8) * np.abs(dx)
    steep = np.abs(dy) > np.tan(3 * np.pi / 8) * np.abs(dx)
    falling = (dx < 0) != (dy < 0)
    a = np.where(flat, around[1:-1, :-2], np.where(steep, around[:-2, 1:-1], np.where(falling, around[:-2, 2:], around[:-2, :-2])))
    b = np.where(flat, around[1:-1, 2:], np.where(steep, around[2:, 1:-1], np.where(falling, around[2:, :-2], around[2:, 2:])))
    ridge = (centre > a) & np.where(flat | steep, centre >= b, centre > b)
    weak, edge = ridge & (size > EDGE_LOW), ridge & (size > EDGE_HIGH)
    while True:
        wide = np.pad(edge, 1)
        grown = np.zeros_like(edge)
        for y in range(3):
            for x in range(3):
                grown |= wide[y : y + edge.shape[0], x : x + edge.shape[1]]
        grown &= weak
        if (grown == edge).all():
            return float(edge.mean())
        edge = grown | edge


def foreground_density(grey: np.ndarray) -> float:
    """Share of pixels that differ from a wide Gaussian blur by more than a step."""
    reach = int(round(BLUR_SIGMA * 6 + 1)) | 1
    at = np.arange(reach) - reach // 2
    kernel = np.exp(-(at**2) / (2 * BLUR_SIGMA**2))
    kernel /= kernel.sum()

    def blur(rows: np.ndarray) -> np.ndarray:
        n = rows.shape[1]
        index = np.arange(-(reach // 2), n + reach // 2)
        if n == 1:
            index[:] = 0
        else:  # reflected without repeating the border, as often as need be
            index = np.abs((index + (n - 1)) % (2 * (n - 1)) - (n - 1))
        wide = rows[:, index]
        return sum(k * wide[:, i : i + n] for i, k in enumerate(kernel))

    blurred = np.rint(blur(blur(grey.astype(np.float64)).T).T)
    return float((np.abs(grey - blurred) > FOREGROUND_STEP).mean())


def densities(grey: Column, width: Column, *, most_wide: int = 480) -> Column:
    """struct<edges, foreground> of frames brought to at most so many columns; zeros for an empty frame."""

    def compute(frames: pa.Array, widths: pa.Array) -> pa.Array:
        rows = []
        for pixels, w in zip(frames, widths.to_pylist(), strict=True):
            values = pixels.values.to_numpy(zero_copy_only=False).astype(np.uint8) if pixels.is_valid else np.zeros(0, np.uint8)
            if not len(values) or not w:
                rows.append((0.0, 0.0))
                continue
            frame = resize_area(values.reshape(-1, w), most_wide)
            rows.append((edge_density(frame), foreground_density(frame)))
        table = np.array(rows, np.float64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(table[:, 0].copy()), pa.array(table[:, 1].copy())], ["edges", "foreground"])

    compute.__annotations__ = {"frames": pa.Array, "widths": pa.Array, "return": pa.Array}
    return F.arrow_udf(compute, "edges double, foreground double")(grey, width)
