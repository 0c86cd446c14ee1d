"""Batch image transforms over an image table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GREY = np.array([0.299, 0.587, 0.114])     # fixed luminance weights of red, green, blue


def sampled(x: np.ndarray, ys: np.ndarray, xs: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Bilinear values of an image at fractional places; outside is ``fill``."""
    h, w = x.shape[:2]
    inside = (ys >= -0.5) & (ys <= h - 0.5) & (xs >= -0.5) & (xs <= w - 0.5)
    ys, xs = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[..., None], (xs - x0)[..., None]
    out = (x[y0, x0] * (1 - fx) + x[y0, x1] * fx) * (1 - fy) + (x[y1, x0] * (1 - fx) + x[y1, x1] * fx) * fy
    return np.where(inside[..., None], out, fill)


def resize(x: np.ndarray, size) -> np.ndarray:
    h, w = x.shape[:2]
    if isinstance(size, int):
        size = (size, max(1, round(size * w / h))) if h <= w else (max(1, round(size * h / w)), size)
    ys, xs = (np.arange(size[0]) + 0.5) * h / size[0] - 0.5, (np.arange(size[1]) + 0.5) * w / size[1] - 0.5
    return sampled(x, *np.meshgrid(np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1), indexing="ij"))


def rotate(x: np.ndarray, degrees: float) -> np.ndarray:
    h, w = x.shape[:2]
    a = np.deg2rad(degrees)
    yy, xx = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    return sampled(x, np.cos(a) * yy + np.sin(a) * xx + (h - 1) / 2, -np.sin(a) * yy + np.cos(a) * xx + (w - 1) / 2)


def grey(x: np.ndarray) -> np.ndarray:
    return (x @ GREY)[..., None] if x.shape[2] == 3 else x


def blend(x: np.ndarray, other, factor: float) -> np.ndarray:
    return np.clip(factor * x + (1 - factor) * other, 0, 1)


def turn_hue(x: np.ndarray, share: float) -> np.ndarray:
    """Rotate colours around the grey axis by a share of the circle."""
    if x.shape[2] != 3:
        return x
    a = 2 * np.pi * share
    c, s, third = np.cos(a), np.sin(a), 1 / 3
    near, up, down = c + (1 - c) * third, (1 - c) * third - np.sqrt(third) * s, (1 - c) * third + np.sqrt(third) * s
    return np.clip(x @ np.array([[near, up, down], [down, near, up], [up, down, near]]).T, 0, 1)


def filtered(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = len(kernel) // 2
    wide = np.pad(x, ((r, r), (r, r), (0, 0)), mode="reflect" if min(x.shape[:2]) > r else "edge")
    return sum(kernel[i, j] * wide[i:i + x.shape[0], j:j + x.shape[1]] for i in range(len(kernel)) for j in range(len(kernel)))


def changed(x: np.ndarray, operation: str, param, draw: np.random.Generator) -> np.ndarray:
    """One named operation on an image of values 0..1; random ones use the row's own generator."""
    jitter = lambda p: draw.uniform(max(0, 1 - p), 1 + p)
    match operation:
        case "resize":
            return resize(x, param)
        case "crop":
            h, w = (param, param) if isinstance(param, int) else param
            if h > x.shape[0] or w > x.shape[1]:
                raise ValueError("crop is larger than the image")
            top, left = draw.integers(0, x.shape[0] - h + 1), draw.integers(0, x.shape[1] - w + 1)
            return x[top:top + h, left:left + w]
        case "pad":
            return np.pad(x, ((param, param), (param, param), (0, 0)))
        case "hflip":
            return x[:, ::-1] if draw.random() < param else x
        case "vflip":
            return x[::-1] if draw.random() < param else x
        case "rotate":
            low, high = (-param, param) if np.isscalar(param) else param
            return rotate(x, draw.uniform(low, high))
        case "brightness":
            return blend(x, 0.0, jitter(param))
        case "contrast":
            return blend(x, grey(x).mean(), jitter(param))
        case "saturation":
            return blend(x, grey(x), jitter(param))
        case "hue":
            return turn_hue(x, draw.uniform(-param, param))
        case "grayscale":
            return np.repeat(grey(x), param or 1, axis=2)
        case "blur":
            size = param if isinstance(param, int) else param[0]
            sigma, at = draw.uniform(0.1, 2.0), np.arange(size) - size // 2
            line = np.exp(-at ** 2 / (2 * sigma ** 2))
            return filtered(x, np.outer(line, line) / line.sum() ** 2)
        case "sharpness":
            if draw.random() >= 0.5:
                return x
            soft = filtered(x, np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13)
            return blend(x, soft, param)
        case "normalize":
            return (x - np.asarray(param["mean"])) / np.asarray(param["std"])
        case _:
            raise ValueError(f"unknown image operation {operation!r}")


def strips(images: DataFrame, height: int) -> DataFrame:
    """Cut every image into images of so many rows, from the top; the last one has what is left.  Files that are no images stay rows."""
    wide, top = F.col("width") * F.col("nChannels"), F.explode(F.sequence(F.lit(0), F.greatest("height", F.lit(1)) - 1, F.lit(height)))
    cut = images.select("*", top.alias("__top"))
    rows = F.least(F.lit(height), F.col("height") - F.col("__top"))
    return cut.select(*[F.substring("data", F.col("__top") * wide + 1, rows * wide).alias(c) if c == "data" else rows.alias(c) if c == "height" else F.col(c)
                        for c in images.columns])


def transform_images(images: DataFrame, steps: Sequence[dict], seed: int = 0) -> DataFrame:
    """Apply ``[{operation, param}]`` to every image; values are scaled to 0..1 first.

    Gives origin, height, width, channels and the values in row order (red, green, blue).  Random choices are
    drawn from a hash of the image's origin, so a repeated task gives the same result.
    """
    todo = [(s["operation"], s.get("param")) for s in steps]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                x = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels).astype(float) / 255
                x = x[..., [2, 1, 0, *range(3, r.nChannels)]] if r.nChannels >= 3 else x     # stored blue first
                draw = np.random.default_rng([seed, zlib.crc32(r.origin.encode())])
                for operation, param in todo:
                    x = changed(x, operation, param, draw)
                rows.append((r.origin, x.shape[0], x.shape[1], x.shape[2], np.ascontiguousarray(x).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["origin", "height", "width", "channels", "pixels"])
    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(
        run, "origin string, height int, width int, channels int, pixels array<double>")
