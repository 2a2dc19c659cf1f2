"""Measures of pictures as flat arrays of grey values, row by row, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType


def _grid(pixels, width) -> np.ndarray | None:
    return np.asarray(pixels, float).reshape(-1, int(width)) if pixels is not None and width and len(pixels) and len(pixels) % width == 0 else None


@F.pandas_udf(DoubleType())
def sharpness(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Variance of the Laplacian; null for what is no picture."""

    def one(p, w):
        g = _grid(p, w)
        if g is None or min(g.shape) < 3:
            return None
        return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())

    return pd.Series([one(p, w) for p, w in zip(pixels, width, strict=True)], dtype="float64")


@F.pandas_udf(BooleanType())
def has_content(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Whether at least 1 % of the pixels are more than 12 below their blurred surroundings; under 8 pixels no, unreadable yes."""

    def one(p, w):
        g = _grid(p, w)
        if g is None:
            return True
        if min(g.shape) < 8:
            return False
        k = max(3, min(g.shape) // 4) | 1
        kernel = np.exp(-0.5 * ((np.arange(k) - k // 2) / (k / 6)) ** 2)
        kernel /= kernel.sum()
        pad = np.pad(g, k // 2, mode="edge")
        blurred = np.apply_along_axis(np.convolve, 0, np.apply_along_axis(np.convolve, 1, pad, kernel, "valid"), kernel, "valid")
        return bool((g < blurred - 12).mean() >= 0.01)

    return pd.Series([one(p, w) for p, w in zip(pixels, width, strict=True)])


@F.pandas_udf(DoubleType())
def page_ink(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Share of pixels more than 40 below the 90th percentile, inside a border of 6 %."""

    def one(p, w):
        g = _grid(p, w)
        if g is None:
            return None
        a, b = int(g.shape[0] * 0.06), int(g.shape[1] * 0.06)
        inner = g[a : g.shape[0] - a, b : g.shape[1] - b]
        return float((inner < np.percentile(g, 90) - 40).mean())

    return pd.Series([one(p, w) for p, w in zip(pixels, width, strict=True)], dtype="float64")


@F.pandas_udf(IntegerType())
def gutter(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Column of a spread's gutter: the darkest column, by the brightest of four strips, between 35 and 65 % of the width; null if
    it is less than 30 below the median column."""

    def one(p, w):
        g = _grid(p, w)
        if g is None or g.shape[0] < 4 or g.shape[1] < 8:
            return None
        profile = np.max([s.mean(axis=0) for s in np.array_split(g, 4)], axis=0)
        lo, hi = int(g.shape[1] * 0.35), int(g.shape[1] * 0.65)
        at = lo + int(profile[lo:hi].argmin())
        return at if np.median(profile) - profile[at] >= 30 else None

    return pd.Series([one(p, w) for p, w in zip(pixels, width, strict=True)], dtype="Int32")
