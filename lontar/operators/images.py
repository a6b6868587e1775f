"""Measures of page images: luminance grids as arrays, worked on in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Darkness, strides over large images, margins of a crop, thresholds of blank pages and resolutions.
DARK, LARGE, INK_STRIDE, BLUR_STRIDE = 40_000, 400_000, 3, 2
PAD, KEEP_AREA, KEEP_INK, SMALL, DIRT, LEAST_WIDTH, LEAST_HEIGHT = 12, 0.98, 0.995, 40, 500, 16, 8
BLANK, SHARP, MEDIUM = 0.0004, 5e8, 5e7


def ink_ratio(grid: np.ndarray) -> float:
    """Share of dark pixels; every third in both directions of large images."""
    step = INK_STRIDE if grid.size > LARGE else 1
    part = grid[::step, ::step]
    return float((part < DARK).mean()) if part.size else 0.0


def blur_score(grid: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian; on large images of every second pixel, with neighbours as far away."""
    step = BLUR_STRIDE if grid.size > LARGE else 1
    if min(grid.shape) < 3:
        return 0.0
    g = grid.astype(np.float64)[::step, ::step]
    if min(g.shape) < 3:
        return 0.0
    inner = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(inner.var())


def _box(rows: np.ndarray, cols: np.ndarray, least_row: int, least_col: int) -> tuple[int, int, int, int] | None:
    """First and last row and column with so many dark pixels."""
    y, x = np.flatnonzero(rows >= least_row), np.flatnonzero(cols >= least_col)
    return (int(y[0]), int(y[-1]), int(x[0]), int(x[-1])) if len(y) and len(x) else None


def crop(grid: np.ndarray) -> tuple[int, int, int, int]:
    """top, bottom, left, right of the inked box with its margin. Rows and columns with a few dark pixels are dirt unless
    more than KEEP_INK of the ink needs them; then any dark pixel counts. The whole image if it is small, blank or
    hardly smaller, or if the box is too small to be text."""
    h, w = grid.shape
    whole = (0, h, 0, w)
    if h < SMALL or w < SMALL:
        return whole
    ink = grid < DARK
    rows, cols = ink.sum(axis=1), ink.sum(axis=0)
    total = int(rows.sum())
    if not total:
        return whole
    box = _box(rows, cols, max(2, w // DIRT), max(2, h // DIRT))
    if box and min(rows[box[0] : box[1] + 1].sum(), cols[box[2] : box[3] + 1].sum()) < total * KEEP_INK:
        box = _box(rows, cols, 1, 1)
    if box is None:
        return whole
    top, bottom, left, right = max(0, box[0] - PAD), min(h, box[1] + 1 + PAD), max(0, box[2] - PAD), min(w, box[3] + 1 + PAD)
    if right - left < LEAST_WIDTH or bottom - top < LEAST_HEIGHT or (bottom - top) * (right - left) / (h * w) > KEEP_AREA:
        return whole
    return top, bottom, left, right


def measures(pixels: Column, width: Column) -> Column:
    """struct(ink_ratio, blur_score, top, bottom, left, right) of a row-major grid; null for null or ragged grids."""

    @F.pandas_udf("ink_ratio double, blur_score double, top int, bottom int, left int, right int")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for grids, widths in parts:
            rows = []
            for p, w in zip(grids, widths):
                if p is None or not w or len(p) % int(w):
                    rows.append((None,) * 6)
                    continue
                g = np.asarray(p, np.int64).reshape(-1, int(w))
                rows.append((ink_ratio(g), blur_score(g), *crop(g)))
            yield pd.DataFrame(rows, columns=["ink_ratio", "blur_score", "top", "bottom", "left", "right"])

    return run(pixels, width)


def box(pixels: Column, width: Column) -> Column:
    """struct(top, bottom, left, right) of measures() alone."""

    @F.pandas_udf("top int, bottom int, left int, right int")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for grids, widths in parts:
            good = lambda p, w: p is not None and w and len(p) % int(w) == 0
            rows = [crop(np.asarray(p).reshape(-1, int(w))) if good(p, w) else (None,) * 4 for p, w in zip(grids, widths)]
            yield pd.DataFrame(rows, columns=["top", "bottom", "left", "right"])

    return run(pixels, width)


def resolution(blur: Column) -> Column:
    return F.when(blur >= SHARP, 100).when(blur >= MEDIUM, 150).otherwise(200)


def page_resolution(pages: DataFrame, forced: int = 0) -> DataFrame:
    """pages (document_id, page_number, blur_score) with dpi: what the first page of a document needs holds for all."""
    first = F.first_value("blur_score").over(Window.partitionBy("document_id").orderBy("page_number"))
    return pages.withColumn("dpi", F.lit(forced) if forced > 0 else resolution(first))


def is_blank(ink: Column) -> Column:
    return ink < BLANK


def cropped_percent(width: Column, height: Column, full: Column) -> Column:
    return F.lit(100) - width * height * 100 / full
