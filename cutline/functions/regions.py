"""Regions of binary images and what changes between two images, for a batch of images at once (numpy within Arrow batches).

A region is labelled by its runs: runs of set cells in neighbouring rows that touch are linked, and links are merged until
each run knows the least run of its region, for all images of a batch together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The elliptic neighbourhood of 5 x 5 cells, row by row.
ELLIPSE = ((0, 0, 1, 0, 0), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (0, 0, 1, 0, 0))
#: A cell has changed above this difference, a region counts above this area, brightness jumps above this
#: step, a picture is flat below this variance.
CHANGED, LEAST_AREA, JUMP, FLAT = 25, 25, 40, 5
#: A cell follows a motion if what the motion leaves unexplained is less than this.
RESIDUAL = 10.0
STATS = "mean_before double, mean double, variance double, mean_mag double, diff_fraction double, inlier_ratio double, frob_norm double"


def closed(masks: np.ndarray) -> np.ndarray:
    """n x height x width, grown by the ellipse and shrunk again; what lies outside changes nothing."""
    offsets = [(r, c) for r, row in enumerate(ELLIPSE) for c, on in enumerate(row) if on]
    _, h, w = masks.shape
    grown, shrunk = np.zeros_like(masks), np.ones_like(masks)
    out = np.pad(masks, ((0, 0), (2, 2), (2, 2)))
    for r, c in offsets:
        grown |= out[:, r : r + h, c : c + w]
    out = np.pad(grown, ((0, 0), (2, 2), (2, 2)), constant_values=True)
    for r, c in offsets:
        shrunk &= out[:, r : r + h, c : c + w]
    return shrunk


def labelled(masks: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each set cell the number (from 1) of its region's first run, else 0; cells that touch at a corner belong together if diagonal."""
    n, h, w = masks.shape
    rows = np.zeros((n, h + 1, w + 1), bool)
    rows[:, :h, :w] = masks
    edge = np.flatnonzero(np.diff(np.concatenate([[False], rows.ravel(), [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    label = np.arange(len(start))
    # runs of the next row that touch a run: from the first one that ends behind its start to the last that begins before its end
    first = np.searchsorted(end, start + w + 1 - diagonal, side="right")
    size = np.maximum(np.searchsorted(start, end + w + 1 + diagonal, side="left") - first, 0)
    a = np.repeat(np.arange(len(start)), size)
    b = np.arange(len(a)) + np.repeat(first - (np.cumsum(size) - size), size)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label[label] == label).all():
            label = label[label]
    out = np.zeros(rows.size, np.int64)
    at = np.repeat(start - np.concatenate([[0], np.cumsum(end - start)[:-1]]), end - start) + np.arange((end - start).sum()) if len(start) else np.empty(0, np.int64)
    out[at] = np.repeat(label + 1, end - start)
    return out.reshape(n, h + 1, w + 1)[:, :h, :w]


def filled(masks: np.ndarray) -> np.ndarray:
    """The masks without holes: cells that can't be reached from outside by steps along rows and columns are set."""
    around = np.pad(~masks, ((0, 0), (1, 1), (1, 1)), constant_values=True)
    label = labelled(around, diagonal=False)
    return ~(label == label[:, :1, :1])[:, 1:-1, 1:-1]


def contour_area(masks: np.ndarray, least: float = LEAST_AREA) -> np.ndarray:
    """The areas of regions above `least`, added up for each image. A region's area is that within its outer contour, drawn through the centres of its cells: a square of four set cells counts 1, a corner of three a half."""
    masks = filled(masks)
    label = labelled(masks, diagonal=True)
    corners = [(slice(None), slice(r, r + masks.shape[1] - 1), slice(c, c + masks.shape[2] - 1)) for r in (0, 1) for c in (0, 1)]
    cells = sum(masks[c].astype(np.int8) for c in corners)
    own = np.maximum.reduce([label[c] for c in corners])
    on = cells >= 3
    areas = np.bincount(own[on], (cells[on] - 2) / 2, minlength=1)
    image = np.broadcast_to(np.arange(len(masks))[:, None, None], label.shape)
    of = np.zeros(len(areas), np.int64)
    inside = (label > 0) & (label < len(areas))
    of[label[inside]] = image[inside]
    large = areas > least
    return np.bincount(of[large], areas[large], minlength=len(masks))[: len(masks)]


def motion(before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one shift of a whole image that explains its change best, by least squares over its gradients: its length, and the share of cells that follow it. 0 where the image has no gradients in two directions. (n x height x width)"""
    mid = (before + now) / 2
    out = np.pad(mid, ((0, 0), (1, 1), (1, 1)), mode="edge")
    gx, gy, gt = (out[:, 1:-1, 2:] - out[:, 1:-1, :-2]) / 2, (out[:, 2:, 1:-1] - out[:, :-2, 1:-1]) / 2, now - before
    total = lambda a, b: (a * b).sum(axis=(1, 2))
    xx, xy, yy, xt, yt = total(gx, gx), total(gx, gy), total(gy, gy), total(gx, gt), total(gy, gt)
    det = xx * yy - xy * xy
    usable = det > 1e-6
    safe = np.where(usable, det, 1.0)
    u, v = np.where(usable, (xy * yt - yy * xt) / safe, 0.0), np.where(usable, (xy * xt - xx * yt) / safe, 0.0)
    left = np.abs(gt + gx * u[:, None, None] + gy * v[:, None, None])
    return np.hypot(u, v), np.where(usable, (left < RESIDUAL).mean(axis=(1, 2)), 0.0)


def _images(column, height: int, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float).reshape(-1, height, width)


def changed_area(before: Column, now: Column, height: int, width: int, changed: float = CHANGED, least: float = LEAST_AREA) -> Column:
    """The share of an image that has changed: cells that differ by more than `changed`, closed, in regions above `least`. Images: flat arrays, not null."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        masks = np.abs(_images(a, height, width) - _images(b, height, width)) > changed
        return pd.Series(contour_area(closed(masks), least) / (height * width))

    return share(before, now)


def pair_stats(before: Column, now: Column, height: int, width: int, least: float = LEAST_AREA) -> Column:
    """Struct of what the dead-frame rule asks of two images: STATS. Motion is that of the whole image (motion()); where brightness jumps or the picture is flat, all of motion, area and camera is 0 and the norm null, as nothing can be told."""

    @F.pandas_udf(STATS)
    def stats(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = _images(a, height, width), _images(b, height, width)
        mean_a, mean_b, var = x.mean(axis=(1, 2)), y.mean(axis=(1, 2)), y.var(axis=(1, 2))
        told = (np.abs(mean_b - mean_a) <= JUMP) & (var >= FLAT)
        length, inliers = motion(x, y)
        area = contour_area(closed(np.abs(x - y) > CHANGED), least) / (height * width)
        zero = lambda v: np.where(told, v, 0.0)
        return pd.DataFrame({"mean_before": mean_a, "mean": mean_b, "variance": var, "mean_mag": zero(length), "diff_fraction": zero(area), "inlier_ratio": zero(inliers), "frob_norm": np.where(told, length, None)})

    return stats(before, now)


import pandas as pd  # noqa: E402  annotations of the functions above name it
