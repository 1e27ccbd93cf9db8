"""Images as flat arrays, row by row: turning, cropping, tiling and joining are lists of places that are composed before Spark sees them, so that an image is read once however many steps there are."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import bound, corners, grid, sample


class Places(NamedTuple):
    """Where each cell of an image of this size comes from; None: from nowhere."""

    height: int
    width: int
    cells: tuple[int | None, ...]

    def at(self, r: int, c: int) -> int | None:
        return self.cells[r * self.width + c] if 0 <= r < self.height and 0 <= c < self.width else None

    def made(self, height: int, width: int, source) -> Places:
        """An image of another size whose cell (r, c) is this one's cell source(r, c)."""
        return Places(height, width, tuple(self.at(*source(r, c)) for r in range(height) for c in range(width)))

    def quarter(self, turns: int) -> Places:
        """Turned counter-clockwise by quarters."""
        out = self
        for _ in range(turns % 4):
            last = out.width - 1
            out = out.made(out.width, out.height, lambda r, c, last=last: (c, last - r))
        return out

    def mirror(self) -> Places:
        return self.made(self.height, self.width, lambda r, c: (r, self.width - 1 - c))

    def upside_down(self) -> Places:
        return self.made(self.height, self.width, lambda r, c: (self.height - 1 - r, c))

    def crop(self, x: float, y: float, width: float, height: float) -> Places:
        """Corner and size are rounded half to even; what lies outside comes from nowhere."""
        x, y, w, h = (round(v) for v in (x, y, width, height))
        return self.made(h, w, lambda r, c: (r + y, c + x))

    def rotate(self, degrees: float) -> Places:
        """Turned clockwise about the centre, in a box that holds all of it; each cell is the one its centre falls into."""
        if degrees % 90 == 0:
            return self.quarter(int(-degrees // 90))
        cos, sin = round(math.cos(math.radians(degrees)), 15), round(math.sin(math.radians(degrees)), 15)
        h, w = self.height, self.width
        to = lambda x, y: (cos * (x - w / 2) + sin * (y - h / 2) + w / 2, -sin * (x - w / 2) + cos * (y - h / 2) + h / 2)
        xs, ys = zip(*(to(x, y) for x in (0, w) for y in (0, h)), strict=True)
        nw, nh = (math.ceil(max(v)) - math.floor(min(v)) for v in (xs, ys))

        def source(r: int, c: int) -> tuple[int, int]:
            x, y = to(c + 0.5 - (nw - w) / 2, r + 0.5 - (nh - h) / 2)
            return math.floor(y), math.floor(x)

        return self.made(nh, nw, source)

    def tiles(self, splits: int) -> list[Places]:
        """Even tiles, row by row."""
        if self.height % splits or self.width % splits:
            raise ValueError("the size must be a multiple of the number of tiles")
        h, w = self.height // splits, self.width // splits
        return [self.crop(j * w, i * h, w, h) for i in range(splits) for j in range(splits)]

    def take(self, pixels: Column, fill: float = 0.0) -> Column:
        places = F.array(*[F.lit(i).cast("int") for i in self.cells])
        return bound(pixels, lambda p: F.transform(places, lambda i: F.coalesce(F.get(p, i), F.lit(fill))))


def whole(height: int, width: int) -> Places:
    return Places(height, width, tuple(range(height * width)))


def split_tiles(pixels: Column, height: int, width: int, splits: int) -> Column:
    """The tiles one after the other."""
    cells = tuple(i for t in whole(height, width).tiles(splits) for i in t.cells)
    return Places(height, width, cells).take(pixels)


def merge_tiles(tiles: Column, height: int, width: int, splits: int) -> Column:
    """The inverse of split_tiles; height and width are those of the result."""
    order = [i for t in whole(height, width).tiles(splits) for i in t.cells]
    back = sorted(range(len(order)), key=order.__getitem__)
    return Places(height, width, tuple(back)).take(tiles)


def beside(left: Column, right: Column, height: int, left_width: int, right_width: int) -> Column:
    """Two images of one height, side by side."""
    n = height * left_width
    cells = tuple(r * left_width + c if c < left_width else n + r * right_width + c - left_width for r in range(height) for c in range(left_width + right_width))
    return Places(height, left_width + right_width, cells).take(F.concat(left, right))


def resize(pixels: Column, height: int, width: int, factor: float) -> Column:
    """Bilinear, with cells' centres aligned and the border repeated."""
    oh, ow = int(height * factor), int(width * factor)
    at = lambda k: F.greatest(F.lit(0.0), (k + 0.5) / factor - 0.5)
    places = F.transform(grid(oh, ow), lambda k: corners(height, width, at(k % ow), at(F.floor(k / ow))))
    return bound(pixels, lambda p: F.transform(places, lambda c: sample(p, height, width, c)))


def _along(n: int, to: int) -> Column:
    """Where each of `to` cells along a side lies among its n cells: between a and b, as far as d behind a and e before b."""
    at = [min(max((k + 0.5) * n / to - 0.5, 0.0), n - 1.0) for k in range(to)]
    spot = lambda x, a: {"a": a, "b": min(a + 1, n - 1), "d": x - a, "e": 1 - (x - a)}
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in spot(x, math.floor(x)).items()]) for x in at])


def _amid(p: Column, width: int, r: Column, c: Column) -> Column:
    px = lambda y, x: F.get(p, y * width + x).cast("double")
    return px(r["a"], c["a"]) * c["e"] * r["e"] + px(r["a"], c["b"]) * c["d"] * r["e"] + px(r["b"], c["a"]) * c["e"] * r["d"] + px(r["b"], c["b"]) * c["d"] * r["d"]


def resized(pixels: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """resize() to any size; where rows and columns lie between others is composed before Spark sees it."""
    return bound(pixels, lambda p: F.flatten(F.transform(_along(height, to_height), lambda r: F.transform(_along(width, to_width), lambda c: _amid(p, width, r, c)))))


def resized_at(pixels: Column, height: int, width: int, to_height: int, to_width: int, row: Column, col: Column) -> Column:
    """One cell of resized()."""
    return _amid(pixels, width, F.get(_along(height, to_height), row), F.get(_along(width, to_width), col))


def above(pixels: Column, threshold: float, most: float = 255.0) -> Column:
    """Binary image of the pixels above a threshold."""
    return F.transform(pixels, lambda p: F.when(p > threshold, most).otherwise(0.0))


#: The colours of a map, by their places from 0 to 1 (red, green, blue).
JET = ((0.0, (0, 0, 128)), (0.125, (0, 0, 255)), (0.375, (0, 255, 255)), (0.625, (255, 255, 0)), (0.875, (255, 0, 0)), (1.0, (128, 0, 0)))


def _colour(x: float, stops: tuple) -> list[int]:
    for (a, low), (b, high) in zip(stops, stops[1:], strict=False):
        if x <= b:
            return [math.floor(p + (x - a) / (b - a) * (q - p)) for p, q in zip(low, high, strict=True)]
    return list(stops[-1][1])


def coloured(levels: Column, stops: tuple = JET) -> Column:
    """Levels from 0 to 255 (whole numbers) as colours, channel by channel within a cell: linear between the stops of a map, cut to whole numbers."""
    table = F.array(*[F.lit(c).cast("long") for v in range(256) for c in _colour(v / 255, stops)])
    cell = lambda v, c: F.get(table, (v * 3 + c).cast("int"))
    return F.flatten(F.transform(levels, lambda v: F.array(*[cell(v, c) for c in range(3)])))


def panel(left: Column, right: Column, height: int, width: int, margin: int, channels: int = 3, fill: int = 255) -> Column:
    """Two images of a size beside each other, with a margin of one colour between them. Channels of a cell stand together."""
    row = lambda p, r: F.slice(p, r * width * channels + 1, width * channels)
    between = F.array_repeat(F.lit(fill).cast("long"), margin * channels)
    rows = lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.concat(row(s["l"], r), between, row(s["r"], r))))
    return bound(F.struct(left.alias("l"), right.alias("r")), rows)


def binary_hole(mask: Column) -> Column:
    return F.transform(mask, lambda m: (m > 0.5).cast("double"))


def targets(flow_x: Column, flow_y: Column, height: int, width: int, border: bool) -> Column:
    """Where the flow of each cell points, as corners(): once for all that is sampled there."""
    spots = F.transform(grid(height, width), lambda k: F.struct((k % width + F.get(flow_x, k)).alias("x"), (F.floor(k / width) + F.get(flow_y, k)).alias("y")))
    return F.transform(spots, lambda p: corners(height, width, p["x"], p["y"], border))


def warp(pixels: Column, flow_x: Column, flow_y: Column, height: int, width: int, border: bool = True) -> Column:
    """An image sampled where its flow points, cell by cell; beyond the image its border (border) or zero."""
    every = lambda p: F.transform(targets(p["x"], p["y"], height, width, border), lambda c: sample(p["px"], height, width, c))
    return bound(F.struct(pixels.alias("px"), flow_x.alias("x"), flow_y.alias("y")), every)


def normalised(x: Column, size: int) -> Column:
    """A coordinate from -1 to 1 across the image."""
    half = (size - 1) / 2
    return (x - half) / half


def inside(x: Column, y: Column, height: int, width: int) -> Column:
    return x.between(0, width - 1) & y.between(0, height - 1)


def window_grid(least: float, most: float, steps: int) -> list[float]:
    """Evenly spaced places, both ends included."""
    return [least + (most - least) * i / (steps - 1) for i in range(steps)] if steps > 1 else [least]


def occluded(fx: Column, fy: Column, bx: Column, by: Column, height: int, width: int, share: float = 0.01, floor: float = 0.5) -> Column:
    """For each cell: isn't the forward flow undone by the backward flow where it leads to?"""
    norm = lambda x, y: F.sqrt(x * x + y * y)
    made = F.struct(fx.alias("fx"), fy.alias("fy"), bx.alias("bx"), by.alias("by"), warp(bx, fx, fy, height, width, border=False).alias("wx"), warp(by, fx, fy, height, width, border=False).alias("wy"))

    def every(s: Column) -> Column:
        v = lambda c, k: F.get(s[c], k)
        return F.transform(grid(height, width), lambda k: norm(v("fx", k) + v("wx", k), v("fy", k) + v("wy", k)) > share * (norm(v("fx", k), v("fy", k)) + norm(v("bx", k), v("by", k))) + floor)

    return bound(made, every)
