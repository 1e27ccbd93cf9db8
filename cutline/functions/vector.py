"""Array mathematics without Python: pooling, cosine, rearrangement, matching. Arrays are row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, f) -> Column:
    """f of a value that is computed once; an expression inside of a lambda is computed for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 1 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 1.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def with_norm(v: Column) -> Column:
    """A vector beside its length, so that cosines with many others need one product each."""
    return bound(v, lambda x: F.struct(x.alias("v"), F.sqrt(dot(x, x)).alias("norm")))


def cosine_of(a: Column, b: Column) -> Column:
    """cosine() of two with_norm()."""
    norm = a["norm"] * b["norm"]
    return F.when(norm == 0, 1.0).otherwise(dot(a["v"], b["v"]) / F.nullif(norm, F.lit(0.0)))


def grid(height: int, width: int) -> Column:
    return F.sequence(F.lit(0), F.lit(height * width - 1))


def average_pool(pixels: Column, height: int, width: int, block: int) -> Column:
    """Means of block x block cells; rows and columns beyond a multiple of the block are cut off."""
    h, w = height // block, width // block
    cell = lambda k: [(F.floor(k / w) * block + r) * width + (k % w) * block + c for r in range(block) for c in range(block)]
    return bound(pixels, lambda p: F.transform(grid(h, w), lambda k: sum((F.get(p, at.cast("int")).cast("double") for at in cell(k)), F.lit(0.0)) / (block * block)))


def space_to_depth(x: Column, height: int, width: int, f: int) -> Column:
    """One channel of height x width to f * f channels of (height / f) x (width / f), channel by channel."""
    if height % f or width % f:
        raise ValueError("the size must be a multiple of the factor")
    h, w = height // f, width // f

    def at(k: Column) -> Column:
        ch, rest = F.floor(k / (h * w)), k % (h * w)
        row, col = F.floor(rest / w), rest % w
        return (row * f + F.floor(ch / f)) * width + col * f + ch % f

    return bound(x, lambda p: F.transform(grid(height, width), lambda k: F.get(p, at(k).cast("int"))))


def depth_to_space(x: Column, height: int, width: int, f: int) -> Column:
    """The inverse of space_to_depth; height and width are those of the result."""
    h, w = height // f, width // f

    def at(k: Column) -> Column:
        row, col = F.floor(k / width), k % width
        ch = (row % f) * f + col % f
        return ch * (h * w) + F.floor(row / f) * w + F.floor(col / f)

    return bound(x, lambda p: F.transform(grid(height, width), lambda k: F.get(p, at(k).cast("int"))))


def halves(x: Column, even_odd: bool = False) -> tuple[Column, Column]:
    """The two halves of an array, or its even and its odd places."""
    if even_odd:
        return F.filter(x, lambda _, i: i % 2 == 0), F.filter(x, lambda _, i: i % 2 == 1)
    n = F.floor(F.size(x) / 2).cast("int")
    return F.slice(x, 1, n), F.slice(x, n + 1, F.size(x) - n)


def gaussian_sample(noise: Column, mean: Column, log_sd: Column) -> Column:
    return mean + F.exp(log_sd) * noise


def reduce_rows(x: Column, height: int, width: int, mean: bool = False) -> Column:
    """Sum or mean of each row."""
    return bound(x, lambda p: F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: total(F.slice(p, r * width + 1, width)) / (width if mean else 1)))


def gaussian_log_density(x: Column, mean: Column, log_sd: Column) -> Column:
    import math

    return -0.5 * math.log(2 * math.pi) - log_sd - F.pow(x - mean, 2) / (2 * F.exp(2 * log_sd))


def normalise_image(pixels: Column, mean: float, sd: float) -> Column:
    return F.transform(pixels, lambda p: (p.cast("double") / 255 - mean) / sd)


def _corner(height: int, width: int, x: Column, y: Column, border: bool) -> tuple[Column, Column, Column, Column]:
    """The pixel above and to the left of a place, and how far the place is from it; border: the place is moved into the image first."""
    if border:
        x, y = F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), x)), F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), y))
    x0, y0 = F.floor(x), F.floor(y)
    return x0, y0, x - x0, y - y0


def corners(height: int, width: int, x: Column, y: Column, border: bool = True) -> Column:
    """_corner() as a struct, for places that are computed once and sampled in several images."""
    return F.struct(*[c.alias(n) for n, c in zip(("x0", "y0", "fx", "fy"), _corner(height, width, x, y, border), strict=True)])


def sample(pixels: Column, height: int, width: int, at: Column) -> Column:
    """A sample between the pixels at corners(); zero outside of the image."""
    return _between(pixels, height, width, *[at[n] for n in ("x0", "y0", "fx", "fy")])


def _between(pixels: Column, height: int, width: int, x0: Column, y0: Column, fx: Column, fy: Column) -> Column:
    def px(r: Column, c: Column) -> Column:
        ok = (r >= 0) & (r < height) & (c >= 0) & (c < width)
        return F.when(ok, F.get(pixels, F.when(ok, r * width + c).otherwise(0).cast("int")).cast("double")).otherwise(0.0)

    return px(y0, x0) * (1 - fx) * (1 - fy) + px(y0, x0 + 1) * fx * (1 - fy) + px(y0 + 1, x0) * (1 - fx) * fy + px(y0 + 1, x0 + 1) * fx * fy


def bilinear(pixels: Column, height: int, width: int, x: Column, y: Column, border: bool = True) -> Column:
    """A sample between pixels; outside of the image the border's value (border) or zero."""
    return _between(pixels, height, width, *_corner(height, width, x, y, border))
