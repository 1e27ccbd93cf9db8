"""Planes: splats cell by cell, and soft matches of all cells of one image with those of another.

Images of any size: a cell is a row here, not an element of its image's array within an expression. Soft matches, whose
products are of all cells with all, are taken in numpy within Arrow batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .image import resized, resized_at


def splats(images: DataFrame, key: str, pixels: Column, flow_x: Column, flow_y: Column, metric: Column, height: int, width: int, flow_height: int | None = None, flow_width: int | None = None) -> DataFrame:
    """Two weighted samples where each cell's flow points, over the sum of the weights there -> key, cell, average (even weights), soft (exp(metric)). A flow and metric of another size are resized, and the flow scaled, to the image's.

    All are flat arrays. A cell is one row that refers to its image's arrays, so nothing but the image itself is held, and no
    Python runs. What a null takes part in is null.
    """
    fh, fw = flow_height or height, flow_width or width
    size, same = height * width, (fh, fw) == (height, width)
    metric = metric if same else resized(metric, fh, fw, height, width)
    # the cell behind the last one is what lies outside of the image
    padded = lambda c: F.concat(c, F.array(F.lit(0.0)))
    wide = images.select(key, padded(F.transform(pixels, lambda p: p.cast("double"))).alias("_p"), padded(F.transform(metric, F.exp)).alias("_w"), flow_x.alias("_fx"), flow_y.alias("_fy"))
    rows = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("cell"))
    row, col = F.floor(F.col("cell") / width).cast("int"), F.col("cell") % width
    flow = lambda n: F.get(n, "cell") if same else resized_at(F.col(n), fh, fw, height, width, row, col)
    rows = rows.select(key, "cell", "_p", "_w", (col + flow("_fx") * (width / fw)).alias("_x"), (row + flow("_fy") * (height / fh)).alias("_y"))
    # further out is as far as two cells are: nothing is there
    near = lambda n, most: F.when(F.col(n) < -2, -2.0).when(F.col(n) > most + 1, most + 1.0).otherwise(F.col(n)).alias(n)
    rows = rows.select(key, "cell", "_p", "_w", near("_x", width), near("_y", height))
    rows = rows.select(key, "cell", "_p", "_w", *[c for n in ("x", "y") for c in (F.floor(f"_{n}").cast("int").alias(f"_{n}0"), (F.col(f"_{n}") - F.floor(f"_{n}")).alias(f"_d{n}"))])
    corners = [(r, c) for r in (0, 1) for c in (0, 1)]

    def place(r: int, c: int) -> Column:
        y, x = F.col("_y0") + r, F.col("_x0") + c
        return F.when(y.between(0, height - 1) & x.between(0, width - 1), y * width + x).otherwise(size)

    rows = rows.select(key, "cell", "_p", "_w", "_dx", "_dy", *[place(r, c).alias(f"_{r}{c}") for r, c in corners])
    found = [(F.get(a, f"_{r}{c}").alias(f"{a}{r}{c}")) for a in ("_p", "_w") for r, c in corners]
    rows = rows.select(key, "cell", "_dx", "_dy", *[(F.col(f"_{r}{c}") < size).cast("double").alias(f"_in{r}{c}") for r, c in corners], *found)

    def between(f) -> Column:
        u, v = F.col("_dx"), F.col("_dy")
        return f("00") * (1 - u) * (1 - v) + f("01") * u * (1 - v) + f("10") * (1 - u) * v + f("11") * u * v

    of = lambda name: between(lambda k: F.col(name + k))
    over = lambda total, weight: total / F.greatest(F.lit(1e-7), weight)
    soft = between(lambda k: F.col("_p" + k) * F.col("_w" + k))
    return rows.select(key, F.col("cell").cast("long").alias("cell"), over(of("_p"), of("_in")).alias("average"), over(soft, of("_w")).alias("soft"))


def match_flow(images: DataFrame, key: str, own: str, other: str, height: int, width: int, channels: int, tile_rows: int = 16, radius: int | None = None) -> DataFrame:
    """Where each cell of an image is expected in another, by softmax of product / sqrt(channels) over all cells of that one, or over those of a square window of `radius` around its place -> key, cell, x, y: how far it has moved.

    images (key, own, other: flat arrays of cells, a cell's channels together). An image is cut into tiles of rows; tiles
    meet tiles, within the radius only, and a pair of tiles gives each cell a state that can be merged: its largest score,
    and sums of weights, x and y relative to that. So no task holds the scores of all pairs of cells, and an image's pairs
    of tiles are dealt to many tasks.
    """
    size, n = tile_rows * width * channels, -(-height // tile_rows)
    reach = n if radius is None else -(-radius // tile_rows)
    tile = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.struct(t.alias("t"), F.slice(c, t * size + 1, size).alias("v")))
    a = images.select(F.col(key).alias("k"), F.inline(tile(F.col(own))))
    b = images.select(F.col(key).alias("k2"), F.inline(tile(F.col(other)))).withColumnsRenamed({"t": "t2", "v": "v2"})
    near = a.withColumn("near", F.explode(F.sequence(F.greatest(F.col("t") - reach, F.lit(0)), F.least(F.col("t") + reach, F.lit(n - 1)))))
    met = near.join(b, (F.col("k") == F.col("k2")) & (F.col("near") == F.col("t2"))).select("k", "t", "v", "t2", "v2")
    kind = dict(images.dtypes)[key]

    def states(batches):
        import pyarrow as pa

        for batch in batches:
            for k, t, v, t2, v2 in zip(*(batch.column(i) for i in range(5)), strict=True):
                p, q = (np.asarray(z.values, float).reshape(-1, channels) for z in (v, v2))
                t, t2 = t.as_py(), t2.as_py()
                score = p @ q.T / channels**0.5
                cell, place = t * tile_rows * width + np.arange(len(p)), t2 * tile_rows * width + np.arange(len(q))
                x, y = place % width, place // width
                if radius is not None:
                    far = (np.abs(cell[:, None] % width - x) > radius) | (np.abs(cell[:, None] // width - y) > radius)
                    score = np.where(far, -np.inf, score)
                top = score.max(axis=1)
                some = np.isfinite(top)
                weight = np.exp(score[some] - top[some, None])
                cols = [pa.array([k.as_py()] * int(some.sum()), batch.column(0).type), cell[some], top[some], weight.sum(axis=1), weight @ x, weight @ y]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["k", "cell", "top", "w", "x", "y"])

    parts = met.mapInArrow(states, f"k {kind}, cell long, top double, w double, x double, y double")
    from pyspark.sql import Window as W

    scale = F.exp(F.col("top") - F.max("top").over(W.partitionBy("k", "cell")))
    merged = parts.select("k", "cell", *[(F.col(c) * scale).alias(c) for c in ("w", "x", "y")]).groupBy("k", "cell").agg(*[F.sum(c).alias(c) for c in ("w", "x", "y")])
    return merged.select(F.col("k").alias(key), "cell", (F.col("x") / F.col("w") - F.col("cell") % width).alias("x"), (F.col("y") / F.col("w") - F.floor(F.col("cell") / width)).alias("y"))
