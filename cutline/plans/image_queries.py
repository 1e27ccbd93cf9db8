"""Queries over images: warps, splats, resizing, tiles, turning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image, planes
from .registry import query
from .vector_queries import SQL_IMAGES, cells, images

H = WIDTH = 8


def with_next(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, px, and the next image (nx)."""
    a = images(spark, sf).select("vec_id", "px")
    return a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("nx")), "vec_id")


SQL_NEXT = f"{SQL_IMAGES}, nexts AS (SELECT a.vec_id, a.px, b.px AS nx FROM images a JOIN images b ON b.vec_id = a.vec_id + 1)"


def sql_sample(array: str, height: int = H, width: int = WIDTH) -> str:
    """A bilinear sample with zeros outside, from columns x0, y0, u, v (the fractions)."""
    px = lambda r, c: f"(CASE WHEN y0 + {r} BETWEEN 0 AND {height - 1} AND x0 + {c} BETWEEN 0 AND {width - 1} THEN {array}[(y0 + {r}) * {width} + x0 + {c} + 1] ELSE 0 END)"
    return f"({px(0, 0)} * (1 - u) * (1 - v) + {px(0, 1)} * u * (1 - v) + {px(1, 0)} * (1 - u) * v + {px(1, 1)} * u * v)"


SQL_FLOOR = "floor(x)::BIGINT AS x0, floor(y)::BIGINT AS y0, x - floor(x) AS u, y - floor(y) AS v"
#: Flows: three times the next image's values, read forwards for x and backwards for y.
SQL_FLOWS = f"""{SQL_NEXT}, spots AS (SELECT vec_id, px, nx, unnest(range(64)) AS cell FROM nexts), flows AS (SELECT *, cell % 8 + 3 * nx[cell + 1] AS fx, cell // 8 + 3 * nx[64 - cell] AS fy FROM spots)"""


def flows(spark: SparkSession, sf: str) -> DataFrame:
    both = with_next(spark, sf)
    return both.withColumn("x", F.transform("nx", lambda v: 3 * v)).withColumn("y", F.transform(F.reverse("nx"), lambda v: 3 * v))


@query(
    f"""WITH {SQL_FLOWS}, p AS (SELECT *, greatest(0, least(7, fx)) AS x, greatest(0, least(7, fy)) AS y FROM flows), q AS (SELECT *, {SQL_FLOOR} FROM p)
    SELECT vec_id, cell, round_even({sql_sample('px')}, 6) AS v FROM q"""
)
def flow_warp(spark: SparkSession, sf: str) -> DataFrame:
    """An image sampled where each of its cells points, with the border repeated."""
    return cells(flows(spark, sf).select("vec_id", image.warp(F.col("px"), F.col("x"), F.col("y"), H, WIDTH).alias("v")), "v")


def splatted(found: DataFrame) -> DataFrame:
    return found.select("vec_id", "cell", *[F.bround(c, 6).alias(c) for c in ("average", "soft")])


@query(
    f"""WITH {SQL_FLOWS}, p AS (SELECT vec_id, cell, px, [1.0::DOUBLE for k in px] AS ones, [exp(m) for m in nx] AS w, [px[k] * exp(nx[k]) for k in range(1, 65)] AS pw, fx AS x, fy AS y FROM flows), q AS (SELECT *, {SQL_FLOOR} FROM p)
    SELECT vec_id, cell, round_even({sql_sample('px')} / greatest(1e-7, {sql_sample('ones')}), 6) AS average, round_even({sql_sample('pw')} / greatest(1e-7, {sql_sample('w')}), 6) AS soft FROM q"""
)
def softsplat(spark: SparkSession, sf: str) -> DataFrame:
    """Samples where the flow points, over the sum of their weights: even, and by a metric."""
    return splatted(planes.splats(flows(spark, sf), "vec_id", F.col("px"), F.col("x"), F.col("y"), F.col("nx"), H, WIDTH))


@query(
    f"""WITH {SQL_NEXT}, spots AS (SELECT vec_id, px, nx, unnest(range(64)) AS cell FROM nexts),
    half AS (SELECT *, greatest(0, least(3, (cell % 8 + 0.5::DOUBLE) / 2 - 0.5)) AS x, greatest(0, least(3, (cell // 8 + 0.5::DOUBLE) / 2 - 0.5)) AS y, nx[1:16] AS fx, nx[17:32] AS fy, nx[33:48] AS m FROM spots), q AS (SELECT *, {SQL_FLOOR} FROM half),
    flow AS (SELECT vec_id, px, cell, cell % 8 + 2 * {sql_sample('fx', 4, 4)} AS x, cell // 8 + 2 * {sql_sample('fy', 4, 4)} AS y, exp({sql_sample('m', 4, 4)}) AS e FROM q),
    w AS (SELECT vec_id, list(e ORDER BY cell) AS w FROM flow GROUP BY 1), p AS (SELECT f.*, w, [1.0::DOUBLE for k in px] AS ones, [px[k] * w[k] for k in range(1, 65)] AS pw FROM flow f JOIN w USING (vec_id)), z AS (SELECT *, {SQL_FLOOR} FROM p)
    SELECT vec_id, cell, round_even({sql_sample('px')} / greatest(1e-7, {sql_sample('ones')}), 6) AS average, round_even({sql_sample('pw')} / greatest(1e-7, {sql_sample('w')}), 6) AS soft FROM z"""
)
def softsplat_resized(spark: SparkSession, sf: str) -> DataFrame:
    """softsplat() with a flow and a metric of half the image's size, which are brought to it first."""
    f = with_next(spark, sf)
    part = lambda k: F.slice("nx", 16 * k + 1, 16)
    return splatted(planes.splats(f, "vec_id", F.col("px"), part(0), part(1), part(2), H, WIDTH, 4, 4))


@query(
    f"""WITH {SQL_IMAGES}, d AS (SELECT vec_id, px, unnest(range(256)) AS cell FROM images), p AS (SELECT *, greatest(0, least(7, (cell % 16 + 0.5::DOUBLE) / 2 - 0.5)) AS x, greatest(0, least(7, (cell // 16 + 0.5::DOUBLE) / 2 - 0.5)) AS y FROM d), q AS (SELECT *, {SQL_FLOOR} FROM p)
    SELECT vec_id, cell, round_even({sql_sample('px')}, 6) AS v, ({sql_sample('px')} > 0.05)::DOUBLE AS hole FROM q"""
)
def image_resize(spark: SparkSession, sf: str) -> DataFrame:
    """An image at twice its size, and where it is above a level."""
    made = images(spark, sf).select("vec_id", image.resize(F.col("px"), H, WIDTH, 2).alias("v"))
    holes = image.binary_hole(F.transform("v", lambda x: x * 10))
    both = made.select("vec_id", F.posexplode(F.arrays_zip("v", holes.alias("h"))).alias("cell", "z"))
    return both.select("vec_id", F.col("cell").cast("long").alias("cell"), F.bround(F.col("z")["v"], 6).alias("v"), F.col("z")["h"].alias("hole"))


@query(
    f"""WITH {SQL_FLOWS}, p AS (SELECT *, fx AS x, fy AS y FROM flows), q AS (SELECT *, {SQL_FLOOR} FROM p)
    SELECT vec_id, cell, round_even((x - 3.5) / 3.5, 6) AS nx, round_even((y - 3.5) / 3.5, 6) AS ny, x >= 0 AND x <= 7 AND y >= 0 AND y <= 7 AS inside, round_even({sql_sample('px')}, 6) AS v FROM q"""
)
def grid_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sample places as coordinates from -1 to 1, whether they are inside, and samples with zeros outside."""
    f = flows(spark, sf).withColumn("v", image.warp(F.col("px"), F.col("x"), F.col("y"), H, WIDTH, border=False))
    rows = f.select("vec_id", F.posexplode(F.arrays_zip("x", "y", "v")).alias("cell", "z"))
    x, y = F.col("cell") % WIDTH + F.col("z")["x"], F.floor(F.col("cell") / WIDTH) + F.col("z")["y"]
    r = lambda c: F.bround(c, 6)
    return rows.select("vec_id", F.col("cell").cast("long").alias("cell"), r(image.normalised(x, WIDTH)).alias("nx"), r(image.normalised(y, H)).alias("ny"), image.inside(x, y, H, WIDTH).alias("inside"), r(F.col("z")["v"]).alias("v"))


@query(
    f"""WITH {SQL_IMAGES}, d AS (SELECT vec_id, px, unnest(range(64)) AS cell FROM images), t AS (SELECT *, cell // 16 AS tile, cell % 16 // 4 AS r, cell % 4 AS c FROM d)
    SELECT vec_id, cell, round_even(px[(tile // 2 * 4 + r) * 8 + tile % 2 * 4 + c + 1], 6) AS v FROM t"""
)
def tile_split(spark: SparkSession, sf: str) -> DataFrame:
    """An image as four tiles."""
    return cells(images(spark, sf).select("vec_id", image.split_tiles(F.col("px"), H, WIDTH, 2).alias("v")), "v")


@query(f"WITH {SQL_IMAGES} SELECT vec_id, cell, round_even(px[cell + 1], 6) AS v FROM (SELECT vec_id, px, unnest(range(64)) AS cell FROM images)")
def tile_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles, put together again."""
    tiles = images(spark, sf).select("vec_id", image.split_tiles(F.col("px"), H, WIDTH, 4).alias("t"))
    return cells(tiles.select("vec_id", image.merge_tiles(F.col("t"), H, WIDTH, 4).alias("v")), "v")


@query(
    f"""WITH {SQL_IMAGES}, d AS (SELECT vec_id, px, unnest(range(144)) AS cell FROM images), p AS (SELECT *, cell % 12 + 0.5 - 6 AS x, cell // 12 + 0.5 - 6 AS y FROM d),
    s AS (SELECT *, floor(cos(radians(30)) * x + sin(radians(30)) * y + 4)::BIGINT AS c, floor(cos(radians(30)) * y - sin(radians(30)) * x + 4)::BIGINT AS r FROM p)
    SELECT vec_id, cell, round_even(CASE WHEN r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 THEN px[r * 8 + c + 1] ELSE 0 END, 6) AS v FROM s"""
)
def image_rotate(spark: SparkSession, sf: str) -> DataFrame:
    """An image turned by 30 degrees, in a box that holds it."""
    return cells(images(spark, sf).select("vec_id", image.whole(H, WIDTH).rotate(30).take(F.col("px")).alias("v")), "v")


@query(f"WITH {SQL_NEXT} SELECT vec_id, cell, round_even(CASE WHEN cell % 16 < 8 THEN px[cell // 16 * 8 + cell % 16 + 1] ELSE nx[cell // 16 * 8 + cell % 16 - 7] END, 6) AS v FROM (SELECT *, unnest(range(128)) AS cell FROM nexts)")
def image_beside(spark: SparkSession, sf: str) -> DataFrame:
    """Two images side by side."""
    return cells(with_next(spark, sf).select("vec_id", image.beside(F.col("px"), F.col("nx"), H, WIDTH, WIDTH).alias("v")), "v")
