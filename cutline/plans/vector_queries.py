"""Queries over vectors and images: embeddings are 8 x 8 images, scene groups are labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image, planes, vector
from ..operators import similarity
from ..sources.proxies import table
from .registry import query


def images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("px"))


SQL_IMAGES = "images AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS px FROM embeddings)"
#: Arrays are compared element by element.
SQL_CELLS = "unnest(range({0})) AS cell"


def cells(df: DataFrame, array: str, places: int = 6) -> DataFrame:
    return df.select("vec_id", F.posexplode(array).alias("cell", "v")).select("vec_id", F.col("cell").cast("long").alias("cell"), F.bround("v", places).alias("v"))


@query(
    f"""WITH {SQL_IMAGES}, p AS (SELECT vec_id, px, unnest(range(64)) AS k FROM images)
    SELECT vec_id, (k // 8 // 2) * 4 + (k % 8) // 2 AS cell, round_even(avg(px[k + 1]), 6) AS v FROM p GROUP BY 1, 2"""
)
def avg_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Means of 2 x 2 cells."""
    return cells(images(spark, sf).select("vec_id", vector.average_pool(F.col("px"), 8, 8, 2).alias("v")), "v")


SQL_ADJACENT = f"""{SQL_IMAGES}, n AS (SELECT label, vec_id AS a, lead(vec_id) OVER w AS b, px AS va, lead(px) OVER w AS vb FROM images WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    adjacent AS (SELECT label, a, b, list_cosine_similarity(va, vb) AS cosine FROM n WHERE b IS NOT NULL)"""


def adjacent(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.adjacent(images(spark, sf), "label", "vec_id", "px")


@query(f"WITH {SQL_ADJACENT} SELECT label, a, b, round_even(cosine, 6) AS cosine FROM adjacent")
def adjacent_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of each scene and the next."""
    return adjacent(spark, sf).withColumn("cosine", F.bround("cosine", 6))


@query(f"WITH {SQL_ADJACENT} SELECT label, a, b FROM adjacent WHERE 1 - cosine < 0.85")
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring scenes that are alike."""
    return adjacent(spark, sf).where(similarity.similar(F.col("cosine"), 0.85)).select("label", "a", "b")


@query(f"WITH {SQL_ADJACENT}, p AS (SELECT * FROM adjacent WHERE 1 - cosine < 0.85) SELECT label, vec_id, EXISTS (SELECT 1 FROM p WHERE p.label = i.label AND i.vec_id IN (p.a, p.b)) AS in_pair FROM images i")
def similar_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Is a scene like a neighbour?"""
    pairs = adjacent(spark, sf).where(similarity.similar(F.col("cosine"), 0.85))
    return similarity.mark(images(spark, sf).select("label", "vec_id"), pairs, "label", "vec_id")


@query(
    f"""WITH {SQL_IMAGES}, p AS (SELECT vec_id, px, unnest(range(64)) AS cell FROM images), q AS (SELECT *, cell // 16 AS ch, cell % 16 // 4 AS r, cell % 4 AS c FROM p)
    SELECT vec_id, cell, round_even(px[(r * 2 + ch // 2) * 8 + c * 2 + ch % 2 + 1], 6) AS v FROM q"""
)
def space_to_depth(spark: SparkSession, sf: str) -> DataFrame:
    """An image as four of half the size."""
    return cells(images(spark, sf).select("vec_id", vector.space_to_depth(F.col("px"), 8, 8, 2).alias("v")), "v")


@query(f"WITH {SQL_IMAGES}, p AS (SELECT vec_id, px, unnest(range(64)) AS cell FROM images) SELECT vec_id, cell, round_even((px[cell + 1] / 255 - 0.485::DOUBLE) / 0.229::DOUBLE, 6) AS v FROM p")
def image_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels shifted and scaled."""
    return cells(images(spark, sf).select("vec_id", vector.normalise_image(F.col("px"), 0.485, 0.229).alias("v")), "v")


@query(f"WITH {SQL_IMAGES} SELECT vec_id, round_even(list_sum(px), 6) AS total, round_even(list_avg(px), 6) AS mean, round_even(list_sum(px[1:32]), 6) AS first_half, round_even(list_sum([x for x, i in px if i % 2 = 1]), 6) AS even, round_even(list_sum(px[17:24]), 6) AS third_row FROM images")
def channel_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of an array, its halves and its even places."""
    total = vector.total
    first, _ = vector.halves(F.col("px"))
    even, _ = vector.halves(F.col("px"), even_odd=True)
    r = lambda x: F.bround(x, 6)
    return images(spark, sf).select("vec_id", r(total(F.col("px"))).alias("total"), r(total(F.col("px")) / F.size("px")).alias("mean"), r(total(first)).alias("first_half"), r(total(even)).alias("even"), r(F.get(vector.reduce_rows(F.col("px"), 8, 8), F.lit(2))).alias("third_row"))


@query(f"WITH {SQL_IMAGES} SELECT vec_id, round_even(list_sum([-0.5 * ln(2 * pi()) - 0.3::DOUBLE - pow(x - 0.1::DOUBLE, 2) / (2 * exp(0.6::DOUBLE)) for x in px]), 6) AS log_density FROM images")
def gaussian_log_density(spark: SparkSession, sf: str) -> DataFrame:
    """Log density of all pixels under one normal distribution."""
    logs = F.transform("px", lambda x: vector.gaussian_log_density(x, F.lit(0.1), F.lit(0.3)))
    return images(spark, sf).select("vec_id", F.bround(vector.total(logs), 6).alias("log_density"))


#: Blocks of 2 x 2 pixels as cells of a 4 x 4 plane, with four channels each.
SQL_PLANES = f"""{SQL_IMAGES}, planes AS (SELECT vec_id, k, [px[(k // 4 * 2 + j // 2) * 8 + k % 4 * 2 + j % 2 + 1] for j in range(4)] AS v FROM (SELECT vec_id, px, unnest(range(16)) AS k FROM images)),
    s AS (SELECT a.vec_id, a.k, b.k AS j, list_inner_product(a.v, b.v) / 2 AS s FROM planes a JOIN planes b ON b.vec_id = a.vec_id + 1)"""
SQL_MATCHED = "e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id, k)) AS w FROM {0}) SELECT vec_id, k AS cell, round_even(sum(w * (j % 4)) / sum(w) - k % 4, 6) AS x, round_even(sum(w * (j // 4)) / sum(w) - k // 4, 6) AS y FROM e GROUP BY 1, 2"


def plane_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, own, other: an image and the next, as cells of four channels one after the other."""
    places = F.array(*[F.lit((k // 4 * 2 + j // 2) * 8 + k % 4 * 2 + j % 2) for k in range(16) for j in range(4)])
    own = images(spark, sf).select("vec_id", vector.bound(F.col("px"), lambda p: F.transform(places, lambda i: F.get(p, i))).alias("own"))
    return own.join(own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("own").alias("other")), "vec_id")


def matched(found: DataFrame) -> DataFrame:
    return found.select("vec_id", "cell", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"))


@query(f"WITH {SQL_PLANES}, {SQL_MATCHED.format('s')}")
def correlation_soft_match(spark: SparkSession, sf: str) -> DataFrame:
    """How far each block of an image has moved in the next one, in x and y: softmax over all its blocks, row of tiles by row of tiles."""
    return matched(planes.match_flow(plane_pairs(spark, sf), "vec_id", "own", "other", 4, 4, 4, tile_rows=2))


@query(f"WITH {SQL_PLANES}, near AS (SELECT * FROM s WHERE abs(k % 4 - j % 4) <= 1 AND abs(k // 4 - j // 4) <= 1), {SQL_MATCHED.format('near')}")
def local_soft_match(spark: SparkSession, sf: str) -> DataFrame:
    """As correlation_soft_match, among the nine blocks around each place that are in the image."""
    return matched(planes.match_flow(plane_pairs(spark, sf), "vec_id", "own", "other", 4, 4, 4, tile_rows=2, radius=1))


def _sql_warped(a: str) -> str:
    px = lambda r, c: f"(CASE WHEN y0 + {r} BETWEEN 0 AND 3 AND x0 + {c} BETWEEN 0 AND 7 THEN {a}[(y0 + {r}) * 8 + x0 + {c} + 1] ELSE 0 END)"
    return f"({px(0, 0)} * (1 - u) * (1 - v) + {px(0, 1)} * u * (1 - v) + {px(1, 0)} * (1 - u) * v + {px(1, 1)} * u * v)"


#: Two flows on 4 x 8 cells: (ox, oy) is held against (px, py).
SQL_OCCLUDED = f"""(SELECT vec_id, cell, sqrt(pow(ox[cell + 1] + {_sql_warped('px')}, 2) + pow(oy[cell + 1] + {_sql_warped('py')}, 2)) > 0.01 * (sqrt(pow(ox[cell + 1], 2) + pow(oy[cell + 1], 2)) + sqrt(pow(px[cell + 1], 2) + pow(py[cell + 1], 2))) + 0.5 AS occluded
    FROM (SELECT *, floor(x)::BIGINT AS x0, floor(y)::BIGINT AS y0, x - floor(x) AS u, y - floor(y) AS v FROM (SELECT *, cell % 8 + ox[cell + 1] AS x, cell // 8 + oy[cell + 1] AS y FROM (SELECT *, unnest(range(32)) AS cell FROM {{0}}))))"""


@query(
    f"""WITH {SQL_IMAGES}, m AS (SELECT vec_id, [4 * px[2 * k - 1] for k in range(1, 33)] AS x, [4 * px[2 * k] for k in range(1, 33)] AS y FROM images),
    fwd AS (SELECT a.vec_id, a.x AS ox, a.y AS oy, b.x AS px, b.y AS py FROM m a JOIN m b ON b.vec_id = a.vec_id + 1), bwd AS (SELECT a.vec_id, b.x AS ox, b.y AS oy, a.x AS px, a.y AS py FROM m a JOIN m b ON b.vec_id = a.vec_id + 1)
    SELECT f.vec_id, f.cell, f.occluded AS forward, b.occluded AS backward FROM {SQL_OCCLUDED.format('fwd')} f JOIN {SQL_OCCLUDED.format('bwd')} b ON b.vec_id = f.vec_id AND b.cell = f.cell"""
)
def flow_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Is a flow not undone by its counterpart, sampled where it leads to? In both directions."""
    every = lambda odd: F.transform(F.filter("px", lambda _, i: i % 2 == odd), lambda v: 4 * v)
    m = images(spark, sf).select("vec_id", every(0).alias("x"), every(1).alias("y"))
    both = m.join(m.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("bx"), F.col("y").alias("by")), "vec_id")
    f, b = (F.col("x"), F.col("y")), (F.col("bx"), F.col("by"))
    made = both.select("vec_id", F.arrays_zip(image.occluded(*f, *b, 4, 8).alias("f"), image.occluded(*b, *f, 4, 8).alias("b")).alias("z"))
    return made.select("vec_id", F.posexplode("z").alias("cell", "z")).select("vec_id", F.col("cell").cast("long").alias("cell"), F.col("z")["f"].alias("forward"), F.col("z")["b"].alias("backward"))


@query(
    f"""WITH {SQL_IMAGES}, p AS (SELECT vec_id, px, unnest(range(64)) AS cell FROM images), q AS (SELECT vec_id, px, cell, greatest(0, least(7, cell % 8 + 0.3::DOUBLE)) AS x, greatest(0, least(7, cell // 8 + 0.6::DOUBLE)) AS y FROM p),
    r AS (SELECT *, floor(x)::INT AS x0, floor(y)::INT AS y0, x - floor(x) AS fx, y - floor(y) AS fy FROM q)
    SELECT vec_id, cell, round_even(px[y0 * 8 + x0 + 1] * (1 - fx) * (1 - fy) + CASE WHEN x0 < 7 THEN px[y0 * 8 + x0 + 2] ELSE 0 END * fx * (1 - fy) + CASE WHEN y0 < 7 THEN px[y0 * 8 + x0 + 9] ELSE 0 END * (1 - fx) * fy
      + CASE WHEN x0 < 7 AND y0 < 7 THEN px[y0 * 8 + x0 + 10] ELSE 0 END * fx * fy, 6) AS v FROM r"""
)
def backward_warp(spark: SparkSession, sf: str) -> DataFrame:
    """An image sampled at a constant flow, with the border repeated."""
    rows = images(spark, sf).select("vec_id", "px", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("cell"))
    v = vector.bilinear(F.col("px"), 8, 8, F.col("cell") % 8 + F.lit(0.3), F.floor(F.col("cell") / 8) + F.lit(0.6))
    return rows.select("vec_id", F.col("cell").cast("long").alias("cell"), F.bround(v, 6).alias("v"))


@query(
    f"""WITH {SQL_IMAGES}, p AS (SELECT vec_id, px, unnest(range(24)) AS cell FROM images), q AS (SELECT *, cell // 6 AS r, cell % 6 AS c FROM p)
    SELECT vec_id, cell, round_even(px[(c + 1) * 8 + (7 - (7 - (r + 2))) + 1], 6) AS v FROM q"""
)
def image_crop(spark: SparkSession, sf: str) -> DataFrame:
    """An image turned a quarter counter-clockwise, flipped top to bottom, and cropped to 6 x 4 at (1, 2)."""
    places = image.whole(8, 8).quarter(1).upside_down().crop(1, 2, 6, 4)
    return cells(images(spark, sf).select("vec_id", places.take(F.col("px")).alias("v")), "v")
