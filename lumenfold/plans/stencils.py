"""Queries of stencil kernels and image quality: an image is a label's vectors, a row for each, grouped as Arrow batches.

An image's size is set by its detector, so one image in one task is bounded; images are many.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenfold.operators import kernels as K
from lumenfold.plans.base import registry, rounded
from lumenfold.session import ship, table

QUERIES, SQL, query = registry()
#: Rows of an image: vectors with a common label and a common tenth of the id.
ROWS = 64


def images(spark, d):
    t = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    return t.select(F.concat_ws("/", "label", F.floor(F.col("vec_id") / (ROWS * 10)).cast("string")).alias("image"), "vec_id", "embedding")


def _mapped(spark, d, f, schema: str):
    ship(spark)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        img = np.stack([np.asarray(v, float) for v in rows["embedding"]])
        return pd.DataFrame([(rows["image"].iloc[0], *r) for r in f(img)], columns=[c.split(" ")[0] for c in schema.split(", ")])

    return rounded(images(spark, d).groupBy("image").applyInPandas(one, schema))


def _stats(name, f):
    """A query that gives mean, deviation and extremes of each image after a kernel."""

    def run(spark, d):
        return _mapped(spark, d, lambda img: [(float(o.mean()), float(o.std()), float(o.min()), float(o.max())) for o in [f(img)]], "image string, mean double, deviation double, low double, high double")

    run.__name__ = name
    query(None)(run)


_stats("hot_pixel_repair", lambda i: K.hot_pixels(i))
_stats("gradient_magnitude", lambda i: K.sobel(i))
_stats("background_map", lambda i: K.blur(i, 2.0))
_stats("background_extraction", lambda i: K.background_removed(i, np.isfinite(i)))
_stats("laplacian_roundtrip", lambda i: K.from_laplacian(K.laplacian(i, 2)) - i)
_stats("erosion", lambda i: K.erode(i > np.median(i)).astype(float))
_stats("object_mask", lambda i: K.object_mask(i).astype(float))


@query(None)
def phase_shift(spark, d):
    return _mapped(spark, d, lambda i: [K.phase_shift(np.roll(i, (2, -3), (0, 1)), i)], "image string, dy int, dx int, confidence double")


_PIX = "px AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def pixels(spark, d):
    return table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("x", "f")).select("label", "vec_id", "x", F.col("f").cast("double").alias("v"))


@query(f"WITH {_PIX}, m AS (SELECT *, median(v) OVER (PARTITION BY label) AS m FROM px) SELECT label, round(any_value(m), 6) AS median, round(1.4826 * median(abs(v - m)) + 1e-6, 6) AS mad FROM m GROUP BY label")
def center_sky_stats(spark, d):
    from pyspark.sql import Window

    p = pixels(spark, d).withColumn("m", F.median("v").over(Window.partitionBy("label")))
    return rounded(p.groupBy("label").agg(F.first("m").alias("median"), (1.4826 * F.median(F.abs(F.col("v") - F.col("m"))) + 1e-6).alias("mad")))


@query(f"WITH {_PIX}, s AS (SELECT label, floor((atan2(x - 31.5, vec_id % 64 - 31.5) + pi()) / (pi() / 4))::INT % 8 AS sector, count(*) AS n, count(*) FILTER (v > 0) AS sky FROM px GROUP BY ALL) SELECT label, round(1 - min(sky / n), 6) AS worst FROM s GROUP BY label")
def sector_completeness(spark, d):
    angle = F.atan2(F.col("x") - 31.5, F.col("vec_id") % 64 - 31.5)
    s = pixels(spark, d).groupBy("label", (F.floor((angle + F.pi()) / (F.pi() / 4)).cast("int") % 8).alias("sector")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("v") > 0, 1)).alias("sky"))
    return rounded(s.groupBy("label").agg((1 - F.min(F.col("sky") / F.col("n"))).alias("worst")))


@query(f"WITH {_PIX}, c AS (SELECT label, (x >= 32)::INT * 2 + (vec_id % 64 >= 32)::INT AS corner, count(*) AS n, count(*) FILTER (v <= 0) AS missing FROM px WHERE (x < 8 OR x >= 56) AND (vec_id % 64 < 8 OR vec_id % 64 >= 56) GROUP BY ALL) SELECT label, round(max(missing / n), 6) AS worst FROM c GROUP BY label")
def corner_emptiness(spark, d):
    x, y = F.col("x"), F.col("vec_id") % 64
    p = pixels(spark, d).where(((x < 8) | (x >= 56)) & ((y < 8) | (y >= 56)))
    c = p.groupBy("label", ((x >= 32).cast("int") * 2 + (y >= 32).cast("int")).alias("corner")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("v") <= 0, 1)).alias("missing"))
    return rounded(c.groupBy("label").agg(F.max(F.col("missing") / F.col("n")).alias("worst")))


@query(f"WITH {_PIX}, b AS (SELECT label, x, vec_id % 64 AS y FROM px WHERE v > 0.15), m AS (SELECT label, count(*) AS n, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM b GROUP BY label) SELECT label, n, round(CASE WHEN n < 50 THEN 0 ELSE 1 - ((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b)) / ((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)) END, 6) AS trailing_index FROM m")
def trailing_index(spark, d):
    b = pixels(spark, d).where("v > 0.15").select("label", F.col("x").cast("double").alias("x"), (F.col("vec_id") % 64).cast("double").alias("y"))
    m = b.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("a"), F.var_pop("y").alias("c"), F.covar_pop("x", "y").alias("b"))
    mid, root = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") * F.col("b"))
    return rounded(m.select("label", "n", F.when(F.col("n") < 50, 0.0).otherwise(1 - (mid - root) / (mid + root)).alias("trailing_index")))


@query(f"WITH {_PIX} SELECT label, count(*) AS n, round(avg(v), 6) AS mean FROM px WHERE x BETWEEN 7 AND 56 AND vec_id % 64 BETWEEN 7 AND 56 GROUP BY label")
def percent_crop(spark, d):
    p = pixels(spark, d).where(F.col("x").between(7, 56) & (F.col("vec_id") % 64).between(7, 56))
    return rounded(p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")))


@query(f"WITH {_PIX}, c AS (SELECT label, x // 8 AS cell, count(*) FILTER (v > 0) AS cover FROM px GROUP BY ALL), m AS (SELECT *, greatest(3, 0.4 * max(cover) OVER (PARTITION BY label)) AS need FROM c) SELECT label, cell::BIGINT AS cell, cover, (cover >= need)::INT * 255 AS alpha FROM m")
def coverage_alpha(spark, d):
    from pyspark.sql import Window

    c = pixels(spark, d).groupBy("label", F.floor(F.col("x") / 8).alias("cell")).agg(F.count(F.when(F.col("v") > 0, 1)).alias("cover"))
    need = F.greatest(F.lit(3.0), 0.4 * F.max("cover").over(Window.partitionBy("label")))
    return c.select("label", "cell", "cover", ((F.col("cover") >= need).cast("int") * 255).alias("alpha"))
