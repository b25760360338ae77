"""Queries of cropping: an image for each return flag, made of the lines' quantities and prices, with tinted and dim borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import edges as E
from lumenfold.plans.base import registry
from lumenfold.session import table

QUERIES, SQL, query = registry()
SIDE, BAND = 96, 4


def pixels(spark, d):
    """Flag A has a magenta border at the left and a dim one below, R a green one at the top and the right, N none."""
    f, y, x = F.col("l_returnflag"), F.col("l_partkey") % SIDE, F.floor(F.col("l_orderkey") / 7) % SIDE
    p = table(spark, d, "lineitem").groupBy(f.alias("image"), y.alias("y"), x.alias("x")).agg((0.5 + F.avg("l_quantity") / 500).alias("g"), F.avg("l_discount").alias("c"))
    left, low = (F.col("image") == "A") & (F.col("x") < 7), (F.col("image") == "A") & (F.col("y") >= SIDE - 12)
    green = (F.col("image") == "R") & ((F.col("y") < 5) | (F.col("x") >= SIDE - 30))
    tint = F.when(left, 1.9).when(green, 0.5).otherwise(1.0)
    shade = F.when(low, 0.05).otherwise(1.0)
    return p.select("image", "y", "x", (F.col("g") * (1 + F.col("c") / 10) * tint * shade).alias("r"), (F.col("g") * shade).alias("g"), (F.col("g") * (1 - F.col("c") / 10) * tint * shade).alias("b"))


PIXELS_SQL = (
    f"p0 AS (SELECT l_returnflag AS image, l_partkey % {SIDE} AS y, l_orderkey // 7 % {SIDE} AS x, 0.5 + avg(l_quantity) / 500 AS g, avg(l_discount) AS c FROM lineitem GROUP BY ALL),"
    f" p1 AS (SELECT *, CASE WHEN image = 'A' AND x < 7 THEN 1.9 WHEN image = 'R' AND (y < 5 OR x >= {SIDE - 30}) THEN 0.5 ELSE 1.0 END::DOUBLE AS tint, CASE WHEN image = 'A' AND y >= {SIDE - 12} THEN 0.05 ELSE 1.0 END::DOUBLE AS shade FROM p0),"
    " px AS (SELECT image, y, x, g * (1 + c / 10) * tint * shade AS r, g * shade AS g, g * (1 - c / 10) * tint * shade AS b FROM p1)"
)


def _eroded(name: str, source: str, wrap: bool) -> str:
    y, x = ("(cy + dy + gh) % gh", "(cx + dx + gw) % gw") if wrap else ("cy + dy", "cx + dx")
    return f"{name} AS (SELECT image, gh, gw, {y} AS cy, {x} AS cx FROM {source}, unnest([-1, 0, 1]) u(dy), unnest([-1, 0, 1]) v(dx) GROUP BY ALL HAVING count(*) = 9)"


def _crop_sql(band: int = BAND, k: float = 2.0, margin: int = 2) -> str:
    one = lambda c: f"CASE WHEN max({c}) OVER i > min({c}) OVER i THEN ({c} - min({c}) OVER i) / (max({c}) OVER i - min({c}) OVER i) ELSE 0 END AS {c}"
    border = -(-max(E.EDGE, margin) // band)
    ctes = [
        PIXELS_SQL, "q0 AS (SELECT image, y, x, greatest(r, 0) AS r, greatest(g, 0) AS g, greatest(b, 0) AS b, (greatest(r, 0) + greatest(g, 0) + greatest(b, 0)) / 3 AS l FROM px)",
        f"q AS (SELECT image, y, x, max(y) OVER i + 1 AS h, max(x) OVER i + 1 AS w, {', '.join(map(one, 'lrgb'))} FROM q0 WINDOW i AS (PARTITION BY image))",
        f"c AS (SELECT image, h, w, h // {band} AS gh, w // {band} AS gw, y // {band} AS cy, x // {band} AS cx, avg(l) AS l, var_pop(l) AS v, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM q WHERE y // {band} < h // {band} AND x // {band} < w // {band} GROUP BY ALL)",
        f"a0 AS (SELECT image, median(l) AS med, stddev_pop(l) AS sd, quantile_cont(l, 0.05) AS p5, quantile_cont(l, 0.02) AS p2, greatest(1e-6, quantile_cont(l, 0.005)) AS eps, greatest(quantile_cont(v, 0.05), coalesce(nullif(quantile_cont(v, 0.01), 0), 1e-6)) AS flat FROM c GROUP BY image)",
        f"a AS (SELECT image, eps, flat, greatest(med - {k} * greatest(sd, 1e-6), p5, eps) AS bright, greatest(p2, eps) AS dim FROM a0)",
        f"k AS (SELECT c.*, (r > eps OR g > eps OR b > eps) AND l >= bright AND NOT (l <= dim AND v <= flat) AS base, (r > eps OR g > eps OR b > eps) AND l >= dim AS relaxed, greatest(r, g, b) - least(r, g, b) > {E.CHROMA} AND (cy < {border} OR cx < {border} OR cy >= gh - {border} OR cx >= gw - {border}) AS tint FROM c JOIN a USING (image))",
        f"m0 AS (SELECT * FROM (SELECT *, avg(base::INT) OVER (PARTITION BY image) AS share FROM k) WHERE CASE WHEN share < {E.LEAST_BASE} THEN relaxed ELSE base END)", "t0 AS (SELECT image, gh, gw, cy, cx FROM k WHERE tint)", _eroded("t1", "t0", False), _eroded("t2", "t1", False),
        "m1 AS (SELECT image, gh, gw, cy, cx FROM m0 ANTI JOIN t2 USING (image, cy, cx))", _eroded("m2", "m1", True), _eroded("m3", "m2", True),
        f"n AS (SELECT image, count(*) > {E.AGAIN} * any_value(gh * gw) AS many FROM m2 GROUP BY image)", "m AS (SELECT m3.* FROM m3 JOIN n USING (image) WHERE many UNION ALL SELECT m2.* FROM m2 JOIN n USING (image) WHERE NOT many)",
        "bb AS (SELECT image, min(cy) AS cy0, min(cx) AS cx0, max(cy) + 1 AS cy1, max(cx) + 1 AS cx1 FROM m GROUP BY image)",
        f"s AS (SELECT image, h, w, gh, gw, floor(cy0 * h / gh) + {margin} AS y0, floor(cx0 * w / gw) + {margin} AS x0, least(h, floor(cy1 * h / gh) - {margin}) AS y1, least(w, floor(cx1 * w / gw) - {margin}) AS x1 FROM (SELECT DISTINCT image, h, w, gh, gw FROM c) LEFT JOIN bb USING (image))",
        "ok AS (SELECT *, coalesce(y1 > y0 + 8 AND x1 > x0 + 8, false) AS sound FROM s)",
    ]
    pick = lambda tiny, name, all_: f"CASE WHEN gh < 3 OR gw < 3 THEN {tiny} WHEN sound THEN {name} ELSE {all_} END::BIGINT AS {name}"
    return "WITH " + ", ".join(ctes) + f" SELECT image, {pick(margin, 'y0', 0)}, {pick(margin, 'x0', 0)}, {pick(f'h - {margin}', 'y1', 'h')}, {pick(f'w - {margin}', 'x1', 'w')} FROM ok"


@query(_crop_sql())
def autocrop_gates(spark, d):
    """The box that a pooled grid's gates leave of each image."""
    return E.autocrop(pixels(spark, d), band=BAND, margin=2)


def _trim_sql(step: int = 3, least: int = 32, guard: int = 64) -> str:
    def strips(name: str, far: dict[str, str], bounds: str) -> str:
        union = " UNION ALL ".join(f"SELECT q.*, '{side}' AS side, ({d}) // {step} AS strip FROM q JOIN {bounds} z USING (image) WHERE q.x >= z.x0 AND q.x < z.x1" for side, d in far.items())
        return (
            f"{name}s AS (SELECT image, side, strip, median(rg) AS rg, median(bg) AS bg, median(sat) AS sat FROM ({union}) WHERE strip * {step} < depth GROUP BY ALL),"
            f" {name} AS (SELECT image, side, coalesce(min(strip) FILTER (NOT (abs(rg - mrg) > trg OR abs(bg - mbg) > tbg)), max(strip) + 1) * {step} AS cut FROM {name}s JOIN core USING (image) GROUP BY image, side"
            f" HAVING bool_or(strip = 0 AND sat >= tsat AND (abs(rg - mrg) > {E.START} * trg OR abs(bg - mbg) > {E.START} * tbg)))"
        )

    cut = lambda t, side: f"coalesce((SELECT cut FROM {t} WHERE {t}.image = z.image AND side = '{side}'), 0)"
    return "WITH " + ", ".join([
        PIXELS_SQL, "box AS (SELECT image, 0 AS y0, 0 AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM px GROUP BY image)",
        f"q AS (SELECT px.image, y, x, y0, y1, x0, x1, least({guard}, greatest(8, (x1 - x0) // 10), greatest(8, (y1 - y0) // 10)) AS depth, ln((r + 1e-6) / (g + 1e-6)) AS rg, ln((b + 1e-6) / (g + 1e-6)) AS bg, greatest(r, g, b) - least(r, g, b) AS sat FROM px JOIN box USING (image) WHERE y1 - y0 > {2 * least} AND x1 - x0 > {2 * least})",
        f"inner_ AS (SELECT * FROM q WHERE y >= y0 + {least} AND y < y1 - {least} AND x >= x0 + {least} AND x < x1 - {least})", "md AS (SELECT image, median(rg) AS mrg, median(bg) AS mbg, median(sat) AS msat FROM inner_ GROUP BY image)",
        f"core AS (SELECT image, any_value(mrg) AS mrg, any_value(mbg) AS mbg, greatest({E.CAST}, {E.MADS} * (median(abs(rg - mrg)) + 1e-6)) AS trg, greatest({E.CAST}, {E.MADS} * (median(abs(bg - mbg)) + 1e-6)) AS tbg, greatest({E.SATURATION}, any_value(msat) + 4 * (median(abs(sat - msat)) + 1e-6)) AS tsat FROM inner_ JOIN md USING (image) GROUP BY image)",
        strips("across", {"x0": "q.x - q.x0", "x1": "q.x1 - 1 - q.x"}, "box"), f"held AS (SELECT image, y0, y1, x0 + {cut('across', 'x0')} AS x0, x1 - {cut('across', 'x1')} AS x1 FROM box z)",
        strips("down", {"y0": "q.y - q.y0", "y1": "q.y1 - 1 - q.y"}, "held"),
    ]) + f" SELECT image, (y0 + {cut('down', 'y0')})::BIGINT AS y0, x0::BIGINT AS x0, (y1 - {cut('down', 'y1')})::BIGINT AS y1, x1::BIGINT AS x1 FROM held z"


@query(_trim_sql())
def cast_edge_trim(spark, d):
    """Tinted borders taken off whole images; the dim one and the wide one aren't."""
    p = pixels(spark, d)
    zero = F.lit(0).cast("long")
    boxes = E.sizes(p).select("image", zero.alias("y0"), zero.alias("x0"), F.col("h").alias("y1"), F.col("w").alias("x1"))
    return E.trim_cast(p, boxes)


@query(
    "WITH c AS (SELECT l_returnflag AS image, l_partkey % 48 AS y, l_orderkey // 7 % 48 AS x, count(*) AS cover FROM lineitem WHERE l_partkey % 48 > 0 OR l_orderkey % 2 = 0 GROUP BY ALL), s AS (SELECT image, max(y) + 1 AS h, max(x) + 1 AS w, max(cover) AS most FROM c GROUP BY image),"
    " t AS (SELECT *, greatest(3, 0.4 * most) AS need, greatest(1, 0.08 * least(h, w)) AS margin FROM s), g AS (SELECT t.image, margin, a.y, b.x, coalesce(c.cover, 0) >= need AS good FROM t, unnest(range(h)) a(y), unnest(range(w)) b(x) LEFT JOIN c ON c.image = t.image AND c.y = a.y AND c.x = b.x),"
    " d AS (SELECT p.image, p.y, p.x, any_value(p.margin) AS margin, min(sqrt((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x))) AS far FROM g p JOIN g q ON q.image = p.image AND NOT q.good AND abs(p.y - q.y) <= ceil(p.margin) AND abs(p.x - q.x) <= ceil(p.margin) WHERE p.good GROUP BY p.image, p.y, p.x)"
    " SELECT g.image, g.y, g.x, round(CASE WHEN NOT good THEN 0 WHEN far IS NULL OR far >= g.margin THEN 1 ELSE pow(far / g.margin, 0.5) END, 6) AS alpha FROM g LEFT JOIN d USING (image, y, x)"
)
def coverage_feather(spark, d):
    """Transparencies from coverage, feathered by the exact distance to what isn't covered."""
    t = table(spark, d, "lineitem").where((F.col("l_partkey") % 48 > 0) | (F.col("l_orderkey") % 2 == 0))
    c = t.groupBy(F.col("l_returnflag").alias("image"), (F.col("l_partkey") % 48).alias("y"), (F.floor(F.col("l_orderkey") / 7) % 48).alias("x")).agg(F.count(F.lit(1)).alias("cover"))
    return E.feather(c, margin_percent=8.0, decay=2.0).select("image", "y", "x", F.round("alpha", 6).alias("alpha"))
