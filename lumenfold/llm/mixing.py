"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source asks for a share of the budget in proportion to its weight. A source that cannot give its share
within ``max_epochs`` repetitions is clamped there and its excess is dealt to the others by weight, until no
target is above its cap. Then each document appears ``floor(target / size)`` times, and once more if its seeded
hash falls below the source's threshold, which two levels of histograms place just short of the target, or in the one
further hash cell whose words come nearest to what is then missing.

Defined cases: a null or empty text has size 0 (it follows its source's repetitions at no cost); a null source is
one source, the last; a source of size 0 has target 0; repeated rows fall on the same side of the threshold
together; an empty table gives an empty result. Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources (about 100 bytes each) the plan is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
CELLS = 4096
_P = "__mix_"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget_share: float, max_epochs: int) -> DataFrame:
    """``sources`` (source, weight, size) -> the same with ``target``; one row per source, so one window suffices.

    With caps sorted by cap / weight, the clamped ones are a prefix: the k-th is clamped while the level that the
    budget left after k - 1 caps would reach over the remaining weights is still above its own ratio.
    """
    cap = F.col("size") * F.lit(max_epochs)
    ratio = cap / F.col("weight")
    order = Window.orderBy(F.col(_P + "ratio"), F.col("source").asc_nulls_first())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.col(_P + "budget") - F.col(_P + "given")) / (F.col(_P + "weights") - F.col(_P + "passed"))
    ranked = (
        sources.withColumn(_P + "cap", cap.cast("double"))
        .withColumn(_P + "ratio", ratio)
        .withColumn(_P + "budget", F.sum("size").over(whole) * F.lit(budget_share))
        .withColumn(_P + "weights", F.sum("weight").over(whole))
        .withColumn(_P + "given", F.coalesce(F.sum(_P + "cap").over(before), F.lit(0.0)))
        .withColumn(_P + "passed", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn(_P + "level", level)
        .withColumn(_P + "open", F.col(_P + "ratio") >= F.col(_P + "level"))
    )
    settled = F.min(F.when(F.col(_P + "open"), F.struct(_P + "ratio", _P + "level"))).over(whole)[_P + "level"]
    target = F.when(F.col(_P + "open"), F.col("weight") * settled).otherwise(F.col(_P + "cap"))
    return ranked.withColumn("target", F.least(target, F.col(_P + "cap"))).select(*sources.columns, "target")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    budget_share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 20240229,
) -> DataFrame:
    """All columns of ``docs`` and ``size``, ``source_size``, ``target``, ``taken`` and ``copies`` (0 .. max_epochs).

    ``weights`` go to the sources in order of their names' code points, null last, again and again.
    """
    size, source = F.col(_P + "size"), F.col(_P + "source")
    added = ("size", "source_size", "target", "taken", "copies")
    cell = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(CELLS * CELLS))
    sized = (
        docs.withColumn(_P + "size", word_count(F.col(text_col)))
        .withColumn(_P + "source", F.col(source_col))
        .withColumn(_P + "cell", cell)
        .withColumn(_P + "high", (F.col(_P + "cell") / CELLS).cast("int"))
        .withColumn(_P + "low", (F.col(_P + "cell") % CELLS).cast("int"))
    )
    cells = materialize(
        sized.groupBy(source.alias("source"), F.col(_P + "high").alias("high"), F.col(_P + "low").alias("low")).agg(F.sum(size).alias("words")),
        "mix-cells",
    )
    plan = _plan(cells, weights, budget_share, max_epochs).withColumnRenamed("source", _P + "plan_source")
    plan = materialize(plan.select(*[F.col(c).alias(_P + "p_" + c) if not c.startswith(_P) else F.col(c) for c in plan.columns]), "mix-plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = sized.join(plan, source.eqNullSafe(F.col(_P + "plan_source")), "left")
    cell = F.col(_P + "cell")
    extra = F.when((cell < F.col(_P + "p_threshold")) | (cell == F.col(_P + "p_topping")), 1).otherwise(0)
    copies = F.least(F.coalesce(F.col(_P + "p_whole"), F.lit(0)) + extra, F.lit(max_epochs)).cast("int")
    out = {
        "size": size,
        "source_size": F.coalesce(F.col(_P + "p_size"), F.lit(0)).cast("long"),
        "target": F.coalesce(F.col(_P + "p_target"), F.lit(0.0)),
        "taken": (size * copies).cast("long"),
        "copies": copies,
    }
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *[v.alias(k) for k, v in out.items()])


def _plan(cells: DataFrame, weights: tuple[int, ...], budget_share: float, max_epochs: int) -> DataFrame:
    """(source, size, target, whole, threshold, topping): documents in cells below the threshold or in the topping appear once more."""
    by_high = cells.groupBy("source", "high").agg(F.sum("words").alias("words"))
    sources = by_high.groupBy("source").agg(F.sum("words").alias("size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long"))
    filled = water_fill(weighed, budget_share, max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    filled = filled.withColumn("whole", whole.cast("int")).withColumn("need", F.col("target") - F.col("whole") * F.col("size"))

    def upto(df: DataFrame, cell: str) -> DataFrame:
        """Adds ``below``: the words in smaller cells of the source; at most CELLS rows a source."""
        w = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("below", F.coalesce(F.sum("words").over(w), F.lit(0)))

    def crossing(df: DataFrame, need: DataFrame, cell: str) -> DataFrame:
        """The cell in which the running sum reaches ``need``."""
        other = need.select(F.col("source").alias("n_source"), "need")
        hit = upto(df, cell).join(other, F.col("source").eqNullSafe(F.col("n_source")))
        hit = hit.where((F.col("below") < F.col("need")) & (F.col("below") + F.col("words") >= F.col("need")))
        return hit.select(F.col("source").alias("c_source"), F.col(cell).alias("c_cell"), (F.col("need") - F.col("below")).alias("c_need"))

    first = crossing(by_high, filled, "high")
    inner = cells.join(first, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("high") == F.col("c_cell")))
    inner = inner.select("source", "high", "low", "words", F.col("c_need").alias("i_need"))
    w = Window.partitionBy("source").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("below", F.coalesce(F.sum("words").over(w), F.lit(0)))
    inner = inner.where((F.col("below") < F.col("i_need")) & (F.col("below") + F.col("words") >= F.col("i_need")))
    number = F.col("high") * CELLS + F.col("low")
    cut = inner.select(F.col("source").alias("t_source"), number.cast("long").alias("threshold"), (F.col("i_need") - F.col("below")).alias("short"))
    # of the cells that are left, the one whose words come nearest to what is still short
    above = cells.join(cut, F.col("source").eqNullSafe(F.col("t_source")) & (number >= F.col("threshold")))
    nearest = F.min(F.struct(F.abs(F.col("words") - F.col("short")).alias("off"), number.cast("long").alias("cell"), "short"))
    topped = above.groupBy(F.col("source").alias("u_source")).agg(nearest.alias("best"))
    topped = topped.where("best.off < best.short").select("u_source", F.col("best.cell").alias("topping"))
    out = filled.join(cut, F.col("source").eqNullSafe(F.col("t_source")), "left").join(topped, F.col("source").eqNullSafe(F.col("u_source")), "left")
    return out.select("source", "size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"), F.coalesce("topping", F.lit(-1)).alias("topping"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says."""
    return mixed.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias(_P + "n")).drop(_P + "n")
