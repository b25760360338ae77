"""Bindings of the engine's relations to the driver's tables, and what the plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.robust import samples
from lumenfold.session import table

#: Decimals of compared numbers.
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stack(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """samples(pixel, frame, channel, value, weight): variance-stabilised prices of a part by supplier."""
    t = table(spark, sf_dir, "lineitem")
    named = {"pixel": F.col("l_partkey"), "frame": F.col("l_suppkey"), "channel": F.col("l_returnflag"), "y": F.col("l_orderkey"), "x": F.col("l_linenumber")}
    keys = {k: named[k] for k in ("pixel", *extra)}
    return samples(t, keys, F.sqrt("l_extendedprice"), F.col("l_quantity"))


STACK_SQL = "s AS (SELECT l_partkey AS pixel, l_suppkey AS frame, l_returnflag AS channel, l_orderkey AS y, l_linenumber AS x, sqrt(l_extendedprice) AS value, l_quantity AS weight FROM lineitem)"


def registry():
    """A decorator that registers a query under its function's name, with its SQL."""
    queries, sql = {}, {}

    def add(text: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return keep

    return queries, sql, add
