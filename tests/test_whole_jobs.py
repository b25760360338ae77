"""Queries do their whole job: no sample left out, none sent in vain."""

import __spark_entry__
from lumenfold.operators import calibration


def test_shapes_are_of_all_samples(spark, tmp_path):
    rows = [(1, 1, 1, 1, 50.0, 9.0, "A"), (2, 1, 1, 3, 5.0, 9.0, "R"), (3, 1, 2, 3, 50.0, 9.0, "A"), (4, 1, 2, 1, 5.0, 9.0, "R"), (5, 1, 3, 1, 50.0, 9.0, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in __spark_entry__.queries()["shape_consistency"](spark, str(tmp_path)).collect()} == {(1, 2, 3), (2, 2, 3)}


def test_samples_are_sent_only_where_both_tiles_reach(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "i long, j long")
    rows = [(1, p, p + 0.5) for p in range(10)] + [(2, p, p + 1.5) for p in range(8, 20)] + [(3, p, p + 2.5) for p in range(100, 110)] + [(1, 50, None), (3, 5, float("nan"))]
    found = calibration.pair_samples(edges, spark.createDataFrame(rows, "id long, place long, value double"))
    assert {tuple(r) for r in found.collect()} == {(1, 2, 8.5, 9.5), (1, 2, 9.5, 10.5)}
    assert "first_i" in found._jdf.queryExecution().optimizedPlan().toString()
