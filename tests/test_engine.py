"""Operators of the engine: analytic cases, invariance to order and partitions, sources, and SQL parity at the smallest scale."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenfold.functions import columns as C
from lumenfold.operators import graph, grouping, kernels, normalize, robust, spatial
from lumenfold.sources import plans as sources

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


def stack(spark, values, weights=None):
    w = weights or [1.0] * len(values)
    return robust.samples(spark.createDataFrame([(1, v, x) for v, x in zip(values, w, strict=True)], "k int, v double, w double"), {"k": F.col("k")}, F.col("v"), F.col("w"))


COMBINES = {
    "mean": lambda s: robust.combine(s, ["k"]),
    "weighted": lambda s: robust.combine(s, ["k"], "weighted"),
    "kappa": lambda s: robust.kept_mean(robust.clip_once(s, ["k"], 1.5, 1.5), ["k"]),
    "iterated": lambda s: robust.kept_mean(robust.kappa_iterated(s, ["k"]), ["k"]),
    "legacy": lambda s: robust.winsor_clip(s, ["k"], (0.05, 0.05), 3.0, 3.0, refill=False),
    "rewinsor": lambda s: robust.winsor_clip(s, ["k"], (0.05, 0.05), 3.0, 3.0, refill=True, rounds=0),
    "linear": lambda s: robust.linear_residual_clip(s, ["k"], 3.0),
    "huber": lambda s: robust.huber_winsorized(s, ["k"], 1.5, 1.5),
    "coadd": lambda s: robust.coadd_kappa(s, ["k"], 3.0),
}


@pytest.mark.parametrize("name", COMBINES)
def test_constant_stack(spark, name):
    assert COMBINES[name](stack(spark, [7.0] * 5)).first()["value"] == pytest.approx(7.0)


@pytest.mark.parametrize("name", ["kappa", "iterated", "legacy", "huber"])
def test_single_outlier_is_rejected(spark, name):
    got = COMBINES[name](stack(spark, [10.0] * 9 + [1000.0])).first()["value"]
    assert got == pytest.approx(10.0, abs=1e-3)


@pytest.mark.parametrize("name", COMBINES)
def test_missing_samples(spark, name):
    got = COMBINES[name](stack(spark, [None, float("nan"), float("inf"), 3.0, 3.0])).first()["value"]
    assert got == pytest.approx(3.0)
    nothing = COMBINES[name](stack(spark, [None, float("nan")])).first()["value"]
    assert nothing is None or nothing == 0.0


def test_zero_weights_fall_back_to_the_mean(spark):
    assert robust.combine(stack(spark, [1.0, 3.0], [0.0, 0.0]), ["k"], "weighted").first()["value"] == 2.0


def brute_huber(x, w, low, high, rounds=10):
    m, s = np.median(x), 1.4826 * np.median(np.abs(x - np.median(x)))
    s = s if s > 0 else 1e-10
    for _ in range(rounds):
        c = np.clip(x, m - low * s, m + high * s)
        n = (c * w).sum() / w.sum()
        u = np.abs(c - n) / s
        h = w * np.where(u > max(low, high), max(low, high) / np.maximum(u, 1e-300), 1.0)
        t = math.sqrt((h * (c - n) ** 2).sum() / h.sum()) or 1e-10
        stop = abs(n - m) <= 5e-4 * max(1, abs(m)) and abs(t - s) <= 5e-4 * max(1, abs(s))
        m, s = n, t
        if stop:
            break
    return m


def test_huber_against_numpy(spark):
    rng = np.random.default_rng(13)
    x, w = rng.normal(100, 5, 40), rng.uniform(0.5, 2, 40)
    x[3] = 400
    got = robust.huber_winsorized(stack(spark, list(map(float, x)), list(map(float, w))), ["k"], 1.5, 1.2).first()["value"]
    assert got == pytest.approx(brute_huber(x, w, 1.5, 1.2), rel=1e-12)


@pytest.mark.parametrize("name", ["kappa_onepass_median", "wsc_huber", "overlap_batches", "components"])
def test_independent_of_partitions(spark, name):
    f = __spark_entry__.queries()[name]
    before = sorted(map(str, f(spark, SF).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert sorted(map(str, f(spark, SF).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_parity(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    quoted = ", ".join(f'"{c}"' for c in df.columns)
    want = duck.execute(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()
    plain = lambda rows: sorted([tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows], key=str)
    got, want = plain(df.collect()), plain(want)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, abs=2e-5) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - set(SQL) - {n for n in __spark_entry__.queries() if n.startswith(("op", "pipeline"))}))
def test_others_run(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize(
    ("name", "column", "outcomes"),
    [("mount_run_split", "run", {"split", "whole"}), ("grid_mode_detection", "grid", {True, False}), ("degenerate_canvas", "degenerate", {True, False}), ("progress_reports", "finished", {True, False}), ("calibration_constraints", "reason", {"kept", "gain"})],
)
def test_both_outcomes_occur(spark, name, column, outcomes):
    assert {r[column] for r in __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()} == outcomes


def test_some_frames_have_another_shape(spark):
    kept = __spark_entry__.queries()["shape_consistency"](spark, SF).count()
    assert 0 < kept < spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_touching_boxes(spark):
    b = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 1.0, 2.0, 0.0, 1.0), (3, 0.5, 1.5, 0.5, 1.5), (4, None, 1.0, 0.0, 1.0)], "id int, x0 double, x1 double, y0 double, y1 double")
    assert {(r["i"], r["j"]) for r in spatial.overlap_pairs(b, 0.4).collect()} == {(1, 3), (2, 3)}
    side = lambda p: b.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "x1", "y0", "y1")])
    assert {(r["a"], r["b"]) for r in spatial.box_join(side("a"), side("b"), 3.0, inclusive=True, extra=F.col("a") < F.col("b")).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_angles_wrap(spark):
    df = spark.createDataFrame([(1, 359.0), (1, 1.0)], "g int, a double")
    assert df.select(C.circular_delta(F.lit(359.0), F.lit(1.0)).alias("d")).first()["d"] == 2.0
    assert 360 - spatial.largest_gap(df, ["g"], "a").first()["gap"] == pytest.approx(2.0)
    islands = grouping.orientation_islands(spark.createDataFrame([(1, i, a) for i, a in enumerate([359.0, 1.0, 90.0, None])], "g int, id int, a double"), "g", "a", "id", 5.0)
    assert {r["id"]: r["island"] for r in islands.collect()} == {0: 0, 1: 0, 2: 1, 3: 0}


def test_long_chain_is_one_component(spark):
    n = 200
    nodes = spark.range(n + 1)
    edges = spark.range(n).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    comp = graph.components(nodes, edges.where("i <> 150"))
    assert {(r["component"], r["n"]) for r in comp.groupBy("component").agg(F.count("id").alias("n")).collect()} == {(0, 151), (151, 50)}


def test_relaxation_moves_toward_the_fits(spark):
    fits = spark.createDataFrame([(0, 1, 2.0, 1.0, 1.0)], "i long, j long, a double, b double, w double")
    got = {r["id"]: (r["gain"], r["offset"]) for r in graph.relax(fits, spark.range(2), rounds=40).collect()}
    assert got[0] == (1.0, 0.0) and got[1][0] == pytest.approx(2.0, abs=1e-3)


def test_top_edges_ties(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (1, 3, 5.0), (2, 3, 5.0), (1, 4, 1.0)], "i int, j int, w double")
    assert {(r["i"], r["j"]) for r in graph.top_edges(e, 0).collect()} == {(1, 2), (1, 3), (1, 4)}


def test_robust_fit_ignores_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 60)
    y = 2 * x + 3 + rng.normal(0, 0.01, 60)
    y[:4] += 500
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    got = normalize.iterated_regression(df, ["k"]).first()
    assert got["gain"] == pytest.approx(2, abs=0.01) and got["offset"] == pytest.approx(3, abs=0.05)
    few = normalize.iterated_regression(df.limit(5), ["k"]).first()
    assert (few["gain"], few["offset"]) == (1.0, 0.0)


def test_kernels():
    assert kernels.clip_area([(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)]) == pytest.approx(1.0)
    assert kernels.clip_area([(0, 0), (1, 0), (1, 1)], [(5, 5), (6, 5), (6, 6)]) == 0.0
    rng = np.random.default_rng(2)
    img = rng.normal(size=(24, 32))
    assert kernels.phase_shift(np.roll(img, (2, -3), (0, 1)), img)[:2] == (-2, 3)
    assert np.allclose(kernels.from_laplacian(kernels.laplacian(img, 3)), img)
    flat = np.full((9, 9), 5.0) + rng.normal(0, 0.01, (9, 9))
    flat[4, 4] = 90
    assert abs(kernels.hot_pixels(flat)[4, 4] - 5) < 0.1
    y, x = np.mgrid[:64, :64]
    slope = 0.3 * x + 0.2 * y + 1.0
    assert kernels.background_removed(slope, np.isfinite(slope)).std() < 0.5 * slope.std()
    mask = np.ones((5, 5), bool)
    assert kernels.erode(mask).sum() == 9 and kernels.dilate(np.pad(np.ones((1, 1), bool), 2)).sum() == 9
    assert kernels.merge_small({1: (0, 0, 10), 2: (1, 0, 2), 3: (50, 0, 10)}, 5, 20) == {1: 1, 2: 1, 3: 3}
    assert kernels.coverage_batches([{1, 2}, {3}, {4}, {1}], 4, 2, 9, 0.9) == [0, 0, 0, 0]
    assert kernels.greedy_orientation([0.0, 10.0, None, 359.0, 200.0], 15.0) == [0, 0, 1, 0, 2]
    assert kernels.kruskal_bridges(3, [(0, 1)], [(0, 1, 9.0), (1, 2, 1.0), (0, 2, 5.0)]) == [(0, 2)]
    o = kernels.solve_offsets(3, [(0, 1, 2.0, 1.0), (1, 2, 3.0, 1.0)], 0)
    assert np.allclose(o, [0, 2, 5], atol=1e-3)
    g, o = kernels.solve_affine(2, [(0, 1, 0.5, 0.0, 1e6)], 0)
    assert g[1] == pytest.approx(2.0, abs=1e-2)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(C.eta_hms(F.lit(3661.5))) == "01:01:02" and one(C.eta_hms(F.lit(-5.0))) == "+00:00:05"
    assert one(C.sexagesimal(F.lit("-00:30:00"), False)) == -0.5 and one(C.sexagesimal(F.lit("1h30m"), True)) == 22.5 and one(C.sexagesimal(F.lit("x"), True)) is None
    assert one(C.mount(F.lit(" alt/az "))) == "ALTZ" and one(C.mount(F.lit("dob"))) is None
    assert one(C.boolish(F.lit("auto"), True)) is True and one(C.boolish(F.lit("OFF"), True)) is False
    assert one(C.epoch_days(F.lit("1970-01-02"))) == 1.0 and one(C.epoch_days(F.lit("02/01/1970"))) == 1.0 and one(C.epoch_days(F.lit("soon"))) is None
    assert one(C.safe_int(F.lit("3.9"), 7)) == 3 and one(C.safe_float(F.lit("inf"), 2.0)) == 2.0
    assert one(C.polygon_area(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 1))]))) == 1.0


def test_stack_plan(spark, tmp_path):
    (tmp_path / "a.fit").write_text("x")
    (tmp_path / "b.fit").write_text("x")
    (tmp_path / "plan.csv").write_text("FilePath;ExpTime;Mount;Order\nC:\\data\\a.fit;30;GEM;5\nb.fit;bad;altaz;\nmissing.fit;1;;\n;2;;\n")
    files = sources.list_files(spark, tmp_path.as_uri(), (".fit",))
    plan = {r["file_path"].rsplit("/", 1)[1]: r for r in sources.read_stack_plan(spark, f"{tmp_path.as_uri()}/plan.csv", files).collect()}
    assert set(plan) == {"a.fit", "b.fit"}
    assert (plan["a.fit"]["exposure"], plan["a.fit"]["mount"], plan["a.fit"]["order"]) == (30.0, "EQ", 5)
    assert (plan["b.fit"]["exposure"], plan["b.fit"]["mount"], plan["b.fit"]["order"]) == (1.0, "ALTZ", 1)


def test_catalogue_and_config_round_trip(spark, tmp_path):
    schema = "path string, width int, height int, ra double, dec double, corners array<struct<ra:double,dec:double>>, header map<string,string>"
    items = spark.createDataFrame([("a", 10, 20, None, None, [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], {"CREATOR": "c", "FILTER": "L"}), ("b", 1, 2, 9.0, 8.0, [], {})], schema)
    out = sources.catalogue(items)
    assert out.columns == sources.CATALOGUE
    sources.write_csv(out, f"{tmp_path.as_uri()}/cat")
    back = {r["path"]: r for r in sources.read_catalogue(spark, f"{tmp_path.as_uri()}/cat").collect()}
    assert (back["a"]["ra"], back["a"]["dec"], len(back["a"]["corners"]), back["a"]["header"]) == (3.0, 4.0, 3, {"CREATOR": "c", "FILTER": "L"})
    assert back["b"]["corners"] == [] and back["b"]["ra"] == 9.0
    assert sources.header_lines(items).count() == 2
    sources.write_config(spark, {"a": 1, "own": [1]}, f"{tmp_path.as_uri()}/conf")
    assert sources.read_config(spark, f"{tmp_path.as_uri()}/conf", {"a": 0, "b": 2}, {"b": 3}) == {"a": 1, "b": 3, "own": [1]}
    sources.append_telemetry(spark.createDataFrame([("t", 1, 2)], "ts string, z int, a int"), ["ts", "cpu"], f"{tmp_path.as_uri()}/tele")
    assert spark.read.csv(f"{tmp_path.as_uri()}/tele", header=True).columns == ["ts", "cpu", "a", "z"]
    (tmp_path / "log.txt").write_text("overlap rms=0.5\nnothing\noverlap rms=1.5\n")
    assert [r["value"] for r in sources.log_values(spark, f"{tmp_path.as_uri()}/log.txt", r"rms=([0-9.]+)").collect()] == [0.5, 1.5]
    assert sources.sniff_separator("a|b|c") == "|" and sources.sniff_separator("one") == ","


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
