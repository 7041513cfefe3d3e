import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterloom.config import Scale, StatLags, Task
from quarterloom.functions import exprs as E
from quarterloom.operators import cells as C
from quarterloom.operators import impute, joins, panel, stats


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_asof_takes_last_of_equal_times_and_keeps_its_null(spark):
    left = spark.createDataFrame([(1, 5), (1, 2), (2, 9), (None, 5), (1, None)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "a", 0), (1, 5, "b", 1), (1, 5, None, 2), (2, 10, "z", 3)], "k int, u int, v string, ord int")
    got = joins.asof_backward(left, right, ["k"], "t", "u", ["v"], ["ord"])
    assert sorted(map(str, rows(got, "k", "t"))) == sorted(map(str, [(1, 5, None), (1, 2, None), (2, 9, None), (None, 5, None), (1, None, None)]))
    got = joins.asof_backward(left, right.where("ord < 2"), ["k"], "t", "u", ["v"], ["ord"])
    assert {tuple(r) for r in got.where("k = 1 and t = 5").collect()} == {(1, 5, "b")}


def test_interval_join_three_regimes(spark):
    p = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5), ("c", 5)], "firm string, d int")
    links = spark.createDataFrame([("a", 5, None, 1), ("a", 9, 9, 2), ("b", None, 4, 3)], "firm string, s int, e int, permno int")
    got = rows(joins.interval_join(p, links, "firm", "d", "s", "e", ["permno"]), "firm", "d", "permno")
    assert got == [("a", 5, 1), ("a", 9, 1), ("a", 9, 2), ("c", 5, None)]


def test_range_lookup_first_range_and_default(spark):
    r = spark.createDataFrame([(2, 15, 30), (1, 10, 20)], "id int, lo int, hi int")
    df = spark.createDataFrame([(9,), (10,), (18,), (30,), (31,), (None,)], "c int")
    assert rows(joins.range_lookup(df, r, F.col("c"), default=48), F.col("c").asc_nulls_last()) == [(9, 48), (10, 1), (18, 1), (30, 2), (31, 48), (None, 48)]


def test_canonical_firm_needs_all_numbers(spark):
    assert rows(joins.canonical_firm(spark.createDataFrame([("001",), ("1",)], "firm string")), "firm") == [("1",), ("1",)]
    assert rows(joins.canonical_firm(spark.createDataFrame([("001",), ("x",)], "firm string")), "firm") == [("001",), ("x",)]


def test_dedupe_null_sort_keys_win(spark):
    df = spark.createDataFrame([("a", 1, 1, 0), ("a", 1, None, 1), ("b", 1, 2, 2), ("b", 1, 2, 3)], "f string, q int, y int, ord int")
    assert rows(panel.dedupe_last(df, ["f", "q"], ["y"], ["ord"]), "f") == [("a", 1, None, 1), ("b", 1, 2, 3)]


def test_ytd_edges(spark):
    df = spark.createDataFrame([("a", 2000, 1, 1, 10.0), ("a", 2000, 2, 2, 15.0), ("a", 2000, 4, 4, 40.0), ("a", 2001, 2, 6, 7.0), ("a", None, 2, 7, 5.0), ("a", 2002, None, 8, 6.0)], "firm_id string, fyearq int, fqtr int, qord int, xy double")
    got = panel.ytd_to_quarterly(df, bases=["x"])
    assert "xy" not in got.columns
    assert [r[0] for r in got.orderBy("qord").select("xq").collect()] == [10.0, 5.0, None, None, None, 6.0]


def test_modal_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1), ("a", None), ("a", None), ("a", None), ("b", None)], "k string, v int")
    assert rows(panel.modal(df, "k", "v"), "k") == [("a", 1), ("b", None)]


def test_scale_falls_back_by_row(spark):
    df = spark.createDataFrame([(1.0, -2.0, 9.0), (None, 2.0, -3.0), (None, None, None), (float("inf"), 1.0, 4.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(panel.size_scale(df.columns, Scale(("a", "b"), ("c",)))).collect()]
    assert got[:2] == pytest.approx([3.001, 3.001]) and got[2] is None and got[3] == pytest.approx(4.001)


def test_panel_guards(spark):
    make = lambda x: spark.createDataFrame(x, "firm_id string, qord int")
    panel.check_panel(make([("a", 1), ("a", 2)]))
    for bad in ([], [(None, 1)], [("a", None)], [("a", 1), ("a", 1)]):
        with pytest.raises(ValueError):
            panel.check_panel(make(bad))


def test_calendar_arrays_equal_gap_filled_lags(spark):
    long = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, "x", 2.0), ("a", 6, "x", 6.0), ("b", 3, "x", 3.0)], "firm string, qord int, item string, value double")
    got = {(r["firm"], r["qord"]): (r["past"], r["future"]) for r in C.calendar_arrays(long, 4, 2).collect()}
    assert got[("a", 6)] == ([6.0, None, None, None, 2.0], [None, None])
    assert got[("a", 1)] == ([1.0, None, None, None, None], [2.0, None])
    assert got[("b", 3)] == ([3.0] + [None] * 4, [None, None])


def test_yoy_clips_once_after_differencing(spark):
    t = Task(levels=1, yoy=1, horizon=0)
    df = spark.createDataFrame([([float(np.sinh(9)), None, None, None, float(np.sinh(1))], 1.0, 1.0, 0.0, 1.0)], "past array<double>, scale double, k double, mu double, sigma double").withColumn("future", F.array().cast("array<double>"))
    r = C.normal_arrays(df, t).first()
    assert r["level"] == [6.0] and r["yoy"][0] == pytest.approx(8.0, abs=1e-5)


def test_split_overlap_and_masks(spark):
    t = Task(train_end=1970, val_end=1971, tuple_history=2)
    q = spark.createDataFrame([(i,) for i in range(1, 10)], "quarter long")
    got = C.tuple_splits(q, t).groupBy("split").agg(F.min("quarter"), F.max("quarter"))
    assert {tuple(r) for r in got.collect()} == {("train", 1, 4), ("val", 3, 8), ("test", 7, 9)}
    c = spark.createDataFrame([(1970 * 4 + 2, "train", [1.0], [1.0, 2.0]), (1970 * 4 + 2, "train", [None], [1.0, 2.0])], "qord int, split string, level array<float>, target array<float>")
    assert [r["target"] for r in C.mask_targets(c, t).collect()] == [[1.0, None], [None, None]]


def test_pools_lag_over_surviving_rows_and_sweep_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(f, q, "x", float(rng.normal() * 5), float(rng.uniform(1, 3))) for f in "abc" for q in range(30)], columns=["firm", "qord", "item", "value", "scale"])
    pdf.loc[::7, "value"] = np.nan
    cells = spark.createDataFrame(pdf).withColumn("value", E.nan_to_null(F.col("value")))
    got = stats.pool(cells, StatLags(1, (0, 2))).toPandas()
    live = pdf.dropna().sort_values(["firm", "qord"])
    g = live.groupby("firm")
    want = np.concatenate([(live["value"] / g["scale"].shift(1)).dropna(), (g["value"].shift(2) / g["scale"].shift(1)).dropna()])
    assert np.allclose(np.sort(got["r"]), np.sort(want))
    grid = (0.05, 0.5, 2.0, 9.0)
    best = min(grid, key=lambda k: (abs(pd.Series(np.arcsinh(k * want)).kurtosis() - 3), k))
    assert stats.sweep_k(stats.pool(cells, StatLags(1, (0, 2))), grid).first()["k"] == best


def test_imputation_matches_row_by_row_solution(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 8)) + 0.1 * rng.normal(size=(40, 8))
    data[rng.random(data.shape) < 0.2] = np.nan
    data[5] = np.nan
    data[:, 7] = np.nan
    got = impute.fill_by_factors(data, 3)
    known = ~np.isnan(data)
    means = np.array([data[known[:, j], j].mean() if known[:, j].any() else 0.0 for j in range(8)])
    x = np.where(known, data - means, 0)
    pairs = known.T.astype(float) @ known
    val, vec = np.linalg.eigh(x.T @ x / np.where(pairs == 0, 1, pairs))
    lam = vec[:, ::-1][:, :3] * np.sqrt(np.maximum(val[::-1][:3], 1e-8))
    for i in range(40):
        o = known[i]
        f = np.linalg.solve(lam[o].T @ lam[o] / 8 + 0.01 / 8 * np.eye(3), lam[o].T @ x[i, o] / 8) if o.any() else np.zeros(3)
        assert np.allclose(got[i], np.where(o, data[i], lam @ f + means), atol=1e-8)
    assert (got[known] == data[known]).all() and not np.isnan(got).any()
    # in Spark: several quarters, blocks smaller than a quarter
    both = np.concatenate([data, data[::-1] * 1.5 + 0.2])
    rows_ = [(f"f{i}", 1 + (i >= 40), "train", [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(both)]
    df = spark.createDataFrame(rows_, "firm string, qord int, split string, features array<float>")
    for size in (1000, 7):
        monkeypatch.setattr(impute, "BLOCK_ROWS", size)
        out = {r["firm"]: r["features"] for r in impute.impute_features(df, 3).collect()}
        want = np.concatenate([got, impute.fill_by_factors(data[::-1] * 1.5 + 0.2, 3)])
        assert np.allclose([out[f"f{i}"] for i in range(80)], want, atol=2e-4)
    few = spark.createDataFrame([("a", 1, "train", [1.0, None])], "firm string, qord int, split string, features array<float>")
    assert impute.impute_features(few, 3).first()["features"] == [1.0, None]


def test_size_shapes_the_imputed_values(spark):
    rng = np.random.default_rng(4)
    rows_ = [(f"f{i}", 1, "train", float(s), item, [float(s + rng.normal())] if rng.random() > 0.3 else [None], [float(rng.normal())], [1.0]) for i in range(60) for s in [rng.normal()] for item in ("x", "y")]
    c = spark.createDataFrame(rows_, "firm string, qord int, split string, size float, item string, level array<float>, yoy array<float>, target array<float>")
    got = {(r["firm"], r["item"]): r["level"][0] for r in impute.impute_cells(c, ["x", "y"], 1, 1, 2).collect()}
    wide = np.array([[np.nan if v is None else v for k in (2 * i, 2 * i + 1) for v in (*rows_[k][5], *rows_[k][6])] + [rows_[2 * i][3]] for i in range(60)], dtype=np.float32).astype(float)
    want = impute.fill_by_factors(wide, 2)
    assert np.allclose([[got[(f"f{i}", "x")], got[(f"f{i}", "y")]] for i in range(60)], want[:, [0, 2]], atol=1e-4)
    assert not np.allclose(impute.fill_by_factors(wide[:, :4], 2)[:, 0], want[:, 0], atol=1e-3)


def test_dense_ids_and_dummies(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "n string")
    assert rows(panel.dense_ids(df, "n", "i"), "i") == [("a", 0), ("b", 1)]
    d = C.dummies(spark.createDataFrame([(0,), (2,), (None,)], "g int"), "g", 2, "d")
    assert [tuple(r)[1:] for r in d.collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
