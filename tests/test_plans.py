import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterloom.config import Scale, Task
from quarterloom.plans import baselines, build, drift, masks, scoring, validate
from quarterloom.sources import readers
from quarterloom.streaming import ingest


def cells(spark, data):
    return spark.createDataFrame(data, "firm string, qord int, item string, level array<float>, yoy array<float>, target array<float>")


def truth_and_forecast(spark, shift=0.0):
    t = spark.createDataFrame([("a", "x", 1, 1, 2.0, 1.0), ("a", "x", 2, 1, 4.0, 1.0), ("b", "y", 1, 2, 3.0, 0.0), ("b", "y", 2, 2, None, 0.0)], "firm string, target string, origin long, horizon long, actual double, base double")
    return t, t.select("firm", "target", "origin", "horizon", (F.coalesce("actual", F.lit(0.0)) + shift).alias("prediction"))


def test_perfect_forecast_scores_one(spark):
    t, f = truth_and_forecast(spark)
    m = {(r["level"], r["model"]): r for r in scoring.evaluate(t, {"m": f}).where("level = 'global'").collect()}
    r = m[("global", "m")]
    assert r["r2"] == pytest.approx(1.0) and r["mae"] == 0 and r["n_complete"] == 3


def test_common_sample_shrinks_for_all(spark):
    t, f = truth_and_forecast(spark, 0.5)
    hole = f.withColumn("prediction", F.when(F.col("firm") == "a", F.when(F.col("origin") == 1, F.col("prediction")).otherwise(float("inf"))).otherwise(F.col("prediction")))
    got = {(r["model"], r["n_complete"], round(r["mae"], 6)) for r in scoring.evaluate(t, {"full": f, "hole": hole}).where("level = 'global'").collect()}
    assert got == {("full", 2, 0.5), ("hole", 2, 0.5)}
    assert scoring.common_sample_violations(scoring.scored_cells(t, {"full": f, "hole": hole})).count() == 0


def test_mask_restricts_cells_and_density_metrics(spark):
    t, f = truth_and_forecast(spark, 1.0)
    f = f.withColumn("sigma", F.lit(1.0))
    mask = spark.createDataFrame([("a", "x", 1, 1), ("zz", "x", 1, 1)], "firm string, target string, origin long, horizon long")
    r = scoring.evaluate(t, {"m": f}, mask=mask).where("level = 'global'").first()
    assert r["n_complete"] == 1 and r["z2"] == pytest.approx(1.0) and r["cover95"] == 1.0
    assert r["nll"] == pytest.approx(0.5 * np.log(2 * np.pi) + 0.5)


def test_first_wins_keeps_a_null_first_value(spark):
    f = spark.createDataFrame([("a", "x", 1, 1, None, 0), ("a", "x", 1, 1, 5.0, 1)], "firm string, target string, origin long, horizon long, prediction double, ord int")
    assert scoring.first_wins(f).first()["prediction"] is None


def test_leaderboard_orders_by_metric(spark):
    s = spark.createDataFrame([("global", None, None, "a", 0.1, 2.0), ("global", None, None, "b", 0.3, 3.0), ("global", None, None, "c", None, None)], "level string, target string, horizon long, model string, r2 double, mae double")
    assert [r["model"] for r in scoring.leaderboard(s, "r2").collect()] == ["b", "a", "c"]
    assert [r["model"] for r in scoring.leaderboard(s, "mae").collect()] == ["a", "b", "c"]


def test_naive_reads_the_season(spark):
    c = cells(spark, [("a", 10, "x", [0.0, 1.0, 2.0, 3.0], [], [])])
    assert [r["prediction"] for r in baselines.naive(c, 8).orderBy("horizon").collect()] == [3, 2, 1, 0, 3, 2, 1, 0]


def test_fade_recovers_line_and_falls_back(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=150)
    data = [("f%d" % i, 1, "x", [float(v)], [], [float(0.5 * v + 1)]) for i, v in enumerate(x)] + [("g%d" % i, 1, "few", [1.0], [], [float(i)]) for i in range(5)] + [("h%d" % i, 1, "flat", [2.0], [], [float(i % 2)]) for i in range(200)] + [("i", 1, "none", [1.0], [], [None])]
    got = {r["target"]: (r["rho"], r["b"]) for r in baselines.fade_coefficients(cells(spark, data), 1).collect()}
    assert got["x"] == pytest.approx((0.5, 1.0), abs=1e-4)
    assert got["few"] == (0.0, 2.0) and got["flat"] == pytest.approx((0.0, 0.5)) and got["none"] == (1.0, 0.0)


def labelled(spark, n=400, seed=2):
    """Rows with five features, of which the last two are a size and a dummy, and labels with gaps."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:, 4] = rng.random(n) < 0.3
    y = np.column_stack([x @ [1.0, -0.5, 0.0, 2.0, 0.7] + 0.3, x @ [0.0, 0.2, 0.4, -1.0, 0.0] - 1, x @ np.ones(5)]) + 0.1 * rng.normal(size=(n, 3))
    y[rng.random(y.shape) < 0.2] = np.nan
    y[:, 2] = np.nan
    rows = [(f"f{i}", i % 7, x[i].tolist(), [None if np.isnan(v) else float(v) for v in y[i]]) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "firm string, qord int, x array<double>, y array<double>")


def test_least_squares_equal_row_by_row_solutions(spark, monkeypatch):
    from quarterloom.operators import gram

    x, y, rows = labelled(spark)
    for held in (1 << 30, 8 * 7 * 7):  # all labels at once; one group a label
        monkeypatch.setattr(gram, "GROUP_BYTES", held)
        w = gram.coefficients(rows.repartition(3), 5, 3)
        for t in (0, 1):
            ok = ~np.isnan(y[:, t])
            want = np.linalg.lstsq(np.column_stack([np.ones(ok.sum()), x[ok]]), y[ok, t], rcond=None)[0]
            assert np.allclose(w[t], want, atol=1e-8)
        assert np.isnan(w[2]).all()
    got = baselines.fit_and_predict(rows, rows.limit(0), rows.where("qord = 0"), ["a"], [1, 2, 3])
    r = {(r["firm"], r["horizon"]): r["prediction"] for r in got.collect()}
    assert r[("f0", 3)] is None and r[("f7", 1)] == pytest.approx(w[0, 0] + x[7] @ w[0, 1:])
    with pytest.raises(ValueError):
        baselines.fit_and_predict(rows, rows, rows.limit(0), ["a"], [1, 2, 3])
    with pytest.raises(ValueError):
        baselines.fit_and_predict(rows, rows, rows, ["a"], [1, 2, 3], "ridge")


def test_collinear_features_get_the_least_norm(spark):
    from quarterloom.operators import gram

    x, y, rows = labelled(spark)
    twice = rows.withColumn("x", F.concat("x", F.array(F.col("x")[0])))
    w = gram.coefficients(twice, 6, 3)[0]
    ok = ~np.isnan(y[:, 0])
    want = np.linalg.lstsq(np.column_stack([x[ok], x[ok, 0]]) - np.append(x[ok].mean(axis=0), x[ok, 0].mean()), y[ok, 0] - y[ok, 0].mean(), rcond=None)[0]
    assert np.allclose(w[1:], want, atol=1e-6)


def test_elastic_net_meets_its_objective_and_its_search_the_best_of_the_grid(spark):
    from quarterloom.operators import gram

    x, y, rows = labelled(spark)
    ok = ~np.isnan(y[:, 0])
    xs, ys = x[ok], y[ok, 0]
    s = gram.Sums(5)
    z = np.column_stack([np.ones(len(xs)), xs, ys])
    s.m = z.T @ z
    rng = np.random.default_rng(0)
    for alpha, ratio in ((0.1, 0.5), (0.5, 0.99), (1.0, 0.01)):
        b, w = gram.elastic_net(s, alpha, ratio)
        loss = lambda b, w: ((ys - xs @ w - b) ** 2).mean() / 2 + alpha * (ratio * np.abs(w).sum() + (1 - ratio) / 2 * (w**2).sum())
        best = loss(b, w)
        assert all(best <= loss(b + 1e-3 * rng.normal(), w + 1e-3 * rng.normal(size=5)) + 1e-12 for _ in range(100))
        # the conditions of a minimum, feature by feature
        grad = xs.T @ (ys - xs @ w - b) / len(ys) - alpha * (1 - ratio) * w
        assert np.allclose(grad[w != 0], alpha * ratio * np.sign(w[w != 0]), atol=1e-7) and (np.abs(grad[w == 0]) <= alpha * ratio + 1e-7).all()
        assert s.squared_error(b, w) == pytest.approx(((ys - xs @ w - b) ** 2).mean())
    train, val = rows.where("qord < 5"), rows.where("qord >= 5")
    found = gram.search(train, val, 5, 3, baselines.ALPHAS, baselines.L1_RATIOS)
    assert set(found) == {0, 1}
    inside = np.arange(len(x)) % 7 < 5
    want, least = None, np.inf
    for a in baselines.ALPHAS:
        for r in baselines.L1_RATIOS:
            m = ok & inside
            z = np.column_stack([np.ones(m.sum()), x[m], y[m, 0]])
            s.m = z.T @ z
            b, w = gram.elastic_net(s, a, r)
            err = ((y[ok & ~inside, 0] - x[ok & ~inside] @ w - b) ** 2).mean()
            if err < least * (1 - 1e-12):
                want, least = (a, r), err
    assert found[0] == want


def test_features_hold_size_and_dummies_in_cells_and_wide_views(spark):
    data = [(f, q, 0.5 + i, i % 3, item, [float(i + q), 1.0], [0.5], [float(i), None]) for i, f in enumerate("abcd") for q in (1, 2) for item in ("x", "y")]
    c = spark.createDataFrame(data, "firm string, qord int, size float, industry_id int, item string, level array<float>, yoy array<float>, target array<float>")
    r = {(r["firm"], r["qord"]): r for r in baselines.feature_rows(c, ["x", "y"], ["x"], [1, 2], 2).collect()}
    assert r[("b", 2)]["x"] == [3.0, 1.0, 0.5, 3.0, 1.0, 0.5, 1.5, 0.0, 1.0] and r[("b", 2)]["y"] == [1.0, None]
    task = Task(levels=2, yoy=1, horizon=2, industries=2)
    from quarterloom.operators import cells as C

    wide = C.dummies(C.wide_view(c, ["x", "y"], task).join(c.select("firm", "qord", "industry_id").distinct(), ["firm", "qord"]), "industry_id", 2, "industry_")
    w = {(r["firm"], r["qord"]): r for r in baselines.wide_rows(wide, ["x"], [1, 2]).collect()}
    assert {k: (sorted(v["x"]), v["y"]) for k, v in r.items()} == {k: (sorted(v["x"]), v["y"]) for k, v in w.items()}
    hole = c.withColumn("size", F.when(F.col("firm") != "a", F.col("size")))
    assert baselines.feature_rows(hole, ["x", "y"], ["x"], [1], 2).count() == 6


FC = "firm string, target string, origin long, horizon double, prediction double, sigma double"


@pytest.mark.parametrize("change,word", [
    ({"target": "bogus"}, "unknown"), ({"horizon": 21.0}, "outside"), ({"horizon": 1.5}, "whole"), ({"horizon": None}, "numbers"),
    ({"firm": None}, "without firm"), ({"sigma": 0.0}, "sigma"), ({}, "repeat"),
])
def test_validators_find_one_defect_each(spark, change, word):
    good = {"firm": "001", "target": "niq", "origin": 1, "horizon": 2.0, "prediction": 0.5, "sigma": 1.0}
    second = good | {"origin": 2} | change if change else good
    problems, _ = validate.validate_forecast(spark.createDataFrame([tuple(good.values()), tuple(second.values())], FC))
    # a null horizon is no number and an incomplete key
    assert len(problems) == (2 if word == "numbers" else 1) and word in problems[0]
    with pytest.raises(validate.InvalidForecast):
        validate.validate_forecast(spark.createDataFrame([tuple(good.values()), tuple(second.values())], FC), strict=True)


def test_validation_of_types_columns_and_warnings(spark):
    ok = spark.createDataFrame([("001", "niq", 1, 1.0, 500.0, 1.0), ("001", "niq", 2, 1.0, float("inf"), 1.0)], FC)
    problems, warnings = validate.validate_forecast(ok)
    assert problems == [] and len(warnings) == 2
    assert "missing" in validate.validate_forecast(ok.drop("target"))[0][0]
    assert any("text" in p for p in validate.validate_forecast(ok.withColumn("firm", F.lit(1)))[0])
    assert any("no rows" in p for p in validate.validate_forecast(ok.limit(0))[0])


def test_write_forecast_is_atomic_and_typed(spark, tmp_path):
    ok = spark.createDataFrame([("001", "niq", 1, 1.0, 0.5, 1.0)], FC)
    path = str(tmp_path / "f.parquet")
    validate.write_forecast(ok, path)
    back = readers.read_forecast(spark, path)
    assert dict(back.dtypes)["prediction"] == "float" and dict(back.dtypes)["horizon"] == "bigint" and back.first()["firm"] == "001"
    tiny = ok.withColumn("sigma", F.lit(1e-60))
    with pytest.raises(Exception, match="single precision"):
        validate.write_forecast(tiny, str(tmp_path / "g.parquet"))
    assert not (tmp_path / "g.parquet").exists()


def test_drift_verdicts(spark):
    df = spark.range(1000).select((F.col("id") / 100).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") / 50).alias("b"), F.lit(None).cast("double").alias("c"))
    s = drift.column_stats(df, ["a", "b", "c"])
    x = np.arange(1000) / 100
    a = s.where("column = 'a'").first()
    assert (a["mean"], a["sd"], a["p05"]) == pytest.approx((x.mean(), x.std(), np.quantile(x, 0.05)), abs=1e-6)
    c = s.where("column = 'c'").first()
    assert c["n_finite"] == 0 and c["mean"] is None
    verdict = lambda p, q, *n: drift.summarize(drift.compare_stats(p, q), *n).first()["verdict"]
    assert verdict(s, s) == "PASS"
    assert verdict(s, s, 100, 120) == "FAIL"
    assert verdict(s, s.where("column <> 'b'")) == "FAIL"
    assert verdict(s.where("column = 'a'"), s.where("column = 'b'")) == "NOT VERIFIED"
    moved = drift.column_stats(df.withColumn("a", F.col("a") + 0.1), ["a", "b", "c"])
    got = drift.summarize(drift.compare_stats(moved, s)).first()
    assert got["verdict"] == "FAIL" and got["worst_mean_column"] == "a" and got["columns_over"] == ["a"]


def test_mask_bits_round_trip_and_errors(spark):
    bits = np.random.default_rng(0).random(103) < 0.3
    got = masks.unpack(spark, bits, 103)
    assert sorted(r[0] for r in got.collect()) == np.flatnonzero(bits).tolist()
    assert (masks.pack(got, 103) == np.packbits(bits)).all()
    with pytest.raises(ValueError):
        masks.unpack(spark, bits[:-8], 103)
    grid = spark.createDataFrame([(0, "a", 1), (1, "b", 1)], "grid_row long, firm string, origin long")
    cell = spark.createDataFrame([(0,), (3,), (6,)], "cell long")
    keys = masks.bits_to_keys(cell, grid, ["y", "x"], 2, 2)
    assert {tuple(r) for r in keys.collect()} == {("a", "x", 1, 1), ("b", "x", 1, 2), ("a", "y", 1, 2)}
    assert masks.realign(keys, grid.where("firm = 'b'")).count() == 1
    with pytest.raises(ValueError):
        masks.realign(keys, grid.where("firm = 'zz'").select("firm", "origin"))
    with pytest.raises(ValueError):
        masks.bits_to_keys(cell, grid.unionByName(grid.withColumn("grid_row", F.col("grid_row") + 5)), ["x", "y"], 2, 2)


def raw_panel(firms=12, first=1998, last=2012, seed=7):
    rng = np.random.default_rng(seed)
    out = []
    for f in range(firms):
        size = rng.uniform(50, 500)
        for y in range(first, last + 1):
            cash = 0.0
            for q in range(1, 5):
                size *= 1 + rng.normal(0.01, 0.05)
                cash += size * rng.normal(0.05, 0.02)
                out.append((f"{f:05d}", pd.Timestamp(year=y, month=3 * q, day=30), y, q, float(rng.choice([2000, 3500, 7370, 1200])), size * 0.3, size * 0.2, size * 0.05 * rng.normal(1, 0.4), size, size * 0.6, size * 0.4, cash))
    return pd.DataFrame(out, columns="gvkey datadate fyearq fqtr sich revtq cogsq niq atq ltq seqq oancfy".split())


def test_build_end_to_end(spark, tmp_path):
    task = Task(items=("revtq", "niq", "atq", "gpq", "oancfq"), horizon=4, factors=3, scale=Scale(), fade_min_rows=20)
    ranges = spark.createDataFrame([(0, 1000, 1999), (1, 2000, 3999)], "id int, lo int, hi int")
    raw = spark.createDataFrame(raw_panel())
    b = build.build(raw, task, ranges=ranges)
    assert b.items == ["revtq", "niq", "atq", "gpq", "oancfq"]
    c = b.cells.persist()
    assert {r[0] for r in c.select("split").distinct().collect()} == {"train", "val", "test"}
    r = c.agg(F.max(F.array_max("level")), F.min(F.array_min("level")), F.count_if(F.exists("level", lambda x: x.isNull() | F.isnan(x))), F.max(F.array_max("yoy"))).first()
    assert r[0] <= 6 and r[1] >= -6 and r[2] == 0 and r[3] <= 6 * 1.4142 + 1e-5
    # train targets never look past the train years
    late = c.where("split = 'train'").select((F.col("qord") + 1).alias("q"), F.get("target", F.lit(0)).alias("t")).where(f"q > {2001 * 4 + 3} and t is not null")
    assert late.count() == 0
    build.write(b, str(tmp_path), task, "t")
    wide = spark.read.parquet(str(tmp_path / "tabular__t"))
    assert {"revtq_level_0", "niq_yoy_7", "atq_t4", "industry_47", "split", "scale_level_0"} <= set(wide.columns)
    assert c.where("size is null or abs(size) > 6").count() == 0
    assert wide.count() == c.select("firm", "qord").distinct().count()
    tuples = spark.read.parquet(str(tmp_path / "tuple__t"))
    assert dict(tuples.dtypes)["account_id"] == "bigint" and tuples.where("split = 'val'").agg(F.min("quarter")).first()[0] == (2001 * 4 + 3 - 7879) - 10
    ids = readers.read_ids(spark, str(tmp_path / "firm_ids__t"), "firm", "firm_id")
    assert ids.orderBy("firm_id").first()["firm"] == "00000"
    # frozen statistics give the same build again
    frozen = spark.read.parquet(str(tmp_path / "stats__t"))
    again = build.build(raw, task, frozen_stats=frozen, ranges=ranges).cells
    key = lambda d: d.agg(F.sum(F.round(F.get("level", F.lit(0)).cast("double"), 3)), F.count("*")).first()
    x, y = key(c), key(again)
    assert x[1] == y[1] and x[0] == pytest.approx(y[0], rel=1e-6)
    part = {s: c.where(F.col("split") == s).drop("split", "industry_id") for s in ("train", "val", "test")}
    f = baselines.run_baselines(["naive", "fade"], part["train"], part["val"], part["test"], task)
    m = scoring.evaluate(baselines.truth_cells(part["test"], 4), f).where("level = 'global'").collect()
    assert {r["model"] for r in m} == {"naive", "fade"} and len({r["n_complete"] for r in m}) == 1
    with pytest.raises(ValueError):
        baselines.run_baselines(["nope"], part["train"], part["val"], part["test"], task)


def test_build_rejects_what_it_cannot_use(spark):
    raw = spark.createDataFrame(raw_panel(2, 2000, 2001))
    with pytest.raises(ValueError, match="lacks"):
        build.clean_panel(raw.drop("fqtr"), Task())
    with pytest.raises(ValueError, match="no rows"):
        build.build(raw.limit(0), Task(items=("niq",)))
    twice = spark.createDataFrame([("x", 1, 0.0, 1.0, 1.0), ("x", 1, 0.0, 1.0, 1.0)], "item string, qord int, mu double, sigma double, k double")
    with pytest.raises(ValueError, match="two statistics"):
        build.build(raw, Task(items=("niq",)), frozen_stats=twice)


def test_build_of_no_rows_is_an_error(spark, tmp_path):
    raw = spark.createDataFrame(raw_panel(2, 2000, 2001))
    old = spark.createDataFrame([(i, 4, 0.0, 1.0, 1.0) for i in ("niq", "scale")], "item string, qord int, mu double, sigma double, k double")
    with pytest.raises(ValueError, match="no row survives"):
        build.write(build.build(raw, Task(items=("niq",), impute=False), frozen_stats=old), str(tmp_path), Task(items=("niq",)), "t")
    assert not (tmp_path / "cells__t").exists() and not (tmp_path / "tabular__t").exists()


def test_keys_meet_across_spellings_and_unmatched_rows_are_counted(spark):
    truth = spark.createDataFrame([(1, "x", 8000, 1, 2.0, 1.0), (2, "x", 8000, 1, 3.0, 1.0)], "firm long, target string, origin long, horizon long, actual double, base double")
    f = spark.createDataFrame([("0001", "x", "2000-03-31", 1.7, 2.5), ("0001", "x", "2000-01-01", 1.0, 9.0), ("0002", "x", "2000-02-29", 1.0, None), ("0003", "x", "2000-03-31", 1.0, 1.0)], "firm string, target string, origin string, horizon double, prediction double")
    assert scoring.match_counts(f, truth).first().asDict() == {"n_rows": 4, "n_unmatched": 1, "n_duplicate": 1, "n_finite": 2}
    one = scoring.evaluate(truth, {"m": f.limit(1).withColumn("origin", F.to_date("origin"))}).where("level = 'global'").first()
    assert one["n_complete"] == 1 and one["mae"] == pytest.approx(0.5)
    named = f.withColumn("firm", F.concat(F.lit("k"), "firm"))
    assert scoring.match_counts(named, truth).first()["n_unmatched"] == 4


def test_forecast_blocks_append_and_refuse_nothing(spark, tmp_path):
    row = lambda o, p: spark.createDataFrame([("001", "niq", o, 1.0, p, 1.0)], FC)
    path = str(tmp_path / "f.parquet")
    assert validate.write_forecast_blocks([row(1, 0.5), row(2, None), row(3, 0.1).limit(0)], path) == 2
    assert spark.read.parquet(path).count() == 2
    for bad in ([], [row(1, None)], [row(1, 0.5), row(1, 0.7)], [row(1, 0.5).drop("target")]):
        with pytest.raises(validate.InvalidForecast):
            validate.write_forecast_blocks(bad, str(tmp_path / "g.parquet"))
    assert [p.name for p in tmp_path.iterdir()] == ["f.parquet"]


def test_masks_on_disk_by_kind(spark, tmp_path):
    truth = spark.createDataFrame([(f, t, q, h, 1.0, 0.0) for f in ("01", "02") for t in ("x", "y") for q in (8000, 8001) for h in (1, 2)], "firm string, target string, origin long, horizon long, actual double, base double")
    grid = masks.grid_rows(scoring.canonical_keys(truth))
    assert [tuple(r) for r in grid.orderBy("grid_row").collect()] == [(0, "1", 8000), (1, "1", 8001), (2, "2", 8000), (3, "2", 8001)]
    cells = spark.createDataFrame([(0,), (7,), (15,)], "cell long")
    npy, rows, keys = str(tmp_path / "m.npy"), str(tmp_path / "rows"), str(tmp_path / "keys")
    masks.write_bits(spark, npy, masks.pack(cells, 16))
    masks.write_grid_rows(grid, rows)
    want = {("1", "x", 8000, 1), ("2", "x", 8001, 2), ("2", "y", 8001, 2)}
    assert {tuple(r) for r in masks.resolve(spark, npy, truth, None, 2).collect()} == want
    assert {tuple(r) for r in masks.resolve(spark, npy, truth.where("firm = '02'"), rows, 2).collect()} == want - {("1", "x", 8000, 1)}
    with pytest.raises(ValueError):  # without the index the bits must fit
        masks.resolve(spark, npy, truth.where("firm = '02'"), None, 2)
    truth.select("target", "horizon", F.col("firm").alias("firm_id"), F.col("origin").alias("quarter")).write.parquet(keys)
    assert masks.resolve(spark, keys, truth, None, 2).count() == 16
    with pytest.raises(ValueError, match="lacks"):
        masks.resolve(spark, npy, truth, keys, 2)


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.source_query("db.quarterly", ["a; drop"], [], 1970, 1971)
    with pytest.raises(ValueError):
        readers.source_query("db.quarterly", ["a"], [("indfmt", "x' or '1")], 1970, 1971)
    q = readers.source_query("db.quarterly", ["gvkey", "niq"], [("indfmt", "INDL")], 1970, 1974)
    assert q == "SELECT gvkey, niq FROM db.quarterly WHERE indfmt = 'INDL' AND datadate BETWEEN '1970-01-01' AND '1974-12-31'"
    assert readers.chunk_name(1, 2, ["b", "a"], []) == readers.chunk_name(1, 2, ["a", "b"], []) != readers.chunk_name(1, 2, ["a"], [])
    assert readers.read_sidecar(json.dumps({"family": "Student_T", "df": 4})) == ("student_t", 4.0)
    assert readers.read_sidecar("nope") == readers.read_sidecar(None) == ("gaussian", None)
    df, lost = readers.coerce_declared(spark.createDataFrame([("1.5", "x"), ("y", "z")], "a string, b string"), {"a": "double precision", "b": "text"})
    assert [r["a"] for r in df.collect()] == [1.5, None] and lost.first()["a"] == 1
    u = readers.union_chunks([spark.createDataFrame([(1.0,)], "a double"), spark.createDataFrame([("2", "k")], "a string, b string")])
    assert sorted(r["a"] for r in u.collect()) == [1.0, 2.0]
    spark.createDataFrame([(float("nan"), "x")], "v double, gvkey string").write.parquet(str(tmp_path / "t"))
    t = readers.read_table(spark, str(tmp_path / "t"), ["firm_id", "v"], {"gvkey": "firm_id"})
    assert t.first()["v"] is None
    with pytest.raises(ValueError, match="lacks"):
        readers.read_table(spark, str(tmp_path / "t"), ["zzz"])


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "x", 1, 1, 1.0), ("a", "x", 1, 1, 9.0), ("b", "x", 1, 1, 2.0)]
    spark.createDataFrame(rows, "firm string, target string, origin long, horizon long, prediction float").withColumn("arrived", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.write_stream(ingest.forecast_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["firm"], r["prediction"]) for r in got.collect()} == {("a", 1.0), ("b", 2.0)}


def test_event_windows_and_sessions(spark):
    e = spark.sql("select * from values (1, timestamp'2024-01-01 00:10:00', 'view', 1.5D), (1, timestamp'2024-01-01 00:50:00', 'view', 2.5D), (1, timestamp'2024-01-01 03:00:00', 'view', 1.0D) t(user_id, ts, event_type, value)")
    assert sorted((r["n"], r["total"]) for r in ingest.event_windows(e).collect()) == [(1, 1.0), (2, 4.0)]
    assert sorted(r["n_events"] for r in ingest.event_sessions(e, "1 hour").collect()) == [1, 2]
