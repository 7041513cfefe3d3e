import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterloom.config import FEATURE_SETS, Scale, raw_columns, year_chunks
from quarterloom.functions import density as D
from quarterloom.functions import exprs as E


def values(spark, expr, rows, schema="x double"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(expr).collect()]


def test_asinh_and_clip_keep_signs_nulls_and_bounds(spark):
    xs = [-1e9, -12345.0, -1.0, 0.0, 1e-9, 5e7, None]
    got = values(spark, E.asinh(F.col("x")), xs)
    assert got[-1] is None
    assert np.allclose(got[:-1], np.arcsinh(xs[:-1]), rtol=1e-12)
    assert values(spark, E.clip(F.col("x"), 6), [None, -9.0, 9.0, 1.5]) == [None, -6.0, 6.0, 1.5]
    assert values(spark, E.finite(F.col("x")), [None, float("nan"), float("inf"), 1.0]) == [False, False, False, True]


def test_regularize_round_trip(spark):
    k, mu, s = F.lit(0.5), F.lit(0.2), F.lit(1.7)
    got = values(spark, E.de_regularize(E.regularize(F.col("x"), k, mu, s), k, mu, s), [-50.0, 0.0, 3.0, 1e4])
    assert np.allclose(got, [-50.0, 0.0, 3.0, 1e4], rtol=1e-5, atol=1e-6)


def test_quarters(spark):
    df = spark.sql("select date'2001-03-31' a union all select date'2001-04-01' union all select date'1969-12-31'")
    q = E.quarter_ordinal(F.col("a"))
    got = [(r[0], str(r[1]), r[2]) for r in df.select(q, E.quarter_end(q), E.tuple_quarter(q)).collect()]
    assert got == [(8004, "2001-03-31", 125), (8005, "2001-06-30", 126), (7879, "1969-12-31", 0)]
    assert values(spark, E.seasonal_lag(F.col("x")), list(range(1, 9)), "x int") == [3, 2, 1, 0, 3, 2, 1, 0]


def test_kurtosis_is_bias_corrected(spark):
    x = [1.0, 2.0, 2.5, 7.0, -3.0, 0.5]
    n, d = len(x), np.array(x) - np.mean(x)
    g2 = (d**4).mean() / (d**2).mean() ** 2 - 3
    want = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    kurt = lambda rows: spark.createDataFrame([(v,) for v in rows], "x double").agg(E.sample_kurtosis(F.col("x"))).first()[0]
    assert kurt(x) == pytest.approx(want)
    assert kurt([1.0, 2.0, 3.0]) is None
    assert kurt([2.0] * 5) == 0


@pytest.mark.parametrize("family,df", [("gaussian", None), ("laplace", None), ("student_t", 3.0), ("student_t", 30.0)])
def test_crps_equals_quadrature(spark, family, df):
    res, sigma = 0.8, 1.3
    x = np.linspace(-400, 400, 800_001)
    if family == "gaussian":
        cdf = D.normal_cdf(x / sigma)
    elif family == "laplace":
        b = sigma / math.sqrt(2)
        cdf = np.where(x < 0, 0.5 * np.exp(np.minimum(x, 0) / b), 1 - 0.5 * np.exp(-np.maximum(x, 0) / b))
    else:
        cdf = D.student_cdf(x / sigma, df)
    want = np.trapezoid((cdf - (x >= -res)) ** 2, x)
    got = spark.range(1).select(D.crps(F.lit(res), F.lit(sigma), family, df)).first()[0]
    assert got == pytest.approx(want, abs=2e-3)


def test_normal_cdf_equals_the_library():
    x = np.concatenate([np.linspace(-9, 9, 2001), [0.0, 0.6629, -0.6630, 5.6568, 5.657]])
    assert np.allclose(D.normal_cdf(x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rtol=1e-13, atol=1e-300)


def test_erf_column_equals_the_library(spark):
    xs = [-30.0, -4.5, -4.0, -1.0, -0.3, 0.0, 1e-9, 0.46875, 0.5, 3.9, 4.1, 7.0, None]
    got = values(spark, D.erf(F.col("x")), xs)
    assert got[-1] is None and np.allclose(got[:-1], [math.erf(v) for v in xs[:-1]], rtol=1e-13)


@pytest.mark.parametrize("nu", [1.0, 2.0, 3.0, 4.0, 5.0, 8.0, 31.0])
def test_t_in_columns_equals_the_continued_fraction(spark, nu):
    xs = [-40.0, -2.0, -0.1, 0.0, 0.7, 3.0, 12.0]
    assert np.allclose(values(spark, D._t_centre(F.col("x"), nu), xs), 2 * D.student_cdf(np.array(xs), nu) - 1, atol=1e-9)


def test_t_cdf_limits():
    assert D.student_cdf(np.array([0.0]), 5)[0] == 0.5
    assert D.student_cdf(np.array([2.015]), 5)[0] == pytest.approx(0.95, abs=1e-4)
    assert np.allclose(D.student_cdf(np.linspace(-3, 3, 7), 1e6), D.normal_cdf(np.linspace(-3, 3, 7)), atol=1e-5)


def test_unknown_family_and_missing_df():
    with pytest.raises(ValueError):
        D.nll(F.lit(1.0), F.lit(1.0), "cauchy")
    with pytest.raises(ValueError):
        D.crps(F.lit(1.0), F.lit(1.0), "student_t")


def test_feature_sets_and_columns():
    assert len(FEATURE_SETS["pf_full"]) == 78 == len(set(FEATURE_SETS["pf_full"]))
    assert len(FEATURE_SETS["pf_avail"]) == 72
    cols = raw_columns(FEATURE_SETS["pf_full"])
    assert len(cols) == len(set(cols)) and "oancfy" in cols and "gpq" not in cols and "xrdq" in cols
    assert raw_columns(["niq"], scale=Scale())[6:] == ["niq", "ltq", "seqq", "atq"]


def test_config_documents(tmp_path):
    import json

    from quarterloom.config import load_feature_sets, load_task, resolve_sets

    specs = {"a": {"computed": ["c1"], "balance_sheet": ["b1", "b2"], "include_sets": ["b"]}, "b": {"cash_flow": ["b2", "f"], "include_sets": ["a", "b"]}}
    assert resolve_sets(specs) == {"a": ["b2", "f", "b1", "c1"], "b": ["b1", "b2", "c1", "f"]}
    with pytest.raises(KeyError, match="nope"):
        resolve_sets({"a": {"include_sets": ["nope"]}})
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"feature_sets": {"mine": {"include_sets": ["core"], "computed": ["wcapq"]}}, "feature_set": "mine", "horizon": 3, "scale": {"add": ["atq"], "constant": 1.0}, "excluded_sic": [[1, 2]], "mu": {"scale": 1, "item": [0, 4]}}))
    t = load_task(str(path))
    assert t.items == (*FEATURE_SETS["core"], "wcapq") and t.horizon == 3 and t.scale == Scale(("atq",), ("atq",), 1.0) and t.excluded_sic == ((1, 2),) and t.mu.item == (0, 4)
    assert load_feature_sets(str(path))["mine"][-1] == "wcapq" and load_feature_sets(str(path))["pf_full"] == FEATURE_SETS["pf_full"]
    for bad in ({"nothing": 1}, {"feature_set": "nope"}):
        path.write_text(json.dumps(bad))
        with pytest.raises((ValueError, KeyError)):
            load_task(str(path))


def test_year_chunks():
    assert year_chunks(1970, 1976, 3) == [(1970, 1972), (1973, 1975), (1976, 1976)]
    for bad in ((1970, 1976, 0), (1976, 1970, 1)):
        with pytest.raises(ValueError):
            year_chunks(*bad)
