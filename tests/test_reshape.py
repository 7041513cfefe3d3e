import pytest
from pyspark.sql import functions as F

from quarterloom.operators import reshape
from quarterloom.plans import drift


def test_targets_and_features_by_name():
    cols = ["firm", "qord", "b_level_0", "b_yoy_1", "b_t10", "b_t2", "a_t1", "a_level_0", "c_t1", "industry_3", "industry_id"]
    assert reshape.target_columns(cols) == [("a_t1", "a", 1), ("b_t2", "b", 2), ("b_t10", "b", 10)]
    assert reshape.discover_targets(cols) == ["a", "b"]
    assert reshape.feature_columns(cols) == ["b_level_0", "b_yoy_1", "a_level_0", "industry_3"]


def test_wide_truth_and_predictions(spark):
    w = spark.createDataFrame([("f", 1, 1.0, 2.0, None), ("g", 1, None, 4.0, 5.0)], "firm string, qord int, a_level_0 double, a_t1 double, a_t2 double")
    got = sorted(map(str, (tuple(r) for r in reshape.wide_truth(w).collect())))
    assert got == sorted(map(str, [("f", 1, "a", 1, 2.0, 1.0), ("f", 1, "a", 2, None, 1.0), ("g", 1, "a", 1, 4.0, None), ("g", 1, "a", 2, 5.0, None)]))
    assert reshape.wide_predictions(w).where("firm = 'g' and horizon = 2").first()["prediction"] == 5.0
    with pytest.raises(ValueError):
        reshape.wide_truth(w.unionByName(w))
    with pytest.raises(ValueError):
        reshape.wide_truth(w.drop("a_level_0"))


def test_verify_and_id_checks(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "k string, q int, v double")
    same, other = drift.fingerprint(df.orderBy(F.desc("k")), ["k", "q"]), drift.fingerprint(df.withColumn("v", F.col("v") + 1), ["k", "q"])
    assert drift.fingerprint(df, ["k", "q"]) == same != other
    assert drift.verify({"x": same, "y": same, "z": same}, {"x": same, "y": other, "w": same}) == ({"x": "ok", "y": "mismatch", "z": "extra", "w": "missing"}, False)
    assert drift.verify({"x": same}, {"x": same})[1] and not drift.verify({}, {})[1]
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "firm string, firm_id long")
    assert drift.check_firm_ids(ids, 3) == []
    assert len(drift.check_firm_ids(ids.withColumn("firm_id", 2 - F.col("firm_id")), 30)) == 2
    assert drift.compare_ids(ids, ids.where("firm_id < 2"), "firm", "firm_id").count() == 1
