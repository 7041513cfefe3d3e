"""Forecast baselines over the cell table: seasonal naive, fade, linear, elastic net."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Task
from ..functions import exprs as E
from ..operators import gram, reshape
from ..operators.hold import hold

# The public grid of the elastic net, and its parameters where no search is possible.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
L1_RATIOS = (0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99)
UNSEARCHED = (1.0, 0.5)


def truth_cells(cells: DataFrame, horizon: int, known_only: bool = False) -> DataFrame:
    """``firm, origin, target, horizon, actual, base``: one row a forecastable cell."""
    t = cells.select("firm", F.col("qord").alias("origin"), F.col("item").alias("target"), F.get("level", F.lit(0)).alias("base"), F.posexplode(F.slice("target", 1, horizon)).alias("i", "actual"))
    out = t.select("firm", "origin", "target", (F.col("i") + 1).cast("long").alias("horizon"), "actual", "base")
    return out.where("actual is not null") if known_only else out


def _horizons(last: int) -> Column:
    return F.explode(F.sequence(F.lit(1).cast("long"), F.lit(last).cast("long"))).alias("horizon")


def naive(cells: DataFrame, horizon: int, period: int = 4) -> DataFrame:
    """The level of the target's season: lag (period - h mod period) mod period. Every cell."""
    f = cells.select("firm", F.col("qord").alias("origin"), F.col("item").alias("target"), "level", _horizons(horizon))
    return f.select("firm", "target", "origin", "horizon", F.get("level", E.seasonal_lag(F.col("horizon"), period)).alias("prediction"))


def fade_coefficients(fit: DataFrame, horizon: int, min_rows: int = 100) -> DataFrame:
    """``target, horizon, rho, b`` of pooled regressions of the target on the current level.

    No pair: (1, 0). Fewer than ``min_rows`` pairs, or a constant level: (0, mean).
    """
    t = truth_cells(fit, horizon)
    x, y = F.col("base").cast("double"), F.col("actual").cast("double")
    both = E.finite(x) & E.finite(y)
    x, y = F.when(both, x), F.when(both, y)
    g = t.groupBy("target", "horizon").agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.regr_sxx(y, x).alias("sxx"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("cut"))
    flat = (F.col("n") < min_rows) | (F.coalesce("sxx", F.lit(0.0)) <= 1e-12)
    rho = F.when(F.col("n") == 0, 1.0).when(flat, 0.0).otherwise(F.col("slope"))
    b = F.when(F.col("n") == 0, 0.0).when(flat, F.col("mean")).otherwise(F.col("cut"))
    return g.select("target", "horizon", rho.alias("rho"), b.alias("b"))


def fade(fit: DataFrame, test: DataFrame, horizon: int, min_rows: int = 100) -> DataFrame:
    """rho * current level + b; pairs that were never fitted fade as a random walk."""
    f = test.select("firm", F.col("qord").alias("origin"), F.col("item").alias("target"), F.get("level", F.lit(0)).cast("double").alias("base"), _horizons(horizon))
    c = fade_coefficients(fit, horizon, min_rows).select(F.col("target").alias("c_target"), F.col("horizon").alias("c_horizon"), "rho", "b")
    j = f.join(c, (F.col("target") == F.col("c_target")) & (F.col("horizon") == F.col("c_horizon")), "left")
    return j.select("firm", "target", "origin", "horizon", (F.coalesce("rho", F.lit(1.0)) * F.col("base") + F.coalesce("b", F.lit(0.0))).alias("prediction"))


# ---- linear family ----------------------------------------------------------------------


def feature_rows(cells: DataFrame, items: Sequence[str], targets: Sequence[str], horizons: Sequence[int], industries: int = 0) -> DataFrame:
    """``firm, qord, x, y`` of the firm-quarters that know all features.

    ``x``: level and yoy of all items, then ``size`` (if the table has it), then the 0/1
    dummies of ``industries``. ``y``: each target at each horizon, null where unknown.
    """
    keys = [c for c in ("size", "industry_id") if c in cells.columns]
    g = cells.groupBy("firm", "qord", *keys).agg(F.map_from_entries(F.collect_list(F.struct("item", F.struct("level", "yoy", "target")))).alias("m"))
    of = lambda i, f: F.try_element_at("m", F.lit(i))[f]
    parts = [F.concat(of(i, "level"), of(i, "yoy")) for i in items]
    if "size" in keys:
        parts.append(F.array("size"))
    if industries and "industry_id" in keys:
        parts.append(F.transform(F.sequence(F.lit(0), F.lit(industries - 1)), lambda i: F.coalesce((F.col("industry_id") == i).cast("float"), F.lit(0.0).cast("float"))))
    y = [F.get(of(t, "target"), F.lit(h - 1)) for t in targets for h in horizons]
    return _complete(g.select("firm", "qord", F.concat(*parts).cast("array<double>").alias("x"), F.array(*y).cast("array<double>").alias("y")))


def wide_rows(wide: DataFrame, targets: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """The same from a wide view, its features found by their names."""
    x = reshape.feature_columns(wide.columns)
    y = [F.col(c) if (c := f"{t}_t{h}") in wide.columns else F.lit(None) for t in targets for h in horizons]
    return _complete(wide.select("firm", "qord", F.array(*x).cast("array<double>").alias("x"), F.array(*y).cast("array<double>").alias("y")))


def _complete(rows: DataFrame) -> DataFrame:
    known = lambda v: v.isNotNull() & ~F.isnan(v)
    return rows.where(F.col("x").isNotNull() & F.forall("x", known)).withColumn("y", F.transform("y", lambda v: F.when(known(v), v)))


def fit_and_predict(train: DataFrame, val: DataFrame, test: DataFrame, targets: Sequence[str], horizons: Sequence[int], kind: str = "linear", reference: str | None = None, alphas: Sequence[float] = ALPHAS, l1_ratios: Sequence[float] = L1_RATIOS) -> DataFrame:
    """``firm, target, origin, horizon, prediction`` from rows of ``firm, qord, x, y``.

    One fit a (target, horizon) on train + val rows that know its label; predicts every
    test row. ``kind`` is ``linear`` or ``elasticnet``; the latter's parameters are searched
    once a horizon on the ``reference`` target. A label without fit rows predicts null.
    """
    if kind not in ("linear", "elasticnet"):
        raise ValueError(f"unknown kind {kind!r}")
    first = test.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no test row has all features")
    horizons = list(horizons)
    width, labels, params = first["n"], len(targets) * len(horizons), None
    if kind == "elasticnet":
        at = list(targets).index(reference or targets[0]) * len(horizons)
        own = lambda d: d.select("x", F.slice("y", at + 1, len(horizons)).alias("y"))
        best = gram.search(own(train), own(val), width, len(horizons), alphas, l1_ratios)
        params = [best.get(h, UNSEARCHED) for _ in targets for h in range(len(horizons))]
    weights = gram.coefficients(train.unionByName(val), width, labels, params)
    names, hs = F.array(*[F.lit(t) for t in targets]), F.array(*[F.lit(h).cast("long") for h in horizons])
    p = gram.predict(test.select("firm", F.col("qord").alias("origin"), "x"), weights)
    return p.select("firm", F.get(names, F.floor(F.col("label") / len(horizons)).cast("int")).alias("target"), "origin", F.get(hs, F.pmod("label", F.lit(len(horizons)))).alias("horizon"), "prediction")


def linear_family(train: DataFrame, val: DataFrame, test: DataFrame, items: Sequence[str], targets: Sequence[str], horizons: Sequence[int], kind: str = "linear", reference: str | None = None, alphas: Sequence[float] = ALPHAS, l1_ratios: Sequence[float] = L1_RATIOS, industries: int = 0) -> DataFrame:
    """``fit_and_predict`` over cell tables."""
    rows = [hold(feature_rows(c, items, targets, horizons, industries)) for c in (train, val, test)]
    return fit_and_predict(*rows, targets, horizons, kind, reference, alphas, l1_ratios)


BASELINES: dict[str, Callable[..., DataFrame]] = {
    "naive": lambda fit, test, task: naive(test, task.horizon, task.period),
    "fade": lambda fit, test, task: fade(fit, test, task.horizon, task.fade_min_rows),
}


def run_baselines(names: Sequence[str], train: DataFrame, val: DataFrame, test: DataFrame, task: Task, items: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """A forecast table for each name: naive, fade, linear, elasticnet."""
    unknown = set(names) - {*BASELINES, "linear", "elasticnet"}
    if unknown:
        raise ValueError(f"unknown baselines: {sorted(unknown)}")
    fit, out = train.unionByName(val), {}
    for n in names:
        if n in BASELINES:
            out[n] = BASELINES[n](fit, test, task)
        else:
            own = list(items or task.items)
            out[n] = linear_family(train, val, test, own, own, range(1, task.horizon + 1), n, "niq" if "niq" in own else own[0], industries=task.industries)
    return out


