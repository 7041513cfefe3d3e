"""Scoring of forecasts on a strict common sample, at four grouping levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import density as D
from ..functions import exprs as E
from ..operators.joins import canonical_firm

KEYS = ("firm", "target", "origin", "horizon")
ALIASES = {"firm_id": "firm", "quarter": "origin", "forecast_horizon": "horizon"}
LEVELS = {0: "by_target_horizon", 1: "by_target", 2: "by_horizon", 3: "global"}
METRICS = ("r2", "mae", "mse", "nll", "crps", "z2", "cover95", "avg_obs")
ASCENDING = ("mae", "mse", "nll", "crps")


def canonical_keys(df: DataFrame, text: bool = True) -> DataFrame:
    """Keys in the form in which truth, forecasts and masks meet.

    Firms: numbers' text if every id of this table is a number, else as they are (``text``
    False leaves numeric ids alone). Origins: quarter ordinals, also from dates, times and
    their text. Horizons: truncated to whole numbers.
    """
    firm, origin = df.schema["firm"].dataType, df.schema["origin"].dataType
    if isinstance(firm, T.StringType):
        df = canonical_firm(df)
    elif text:
        df = df.withColumn("firm", F.col("firm").cast("long").cast("string"))
    if isinstance(origin, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn("origin", E.quarter_ordinal(F.col("origin")).cast("long"))
    elif isinstance(origin, T.StringType):
        df = df.withColumn("origin", F.coalesce(F.expr("try_cast(origin as bigint)"), E.quarter_ordinal(F.expr("try_cast(origin as date)")).cast("long")))
    if "horizon" in df.columns:
        df = df.withColumn("horizon", F.expr("try_cast(horizon as double)").cast("long"))
    return df


def match_counts(forecast: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ``n_rows, n_unmatched, n_duplicate, n_finite`` of a forecast against the truth's grid.

    Rows whose key the truth doesn't have are unmatched; those beyond the first of a key on the grid
    are duplicates; finite counts predictions on the grid.
    """
    f, grid = canonical_keys(forecast), canonical_keys(truth.select(*KEYS)).select(*[F.col(k).alias(f"t_{k}") for k in KEYS])
    ok = E.finite(F.col("prediction").cast("double"))
    per = f.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    on = None
    for k in KEYS:
        c = F.col(k) == F.col(f"t_{k}")
        on = c if on is None else on & c
    hit = F.col("t_firm").isNotNull()
    zero = F.lit(0).cast("long")
    return per.join(grid, on, "left").agg(
        F.coalesce(F.sum("n"), zero).alias("n_rows"), F.coalesce(F.sum(F.when(~hit, F.col("n"))), zero).alias("n_unmatched"),
        F.coalesce(F.sum(F.when(hit, F.col("n") - 1)), zero).alias("n_duplicate"), F.coalesce(F.sum(F.when(hit, F.col("ok"))), zero).alias("n_finite"),
    )


def first_wins(forecast: DataFrame, order: Sequence[str] = ("ord",), values: Sequence[str] = ("prediction",)) -> DataFrame:
    """One row a key: the first in ``order``, with its nulls."""
    return forecast.groupBy(*KEYS).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("v")).select(*KEYS, "v.*")


def residuals(forecast: DataFrame, truth: DataFrame, sigma: bool = False) -> DataFrame:
    """``firm, target, origin, horizon, actual, base, residual`` (single precision).

    Forecast rows off the truth's grid fall away; truth cells without forecast don't
    appear. Horizons are truncated to whole numbers.
    """
    f = forecast.withColumn("horizon", F.col("horizon").cast("long"))
    f = f.select(*[F.col(k).alias(f"f_{k}") for k in KEYS], "prediction", *(["sigma"] if sigma else []))
    on = None
    for k in KEYS:
        c = F.col(k) == F.col(f"f_{k}")
        on = c if on is None else on & c
    j = truth.join(f, on)
    res = (F.col("prediction").cast("float") - F.col("actual").cast("float")).cast("float")
    return j.select(*KEYS, "actual", "base", res.alias("residual"), *([F.col("sigma").cast("float").alias("sigma")] if sigma else []))


def scored_cells(truth: DataFrame, forecasts: dict[str, DataFrame], families: dict[str, tuple[str, float | None]] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """One row a (cell, model): ``model, residual, common, change`` and density scores.

    ``common`` is true where truth and base are finite, every model's residual is, and
    the mask, if any, holds the cell. All models meet in one aggregate by cell. Keys are
    made canonical on every side first.
    """
    families = families or {}
    sides = [truth, *forecasts.values(), *([mask] if mask is not None else [])]
    text = any(isinstance(d.schema["firm"].dataType, T.StringType) for d in sides)
    truth, forecasts = canonical_keys(truth, text), {n: canonical_keys(f, text) for n, f in forecasts.items()}
    mask = canonical_keys(mask, text) if mask is not None else None
    known = truth.where(F.col("actual").isNotNull() & ~F.isnan("actual"))
    rows = None
    for name, f in forecasts.items():
        with_sigma = "sigma" in f.columns
        r = residuals(f, known, with_sigma)
        res, sig = F.col("residual").cast("double"), F.col("sigma").cast("double") if with_sigma else F.lit(None).cast("double")
        family, df = families.get(name, ("gaussian", None))
        ok = E.finite(res) & E.finite(sig) & (sig > 0)
        res_ok, sig_ok = F.when(ok, res), F.when(ok, sig)
        scores = {"nll": D.nll(res_ok, sig_ok, family, df), "crps": D.crps(res_ok, sig_ok, family, df)} if with_sigma else {"nll": F.lit(None).cast("double"), "crps": F.lit(None).cast("double")}
        gaussian = with_sigma and family == "gaussian"
        scores["z2"] = D.z_squared(res_ok, sig_ok) if gaussian else F.lit(None).cast("double")
        scores["cover95"] = D.covered95(res_ok, sig_ok) if gaussian else F.lit(None).cast("double")
        part = r.select(*KEYS, "actual", "base", F.lit(name).alias("model"), "residual", *[E.or_null(c).alias(n) for n, c in scores.items()])
        rows = part if rows is None else rows.unionByName(part)
    every = Window.partitionBy(*KEYS)
    finite_models = F.sum(E.finite(F.col("residual")).cast("int")).over(every)
    common = (finite_models == len(forecasts)) & E.finite(F.col("base")) & E.finite(F.col("actual"))
    out = rows.withColumn("common", common)
    if mask is not None:
        m = mask.select(*[F.col(k).alias(f"m_{k}") for k in KEYS]).distinct()
        on = None
        for k in KEYS:
            c = F.col(k) == F.col(f"m_{k}")
            on = c if on is None else on & c
        out = out.join(m, on, "left").withColumn("common", F.col("common") & F.col("m_firm").isNotNull()).drop(*[f"m_{k}" for k in KEYS])
    return out.withColumn("change", F.col("actual").cast("double") - F.col("base").cast("double"))


def metrics(cells: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """``level, target, horizon, model, r2, mae, ..., avg_obs, n_complete``.

    Sums are folded to (model, target, horizon) first, and the four levels are grouping
    sets over those few rows. The R2 denominator is the variance of the change from the
    base over the common sample: the same for all models. avg_obs divides all of a
    model's residuals by the quarters in which the group has truth.
    """
    common = F.col("common")
    on = lambda c: F.when(common, c)
    res = F.col("residual").cast("double")
    block = cells.groupBy("model", "target", "horizon").agg(
        F.count(F.when(~F.isnan("residual"), F.col("residual"))).alias("n_obs"),
        F.count_if(common).alias("n"),
        F.sum(on(res * res)).alias("ss"),
        F.sum(on(F.abs(res))).alias("sa"),
        F.sum(on(F.col("change"))).alias("sy"),
        F.sum(on(F.col("change") * F.col("change"))).alias("syy"),
        *[F.sum(on(F.col(m))).alias(f"s_{m}") for m in ("nll", "crps", "z2", "cover95")],
        *[F.count(on(F.col(m))).alias(f"n_{m}") for m in ("nll", "crps", "z2", "cover95")],
        F.collect_set("origin").alias("quarters"),
    )
    if truth is not None:
        seen = truth.where(F.col("actual").isNotNull()).groupBy("target", "horizon").agg(F.collect_set("origin").alias("quarters"))
        block = block.drop("quarters").join(seen, ["target", "horizon"])
    sums = [F.sum(c).alias(c) for c in block.columns if c not in ("model", "target", "horizon", "quarters")]
    g = block.groupingSets([["model", "target", "horizon"], ["model", "target"], ["model", "horizon"], ["model"]], "model", "target", "horizon").agg(*sums, F.size(F.array_distinct(F.flatten(F.collect_list("quarters")))).alias("n_quarters"), F.grouping_id().alias("gid"))
    n = F.when(F.col("n") > 0, F.col("n"))
    total = F.coalesce(F.col("syy"), F.lit(0.0)) - F.coalesce(F.col("sy") * F.col("sy"), F.lit(0.0)) / n
    level = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))])[F.col("gid").cast("int")]
    return g.select(
        level.alias("level"), "target", "horizon", "model",
        F.when(total > 1e-15, 1 - F.col("ss") / (total + 1e-12)).alias("r2"),
        (F.col("sa") / n).alias("mae"), (F.col("ss") / n).alias("mse"),
        *[F.try_divide(F.col(f"s_{m}"), F.col(f"n_{m}")).alias(m) for m in ("nll", "crps", "z2", "cover95")],
        F.try_divide(F.col("n_obs").cast("double"), F.col("n_quarters")).alias("avg_obs"),
        F.col("n").cast("long").alias("n_complete"),
    )


def leaderboard(scores: DataFrame, metric: str = "r2") -> DataFrame:
    """Global metrics, best model first: errors and NLL, CRPS rise, everything else falls."""
    order = F.col(metric).asc_nulls_last() if metric in ASCENDING else F.col(metric).desc_nulls_last()
    return scores.where("level = 'global'").drop("level", "target", "horizon").orderBy(order, "model")


def common_sample_violations(cells: DataFrame) -> DataFrame:
    """Blocks in which models are scored on different numbers of cells; none is right."""
    per = cells.groupBy("target", "horizon", "model").agg(F.count_if(F.col("common")).alias("n"))
    return per.groupBy("target", "horizon").agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least <> most")


def pivot_metric(scores: DataFrame, level: str, metric: str, models: Sequence[str]) -> DataFrame:
    """A row a group, a column a model."""
    keys = {"by_target_horizon": ["target", "horizon"], "by_target": ["target"], "by_horizon": ["horizon"], "global": []}[level]
    return scores.where(F.col("level") == level).groupBy(*keys).pivot("model", list(models)).agg(F.first(metric))


def evaluate(truth: DataFrame, forecasts: dict[str, DataFrame], families: dict | None = None, mask: DataFrame | None = None) -> DataFrame:
    """The metrics of all forecasts on their common sample."""
    if not forecasts:
        raise ValueError("no forecast to evaluate")
    return metrics(scored_cells(truth, forecasts, families, mask), truth)
