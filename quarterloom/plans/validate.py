"""Checks of forecast tables, and their writer."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FEATURE_SETS
from ..functions import exprs as E
from ..operators.panel import rename_aliases
from ..sources import files
from .scoring import ALIASES, KEYS

REQUIRED = (*KEYS, "prediction")
CLAMP = 6.0
#: Predictions this many times beyond the clamp are in raw units.
RAW_UNITS = 10.0


class InvalidForecast(ValueError):
    """A forecast table breaks the schema."""


def forecast_counters(df: DataFrame, targets: Sequence[str] | None = None, horizon: int = 20) -> DataFrame:
    """One row of counters: everything the checks need, in one pass and one grouping."""
    targets = list(targets or FEATURE_SETS["pf_full"])
    h = F.expr("try_cast(horizon as double)")
    p = F.expr("try_cast(prediction as double)")
    s = F.expr("try_cast(sigma as double)") if "sigma" in df.columns else F.lit(None).cast("double")
    one = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in KEYS],
        F.count_if(h.isNull()).alias("bad_horizon"),
        F.count_if(h != F.round(h)).alias("fractional_horizon"),
        F.count_if((h < 1) | (h > horizon)).alias("horizon_out_of_range"),
        F.count_if(~E.finite(p) | p.isNull()).alias("nonfinite"),
        F.count_if(p.isNotNull() & ~F.isnan(p)).alias("n_prediction"),
        F.count_if(s <= 0).alias("bad_sigma"),
        F.max(F.when(E.finite(p), F.abs(p))).alias("largest"),
        F.count_if(F.col("target").isNotNull() & ~F.col("target").cast("string").isin(targets)).alias("unknown_target_rows"),
    )
    twice = df.groupBy(*KEYS).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicate"))
    return one.crossJoin(twice)


def validate_forecast(df: DataFrame, targets: Sequence[str] | None = None, horizon: int = 20, strict: bool = False, require_values: bool = True) -> tuple[list[str], list[str]]:
    """(problems, warnings) of a forecast table; with ``strict`` problems raise InvalidForecast.

    Duplicates are found over the whole table.
    """
    df = rename_aliases(df, ALIASES)
    problems: list[str] = []
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        problems.append(f"missing columns: {', '.join(missing)}")
        if strict:
            raise InvalidForecast("; ".join(problems))
        return problems, []
    known = list(targets or FEATURE_SETS["pf_full"])
    c = forecast_counters(df, known, horizon).first()
    if c["unknown_target_rows"]:
        names = [r[0] for r in df.select(F.col("target").cast("string")).where(F.col("target").isNotNull() & ~F.col("target").cast("string").isin(known)).distinct().orderBy("target").limit(10).collect()]
        problems.append(f"unknown targets: {', '.join(names)}")
    if c["bad_horizon"]:
        problems.append(f"{c['bad_horizon']} horizons are no numbers")
    if c["fractional_horizon"]:
        problems.append("horizons must be whole numbers")
    if c["horizon_out_of_range"]:
        problems.append(f"{c['horizon_out_of_range']} horizons are outside 1..{horizon}")
    problems += [f"{c[f'null_{k}']} rows without {k}" for k in KEYS if c[f"null_{k}"]]
    if not isinstance(df.schema["firm"].dataType, T.StringType):
        problems.append(f"firm must be text, not {df.schema['firm'].dataType.simpleString()}")
    if not c["n_rows"]:
        problems.append("no rows")
    elif require_values and not c["n_prediction"]:
        problems.append("no prediction at all")
    elif require_values and c["nonfinite"] == c["n_rows"]:
        problems.append("no prediction is finite")
    if c["bad_sigma"]:
        problems.append(f"{c['bad_sigma']} sigmas are not positive")
    if c["n_duplicate"]:
        problems.append(f"{c['n_duplicate']} rows repeat a key; the first counts")
    warnings = []
    if c["n_rows"] and 0 < c["nonfinite"] < c["n_rows"]:
        warnings.append(f"{c['nonfinite']} of {c['n_rows']} predictions aren't finite and shrink every model's common sample")
    if c["largest"] is not None and c["largest"] > CLAMP * RAW_UNITS:
        warnings.append(f"predictions reach {c['largest']:.4g}; they should be in the regularised space, within {CLAMP:g}")
    if strict and problems:
        raise InvalidForecast("; ".join(problems))
    return problems, warnings


def forecast_payload(df: DataFrame) -> DataFrame:
    """The stored columns and types; a sigma that becomes 0 in single precision is an error."""
    df = rename_aliases(df, ALIASES)
    cols = [F.col("firm").cast("string").alias("firm"), F.col("target").cast("string").alias("target"), F.col("origin"), F.col("horizon").cast("long").alias("horizon"), F.col("prediction").cast("float").alias("prediction")]
    if "sigma" in df.columns:
        s = F.col("sigma").cast("float")
        gone = (F.col("sigma") > 0) & (s <= 0)
        cols.append(F.when(gone, F.raise_error(F.lit("a sigma is too small for single precision")).cast("float")).otherwise(s).alias("sigma"))
    return df.select(*cols)


def write_forecast(df: DataFrame, path: str, targets: Sequence[str] | None = None, horizon: int = 20, validate: bool = True) -> None:
    """Validate, then write to a side path and rename, so that ``path`` is whole or absent."""
    if validate:
        validate_forecast(df, targets, horizon, strict=True)
    side = f"{path}.partial-{uuid.uuid4().hex[:8]}"
    forecast_payload(df).write.mode("errorifexists").parquet(side)
    files.publish(df.sparkSession, side, path)


def write_forecast_blocks(blocks: Iterable[DataFrame], path: str, targets: Sequence[str] | None = None, horizon: int = 20, validate: bool = True) -> int:
    """Append blocks one by one to a side path, then publish it; returns the number of blocks.

    Each block is validated by itself; one without any value is allowed and an empty one is
    skipped, but a forecast of no rows, or of no values at all, is an error and leaves nothing.
    """
    spark, side, n = None, f"{path}.partial-{uuid.uuid4().hex[:8]}", 0
    try:
        for b in blocks:
            spark = b.sparkSession
            if not b.limit(1).count():
                continue
            if validate:
                validate_forecast(b, targets, horizon, strict=True, require_values=False)
            forecast_payload(b).write.mode("append").parquet(side)
            n += 1
        if not n:
            raise InvalidForecast("no rows")
        if validate:
            validate_forecast(spark.read.parquet(side), targets, horizon, strict=True)
        files.publish(spark, side, path)
    finally:
        if spark is not None:
            files.remove(spark, side)
    return n
