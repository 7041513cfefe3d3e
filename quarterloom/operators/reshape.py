"""Between wide views and long tables: discovery of targets by name, melts of truth and predictions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TARGET = re.compile(r"(.+)_t(\d+)")
_FEATURE = re.compile(r"(.+)_(level|yoy)_(\d+)")


def target_columns(columns: Sequence[str]) -> list[tuple[str, str, int]]:
    """(column, target, horizon) of ``{target}_t{h}`` with a ``{target}_level_0``, by target and horizon."""
    have = set(columns)
    found = [(c, m[1], int(m[2])) for c in columns if (m := _TARGET.fullmatch(c)) and f"{m[1]}_level_0" in have]
    return sorted(found, key=lambda x: (x[1], x[2]))


def feature_columns(columns: Sequence[str], prefixes: Sequence[str] = ("industry_",)) -> list[str]:
    """Level, change and dummy columns, in the table's order."""
    return [c for c in columns if _FEATURE.fullmatch(c) or any(c.startswith(p) for p in prefixes if c != "industry_id")]


def discover_targets(columns: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(t for _, t, _ in target_columns(columns)))


def wide_truth(df: DataFrame, firm: str = "firm", origin: str = "qord") -> DataFrame:
    """``firm, origin, target, horizon, actual, base`` from a wide view.

    Raises where the view has no target or repeats a (firm, origin).
    """
    found = target_columns(df.columns)
    if not found:
        raise ValueError("no {target}_t{h} column with its {target}_level_0")
    twice = df.groupBy(firm, origin).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]}, {twice[0][1]} is there {twice[0][2]} times")
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(h).cast("long").alias("horizon"), F.col(c).cast("double").alias("actual"), F.col(f"{t}_level_0").cast("double").alias("base")) for c, t, h in found])
    return df.select(F.col(firm).alias("firm"), F.col(origin).alias("origin"), F.explode(cells).alias("c")).select("firm", "origin", "c.*")


def wide_predictions(df: DataFrame, firm: str = "firm", origin: str = "qord") -> DataFrame:
    """``firm, target, origin, horizon, prediction`` from columns ``{target}_t{h}``."""
    found = sorted(((c, m[1], int(m[2])) for c in df.columns if (m := _TARGET.fullmatch(c))), key=lambda x: (x[1], x[2]))
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(h).cast("long").alias("horizon"), F.col(c).cast("double").alias("prediction")) for c, t, h in found])
    return df.select(F.col(firm).alias("firm"), F.col(origin).alias("origin"), F.explode(cells).alias("c")).select("firm", "c.target", "origin", "c.horizon", "c.prediction")
