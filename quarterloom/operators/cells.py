"""The long cell table: per firm, quarter and item, arrays of levels, changes and targets.

Rows stay narrow: a wide view of thousands of columns exists only on export. One
shuffle by (firm, item) builds a firm's calendar as an array, whose length is the
number of quarters; lags and leads are positions in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Task
from ..functions import exprs as E


def melt(panel: DataFrame, items: Sequence[str], keys: Sequence[str] = ("firm", "qord"), name: str = "item", value: str = "value", drop_null: bool = True) -> DataFrame:
    """Wide to long; nulls go unless asked for."""
    wide = panel.select(*keys, *[F.col(i).cast("double").alias(i) for i in items])
    long = wide.unpivot(list(keys), list(items), name, value)
    return long.where(F.col(value).isNotNull()) if drop_null else long


def calendar_arrays(long: DataFrame, back: int, ahead: int, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Add ``past`` (value at q, q-1, .. q-back) and ``future`` (q+1 .. q+ahead) by calendar.

    Unknown quarters are null. ``long`` has unique ``firm, item, qord``; only its rows come out.
    """
    row = F.struct("qord", F.col(value).alias("v"), *keep)
    g = long.groupBy("firm", "item").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    nothing = lambda n: F.array_repeat(F.lit(None).cast(long.schema[value].dataType), n)
    # each value, then a null for every quarter up to the next one
    gap = lambda r, i: F.coalesce(F.get("rows", i + 1)["qord"] - r["qord"] - 1, F.lit(0)).cast("int")
    axis = F.flatten(F.transform("rows", lambda r, i: F.concat(F.array(r["v"]), nothing(gap(r, i)))))
    g = g.select("firm", "item", "rows", F.concat(nothing(F.lit(back)), axis, nothing(F.lit(ahead))).alias("axis"))
    out = g.select("firm", "item", F.element_at("rows", 1)["qord"].alias("first"), "axis", F.explode("rows").alias("r"))
    at = (F.col("r.qord") - F.col("first")).cast("int")
    past, future = F.reverse(F.slice("axis", at + 1, back + 1)), F.slice("axis", at + back + 2, ahead)
    return out.select("firm", "item", F.col("r.qord").alias("qord"), F.col("r.v").alias(value), *[F.col(f"r.{c}").alias(c) for c in keep], past.alias("past"), future.alias("future"))


def normal_arrays(cells: DataFrame, task: Task) -> DataFrame:
    """Add ``level``, ``yoy`` and ``target`` arrays in the regularised space.

    ``cells`` has ``past``, ``future`` and the origin's ``scale, mu, sigma, k``: lagged and
    future values are all put on the origin's scale. A change is the difference of two
    unclipped normals, clipped once.
    """
    norm = lambda v: E.normalize(v, F.col("scale"), F.col("k"), F.col("mu"), F.col("sigma"))
    n = F.transform("past", norm)
    wide = task.clamp * task.yoy_factor
    return (
        cells.withColumn("__n", n)
        .withColumns({
            "level": F.transform(F.slice("__n", 1, task.levels), lambda x: E.clip(x, task.clamp).cast("float")),
            "yoy": F.transform(F.sequence(F.lit(0), F.lit(task.yoy - 1)), lambda i: E.clip(F.get("__n", i) - F.get("__n", i + task.period), wide).cast("float")),
            "target": F.transform("future", lambda v: E.clip(norm(v), task.clamp).cast("float")),
        })
        .drop("__n")
    )


def keep_rows(cells: DataFrame, first_quarters: DataFrame, task: Task) -> DataFrame:
    """Origins with enough history and something known.

    Early: not before the ``min_lookback``-th quarter of the panel (if it has more), and a
    known ``size``, or scale in a table without sizes. Late: over the firm-quarter's items,
    some level and some feature is known.
    """
    n = task.min_lookback
    some = first_quarters.select("qord").distinct().orderBy("qord").limit(n + 1)
    start = some.agg(F.when(F.count("*") > n, F.element_at(F.array_sort(F.collect_list("qord")), n)).alias("__start"))
    known = F.col("size" if "size" in cells.columns else "scale").isNotNull()
    early = cells.crossJoin(F.broadcast(start)).where(F.coalesce(F.col("qord") >= F.col("__start"), F.lit(True)) & known).drop("__start")
    known = E.any_value(F.col("level")) | E.any_value(F.col("yoy"))
    alive = early.groupBy("firm", "qord").agg(F.bool_or(E.any_value(F.col("level"))).alias("a"), F.bool_or(known).alias("b")).where("a and b").select("firm", "qord")
    return early.join(alive, ["firm", "qord"], "left_semi")


def split_of(qord: Column, task: Task) -> Column:
    year = E.quarter_year(qord)
    return F.when(year <= task.train_end, "train").when(year <= task.val_end, "val").otherwise("test")


def mask_targets(cells: DataFrame, task: Task) -> DataFrame:
    """Null targets that leave the split's period, then those not observed at the origin."""
    end = F.when(F.col("split") == "train", task.train_end * 4 + 3).when(F.col("split") == "val", task.val_end * 4 + 3)
    target = F.transform("target", lambda t, i: F.when(end.isNull() | (F.col("qord") + i + 1 <= end), t))
    out = cells.withColumn("target", target)
    if task.present_in_q0:
        out = out.withColumn("target", F.when(F.get("level", F.lit(0)).isNotNull(), F.col("target")).otherwise(F.transform("target", lambda t: F.lit(None).cast("float"))))
    return out


def tuple_splits(tuples: DataFrame, task: Task, quarter: str = "quarter") -> DataFrame:
    """Add ``split``; validation and test also get the history before them, so rows may repeat."""
    t_end, v_end = task.train_end * 4 + 3 - E.TUPLE_ORIGIN, task.val_end * 4 + 3 - E.TUPLE_ORIGIN
    q = F.col(quarter)
    member = F.array_compact(F.array(
        F.when(q <= t_end, F.lit("train")),
        F.when((q > t_end - task.tuple_history) & (q <= v_end), F.lit("val")),
        F.when(q > v_end - task.tuple_history, F.lit("test")),
    ))
    return tuples.withColumn("split", F.explode(member))


def dummies(df: DataFrame, col: str, count: int, prefix: str) -> DataFrame:
    """0/1 columns ``{prefix}{i}`` for i below ``count``; higher ids are the reference level."""
    return df.withColumns({f"{prefix}{i}": F.coalesce((F.col(col) == i).cast("float"), F.lit(0.0).cast("float")) for i in range(count)})


def wide_view(cells: DataFrame, items: Sequence[str], task: Task) -> DataFrame:
    """One row a firm-quarter: ``{item}_level_i``, ``{item}_yoy_i``, ``{item}_t{h}``. For export.

    A table with ``size`` also gets ``scale_level_0``.
    """
    size = [F.col("size").alias("scale_level_0")] if "size" in cells.columns else []
    g = cells.groupBy("firm", "qord", *size).pivot("item", list(items)).agg(F.first("level").alias("level"), F.first("yoy").alias("yoy"), F.first("target").alias("target"))
    cols = []
    for i in items:
        cols += [F.get(f"{i}_level", F.lit(n)).alias(f"{i}_level_{n}") for n in range(task.levels)]
        cols += [F.get(f"{i}_yoy", F.lit(n)).alias(f"{i}_yoy_{n}") for n in range(task.yoy)]
        cols += [F.get(f"{i}_target", F.lit(n - 1)).alias(f"{i}_t{n}") for n in range(1, task.horizon + 1)]
    return g.select("firm", "qord", *(["scale_level_0"] if size else []), *cols)
