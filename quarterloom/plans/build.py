"""Raw panel to artifacts: statistics, tuple view, tabular view, in three splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Task
from ..functions import exprs as E
from ..operators import cells as C
from ..operators import joins, panel, stats
from ..operators.hold import hold
from ..operators.impute import impute_cells
from ..sources import files


@dataclass
class Built:
    """Lazy tables of one build."""

    panel: DataFrame
    stats: DataFrame
    cells: DataFrame
    tuples: DataFrame
    firm_ids: DataFrame
    item_ids: DataFrame
    items: list[str]
    industry_ids: DataFrame | None = None


def clean_panel(raw: DataFrame, task: Task, order: list[str] | None = None) -> DataFrame:
    """One row a firm-quarter with quarterly items, ``scale`` and ``firm, qord``.

    ``raw`` has ``firm_id``/``gvkey``, ``date``/``datadate``, fiscal year and quarter. Of repeated
    firm-quarters the last by fiscal year and quarter counts, then by ``order``.
    """
    df = panel.rename_aliases(raw)
    lost = [c for c in ("firm_id", "date", "fyearq", "fqtr") if c not in df.columns]
    if lost:
        raise ValueError(f"the raw panel lacks {', '.join(lost)}")
    if "sic" in df.columns:
        df = panel.keep_unless_in(df, "sic", task.excluded_sic)
    df = df.withColumn("firm", F.col("firm_id").cast("string")).withColumn("qord", E.quarter_ordinal(F.col("date")))
    df = panel.dedupe_last(df, ["firm", "qord"], ["fyearq", "fqtr"], order or ())
    df = panel.ytd_to_quarterly(df, "firm")
    df = panel.add_computed(df, task.items)
    return df.withColumn("scale", panel.size_scale(df.columns, task.scale))


def firm_industries(df: DataFrame, ranges: DataFrame | None, task: Task) -> DataFrame:
    """``firm, industry_id``: the modal code's range; none gives the unknown id."""
    codes = panel.modal(df, "firm", "sic", "code")
    if ranges is None:
        return codes.select("firm", F.lit(task.industries).alias("industry_id"))
    return joins.range_lookup(codes, ranges, F.col("code"), "industry_id", task.industries).select("firm", "industry_id")


def row_sizes(df: DataFrame, stats_of: DataFrame, task: Task) -> DataFrame:
    """``firm, qord, scale, size``: the scale, and itself in the regularised space.

    The size item is not divided by itself. Without statistics of it there is no ``size``.
    """
    own = stats_of.where("s_item = 'scale'").select(F.col("s_qord").alias("z_qord"), "mu", "sigma", F.coalesce("k", F.lit(1.0)).alias("k"))
    base = df.select("firm", "qord", "scale")
    if not own.limit(1).count():
        return base
    size = E.clip(E.normalize(F.col("scale"), F.lit(1.0), F.col("k"), F.col("mu"), F.col("sigma")), task.clamp).cast("float")
    return base.join(joins.small(own), F.col("qord") == F.col("z_qord"), "left").select("firm", "qord", "scale", size.alias("size"))


def build(raw: DataFrame, task: Task, frozen_stats: DataFrame | None = None, ranges: DataFrame | None = None, order: list[str] | None = None) -> Built:
    """All tables of a task, lazily; statistics are estimated on the train years unless given."""
    df = hold(clean_panel(raw, task, order))
    panel.check_panel(df, "firm")
    items = [i for i in task.items if i in df.columns]
    industry = firm_industries(df, ranges, task) if "sic" in df.columns else None
    long = C.melt(df, [*items, "scale"])
    with_scale = long.join(df.select("firm", "qord", "scale"), ["firm", "qord"])
    if frozen_stats is None:
        frozen_stats = hold(stats.estimate(with_scale, task))
    else:
        stats.check_unique(frozen_stats)
    back = max(task.levels - 1, task.yoy - 1 + task.period)
    s = frozen_stats.select(F.col("item").alias("s_item"), F.col("qord").alias("s_qord"), "mu", "sigma", "k")
    sizes = row_sizes(df, s, task)
    arrays = C.calendar_arrays(long.where("item <> 'scale'"), back, task.horizon).join(sizes, ["firm", "qord"])
    arrays = arrays.join(s, (F.col("item") == F.col("s_item")) & (F.col("qord") == F.col("s_qord")), "left").withColumn("k", F.coalesce("k", F.lit(1.0))).drop("s_item", "s_qord")
    cells = C.normal_arrays(arrays, task)
    axis = panel.gap_fill(df.select("firm", "qord"), "firm")
    cells = C.keep_rows(cells, axis, task).select("firm", "qord", *(["size"] if "size" in sizes.columns else []), "item", "level", "yoy", "target")
    cells = C.mask_targets(cells.withColumn("split", C.split_of(F.col("qord"), task)), task)
    if task.impute:
        cells = impute_cells(cells, items, task.levels, task.yoy, task.factors)
    firm_ids, item_ids = panel.dense_ids(df, "firm", "firm_id"), panel.dense_ids(long, "item", "account_id")
    tuples = joins.lookup(joins.lookup(long, firm_ids, "firm", "firm_id"), item_ids, "item", "account_id")
    if industry is not None:
        cells = joins.lookup(cells, industry, "firm", "industry_id", task.industries)
        tuples = joins.lookup(tuples, industry, "firm", "industry_id", task.industries)
    else:
        tuples = tuples.withColumn("industry_id", F.lit(task.industries))
    tuples = tuples.select("firm_id", "account_id", E.tuple_quarter(F.col("qord")).alias("quarter"), "value", F.col("industry_id").cast("long").alias("industry_id"))
    industry_ids = None
    if ranges is not None:
        name = F.first("name") if "name" in ranges.columns else F.first(F.col("id").cast("string"))
        industry_ids = ranges.groupBy("id").agg(name.alias("industry")).select("industry", F.col("id").cast("long").alias("industry_id"))
    return Built(df, frozen_stats, cells, tuples, firm_ids, item_ids, items, industry_ids)


def write(built: Built, folder: str, task: Task, tag: str = "default", views: tuple[str, ...] = ("cells", "tuple", "tabular")) -> None:
    """Write the artifacts under ``folder``; splits are partitions of one table a view.

    Cells are written first and once; the tabular view is made from what was written. A
    build of no rows leaves no cells and is an error.
    """
    spark, path = built.cells.sparkSession, f"{folder}/cells__{tag}"
    built.stats.write.mode("overwrite").parquet(f"{folder}/stats__{tag}")
    if "cells" in views or "tabular" in views:
        built.cells.write.mode("overwrite").partitionBy("split").parquet(path)
        cells = spark.read.schema(built.cells.schema).parquet(path)
        if not cells.limit(1).count():
            files.remove(spark, path)
            raise ValueError("no row survives: is the scale known, and do the statistics cover this panel's quarters?")
    if "tuple" in views:
        C.tuple_splits(built.tuples, task).write.mode("overwrite").partitionBy("split").parquet(f"{folder}/tuple__{tag}")
        for name, ids in (("firm", built.firm_ids), ("account", built.item_ids), ("industry", built.industry_ids)):
            if ids is not None:
                ids.orderBy(ids.columns[1]).coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}_ids__{tag}", header=True)
    if "tabular" in views:
        keep = ["firm", "qord", "split", *(["industry_id"] if "industry_id" in cells.columns else [])]
        wide = C.wide_view(cells, built.items, task).join(cells.select(*keep).distinct(), ["firm", "qord"])
        if "industry_id" in keep:
            wide = C.dummies(wide, "industry_id", task.industries, "industry_")
        wide.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/tabular__{tag}")
