"""From raw rows to a clean quarterly panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COMPUTED_ITEMS, RAW_ALIASES, YTD_BASES, Scale
from ..functions import exprs as E


def rename_aliases(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename each alias whose canonical name isn't there; applying it twice changes nothing."""
    aliases = RAW_ALIASES if aliases is None else aliases
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def keep_unless_in(df: DataFrame, code: str, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Drop rows whose code lies in a range; rows without code stay."""
    keep = F.col(code).isNull()
    inside = F.lit(False)
    for lo, hi in ranges:
        inside = inside | F.col(code).between(lo, hi)
    return df.where(keep | ~inside)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """One row a key: the last in ``order``, where nulls come last, then by ``tie``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_first() for c in order], *[F.col(c).desc() for c in tie])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ytd_to_quarterly(df: DataFrame, firm: str = "firm_id", fiscal_year: str = "fyearq", fiscal_quarter: str = "fqtr", at: str = "qord", bases: Sequence[str] | None = None) -> DataFrame:
    """Turn fiscal-year-to-date totals ``{base}y`` into quarterly ``{base}q``.

    In fiscal quarter 1, or without one, the total is the quarter's. Later, the
    previous row's total of the same fiscal year is taken off, if that is of the
    previous fiscal quarter; else the value is unknown.
    """
    w = Window.partitionBy(firm, fiscal_year).orderBy(at)
    follows = F.col(fiscal_year).isNotNull() & (F.lag(fiscal_quarter).over(w) == F.col(fiscal_quarter) - 1)
    out, gone = {}, []
    for b in YTD_BASES if bases is None else bases:
        if f"{b}y" in df.columns:
            y = F.col(f"{b}y")
            out[f"{b}q"] = F.when(F.coalesce(F.col(fiscal_quarter) > 1, F.lit(False)), F.when(follows, y - F.lag(y).over(w))).otherwise(y)
            gone.append(f"{b}y")
    return df.withColumns(out).drop(*gone)


def computed(left: Column, right: Column, nulls: str) -> Column:
    zero = F.lit(0.0)
    if nulls == "strict":
        return left - right
    return (F.coalesce(left, zero) if nulls == "both0" else left) - F.coalesce(right, zero)


def add_computed(df: DataFrame, items: Sequence[str], formulas: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """Compute each listed item whose inputs exist, replacing a native column of that name."""
    formulas = COMPUTED_ITEMS if formulas is None else formulas
    new = {i: computed(F.col(formulas[i][0]), F.col(formulas[i][1]), formulas[i][2]) for i in items if i in formulas and set(formulas[i][:2]) <= set(df.columns)}
    return df.withColumns(new) if new else df


def size_scale(columns: Sequence[str], cfg: Scale) -> Column:
    """Sum of absolute items plus the constant; else, row by row, the first valid fallback."""
    valid = lambda x: F.when(E.finite(x) & (x > 0), x)
    options = []
    if cfg.add and set(cfg.add) <= set(columns):
        total = F.lit(0.0)
        for c in cfg.add:
            total = total + F.abs(F.col(c).cast("double"))
        options.append(valid(total + cfg.constant))
    options += [valid(F.abs(F.col(c).cast("double")) + cfg.constant) for c in cfg.fallbacks if c in columns]
    return F.coalesce(*options) if options else F.lit(None).cast("double")


def modal(df: DataFrame, key: str, value: str, out: str = "modal") -> DataFrame:
    """Each key's most frequent non-null value; ties go to the smallest, no value gives null.

    Counts are folded before the shuffle by (key, value), so a hot key costs little.
    """
    counts = df.groupBy(key, value).agg(F.count(value).alias("__n"))
    # the largest count, then the least value: order by (count, -rank) without windows
    best = counts.groupBy(key).agg(F.max("__n").alias("__top"))
    top = counts.join(best.withColumnRenamed(key, "__k"), (F.col(key) == F.col("__k")) & (F.col("__n") == F.col("__top")))
    return top.groupBy(key).agg(F.min(value).alias(out))


def check_panel(df: DataFrame, firm: str = "firm_id", at: str = "qord") -> None:
    """Raise if a key is null, a firm-quarter repeats, or there is no row."""
    n, no_firm, no_quarter = df.agg(F.count("*"), F.count_if(F.col(firm).isNull()), F.count_if(F.col(at).isNull())).first()
    if not n:
        raise ValueError("the panel has no rows")
    if no_firm or no_quarter:
        raise ValueError(f"{no_firm} rows without {firm}, {no_quarter} without {at}")
    twice = df.groupBy(firm, at).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{firm} {twice[0][0]} has quarter {twice[0][1]} {twice[0][2]} times")


def gap_fill(df: DataFrame, firm: str = "firm_id", at: str = "qord") -> DataFrame:
    """Every quarter from a firm's first to its last; added rows have nulls elsewhere."""
    axis = df.groupBy(firm).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi")).select(firm, F.explode(F.sequence("__lo", "__hi")).alias(at))
    return axis.join(df, [firm, at], "left")


def aggregate_panel(df: DataFrame, firm: Column, date: Column, **items: Column) -> DataFrame:
    """``firm, qord`` and the given aggregates: transactions to a panel."""
    return df.groupBy(firm.alias("firm"), E.quarter_ordinal(date).cast("long").alias("qord")).agg(*[c.alias(n) for n, c in items.items()])


def dense_ids(df: DataFrame, name: str, out: str) -> DataFrame:
    """``name, out``: ids from 0 in order of the distinct names, a small dictionary."""
    return df.select(name).where(F.col(name).isNotNull()).distinct().withColumn(out, (F.row_number().over(Window.orderBy(name)) - 1).cast("long"))
