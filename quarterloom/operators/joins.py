"""Joins a panel needs beyond equality: as-of, interval, range, and key rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; a larger one is shuffled.
MAX_BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count that stops past ``rows`` shows it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, payload: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Every left row with the payload of the latest right row at or before it.

    Of right rows at the same time the last in ``order`` counts. The row is matched as a
    whole: its nulls are kept. Left rows whose key or time is null match nothing.

    One union, one shuffle by key and a running ``last``: linear, where a
    non-equi join would multiply rows.
    """
    keys = list(by)
    l = left.select(F.struct("*").alias("__row"), *keys, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__o_{c}") for c in order], F.lit(None).cast(right.select(F.struct(*payload).alias("p")).schema["p"].dataType).alias("__hit"))
    r = right.where(F.col(right_on).isNotNull()).select(F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), *keys, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), *[F.col(c).alias(f"__o_{c}") for c in order], F.struct(*payload).alias("__hit"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side", *[f"__o_{c}" for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("__at").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    both = l.unionByName(r).withColumn("__hit", F.when(known, F.last("__hit", ignorenulls=True).over(w)))
    return both.where("__side = 1").select("__row.*", *[F.col(f"__hit.{c}").alias(c) for c in payload])


def interval_join(panel: DataFrame, links: DataFrame, key: str, at: str, start: str, end: str, payload: Sequence[str], impose: bool = True) -> DataFrame:
    """Panel rows with the link valid at their date; a null end is open.

    A key without any link keeps its rows, payload null. A key with links of which none
    covers the date loses the row. Overlapping links repeat it.
    """
    r = links.select(F.col(key).alias("__key"), F.col(start).alias("__start"), F.col(end).alias("__end"), F.lit(True).alias("__linked"), *payload)
    joined = panel.join(r, panel[key] == F.col("__key"), "left")
    if impose:
        inside = F.coalesce(F.col("__start") <= F.col(at), F.lit(True)) & F.coalesce(F.col(at) <= F.col("__end"), F.lit(True))
        joined = joined.where(F.col("__linked").isNull() | inside)
    return joined.drop("__key", "__start", "__end", "__linked")


def with_calendar(df: DataFrame, at: str) -> DataFrame:
    """Add ``jdate`` (the month's last day) and ``year``."""
    return df.withColumns({"jdate": F.last_day(at), "year": F.year(at)})


def range_lookup(df: DataFrame, ranges: DataFrame, code: Column, out: str = "range_id", default: int | None = None) -> DataFrame:
    """Add the id of the first range (by its lower end) that holds the integer code.

    ``ranges`` has ``id, lo, hi``, both ends included. Ranges become a code -> id table, so
    the join is an equality; its size is counted before it is broadcast.
    """
    codes = ranges.select("id", "lo", F.explode(F.sequence("lo", "hi")).alias("__c")).groupBy("__c").agg(F.min_by("id", F.struct("lo", "id")).alias("__id"))
    joined = df.withColumn("__code", code.cast("int")).join(small(codes), F.col("__code") == F.col("__c"), "left")
    return joined.withColumn(out, F.coalesce("__id", F.lit(default))).drop("__code", "__c", "__id")


def lookup(df: DataFrame, table: DataFrame, on: str, value: str, default=None) -> DataFrame:
    """Add ``value`` from a dictionary table of unique keys; a missing key gives the default."""
    t = table.select(F.col(on).alias("__k"), F.col(value).alias("__v"))
    return df.join(small(t), F.col(on) == F.col("__k"), "left").withColumn(value, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def canonical_firm(df: DataFrame, col: str = "firm") -> DataFrame:
    """Turn ids into numbers' text if every id of this side is a number, else leave them.

    ``000123`` and ``123`` are then the same firm. The decision is one aggregate.
    """
    number = F.expr(f"try_cast(`{col}` as bigint)")
    total = df.agg(F.count_if(F.col(col).isNotNull() & number.isNull()).alias("n")).first()["n"]
    return df.withColumn(col, number.cast("string")) if total == 0 else df.withColumn(col, F.col(col).cast("string"))
