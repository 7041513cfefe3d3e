"""Readers: projected, typed, with NaN turned into NULL."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Task, raw_columns

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?")
CODE = re.compile(r"[A-Za-z0-9]{1,8}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """All floating columns with NaN replaced by NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, aliases: dict[str, str] | None = None, order: bool = False) -> DataFrame:
    """A Parquet table, projected by canonical names; a missing one is an error.

    With ``order``, ``file_path`` and ``row_index`` say where each row stood.
    """
    df = spark.read.parquet(path)
    if order:
        df = df.withColumns({"file_path": F.col("_metadata.file_path"), "row_index": F.col("_metadata.row_index")})
    for a, b in (aliases or {}).items():
        if a in df.columns and b not in df.columns:
            df = df.withColumnRenamed(a, b)
    if columns is not None:
        lost = [c for c in columns if c not in df.columns]
        if lost:
            raise ValueError(f"{path} lacks {', '.join(lost)}")
        df = df.select(*columns, *(["file_path", "row_index"] if order else []))
    return nan_to_null(df)


def read_raw_panel(spark: SparkSession, path: str, task: Task) -> DataFrame:
    """The columns a build needs, of those that the table has."""
    have = spark.read.parquet(path).columns
    want = [c for c in [*raw_columns(task.items), *raw_columns(task.items, ytd=False), "firm_id", "date", "sic", "naics"] if c in have]
    return read_table(spark, path, list(dict.fromkeys(want)))


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """A forecast table with canonical names; row order columns for first-wins.

    Missing columns are an error here; what a table's values break, ``plans.validate`` finds.
    """
    df = read_table(spark, path, aliases={"firm_id": "firm", "quarter": "origin", "forecast_horizon": "horizon"}, order=True)
    lost = [c for c in ("firm", "target", "origin", "horizon", "prediction") if c not in df.columns]
    if lost:
        raise ValueError(f"{path} lacks {', '.join(lost)}")
    return df


def read_ids(spark: SparkSession, path: str, name: str, id_col: str) -> DataFrame:
    """An id dictionary in CSV, typed: names stay text with their leading zeros."""
    return spark.read.schema(f"`{name}` string, `{id_col}` long").csv(path, header=True)


def read_sidecar(text: str | None) -> tuple[str, float | None]:
    """(family, df) from a forecast's JSON sidecar; absent or unreadable means gaussian."""
    try:
        d = json.loads(text or "")
        return str(d["family"]).lower(), None if d.get("df") is None else float(d["df"])
    except (ValueError, KeyError, TypeError, AttributeError):
        return "gaussian", None


def coerce_declared(df: DataFrame, declared: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(columns cast to declared types, one row of values lost per column).

    ``declared`` maps columns to database type names.
    """
    kinds = {"character varying": "string", "text": "string", "character": "string", "date": "date", "double precision": "double", "real": "double", "numeric": "double", "integer": "bigint", "smallint": "bigint", "bigint": "bigint"}
    cast, lost = {}, []
    for c, kind in declared.items():
        if c in df.columns and kind in kinds:
            new = F.expr(f"try_cast(`{c}` as {kinds[kind]})")
            cast[c] = new
            lost.append(F.count_if(F.col(c).isNotNull() & new.isNull()).alias(c))
    return df.withColumns(cast), df.agg(*lost) if lost else df.limit(0)


def union_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """Chunks by column name; a column that is numeric in any is numeric in all."""
    numeric = {f.name for c in chunks for f in c.schema.fields if isinstance(f.dataType, T.NumericType)}
    out = None
    for c in chunks:
        c = c.withColumns({n: F.expr(f"try_cast(`{n}` as double)") for n in numeric if n in c.columns})
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    return out


def source_query(table: str, columns: Sequence[str], filters: Sequence[tuple[str, str]], first: int, last: int, date: str = "datadate", order: Sequence[str] = ()) -> str:
    """The projected, filtered query for one window of years; every name is checked.

    ``order`` fixes the order of rows, and with it which of two rows of a key comes last.
    """
    for n in (table, date, *order, *(c for c in columns if c != "*"), *(f for f, _ in filters)):
        if not NAME.fullmatch(n):
            raise ValueError(f"{n!r} is no column or table name")
    for _, v in filters:
        if not CODE.fullmatch(v):
            raise ValueError(f"{v!r} is no filter code")
    where = " AND ".join([*(f"{c} = '{v}'" for c, v in filters), f"{date} BETWEEN '{first}-01-01' AND '{last}-12-31'"])
    return f"SELECT {', '.join(columns)} FROM {table} WHERE {where}" + (f" ORDER BY {', '.join(order)}" if order else "")


def filter_source(df: DataFrame, filters: Sequence[tuple[str, str]], first: int, last: int, date: str = "datadate") -> DataFrame:
    """The same filters on a table: equal codes and whole years, as predicates a scan can use."""
    out = df.where(F.col(date).between(F.lit(f"{first}-01-01").cast("date"), F.lit(f"{last}-12-31").cast("date")))
    for c, v in filters:
        out = out.where(F.col(c) == v)
    return out


def chunk_name(first: int, last: int, columns: Sequence[str], filters: Sequence[tuple[str, str]]) -> str:
    """A cache name that only an identical request has."""
    sig = hashlib.md5(json.dumps([sorted(columns), sorted(map(list, filters))]).encode()).hexdigest()[:12]
    return f"chunk_{first}_{last}_{sig}"
