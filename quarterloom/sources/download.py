"""The source panel from a database that allows one login.

All queries of a pull go through one connection, opened once by the driver and never
retried: a source behind a second factor locks accounts that keep trying. Windows of
years are written as they arrive and reused by signature, so a broken pull resumes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Task, raw_columns, year_chunks
from ..operators import joins, panel
from . import files, readers


class LoginFailed(RuntimeError):
    """The one attempt to connect failed."""


@dataclass(frozen=True)
class Source:
    """Where the panel comes from: tables, and the names of what links them."""

    fundamentals: str = "fundq"
    industry: str | None = "co_industry"
    links: str | None = "link_table"
    key: str = "gvkey"
    date: str = "datadate"
    industry_codes: tuple[str, ...] = ("sich", "naicsh")
    impose_link_dates: bool = True


class OneLogin:
    """One database connection of the driver; ``query`` gives a table that is held in memory.

    Rows come as typed by the database's own column types.
    """

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> None:
        self.spark, self.url = spark, url
        jvm = spark._jvm
        given = jvm.java.util.Properties()
        for k, v in (properties or {}).items():
            if k != "driver":
                given.setProperty(k, v)
        if (properties or {}).get("driver"):
            jvm.org.apache.spark.util.Utils.classForName(properties["driver"], True, False)
        try:
            self.connection = jvm.java.sql.DriverManager.getConnection(url, given)
        except Exception as e:  # noqa: BLE001
            raise LoginFailed(f"could not connect to {url}; this is not tried again. Check name, password file and second factor first: {e}") from e

    def __enter__(self) -> OneLogin:
        return self

    def __exit__(self, *_: object) -> None:
        self.connection.close()

    def query(self, sql: str) -> DataFrame:
        jvm = self.spark._jvm
        statement = self.connection.createStatement()
        try:
            statement.setFetchSize(10_000)
            found = statement.executeQuery(sql)
            utils = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils
            dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url)
            schema = utils.getSchema(self.connection, found, dialect, True, False)
            rows, each = jvm.java.util.ArrayList(), utils.resultSetToRows(found, schema)
            while each.hasNext():
                rows.add(each.next())
            return DataFrame(self.spark._jsparkSession.createDataFrame(rows, schema), self.spark)
        finally:
            statement.close()


def declared_types(db: OneLogin, table: str) -> dict[str, str]:
    """{column: declared type} from the database's own catalogue; {} if it can't be read."""
    schema, _, name = table.rpartition(".")
    where = f"table_name = '{name}'" + (f" AND table_schema = '{schema}'" if schema else "")
    try:
        rows = db.query(f"SELECT column_name, data_type FROM information_schema.columns WHERE {where}").collect()
    except Exception:  # noqa: BLE001
        return {}
    return {str(r[0]).lower(): str(r[1]).lower() for r in rows}


def attach_industry(df: DataFrame, codes: DataFrame, source: Source = Source()) -> DataFrame:
    """The latest industry codes at or before each row's date; keys are compared as text."""
    left = df.withColumn(source.key, F.col(source.key).cast("string")).withColumn(source.date, F.col(source.date).cast("date"))
    right = codes.select(F.col(source.key).cast("string").alias(source.key), F.col(source.date).cast("date").alias("__seen"), *source.industry_codes)
    left = left.drop(*[c for c in source.industry_codes if c in left.columns])
    return joins.asof_backward(left, right, [source.key], source.date, "__seen", list(source.industry_codes), list(source.industry_codes))


def attach_links(df: DataFrame, links: DataFrame, source: Source = Source()) -> DataFrame:
    """``permno`` and ``permco`` of the link valid at each row's date, ``jdate`` and ``year``.

    Keys without any link stay without numbers; keys with links of which none covers the
    date lose the row, unless the dates aren't imposed.
    """
    left = df.withColumn(source.key, F.col(source.key).cast("string")).withColumn(source.date, F.col(source.date).cast("date"))
    right = links.select(F.col(source.key).cast("string").alias(source.key), F.col("linkdt").cast("date").alias("linkdt"), F.col("linkenddt").cast("date").alias("linkenddt"), F.col("lpermno").alias("permno"), F.col("lpermco").alias("permco"))
    out = joins.interval_join(left, right, source.key, source.date, "linkdt", "linkenddt", ["permno", "permco"], source.impose_link_dates)
    return joins.with_calendar(out, source.date)


def checked_windows(task: Task, first: int | None, last: int | None, years: int) -> list[tuple[int, int]]:
    """The windows of a pull, before anything touches the database; 0 years is one window."""
    lo, hi = first or task.first_year, last or task.last_year
    if lo > hi:
        raise ValueError(f"{lo} is after {hi}")
    return year_chunks(lo, hi, years) if years else [(lo, hi)]


def pull(db: OneLogin, folder: str, task: Task, source: Source = Source(), years: int = 1, first: int | None = None, last: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The assembled panel: fundamentals by windows, industry codes, sector filter, links.

    ``columns`` ``["*"]`` takes every column. A projected column that the database doesn't
    declare is an error: without it an item would silently be gone.
    """
    spark = db.spark
    wanted = list(columns or [c for c in raw_columns(task.items, keys=(source.key, source.date, "fyearq", "fqtr")) if c not in source.industry_codes])
    windows = checked_windows(task, first, last, years)
    queries = {w: readers.source_query(source.fundamentals, wanted, task.row_filters, *w, date=source.date, order=(source.key, source.date)) for w in windows}
    declared = declared_types(db, source.fundamentals)
    lost = [c for c in wanted if declared and c != "*" and c.lower() not in declared]
    if lost:
        raise KeyError(f"{source.fundamentals} has no {', '.join(lost)}")
    parts = []
    for window, sql in queries.items():
        path = f"{folder}/{readers.chunk_name(*window, wanted, task.row_filters)}"
        if not files.exists(spark, f"{path}/_SUCCESS"):
            got = db.query(sql)
            got = got.toDF(*[c.lower() for c in got.columns])
            readers.coerce_declared(got, declared)[0].write.mode("overwrite").parquet(path)
        parts.append(spark.read.parquet(path))
    df = readers.union_chunks(parts) if not declared else _union(parts)
    df = readers.nan_to_null(readers.coerce_declared(df, declared)[0])
    if source.industry:
        where = " AND ".join(f"{c} = '{v}'" for c, v in task.row_filters if c in ("consol", "popsrc"))
        codes = db.query(f"SELECT {', '.join((source.date, source.key, *source.industry_codes))} FROM {source.industry}" + (f" WHERE {where}" if where else ""))
        df = attach_industry(df, codes.toDF(*[c.lower() for c in codes.columns]), source)
        df = panel.keep_unless_in(df, source.industry_codes[0], task.excluded_sic)
    if source.links:
        for code in (*task.link_types, *task.link_primary):
            if not readers.CODE.fullmatch(code):
                raise ValueError(f"{code!r} is no link code")
        quoted = lambda vs: ", ".join(f"'{v}'" for v in vs)
        links = db.query(f"SELECT * FROM {source.links} WHERE linktype IN ({quoted(task.link_types)}) AND linkprim IN ({quoted(task.link_primary)})")
        df = attach_links(df, links.toDF(*[c.lower() for c in links.columns]), source)
    return df


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def download(spark: SparkSession, url: str, folder: str, task: Task, source: Source = Source(), properties: dict[str, str] | None = None, years: int = 1, first: int | None = None, last: int | None = None, columns: Sequence[str] | None = None, out: str | None = None) -> str:
    """Pull everything over one login and write the raw panel; returns its path."""
    checked_windows(task, first, last, years)
    path = out or f"{folder}/raw_panel"
    with OneLogin(spark, url, properties) as db:
        side = f"{path}.partial"
        pull(db, folder, task, source, years, first, last, columns).write.mode("overwrite").parquet(side)
    files.publish(spark, side, path)
    return path
