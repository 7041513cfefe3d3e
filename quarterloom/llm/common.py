"""Shared helpers: the cluster's shared folder, materialised tables, keys, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_fallback_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may go without (tests, local mode): it gets a temporary
    folder. On a cluster a local folder would be another one on every machine, so a
    session there that names none is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dir:
        _fallback_dir[app] = "file://" + tempfile.mkdtemp(prefix="quarterloom-")
    return _fallback_dir[app]


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/quarterloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path nobody else uses, inside this application's folder."""
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, evaluates an expensive input once, and survives lost
    executors because the files belong to the shared folder, not to a machine.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarterloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete materialised tables from which nothing will be read any more."""
    for t in tables:
        path = getattr(t, "_quarterloom_path", None)
        if path:
            _delete(t.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Let go of finished shuffles, whose files stay until both collectors have run, and of the driver's freed memory."""
    gc.collect()
    spark._jvm.System.gc()
    _trim_driver(spark)
    release_memory()


def _trim_driver(spark: SparkSession) -> None:
    """Give the native memory that the driver's JVM has freed back; malloc keeps it in the arenas of its threads.

    A JVM without that command keeps it.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kinds = gateway.new_array(jvm.java.lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    values = gateway.new_array(jvm.java.lang.Object, 4)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # through the interface: the server's own class is not exported
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        pass


def drop_materialized(spark: SparkSession) -> None:
    """Delete every table this application left in the shared folder."""
    _delete(spark, own_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def words_of(col: Column, separators: str = ASCII_SPACE) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), separators), lambda w: w != "")


def row_key(*cols: Column | str) -> Column:
    """A 64-bit content key; rows it joins are also compared by their id."""
    return F.xxhash64(*cols)


def least_hashed(df: DataFrame, h: str, limit: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``limit`` rows with the least 64-bit hash ``h``: a fixed sample of bounded size.

    A cut at twice the expected hash keeps all but a few rows from the one task that
    orders them, whatever the number of partitions.
    """
    n = df.count()
    if n > 4 * limit:
        df = df.where(F.col(h) < F.lit(-(2**63) + int(2**64 * 2 * limit / n)))
    return df.orderBy(h, *ties).limit(limit)


def release_memory() -> None:
    """Give a worker's freed memory back at a partition's end: idle workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
