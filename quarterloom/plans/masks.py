"""Sample masks: sets of scored cells, as keys or as bits over a fixed grid."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources import files
from .scoring import KEYS, canonical_keys

#: Bytes of a mask that one row carries.
CHUNK = 65536


def cell_address(target_id: Column, horizon: Column, row: Column, horizons: int, rows: Column | int) -> Column:
    """(target, horizon, row) -> position in the grid: targets by name, then horizons, then rows."""
    return (target_id * horizons + (horizon - 1)) * rows + row


def address_parts(cell: Column, horizons: int, rows: int) -> dict[str, Column]:
    block = F.floor(cell / rows)
    return {"target_id": F.floor(block / horizons).cast("long"), "horizon": (F.pmod(block, F.lit(horizons)) + 1).cast("long"), "grid_row": F.pmod(cell, F.lit(rows)).cast("long")}


def pack_chunks(cells: DataFrame) -> DataFrame:
    """Cell positions (``cell``) to ``chunk, bits``: CHUNK bytes each, most significant bit first.

    Only chunks with a cell appear. Executors build the bytes; the driver sees none of them here.
    """
    one = F.call_function("shiftleft", F.lit(1), (7 - F.pmod("cell", F.lit(8))).cast("int"))
    per = cells.select("cell").distinct().groupBy(F.floor(F.col("cell") / 8).alias("byte")).agg(F.sum(one).cast("int").alias("v"))
    at = F.pmod("byte", F.lit(CHUNK)).cast("int")
    some = per.groupBy(F.floor(F.col("byte") / CHUNK).alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "v"))).alias("m"), F.max(at).alias("last"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bits = []
            for m in b.column(1).to_pylist():
                x = np.zeros(CHUNK, dtype=np.uint8)
                if m:
                    at, v = zip(*m, strict=True)
                    x[list(at)] = v
                bits.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], names=["chunk", "bits"])

    return some.select("chunk", "m").mapInArrow(run, "chunk long, bits binary")


def pack(cells: DataFrame, total: int) -> np.ndarray:
    """Cell positions to bits, most significant first; the driver gets whole chunks of bytes."""
    out = np.zeros((total + 7) // 8, dtype=np.uint8)
    for r in pack_chunks(cells).toLocalIterator():
        lo = r["chunk"] * CHUNK
        part = np.frombuffer(r["bits"], dtype=np.uint8)[: len(out) - lo]
        out[lo : lo + len(part)] = part
    return out


def write_bits(spark: SparkSession, path: str, bits: np.ndarray) -> None:
    """A ``.npy`` file of packed bits."""
    fs, p = files._path(spark, path)
    held = io.BytesIO()
    np.save(held, np.asarray(bits))
    out = fs.create(p, True)
    try:
        for lo in range(0, len(held.getbuffer()), 1 << 24):
            out.write(bytearray(held.getbuffer()[lo : lo + (1 << 24)]))
    finally:
        out.close()


def read_bits(spark: SparkSession, path: str) -> np.ndarray:
    """The array of a ``.npy`` file: packed bytes or booleans."""
    fs, p = files._path(spark, path)
    stream = fs.open(p)
    try:
        return np.load(io.BytesIO(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))), allow_pickle=False)
    finally:
        stream.close()


def grid_rows(truth: DataFrame) -> DataFrame:
    """``grid_row, firm, origin`` of a truth's rows in order of firm and origin.

    Counts by firm give each firm's first number; rows then count within their firm.
    """
    rows = truth.select("firm", "origin").distinct()
    per = rows.groupBy("firm").agg(F.count("*").alias("n"))
    per = per.select(F.col("firm").alias("g_firm"), (F.sum("n").over(Window.orderBy("firm").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    own = rows.withColumn("i", F.row_number().over(Window.partitionBy("firm").orderBy("origin")) - 1)
    return own.join(per, F.col("firm") == F.col("g_firm")).select((F.col("first") + F.col("i")).cast("long").alias("grid_row"), "firm", "origin")


def write_grid_rows(rows: DataFrame, path: str) -> None:
    """The row index, its origins as the ISO dates of quarters' ends."""
    origin = F.date_format(E.quarter_end(F.col("origin")), "yyyy-MM-dd")
    rows.select("grid_row", F.col("firm").cast("string").alias("firm"), origin.alias("origin")).write.mode("overwrite").parquet(path)


def resolve(spark: SparkSession, mask: str, truth: DataFrame, index: str | None = None, horizon: int = 20) -> DataFrame:
    """The keys of a mask by its kind: a ``.npy`` of bits over a grid, or a table of keys.

    Bits need their grid: that of ``index`` (a row index, from which they are realigned to the
    truth's rows), else the truth's own, whose size must then fit.
    """
    if not mask.endswith(".npy"):
        df = spark.read.parquet(mask)
        lost = [k for k in KEYS if k not in df.columns and k not in ("firm", "origin", "horizon")]
        if lost:
            raise ValueError(f"{mask} lacks {', '.join(lost)}")
        return canonical_keys(df.withColumnsRenamed({"firm_id": "firm", "quarter": "origin", "forecast_horizon": "horizon"}))
    bits = read_bits(spark, mask)
    here = canonical_keys(truth)
    names = sorted(r[0] for r in here.select("target").distinct().collect())
    if index:
        grid = spark.read.parquet(index)
        lost = [c for c in ("grid_row", "firm", "origin") if c not in grid.columns]
        if lost:
            raise ValueError(f"{index} lacks {', '.join(lost)}")
        grid = canonical_keys(grid)
    else:
        grid = grid_rows(here)
    rows = grid.count()
    total = len(names) * horizon * rows
    keys = bits_to_keys(unpack(spark, bits, total), grid, names, horizon, rows)
    return realign(keys, here)


def unpack(spark: SparkSession, bits: np.ndarray, total: int) -> DataFrame:
    """Bits to cell positions; the size is checked before anything is cut off."""
    bits = np.asarray(bits)
    if bits.dtype == bool:
        if len(bits) != total:
            raise ValueError(f"the mask has {len(bits)} cells, the grid {total}")
        bits = np.packbits(bits)
    if len(bits) != (total + 7) // 8:
        raise ValueError(f"the mask has {len(bits)} bytes, the grid needs {(total + 7) // 8}")
    parts = [(i, bytes(bits[i : i + 65536])) for i in range(0, len(bits), 65536)]
    df = spark.createDataFrame(parts, "at long, bits binary")
    byte = df.select("at", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("bits")), lambda i: F.conv(F.hex(F.substr("bits", i, F.lit(1))), 16, 10).cast("int"))).alias("i", "v"))
    bit = byte.where("v > 0").select(((F.col("at") + F.col("i")) * 8).alias("first"), "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    on = F.col("v").bitwiseAND(F.call_function("shiftleft", F.lit(1), 7 - F.col("b"))) > 0
    return bit.where(on).select((F.col("first") + F.col("b")).alias("cell")).where(F.col("cell") < total)


def bits_to_keys(cells: DataFrame, grid_rows: DataFrame, targets: Sequence[str], horizons: int, rows: int) -> DataFrame:
    """Cell positions to ``firm, target, origin, horizon`` by the grid's row index."""
    twice = grid_rows.groupBy("firm", "origin").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the row index repeats {twice[0][0]}, {twice[0][1]}")
    names = F.array(*[F.lit(t) for t in sorted(targets)])
    parts = address_parts(F.col("cell"), horizons, rows)
    at = cells.select(F.get(names, parts["target_id"].cast("int")).alias("target"), parts["horizon"].alias("horizon"), parts["grid_row"].alias("grid_row"))
    return at.join(grid_rows, "grid_row").select("firm", "target", "origin", "horizon")


def realign(keys: DataFrame, new_rows: DataFrame) -> DataFrame:
    """The mask's cells whose (firm, origin) exists in a build of other rows; none is an error."""
    kept = keys.join(new_rows.select("firm", "origin").distinct(), ["firm", "origin"], "left_semi").select(*keys.columns)
    if not kept.limit(1).count():
        raise ValueError("no row of the mask exists in this build")
    return kept


def keys_mask(table: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows of ``table`` whose key is in the mask; keys off the table are ignored."""
    return table.join(mask.select(*KEYS).distinct(), list(KEYS), "left_semi")


def build_mask(forecast: DataFrame, truth: DataFrame) -> DataFrame:
    """Cells with finite truth and, in any of their repeated rows, a finite prediction."""
    some = forecast.groupBy(*KEYS).agg(F.bool_or(F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < float("inf"))).alias("ok")).where("ok")
    return truth.where(F.col("actual").isNotNull()).select(*KEYS).join(some.select(*KEYS), list(KEYS), "left_semi")
