"""Cross-sectional factor imputation within quarters, in two distributed passes.

Pass 1 sums, for each quarter, what its factors follow from: how often two features are
known together, and their first and second moments over those rows. Tasks take blocks of
rows, so a quarter of any number of firms is spread; what meets again is a row a feature.
Pass 2 fills each row by itself with its quarter's loadings, whose number is that of the
quarters and doesn't grow with the firms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hold import hold

#: Rows of a quarter that one task folds in the first pass.
BLOCK_ROWS = 8192


class Moments:
    """Sums over rows: both known, products, and first moments where the other is known."""

    def __init__(self, width: int) -> None:
        self.sums = np.zeros((width, 3 * width))

    def add(self, data: np.ndarray) -> None:
        known = ~np.isnan(data)
        w, x = known.astype(float), np.where(known, data, 0.0)
        self.sums += np.concatenate([w.T @ w, x.T @ x, x.T @ w], axis=1)

    def loadings(self, n_factors: int) -> tuple[np.ndarray, np.ndarray]:
        """(column means, loadings): centred on the known mean, over pairs that are both known.

        The loadings are the leading eigenvectors, scaled. A column of which nothing is
        known has mean 0.
        """
        both, products, firsts = np.split(self.sums, 3, axis=1)
        count = np.diag(both)
        means = np.where(count > 0, np.diag(firsts) / np.maximum(count, 1), 0.0)
        cov = products - firsts * means[None, :] - firsts.T * means[:, None] + both * np.outer(means, means)
        values, vectors = np.linalg.eigh(cov / np.where(both == 0, 1.0, both))
        top = np.argsort(values)[::-1][:n_factors]
        return means, vectors[:, top] * np.sqrt(np.maximum(values[top], 1e-8))


def fill_rows(data: np.ndarray, means: np.ndarray, loadings: np.ndarray, gamma: float | None = None) -> np.ndarray:
    """Fill the NaN cells of rows; known cells stay.

    A row's factors are ridge-regressed on its known cells. A row of which nothing is
    known gets the column means.
    """
    width, k = loadings.shape
    gamma = 0.01 / width if gamma is None else gamma
    known = ~np.isnan(data)
    x, w = np.where(known, data - means, 0.0), known.astype(float)
    outer = (loadings[:, :, None] * loadings[:, None, :]).reshape(width, -1)
    left = (w @ outer).reshape(len(data), k, k) / width + gamma * np.eye(k)
    factors = np.linalg.solve(left, (x @ loadings / width)[:, :, None])[:, :, 0]
    return np.where(known, data, factors @ loadings.T + means)


def fill_by_factors(data: np.ndarray, n_factors: int = 10, gamma: float | None = None) -> np.ndarray:
    """Fill the NaN cells of one (rows x features) cross-section."""
    m = Moments(data.shape[1])
    m.add(data)
    return fill_rows(data, *m.loadings(n_factors), gamma)


def _matrix(col: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix, nulls as NaN."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def _runs(keys: Sequence[tuple]) -> Iterator[tuple[int, int]]:
    """(start, end) of equal neighbours."""
    lo = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[lo]:
            yield lo, i
            lo = i


def quarter_loadings(rows: DataFrame, n_factors: int, by: Sequence[str]) -> DataFrame:
    """``by, means, loadings`` (row by row) of the quarters that have something to fill.

    Quarters with fewer than n_factors + 1 rows, or with nothing missing, have none.
    """
    names = [*by, "i", "v"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    quarters = rows.groupBy(*by).agg(F.count("*").alias("n"), F.bool_or(F.exists("features", lambda x: x.isNull() | F.isnan(x))).alias("missing"))
    quarters = quarters.where((F.col("n") > n_factors) & F.col("missing"))
    most = quarters.agg(F.max("n")).first()[0] or 0
    blocks = max(1, math.ceil(most / BLOCK_ROWS))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m = None, None

        def out() -> pa.RecordBatch:
            w = m.sums.shape[0]
            return pa.RecordBatch.from_arrays([*[pa.array([k] * w, rows_type[j]) for j, k in enumerate(key)], pa.array(range(w), pa.int32()), pa.array(list(m.sums), pa.list_(pa.float64()))], names=names)

        rows_type: list[pa.DataType] = []
        for b in batches:
            rows_type = [b.column(j).type for j in range(len(by))]
            keys = list(zip(*(b.column(j).to_pylist() for j in range(len(by))), strict=True))
            data = _matrix(b.column(len(by)))
            for lo, hi in _runs(keys):
                if keys[lo] != key:
                    if m is not None:
                        yield out()
                    key, m = keys[lo], Moments(data.shape[1])
                m.add(data[lo:hi])
        if m is not None:
            yield out()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m, kinds_ = None, None, None

        def out() -> pa.RecordBatch:
            means, lam = m.loadings(n_factors)
            return pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(key, kinds_, strict=True)], pa.array([means.tolist()], pa.list_(pa.float64())), pa.array([lam.ravel().tolist()], pa.list_(pa.float64()))], names=[*by, "means", "loadings"])

        for b in batches:
            kinds_ = [b.column(j).type for j in range(len(by))]
            keys = list(zip(*(b.column(j).to_pylist() for j in range(len(by))), strict=True))
            at, v = b.column(len(by)).to_numpy(), _matrix(b.column(len(by) + 1))
            for lo, hi in _runs(keys):
                if keys[lo] != key:
                    if m is not None:
                        yield out()
                    key, m = keys[lo], Moments(v.shape[1] // 3)
                np.add.at(m.sums, at[lo:hi], v[lo:hi])
        if m is not None:
            yield out()

    wanted = rows.select(*by, "features", F.pmod(F.xxhash64("features"), F.lit(blocks)).alias("block")).join(quarters.select(*[F.col(c).alias(f"q_{c}") for c in by]), [F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in by], "left_semi")
    dealt = wanted.repartition(*by, "block").sortWithinPartitions(*by).select(*by, "features")
    sums = dealt.mapInArrow(partial, f"{kinds}, i int, v array<double>")
    return sums.repartition(*by).sortWithinPartitions(*by).mapInArrow(solve, f"{kinds}, means array<double>, loadings array<double>")


def impute_features(rows: DataFrame, n_factors: int = 10, by: tuple[str, ...] = ("split", "qord")) -> DataFrame:
    """Fill ``features`` (array<float>, one layout for all rows) within each quarter of a split.

    A quarter with fewer than n_factors + 1 rows, or with nothing missing, stays as it is.
    The loadings that executors get are (quarters x features x factors) numbers.
    """
    found = quarter_loadings(rows, n_factors, by)
    models = {tuple(r[c] for c in by): (np.array(r["means"]), np.array(r["loadings"]).reshape(len(r["means"]), -1)) for r in found.toLocalIterator()}
    shipped = rows.sparkSession.sparkContext.broadcast(models)
    others = [c for c in rows.columns if c not in (*by, "features")]
    order = [*by, "features", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for b in batches:
            keys = list(zip(*(b.column(j).to_pylist() for j in range(len(by))), strict=True))
            data = _matrix(b.column(len(by)))
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                places.setdefault(k, []).append(i)
            for k, at in places.items():
                if k in held:
                    for lo in range(0, len(at), 4096):
                        own = at[lo : lo + 4096]
                        data[own] = fill_rows(data[own], *held[k])
            flat = data.astype(np.float32).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], lists, *b.columns[len(by) + 1 :]], names=order)

    typed = rows.select(*by, F.col("features").cast("array<float>").alias("features"), *others)
    return typed.mapInArrow(run, typed.schema).select(*rows.columns)


def impute_cells(cells: DataFrame, items: list[str], levels: int, yoy: int, n_factors: int = 10) -> DataFrame:
    """Fill ``level`` and ``yoy`` of a cell table with ``firm, qord, split, item``.

    The cells of a firm-quarter become one feature array in item order, with the row's
    ``size`` (if the table has it) as the last feature: it is known wherever a row is kept,
    but it shapes the factors. An item that a firm-quarter lacks altogether counts as missing.
    """
    sized = "size" in cells.columns
    keys = ["firm", "qord", "split", *(["size"] if sized else [])]
    one = F.struct(F.col("level"), F.col("yoy"), F.col("target"))
    g = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("item", one))).alias("m"))
    nothing = lambda n: F.array_repeat(F.lit(None).cast("float"), n)
    parts = []
    for i in items:
        got = F.try_element_at("m", F.lit(i))
        parts += [F.coalesce(got["level"], nothing(levels)), F.coalesce(got["yoy"], nothing(yoy))]
    if sized:
        parts.append(F.array(F.col("size").cast("float")))
    wide = g.select(*keys, F.concat(*parts).alias("features"), F.transform(F.array(*[F.lit(i) for i in items]), lambda i: F.try_element_at("m", i)["target"]).alias("targets"))
    filled = impute_features(hold(wide), n_factors)
    width = levels + yoy
    at = F.array(*[F.struct(F.lit(i).alias("item"), F.slice("features", n * width + 1, levels).alias("level"), F.slice("features", n * width + levels + 1, yoy).alias("yoy"), _null_for_nan(F.get("targets", F.lit(n))).alias("target")) for n, i in enumerate(items)])
    return filled.select(*keys, F.explode(at).alias("c")).select(*keys, "c.*")


def _null_for_nan(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.when(~F.isnan(x), x))
