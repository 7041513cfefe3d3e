"""Regularisation statistics: mu and sigma by (item, quarter), k by item."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import StatLags, Task
from ..functions import exprs as E

K_GRID = tuple(float(x) for x in np.logspace(-2, 3, 250))


def pool(cells: DataFrame, lags: StatLags) -> DataFrame:
    """``item, qord, r``: lagged value / lagged scale, stacked over the item lags.

    ``cells`` has ``firm, qord, item, value, scale``. Lags count the firm's surviving rows
    of the item (value and scale known), not quarters.
    """
    w = Window.partitionBy("firm", "item").orderBy("qord")
    lag = lambda c, n: F.lag(c, n).over(w) if n else F.col(c)
    known = cells.where("value is not null and scale is not null")
    size = F.nullif(lag("scale", lags.scale), F.lit(0.0))
    ratios = known.select("item", "qord", F.array(*[F.try_divide(lag("value", n), size) for n in lags.item]).alias("rs"))
    return ratios.select("item", "qord", F.explode("rs").alias("r")).where("r is not null")


class _Powers:
    """Per item: count, mean and central power sums of asinh(k r) for every k at once."""

    def __init__(self, grid: np.ndarray) -> None:
        self.grid, self.held = grid, {}

    def merge(self, item: str, n: int, m1: np.ndarray, m2: np.ndarray, m3: np.ndarray, m4: np.ndarray) -> None:
        """Pairwise update of central moments."""
        if item not in self.held:
            self.held[item] = (n, m1, m2, m3, m4)
            return
        a, x1, x2, x3, x4 = self.held[item]
        t, d = a + n, m1 - x1
        self.held[item] = (
            t,
            x1 + d * n / t,
            x2 + m2 + d**2 * (a * n / t),
            x3 + m3 + d**3 * (a * n * (a - n) / t**2) + 3 * d * (a * m2 - n * x2) / t,
            x4 + m4 + d**4 * (a * n * (a * a - a * n + n * n) / t**3) + 6 * d**2 * (a * a * m2 + n * n * x2) / t**2 + 4 * d * (a * m3 - n * x3) / t,
        )

    def add(self, item: str, r: np.ndarray) -> None:
        for lo in range(0, len(r), 4096):
            y = np.arcsinh(np.outer(self.grid, r[lo : lo + 4096]))
            m = y.mean(axis=1)
            y -= m[:, None]
            sq = y * y
            self.merge(item, y.shape[1], m, sq.sum(axis=1), (sq * y).sum(axis=1), (sq * sq).sum(axis=1))

    def best(self, item: str) -> float | None:
        """The k whose bias-corrected excess kurtosis is nearest 3; the least k on ties."""
        n, _, m2, _, m4 = self.held[item]
        if n < 4:
            return None
        with np.errstate(all="ignore"):
            g = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / (m2 * m2) - 3) + 6)
        far = np.round(np.abs(np.where((m2 > 0) & np.isfinite(g), g, 0.0) - 3.0), 12)
        return float(self.grid[int(np.argmin(far))])


def sweep_k(ratios: DataFrame, grid: tuple[float, ...] = K_GRID) -> DataFrame:
    """``item, k``: the k whose asinh(k r) has excess kurtosis nearest 3; the least k on ties.

    One pass: a task folds its ratios into power sums of all k at once, a row an item, and
    those few rows meet by item. Items with fewer than 4 ratios have k 1.
    """
    ks = np.sort(np.asarray(grid, dtype=float))
    names = ["item", "n", "m1", "m2", "m3", "m4"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Powers(ks)
        for b in batches:
            coded = b.column(0).dictionary_encode()
            code, r = coded.indices.to_numpy(), b.column(1).to_numpy()
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
            for i, item in enumerate(coded.dictionary.to_pylist()):
                p.add(item, r[order[edges[i] : edges[i + 1]]])
        if p.held:
            rows = [(i, *x) for i, x in p.held.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows], pa.int64()), *[pa.array([x[j].tolist() for x in rows], pa.list_(pa.float64())) for j in range(2, 6)]], names=names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Powers(ks)
        for b in batches:
            cols = [b.column(0).to_pylist(), b.column(1).to_pylist(), *(c.values.to_numpy().reshape(b.num_rows, -1) for c in b.columns[2:])]
            for i, n, *m in zip(*cols, strict=True):
                p.merge(i, n, *m)
        if p.held:
            best = [p.best(i) for i in p.held]
            yield pa.RecordBatch.from_arrays([pa.array(list(p.held)), pa.array([1.0 if k is None else k for k in best], pa.float64())], names=["item", "k"])

    known = ratios.where("r is not null").select("item", F.col("r").cast("double").alias("r"))
    sums = known.mapInArrow(fold, "item string, n long, m1 array<double>, m2 array<double>, m3 array<double>, m4 array<double>")
    return sums.repartition("item").mapInArrow(finish, "item string, k double")


def mu_sigma(ratios_mu: DataFrame, ratios_sigma: DataFrame, k: DataFrame) -> DataFrame:
    """``item, qord, mu, sigma, k`` with trailing means over 4 quarters that are present."""
    t = E.asinh(F.col("r") * F.col("k"))
    mu = ratios_mu.join(k, "item").groupBy("item", "qord").agg(F.avg(t).alias("mu_raw"))
    sigma = ratios_sigma.join(k, "item").groupBy("item", "qord").agg(F.stddev_samp(t).alias("sigma_raw"))
    raw = mu.join(sigma, ["item", "qord"]).withColumns({"mu_raw": F.coalesce("mu_raw", F.lit(0.0)), "sigma_raw": F.coalesce(F.nullif("sigma_raw", F.lit(0.0)), F.lit(1.0)) + E.EPS})
    w = Window.partitionBy("item").orderBy("qord").rowsBetween(-3, 0)
    rolled = raw.select("item", "qord", F.avg("mu_raw").over(w).alias("mu"), (F.avg("sigma_raw").over(w) + E.EPS).alias("sigma"))
    return rolled.join(k, "item")


def estimate(cells: DataFrame, task: Task, grid: tuple[float, ...] = K_GRID) -> DataFrame:
    """All statistics of a task; k from train rows only, or from all where an item has none there.

    ``scale`` is an item of its own whose ratio is its value.
    """
    items = cells.where("item <> 'scale'")
    own = cells.where("item = 'scale' and value is not null").select("item", "qord", F.col("value").alias("r"))
    cutoff = task.train_end * 4 + 3
    ratios = {n: pool(items, lags).unionByName(own) for n, lags in (("mu", task.mu), ("sigma", task.sigma), ("k", task.k))}
    train = ratios["k"].where(F.col("qord") <= cutoff)
    missing = ratios["k"].join(train.select("item").distinct(), "item", "left_anti")
    return mu_sigma(ratios["mu"], ratios["sigma"], sweep_k(train.unionByName(missing), grid))


def check_unique(stats: DataFrame) -> None:
    """Raise if an (item, quarter) has two statistics."""
    twice = stats.groupBy("item", "qord").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two statistics for {twice[0][0]} in quarter {twice[0][1]}")
