"""Least squares and elastic nets for many targets at once, from shared moment matrices.

Every fit of a (target, horizon) needs only sums over its rows: of the products of its
features, of those with the label, and of the label's square. Tasks fold blocks of rows
into such sums for a group of labels at a time; labels known on the same rows share their
matrix in a block. Partial sums meet by label, a row a feature, and are solved where they
meet. The plan is the same for one label and for thousands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of moment matrices that a task may hold, and rows folded by one task and group.
GROUP_BYTES, TASK_ROWS = 256 << 20, 100_000
#: Rows predicted at once.
PREDICTED = 256


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


class Sums:
    """Sums of products of (1, features, label) over the rows that know the label."""

    def __init__(self, width: int) -> None:
        self.m = np.zeros((width + 2, width + 2))

    @property
    def n(self) -> float:
        return self.m[0, 0]

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(feature products, products with the label, feature means, label mean), centred."""
        mean = self.m[0] / self.n
        c = self.m - self.n * np.outer(mean, mean)
        return c[1:-1, 1:-1], c[1:-1, -1], mean[1:-1], mean[-1]

    def squared_error(self, bias: float, w: np.ndarray) -> float:
        """The mean squared error of a linear prediction on these rows."""
        v = np.concatenate([[-bias], -w, [1.0]])
        return float(v @ self.m @ v) / self.n


def least_squares(s: Sums) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of least norm among the least squares solutions."""
    g, c, mx, my = s.centred()
    values, vectors = np.linalg.eigh(g)
    keep = values > max(values.max(initial=0.0), 0.0) * 1e-11 if len(values) else np.zeros(0, bool)
    w = vectors[:, keep] @ ((vectors[:, keep].T @ c) / values[keep])
    return float(my - w @ mx), w


def elastic_net(s: Sums, alpha: float, l1_ratio: float, max_iter: int = 10_000, tol: float = 1e-10, start: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Least squares / 2 n + alpha (l1 |w| + (1 - l1) w^2 / 2), by coordinate descent on the sums."""
    g, c, mx, my = s.centred()
    g, c = g / s.n, c / s.n
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w = np.zeros(len(c)) if start is None else start.copy()
    left = c - g @ w  # what the label still has in common with each feature
    size = np.diag(g) + l2
    for _ in range(max_iter):
        most = 0.0
        for j in np.flatnonzero(size > 0):
            old = w[j]
            z = left[j] + g[j, j] * old
            new = math.copysign(max(abs(z) - l1, 0.0), z) / size[j]
            if new != old:
                left -= g[:, j] * (new - old)
                w[j] = new
                most = max(most, abs(new - old) * math.sqrt(size[j]))
        if most <= tol:
            break
    return float(my - w @ mx), w


def label_sums(rows: DataFrame, width: int, labels: int) -> DataFrame:
    """``label, i, v``: row i of the partial moment matrices of each label.

    ``rows`` has ``x`` (array of ``width`` known features) and ``y`` (array of ``labels``,
    null where unknown).
    """
    held = max(1, min(labels, GROUP_BYTES // (8 * (width + 2) ** 2)))
    groups = math.ceil(labels / held)
    d = rows.select("x", "y")
    if groups > 1:
        blocks = max(1, math.ceil(d.count() / TASK_ROWS))
        d = d.select("x", "y", F.pmod(F.xxhash64("x"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
        d = d.select("g", "block", "x", F.slice("y", F.col("g") * held + 1, held).alias("y")).repartition("g", "block").sortWithinPartitions("g").select("g", "x", "y")
    else:
        d = d.select(F.lit(0).alias("g"), "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            for p, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([at * held + p] * (width + 2), pa.int32()), pa.array(range(width + 2), pa.int32()), pa.array(list(s.m), pa.list_(pa.float64()))], names=["label", "i", "v"])

        for b in batches:
            g, x = b.column(0).to_numpy(), _matrix(b.column(1))
            y = _matrix(b.column(2))
            for k in np.unique(g).tolist():
                if k != at:
                    yield from out()
                    at, sums = k, {}
                own = np.flatnonzero(g == k)
                xs, ys = np.concatenate([np.ones((len(own), 1)), x[own]], axis=1), y[own]
                known = ~np.isnan(ys)
                shared: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
                for p in range(ys.shape[1]):
                    mask = known[:, p]
                    if not mask.any():
                        continue
                    sign = mask.tobytes()
                    if sign not in shared:
                        z = xs[mask]
                        shared[sign] = (z, z.T @ z)
                    z, zz = shared[sign]
                    label = ys[mask, p]
                    s = sums.setdefault(p, Sums(width))
                    s.m[:-1, :-1] += zz
                    cross = z.T @ label
                    s.m[:-1, -1] += cross
                    s.m[-1, :-1] += cross
                    s.m[-1, -1] += label @ label
        yield from out()

    return d.mapInArrow(run, "label int, i int, v array<double>")


def _whole(batches: Iterator[pa.RecordBatch], keys: int, width: int) -> Iterator[tuple[tuple, Sums]]:
    """(key, sums) of rows that arrive sorted by their first ``keys`` columns."""
    key, s = None, None
    for b in batches:
        ks = np.column_stack([b.column(j).to_numpy() for j in range(keys)])
        at, v = b.column(keys).to_numpy(), _matrix(b.column(keys + 1))
        edges = np.flatnonzero(np.concatenate([[True], (ks[1:] != ks[:-1]).any(axis=1)])) if len(ks) else []
        for lo, hi in zip(edges, [*edges[1:], len(ks)], strict=True):
            k = tuple(ks[lo].tolist())
            if k != key:
                if s is not None:
                    yield key, s
                key, s = k, Sums(width)
            np.add.at(s.m, at[lo:hi], v[lo:hi])
    if s is not None:
        yield key, s


def search(train: DataFrame, val: DataFrame, width: int, labels: int, alphas: Sequence[float], l1_ratios: Sequence[float]) -> dict[int, tuple[float, float]]:
    """{label: (alpha, l1 ratio)} of least validation error, fitted on train; the first on ties.

    Labels without rows on either side are left out. A row a label reaches the driver.
    """
    sums = label_sums(train, width, labels).withColumn("part", F.lit(0)).unionByName(label_sums(val, width, labels).withColumn("part", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit: dict[int, Sums] = {}
        for (label, part), s in _whole(batches, 2, width):
            if part == 0:
                fit = {label: s}
            elif label in fit:
                best = (math.inf, 1.0, 0.5)
                for a in alphas:
                    w = None
                    for r in l1_ratios:
                        bias, w = elastic_net(fit[label], a, r, start=w)
                        err = s.squared_error(bias, w)
                        if err < best[0] * (1 - 1e-12):
                            best = (err, a, r)
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([best[1]]), pa.array([best[2]])], names=["label", "alpha", "ratio"])

    found = sums.repartition("label").sortWithinPartitions("label", "part").select("label", "part", "i", "v").mapInArrow(run, "label int, alpha double, ratio double")
    return {r["label"]: (r["alpha"], r["ratio"]) for r in found.collect()}


def coefficients(rows: DataFrame, width: int, labels: int, params: Sequence[tuple[float, float]] | None = None) -> np.ndarray:
    """(labels x (1 + width)) intercepts and coefficients; NaN where a label has no row.

    ``params`` has (alpha, l1 ratio) for each label; without, fits are least squares. What
    reaches the driver is as many numbers as the models have, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (label,), s in _whole(batches, 1, width):
            bias, w = least_squares(s) if params is None else elastic_net(s, *params[label])
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([[bias, *w.tolist()]], pa.list_(pa.float64()))], names=["label", "w"])

    out = np.full((labels, 1 + width), np.nan)
    fitted = label_sums(rows, width, labels).repartition("label").sortWithinPartitions("label").mapInArrow(run, "label int, w array<double>")
    for r in fitted.toLocalIterator():
        out[r["label"]] = r["w"]
    return out


def predict(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``rows`` without ``x`` but with ``label, prediction``: a row for each label, null without a fit."""
    keep = [c for c in rows.columns if c not in ("x", "y")]
    shipped = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        label = np.arange(len(w), dtype=np.int32)
        for b in batches:
            for lo in range(0, b.num_rows, PREDICTED):
                part = b.slice(lo, PREDICTED)
                p = (w[:, 0] + _matrix(part.column(len(keep))) @ w[:, 1:].T).ravel()
                at = pa.array(np.repeat(np.arange(part.num_rows), len(w)))
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(len(keep))], pa.array(np.tile(label, part.num_rows)), pa.array(p, mask=np.isnan(p))], names=[*keep, "label", "prediction"])

    schema = rows.select(*keep, F.lit(0).cast("int").alias("label"), F.lit(None).cast("double").alias("prediction")).schema
    return rows.select(*keep, "x").mapInArrow(run, schema)
