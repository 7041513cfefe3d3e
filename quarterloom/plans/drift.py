"""Per-column distribution summaries and their drift from a reference."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    rows: float = 0.01
    mean: float = 0.05
    sd: float = 0.05
    coverage: float = 0.02


QUANTILES = (0.05, 0.5, 0.95)
#: An approximate quantile's rank is off by a share of 1 / ACCURACY at most; its bracket allows for SLACK.
ACCURACY, SLACK = 10_000, 3e-4


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n_finite, coverage, mean, sd, p05, p50, p95`` of numeric columns, rounded to 6.

    Moments are of the population, percentiles interpolated; an empty column has only
    its counts. Percentiles are exact, by two passes of bounded memory: approximate ones
    bracket each, then the bracket's few values, folded by value, are ranked.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_finite long, coverage double, mean double, sd double, p05 double, p50 double, p95 double")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "x")
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    x = F.when(finite, F.col("x"))
    near = [min(max(q + d, 0.0), 1.0) for q in QUANTILES for d in (-SLACK, SLACK)]
    g = long.groupBy("column").agg(F.count(x).alias("n_finite"), F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.percentile_approx(x, near, ACCURACY).alias("near"))
    # where each quantile lies: between the values of ranks floor(at) and floor(at) + 1, from 0
    few, inf = F.col("n_finite") <= ACCURACY, float("inf")
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.when(few, -inf).otherwise(F.get("near", F.lit(2 * i))).alias("lo"), F.when(few, inf).otherwise(F.get("near", F.lit(2 * i + 1))).alias("hi"), (F.lit(q) * (F.col("n_finite") - 1)).alias("at")) for i, q in enumerate(QUANTILES)])
    brackets = g.where("n_finite > 0").select(F.col("column").alias("b_column"), F.explode(at).alias("b")).select("b_column", "b.*")
    met = long.where(finite).join(F.broadcast(brackets), F.col("column") == F.col("b_column"))
    inside = F.when(F.col("x") >= F.col("lo"), F.col("x"))
    folded = met.where("x <= hi").groupBy("column", "i", "at", inside.alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("column", "i").orderBy(F.col("v").asc_nulls_first())
    ranked = folded.withColumn("upto", F.sum("n").over(w))
    value = lambda k: F.min(F.when(F.col("v").isNotNull() & (F.col("upto") > k), F.col("v")))
    low = F.floor("at")
    ends = ranked.groupBy("column", "i", "at").agg(value(low).alias("a"), value(F.ceil("at")).alias("b"))
    exact = ends.groupBy(F.col("column").alias("e_column")).agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))))).alias("q"))
    r = lambda c: F.round(c, 6)
    j = g.join(exact, F.col("column") == F.col("e_column"), "left")
    return j.select("column", "n_finite", r(F.col("n_finite") / F.col("n")).alias("coverage"), r(F.col("mean")).alias("mean"), r(F.col("sd")).alias("sd"), *[r(F.try_element_at("q", F.lit(i))).alias(p) for i, p in enumerate(("p05", "p50", "p95"))])


def content_hash(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """An order-insensitive hash of a column: the sum of the row hashes of key and rounded value."""
    h = F.xxhash64(*keys, F.bround(F.col(column).cast("double"), 6))
    return df.agg(F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash"), F.count("*").alias("n"))


def compare_stats(built: DataFrame, reference: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """One row a column: ``side, d_mean, d_sd, d_coverage, over``.

    A column on one side only, or with values on one side only, is over.
    """
    b = built.select(F.col("column").alias("b_column"), *[F.col(c).alias(f"b_{c}") for c in ("n_finite", "mean", "sd", "coverage")])
    j = b.join(reference, F.col("b_column") == F.col("column"), "full_outer")
    side = F.when(F.col("column").isNull(), "here").when(F.col("b_column").isNull(), "reference").otherwise("both")
    live = (F.col("b_n_finite") > 0) & (F.col("n_finite") > 0)
    d = lambda c: F.when(live, F.abs(F.col(f"b_{c}") - F.col(c)))
    j = j.select(F.coalesce("column", "b_column").alias("column"), side.alias("side"), d("mean").alias("d_mean"), d("sd").alias("d_sd"), d("coverage").alias("d_coverage"), ((F.col("b_n_finite") > 0) != (F.col("n_finite") > 0)).alias("half"))
    over = (F.col("side") != "both") | F.coalesce("half", F.lit(False)) | F.coalesce((F.col("d_mean") > limits.mean) | (F.col("d_sd") > limits.sd) | (F.col("d_coverage") > limits.coverage), F.lit(False))
    return j.withColumn("over", over).drop("half")


def summarize(compared: DataFrame, rows_here: int | None = None, rows_reference: int | None = None, limits: Thresholds = Thresholds()) -> DataFrame:
    """One row: shared columns, how many are over, the worst moves, and a verdict.

    Verdicts: PASS, FAIL, or NOT VERIFIED if no column is shared. One-sided columns and
    a row count off by more than its limit never pass.
    """
    both = F.col("side") == "both"
    g = compared.agg(
        F.count_if(both).alias("n_cols"), F.count_if(~both).alias("n_one_sided"), F.count_if(F.col("over") & both).alias("n_over"),
        *[F.max(f"d_{c}").alias(f"worst_{c}") for c in ("mean", "sd", "coverage")],
        *[F.max_by("column", f"d_{c}").alias(f"worst_{c}_column") for c in ("mean", "sd", "coverage")],
        F.percentile("d_mean", F.lit(0.5)).alias("median_mean"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("over") & both, F.col("column")))), 1, 10).alias("columns_over"),
    )
    moved = bool(rows_reference) and rows_here is not None and abs(rows_here - rows_reference) / rows_reference > limits.rows
    verdict = F.when(F.col("n_cols") == 0, "NOT VERIFIED").when((F.col("n_over") > 0) | (F.col("n_one_sided") > 0) | F.lit(moved), "FAIL").otherwise("PASS")
    return g.withColumn("verdict", verdict)


def compare_ids(a: DataFrame, b: DataFrame, name: str, id_col: str, limit: int = 5) -> DataFrame:
    """The first differing entries of two id dictionaries."""
    x, y = a.select(F.col(name).alias("a_name"), F.col(id_col).alias("a_id")), b.select(F.col(name).alias("b_name"), F.col(id_col).alias("b_id"))
    j = x.join(y, F.col("a_id") == F.col("b_id"), "full_outer")
    return j.where(~F.col("a_name").eqNullSafe(F.col("b_name"))).select(F.coalesce("a_id", "b_id").alias("id"), "a_name", "b_name").orderBy("id").limit(limit)


def fingerprint(df: DataFrame, keys: list[str]) -> dict[str, str]:
    """Rows and an order-insensitive hash for every column: a table's identity."""
    cols = [c for c in df.columns if c not in keys]
    hashes = [F.sum(F.xxhash64(*keys, F.bround(F.col(c).cast("double"), 6) if t in ("float", "double") else F.col(c)).cast("decimal(38,0)")).cast("string").alias(c) for c, t in df.select(*cols).dtypes]
    r = df.agg(F.count("*").cast("string").alias("n_rows"), *hashes).first()
    return {k: v or "0" for k, v in r.asDict().items()}


def digest_of(prints: dict[str, str]) -> str:
    """One digest of a table's column digests."""
    return hashlib.md5(json.dumps(sorted(prints.items())).encode()).hexdigest()


def to_json(doc: dict) -> str:
    return json.dumps(doc, indent=1, sort_keys=True, default=str)


def verify(built: dict[str, dict[str, str]], reference: dict[str, dict[str, str]]) -> tuple[dict[str, str], bool]:
    """(status of each artifact: ok, mismatch, missing or extra; whether all match)."""
    status = {n: "missing" if n not in built else "extra" if n not in reference else "ok" if built[n] == reference[n] else "mismatch" for n in {*built, *reference}}
    return status, bool(status) and all(s == "ok" for s in status.values())


def check_firm_ids(ids: DataFrame, expected: int, tolerance: float = 0.01, name: str = "firm", id_col: str = "firm_id") -> list[str]:
    """Problems of a firm dictionary: ids that aren't 0.. in order of the names, or a count too far off."""
    w = Window.orderBy(name)
    wrong = ids.withColumn("want", F.row_number().over(w) - 1).where(F.col(id_col) != F.col("want")).count()
    n = ids.count()
    out = [f"{wrong} ids out of order"] if wrong else []
    if expected and abs(n - expected) / expected > tolerance:
        out.append(f"{n} names where {expected} are expected")
    return out
