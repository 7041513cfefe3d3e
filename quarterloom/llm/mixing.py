"""Mixing sources to target weights by entropy balancing.

Method: among all document rates ``r`` in [0, 2] that meet a source's token target
``sum(r * size) = target``, take the one nearest to 1 in Kullback-Leibler divergence.
Its dual is convex with one multiplier a source, and its solution is exponentially
tilted: ``r = min(2, exp(lambda * size / scale))``. Newton's method finds lambda
with one distributed aggregate an iteration over the (source, size) histogram,
which stands for the documents because equal sizes get equal rates. The rates
are then rounded into whole copies: cumulatively in order of size, so that a
source's rounding error stays below its largest document, and a few single copies
are moved to close what is left.

Everything is DataFrame operations. Per-source state stays in a table. Sums run in decimals,
whose result doesn't depend on the order of rows, so reruns agree to the last copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_RATE = 2
#: Rounds end when every source's words are this close to its target; more than NEWTON_ROUNDS are an error.
TOLERANCE, NEWTON_ROUNDS = 1e-9, 200
FIX_ROUNDS = 4
#: Buckets over which the copies of one size class are dealt: the first byte of a digest of the id.
BUCKETS = 256
EXACT = "decimal(38,12)"


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = MAX_RATE) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order, null last, weigh ``weights``, repeating. The budget
    ``share * all sizes`` is split by weight; no source gets more than ``cap`` times
    its size and the excess is shared again by weight. That is a water level
    c with ``target = min(cap * size, c * weight)``: in order of ``cap * size /
    weight``, the first sources are full, and the level is that of the first that is not.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("full", F.col("source_size") * float(cap))
    by_ratio = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "budget": F.sum("source_size").over(everything) * float(share),
        "full_before": F.coalesce(F.sum("full").over(before), F.lit(0.0)),
        "w_from": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("budget") - F.col("full_before")) / F.col("w_from")
    s = s.withColumn("level", level).withColumn("short", F.col("level") * F.col("w") <= F.col("full"))
    water = F.coalesce(F.max(F.when(F.col("short"), F.col("level"))).over(everything), F.lit(float("inf")))
    return s.withColumn("target", F.least(F.col("full"), water * F.col("w"))).select("source", "source_size", "target")


def balance_rates(histogram: DataFrame, rounds: int = NEWTON_ROUNDS, cap: float = MAX_RATE) -> DataFrame:
    """Add ``rate`` to a (source, size, n, source_size, target) histogram.

    Safeguarded Newton on the dual: each iteration is one aggregate by source, and
    the multiplier stays inside a bracket that shrinks by the sign of the gradient.
    Rounds go on until every source is within TOLERANCE of its target.
    A source whose target is its cap has rate ``cap`` throughout.
    """
    h = histogram.where("size > 0")
    scale = h.groupBy("source").agg(
        F.first("target").alias("target"),
        F.first("source_size").alias("source_size"),
        (F.sum((F.col("n") * F.col("size")).cast("decimal(24,0)") * F.col("size").cast("decimal(14,0)")).cast("double") / F.sum(F.col("n") * F.col("size"))).alias("scale"),
    )
    # at lo every rate is next to 0; at hi even a one-word document is at the cap
    state = scale.withColumns({"lam": F.log(F.col("target") / F.col("source_size")), "lo": -F.col("scale") * 60.0, "hi": F.col("scale") * 2.0, "done": F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)})
    state = materialize(state, "mix-state")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    for _ in range(rounds):
        x = F.col("size") / F.col("scale")
        r = F.least(F.exp(F.col("lam") * x), F.lit(float(cap)))
        words = F.col("n") * F.col("size") * r
        b = state.alias("s")
        grad = h.select("source", "size", "n").alias("h").join(b, F.col("h.source").eqNullSafe(F.col("s.source"))).groupBy("h.source").agg(F.sum(words.cast(EXACT)).cast("double").alias("got"), F.sum(F.when(r < cap, words * x).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"))
        s = state.drop("gap").join(grad.withColumnRenamed("source", "g_source"), state["source"].eqNullSafe(F.col("g_source")))
        below = F.col("got") < F.col("target")
        lo, hi = F.when(below, F.col("lam")).otherwise(F.col("lo")), F.when(below, F.col("hi")).otherwise(F.col("lam"))
        # Newton on log(got) = log(target): the curve is close to straight there
        step = F.col("lam") + F.when((F.col("slope") > 0) & (F.col("got") > 0), F.col("got") / F.col("slope") * F.log(F.col("target") / F.col("got")))
        s = s.withColumns({"new_lo": lo, "new_hi": hi}).withColumn("new", F.when((step >= F.col("new_lo")) & (step <= F.col("new_hi")), step).otherwise(F.sinh((F.asinh("new_lo") + F.asinh("new_hi")) / 2)))
        s = s.withColumn("gap", F.when(F.col("done"), 0.0).otherwise(F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1))))
        state = materialize(s.select("source", "target", "source_size", "scale", F.when(F.col("gap") <= TOLERANCE, F.col("lam")).otherwise(F.col("new")).alias("lam"), F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), "done", "gap"), "mix-state")
        tidy(histogram.sparkSession)
        if not (state.agg(F.max("gap")).first()[0] or 0.0) > TOLERANCE:
            break
    else:
        raise RuntimeError(f"mixing rates did not converge in {rounds} rounds")
    t = state.select(F.col("source").alias("t_source"), "scale", "lam", "done")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("done"), float(cap)).otherwise(F.least(F.exp(F.col("lam") * F.col("size") / F.col("scale")), F.lit(float(cap))))
    return histogram.join(t, histogram["source"].eqNullSafe(F.col("t_source")), "left").withColumn("rate", F.coalesce(rate, F.lit(1.0))).drop("t_source", "scale", "lam", "done")


def round_classes(rated: DataFrame, cap: int = MAX_RATE, fixes: int = FIX_ROUNDS) -> DataFrame:
    """``source, size, n, copies``: whole copies for each (source, size) class.

    Running sums of ``n * rate`` in order of size, rounded, give each class its share;
    partial sums are off by half a copy at most, so a source's words are off by
    less than its largest size. Then, ``fixes`` times, the class whose single copy
    best closes a source's gap takes or gives one.
    """
    w = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    c = rated.withColumn("cum", F.round(F.sum((F.col("n") * F.col("rate")).cast(EXACT)).over(w)).cast("long"))
    c = c.withColumn("copies", F.col("cum") - F.coalesce(F.lag("cum").over(Window.partitionBy("source").orderBy("size")), F.lit(0)))
    c = c.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), F.col("n") * cap))).select("source", "size", "n", "target", "copies")
    whole = Window.partitionBy("source")
    for _ in range(fixes):
        gap = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)
        can = (F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("copies") < F.col("n") * cap).otherwise(F.col("copies") > 0)
        left = F.abs(F.abs(F.col("gap")) - F.col("size"))
        c = c.withColumn("gap", gap).withColumn("left", F.when(can & (left < F.abs(F.col("gap"))), left))
        best = F.min(F.when(F.col("left").isNotNull(), F.struct("left", "size"))).over(whole)
        c = c.withColumn("pick", F.coalesce(best["size"] == F.col("size"), F.lit(False)))
        c = c.withColumn("copies", F.col("copies") + F.when(F.col("pick"), F.signum("gap")).otherwise(0).cast("long")).select("source", "size", "n", "target", "copies")
    return c.select("source", "size", "n", "copies")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``doc_id, key, source, size, source_size, target, copies``, one row a document.

    ``copies`` is 0, 1 or 2. ``key`` hashes id and text, for joining back. A class of
    equal (source, size) deals its copies evenly, in order of the ids' MD5 digests, through
    BUCKETS buckets, so that a class with a third of all rows is no single task.

    Defined cases: a null text is empty (size 0, one copy); a null source is a
    source of its own, last in order; repeated rows are separate documents; a source of
    only empty texts takes nothing; extra columns are ignored; an empty table gives none.
    """
    size = F.size(words_of(F.col(text_col))).cast("long")
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(source_col).alias("source"), size.alias("size"))
    d = materialize(d, "mix-sizes")
    histogram = d.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = source_targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)
    targets = targets.withColumnRenamed("source", "t_source")
    histogram = materialize(histogram.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source"), "mix-histogram")
    classes = materialize(round_classes(balance_rates(histogram)), "mix-classes")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = d.withColumn("bucket", F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"))
    first = d.groupBy("source", "size", "bucket").agg(F.count("*").alias("m"))
    first = first.withColumn("before", F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("m"))
    one = _keyed(classes, "c").select("c_source", F.col("size").alias("c_size"), "n", "copies")
    first = first.join(one, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))).select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), F.col("bucket").alias("f_bucket"), "before", "n", "copies")
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(digest, "doc_id", "key"))
    d = d.withColumn("place", place).join(first, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("size") == F.col("f_size")) & (F.col("bucket") == F.col("f_bucket")))
    base, extra = F.floor(F.col("copies") / F.col("n")), F.pmod(F.col("copies"), F.col("n"))
    d = d.withColumn("each", (base + F.when(F.col("before") + F.col("place") <= extra, 1).otherwise(0)).cast("long"))
    per_source = histogram.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target")).withColumnRenamed("source", "p_source")
    d = d.join(per_source, F.col("source").eqNullSafe(F.col("p_source")))
    return d.select("doc_id", "key", "source", "size", "source_size", "target", F.col("each").alias("copies"))


def _keyed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnRenamed("source", f"{prefix}_source")


def op9_sql(fixes: int = FIX_ROUNDS) -> str:
    """The same mixture in DuckDB SQL: multipliers by bisection, then the same rounding and dealing."""
    weights = ", ".join(f"{float(w)}" for w in WEIGHTS)
    moved = "c0"
    steps = []
    for k in range(fixes):
        steps.append(f"""
g{k} AS (SELECT *, target - sum(copies * size) OVER (PARTITION BY source) AS gap FROM {moved}),
l{k} AS (SELECT *, CASE WHEN size > 0 AND CASE WHEN gap > 0 THEN copies < n * {MAX_RATE} ELSE copies > 0 END AND abs(abs(gap) - size) < abs(gap) THEN abs(abs(gap) - size) END AS off FROM g{k}),
m{k} AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off NULLS LAST, size) AS place FROM l{k}),
c{k + 1} AS (SELECT source, size, n, target, copies + CASE WHEN place = 1 AND off IS NOT NULL THEN CAST(sign(gap) AS BIGINT) ELSE 0 END AS copies FROM m{k})""")
        moved = f"c{k + 1}"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size FROM documents
), sz AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([{weights}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w, source_size * {float(MAX_RATE)} AS f FROM sz),
o AS (SELECT *, sum(source_size) OVER () * {SHARE} AS budget, coalesce(sum(f) OVER (ORDER BY f / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
  sum(w) OVER (ORDER BY f / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM w),
lv AS (SELECT *, (budget - before) / w_from AS level FROM o),
tg AS (SELECT source, source_size, least(f, coalesce((SELECT max(level) FROM lv WHERE level * w <= f), CAST('inf' AS DOUBLE)) * w) AS target FROM lv),
h AS (SELECT d.source, d.size, count(*) AS n, any_value(source_size) AS source_size, any_value(target) AS target FROM d JOIN tg ON tg.source IS NOT DISTINCT FROM d.source GROUP BY 1, 2),
sc AS (SELECT source, any_value(target) AS target, any_value(source_size) AS source_size, sum(n * size * size) / sum(n * size) AS scale FROM h WHERE size > 0 GROUP BY 1),
b AS (SELECT 0 AS k, source, -60.0 * scale AS lo, 2.0 * scale AS hi, scale, target FROM sc
  UNION ALL SELECT k + 1, source, CASE WHEN got < target THEN mid ELSE lo END, CASE WHEN got < target THEN hi ELSE mid END, scale, target
  FROM (SELECT b.k, b.source, lo, hi, scale, b.target, any_value((lo + hi) / 2) AS mid, sum(h.n * h.size * least(exp((lo + hi) / 2 * h.size / scale), {float(MAX_RATE)})) AS got
        FROM b JOIN h ON h.source IS NOT DISTINCT FROM b.source AND h.size > 0 WHERE b.k < 120 GROUP BY ALL)),
r AS (SELECT h.*, CASE WHEN h.size = 0 OR b.source IS NULL AND b.lo IS NULL THEN 1.0 WHEN h.target >= h.source_size * {float(MAX_RATE)} * (1 - 1e-12) THEN {float(MAX_RATE)} ELSE least(exp((lo + hi) / 2 * h.size / scale), {float(MAX_RATE)}) END AS rate
  FROM h LEFT JOIN b ON b.k = 120 AND b.source IS NOT DISTINCT FROM h.source),
cu AS (SELECT *, CAST(round(sum(n * rate) OVER (PARTITION BY source ORDER BY size)) AS BIGINT) AS cum FROM r),
c0 AS (SELECT source, size, n, target, greatest(0, least(cum - coalesce(lag(cum) OVER (PARTITION BY source ORDER BY size), 0), n * {MAX_RATE})) AS copies FROM cu),{",".join(steps)},
p AS (SELECT d.*, row_number() OVER (PARTITION BY source, size ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM d)
SELECT doc_id, CAST(p.size AS BIGINT) AS size, source_size, t.target, CAST((copies // n + CASE WHEN place <= copies % n THEN 1 ELSE 0 END) * p.size AS BIGINT) AS taken
FROM p JOIN {moved} c ON c.source IS NOT DISTINCT FROM p.source AND c.size = p.size JOIN tg t ON t.source IS NOT DISTINCT FROM p.source
"""


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
