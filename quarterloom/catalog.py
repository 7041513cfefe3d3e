"""All registered queries of the engine and their DuckDB SQL.

The supplied tables stand in for a firm panel: customers' orders by quarter
(gappy) and suppliers' line items by quarter (dense). Sums run in decimals and
floating results are rounded alike on both sides, so that values compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Scale, StatLags, Task
from .functions import density as D
from .functions import exprs as E
from .operators import cells as C
from .operators import impute, joins, panel, reshape, stats
from .plans import baselines, build, drift, masks, scoring, validate
from .sources import download, readers
from .streaming import ingest

FLAGSHIP = "q_metrics_grouping_sets"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HORIZON = 8
TRAIN_END, VAL_END = 1997, 1998
ITEMS = ("tot", "n", "mx")
TASK = Task(items=ITEMS, train_end=TRAIN_END, val_end=VAL_END, horizon=HORIZON, scale=Scale(("tot",), ("n",)), fade_min_rows=100)


def query(sql: str | None = None):
    """Register a function as a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, digits: int = 6):
    return F.round(c, digits)


# ---- surrogate panels ---------------------------------------------------------------------


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


def panel_c(spark, d) -> DataFrame:
    return panel.aggregate_panel(read(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderdate"), tot=F.sum(money("o_totalprice")).cast("double"), n=F.count("*"), mx=F.max("o_totalprice"))


def panel_s(spark, d) -> DataFrame:
    rate = lambda c: F.col(c).cast("decimal(4,2)")
    return panel.aggregate_panel(
        read(spark, d, "lineitem"), F.col("l_suppkey"), F.col("l_shipdate"),
        rev=F.sum(money("l_extendedprice")).cast("double"), disc=F.sum(money("l_extendedprice") * rate("l_discount")).cast("double"),
        qty=F.sum(money("l_quantity")).cast("double"), tax=F.sum(money("l_extendedprice") * rate("l_tax")).cast("double"), n=F.count("*"),
    )


def long_c(spark, d) -> DataFrame:
    """Items of the customer panel in logs, long."""
    p = panel_c(spark, d)
    return C.melt(p.select("firm", "qord", *[r6(F.log1p(F.col(i).cast("double"))).alias(i) for i in ITEMS]), ITEMS)


def cells_c(spark, d, back: int = 11) -> DataFrame:
    c = C.calendar_arrays(long_c(spark, d), back, HORIZON)
    return c.select("firm", "qord", "item", F.slice("past", 1, 4).alias("level"), F.col("future").alias("target"), F.array().cast("array<double>").alias("yoy"))


def truth_c(spark, d) -> DataFrame:
    return baselines.truth_cells(cells_c(spark, d), HORIZON)


def fit_and_test(spark, d) -> tuple[DataFrame, DataFrame]:
    """Cells of train and validation years, targets within them; cells of test years."""
    c = cells_c(spark, d).withColumn("split", F.when(E.quarter_year(F.col("qord")) <= VAL_END, "val").otherwise("test"))
    fit = C.mask_targets(c.where("split = 'val'"), Task(val_end=VAL_END, present_in_q0=False))
    return fit.drop("split"), c.where("split = 'test'").drop("split")


Q = "CAST(year({0}) * 4 + quarter({0}) - 1 AS BIGINT)"
PANEL_C = f"""panel_c AS (
  SELECT o_custkey AS firm, {Q.format('o_orderdate')} AS qord, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS tot, count(*) AS n, max(o_totalprice) AS mx
  FROM orders GROUP BY 1, 2)"""
PANEL_S = f"""panel_s AS (
  SELECT l_suppkey AS firm, {Q.format('l_shipdate')} AS qord,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS rev,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS disc,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS tax, count(*) AS n
  FROM lineitem GROUP BY 1, 2)"""
LONG_C = PANEL_C + """, long_c AS (
  SELECT firm, qord, 'tot' AS item, round(ln(1 + tot), 6) AS value FROM panel_c
  UNION ALL SELECT firm, qord, 'n', round(ln(1 + CAST(n AS DOUBLE)), 6) FROM panel_c
  UNION ALL SELECT firm, qord, 'mx', round(ln(1 + mx), 6) FROM panel_c)"""
TRUTH_C = LONG_C + f""", h AS (SELECT unnest(range(1, {HORIZON + 1})) AS horizon), truth AS (
  SELECT c.firm, c.item AS target, c.qord AS origin, h.horizon, f.value AS actual, c.value AS base
  FROM long_c c CROSS JOIN h LEFT JOIN long_c f ON f.firm = c.firm AND f.item = c.item AND f.qord = c.qord + h.horizon)"""
NAIVE_C = TRUTH_C + f""", naive AS (
  SELECT t.firm, t.target, t.origin, t.horizon, p.value AS prediction
  FROM truth t LEFT JOIN long_c p ON p.firm = t.firm AND p.item = t.target AND p.qord = t.origin - (4 - t.horizon % 4) % 4
  WHERE t.origin >= {(VAL_END + 1) * 4})"""
FADE_C = NAIVE_C + f""", pairs AS (
  SELECT * FROM truth WHERE origin < {(VAL_END + 1) * 4}), coef AS (
  SELECT target, horizon, count(actual) AS cnt, avg(CASE WHEN actual IS NOT NULL THEN actual END) AS m,
         regr_sxx(actual, base) AS sxx, regr_slope(actual, base) AS slope, regr_intercept(actual, base) AS cut
  FROM (SELECT target, horizon, CASE WHEN origin + horizon <= {VAL_END * 4 + 3} THEN actual END AS actual, base FROM pairs) GROUP BY 1, 2), coefs AS (
  SELECT target, horizon,
         CASE WHEN cnt = 0 THEN 1.0 WHEN cnt < 100 OR coalesce(sxx, 0) <= 1e-12 THEN 0.0 ELSE slope END AS rho,
         CASE WHEN cnt = 0 THEN 0.0 WHEN cnt < 100 OR coalesce(sxx, 0) <= 1e-12 THEN m ELSE cut END AS b FROM coef), fade AS (
  SELECT t.firm, t.target, t.origin, t.horizon, coalesce(rho, 1.0) * t.base + coalesce(b, 0.0) AS prediction
  FROM truth t LEFT JOIN coefs c ON c.target = t.target AND c.horizon = t.horizon WHERE t.origin >= {(VAL_END + 1) * 4})"""


# ---- panel preparation -----------------------------------------------------------------


@query(f"WITH {PANEL_S} SELECT * FROM panel_s")
def q_panel_build(spark, d):
    return panel_s(spark, d)


@query("SELECT p_partkey, nullif(p_size, 7) AS sic FROM part WHERE nullif(p_size, 7) IS NULL OR NOT (nullif(p_size, 7) BETWEEN 10 AND 30)")
def q_sector_filter_keep_null(spark, d):
    df = read(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("sic"))
    return panel.keep_unless_in(df, "sic", [(10, 30)])


@query(f"""WITH {PANEL_S}, x AS (SELECT firm, qord, CASE WHEN n % 3 <> 0 THEN rev END AS a, CASE WHEN n % 5 <> 0 THEN disc END AS b FROM panel_s)
SELECT firm, qord, round(a - b, 6) AS strict_item, round(a - coalesce(b, 0), 6) AS right_item, round(coalesce(a, 0) - coalesce(b, 0), 6) AS both_item FROM x""")
def q_computed_items(spark, d):
    x = panel_s(spark, d).select("firm", "qord", F.when(F.col("n") % 3 != 0, F.col("rev")).alias("a"), F.when(F.col("n") % 5 != 0, F.col("disc")).alias("b"))
    formulas = {"strict_item": ("a", "b", "strict"), "right_item": ("a", "b", "right0"), "both_item": ("a", "b", "both0")}
    out = panel.add_computed(x, list(formulas), formulas)
    return out.select("firm", "qord", *[r6(F.col(c)).alias(c) for c in formulas])


@query(f"""WITH {PANEL_S}, x AS (SELECT firm, qord, CASE WHEN n % 3 <> 0 THEN rev END AS a, qty AS b, CASE WHEN n % 7 <> 0 THEN n END AS f FROM panel_s)
SELECT firm, qord, round(coalesce(abs(a) + abs(b) + 1e-3, abs(CAST(f AS DOUBLE)) + 1e-3), 6) AS scale FROM x""")
def q_scale_fallback(spark, d):
    x = panel_s(spark, d).select("firm", "qord", F.when(F.col("n") % 3 != 0, F.col("rev")).alias("a"), F.col("qty").alias("b"), F.when(F.col("n") % 7 != 0, F.col("n")).alias("f"))
    return x.select("firm", "qord", r6(panel.size_scale(x.columns, Scale(("a", "b"), ("f",)))).alias("scale"))


@query("""WITH c AS (SELECT o_custkey AS firm, nullif(o_orderpriority, '3-MEDIUM') AS code FROM orders),
g AS (SELECT firm, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1, 2),
r AS (SELECT firm, code, row_number() OVER (PARTITION BY firm ORDER BY n DESC, code) AS k FROM g)
SELECT f.firm, r.code FROM (SELECT DISTINCT firm FROM c) f LEFT JOIN r ON r.firm = f.firm AND k = 1""")
def q_modal_code(spark, d):
    x = read(spark, d, "orders").select(F.col("o_custkey").alias("firm"), F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("c"))
    return panel.modal(x, "firm", "c", "code")


RANGES = ((3, 5, 20), (1, 10, 14), (2, 15, 30), (4, 28, 40))


@query(f"""WITH r(id, lo, hi) AS (VALUES {', '.join(map(str, RANGES))}),
m AS (SELECT p_partkey, min_by(id, lo) AS id FROM part JOIN r ON p_size BETWEEN lo AND hi GROUP BY 1)
SELECT p_partkey, CAST(coalesce(id, 48) AS BIGINT) AS range_id FROM part LEFT JOIN m USING (p_partkey)""")
def q_range_lookup(spark, d):
    ranges = spark.createDataFrame(RANGES, "id long, lo int, hi int")
    return joins.range_lookup(read(spark, d, "part"), ranges, F.col("p_size"), default=48).select("p_partkey", "range_id")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT event_id AS view_id, user_id, ts, value AS view_value FROM events WHERE event_type = 'view'),
j AS (SELECT p.event_id, view_id, view_value, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, view_id DESC) AS k FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts)
SELECT event_id, view_id, view_value FROM j WHERE k = 1""")
def q_asof_backward(spark, d):
    e = read(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("seen"), F.col("value").alias("view_value"))
    return joins.asof_backward(left, right, ["user_id"], "ts", "seen", ["view_id", "view_value"], ["view_id"]).select("event_id", "view_id", "view_value")


LINKS = """links AS (SELECT o_custkey AS firm, o_custkey * 10 AS permno, min(o_orderdate) AS s, CASE WHEN max(o_orderpriority) = '5-LOW' THEN NULL ELSE max(o_orderdate) END AS e FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


@query(f"""WITH {LINKS} SELECT o_orderkey, permno, CAST(last_day(o_orderdate) AS DATE) AS jdate, CAST(year(o_orderdate) AS BIGINT) AS year
FROM orders LEFT JOIN links ON links.firm = o_custkey WHERE permno IS NULL OR (coalesce(s <= o_orderdate, true) AND coalesce(o_orderdate <= e, true))""")
def q_interval_join(spark, d):
    # customers without a finished order have no link; some links are open
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "firm")
    links = o.where("o_orderstatus = 'F'").groupBy("firm").agg((F.col("firm") * 10).alias("permno"), F.min("o_orderdate").alias("s"), F.when(F.max("o_orderpriority") != "5-LOW", F.max("o_orderdate")).alias("e"))
    out = joins.with_calendar(joins.interval_join(o, links, "firm", "o_orderdate", "s", "e", ["permno"]), "o_orderdate")
    return out.select("o_orderkey", "permno", "jdate", F.col("year").cast("long").alias("year"))


@query(f"""SELECT o_custkey AS firm, {Q.format('o_orderdate')} AS qord, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, {Q.format('o_orderdate')} ORDER BY nullif(o_orderstatus, 'O') DESC NULLS FIRST, o_orderdate DESC, o_orderkey DESC) = 1""")
def q_dedupe_last(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("firm"), E.quarter_ordinal(F.col("o_orderdate")).cast("long").alias("qord"), "o_orderkey", "o_orderdate", F.nullif("o_orderstatus", F.lit("O")).alias("st"))
    return panel.dedupe_last(o, ["firm", "qord"], ["st", "o_orderdate"], ["o_orderkey"]).select("firm", "qord", "o_orderkey")


@query(f"""WITH {PANEL_C}, y AS (SELECT firm, qord, qord // 4 AS fy, CASE WHEN n % 4 = 3 THEN NULL ELSE qord % 4 + 1 END AS fq, sum(CAST(tot AS DECIMAL(18,2))) OVER (PARTITION BY firm, qord // 4 ORDER BY qord) AS ytd FROM panel_c),
z AS (SELECT *, lag(ytd) OVER w AS p, lag(fq) OVER w AS pq FROM y WINDOW w AS (PARTITION BY firm, fy ORDER BY qord))
SELECT firm, qord, round(CAST(CASE WHEN coalesce(fq > 1, false) THEN CASE WHEN pq = fq - 1 THEN ytd - p END ELSE ytd END AS DOUBLE), 2) AS flowq FROM z""")
def q_ytd_decumulate(spark, d):
    p = panel_c(spark, d).withColumns({"fyearq": F.floor(F.col("qord") / 4), "fqtr": F.when(F.col("n") % 4 != 3, F.col("qord") % 4 + 1)})
    p = p.withColumn("flowy", F.sum(money("tot")).over(Window.partitionBy("firm", "fyearq").orderBy("qord")).cast("double"))
    return panel.ytd_to_quarterly(p, "firm", bases=["flow"]).select("firm", "qord", F.round("flowq", 2).alias("flowq"))


@query(f"""WITH {PANEL_C}, a AS (SELECT firm, unnest(range(min(qord), max(qord) + 1)) AS qord FROM panel_c GROUP BY firm)
SELECT firm, qord, tot, n FROM a LEFT JOIN panel_c USING (firm, qord)""")
def q_gap_fill(spark, d):
    return panel.gap_fill(panel_c(spark, d).select("firm", "qord", "tot", "n"), "firm")


@query(f"""WITH {LONG_C}, x AS (SELECT c.firm, c.qord, c.item, c.value, a.value AS lag1, b.value AS lag3, e.value AS lead2
FROM long_c c LEFT JOIN long_c a ON a.firm = c.firm AND a.item = c.item AND a.qord = c.qord - 1
LEFT JOIN long_c b ON b.firm = c.firm AND b.item = c.item AND b.qord = c.qord - 3 LEFT JOIN long_c e ON e.firm = c.firm AND e.item = c.item AND e.qord = c.qord + 2) SELECT * FROM x""")
def q_calendar_lag_lead(spark, d):
    c = C.calendar_arrays(long_c(spark, d), 3, 2)
    return c.select("firm", "qord", "item", "value", F.get("past", F.lit(1)).alias("lag1"), F.get("past", F.lit(3)).alias("lag3"), F.get("future", F.lit(1)).alias("lead2"))


# ---- regularised space -------------------------------------------------------------------


def _on_scale(spark, d) -> DataFrame:
    """Signed values of the dense panel with the origin's scale and fixed statistics."""
    p = panel_s(spark, d)
    long = C.melt(p.select("firm", "qord", (F.col("rev") - 40 * F.col("qty") * F.col("n")).alias("net"), "disc"), ("net", "disc"))
    scale = p.select("firm", "qord", (F.abs("qty") + 1e-3).alias("scale"))
    return C.calendar_arrays(long, 11, HORIZON).join(scale, ["firm", "qord"]).withColumns({"k": F.lit(0.25), "mu": F.lit(0.5), "sigma": F.lit(0.75)})


ON_SCALE = PANEL_S + """, long_s AS (
  SELECT firm, qord, 'net' AS item, rev - 40 * qty * n AS value FROM panel_s UNION ALL SELECT firm, qord, 'disc', disc FROM panel_s), norm AS (
  SELECT o.firm, o.qord, o.item, l.lag, (asinh(0.25 * (v.value / (abs(p.qty) + 1e-3))) - 0.5) / 0.75 AS z
  FROM long_s o JOIN panel_s p ON p.firm = o.firm AND p.qord = o.qord CROSS JOIN (SELECT unnest(range(0, 12)) AS lag) l
  LEFT JOIN long_s v ON v.firm = o.firm AND v.item = o.item AND v.qord = o.qord - l.lag)"""


@query(f"""WITH {ON_SCALE} SELECT firm, qord, item, CAST(lag AS BIGINT) AS lag, round(CASE WHEN z IS NOT NULL THEN greatest(least(z, 6.0), -6.0) END, 4) AS level FROM norm WHERE lag < 4""")
def q_regularize_levels(spark, d):
    c = _on_scale(spark, d)
    z = F.transform(F.slice("past", 1, 4), lambda v: F.round(E.clip(E.normalize(v, F.col("scale"), F.col("k"), F.col("mu"), F.col("sigma")), 6.0), 4))
    return c.select("firm", "qord", "item", F.posexplode(z).alias("lag", "level")).withColumn("lag", F.col("lag").cast("long"))


@query(f"""WITH {ON_SCALE} SELECT a.firm, a.qord, a.item, CAST(a.lag AS BIGINT) AS lag,
round(CASE WHEN a.z - b.z IS NOT NULL THEN greatest(least(a.z - b.z, 6 * 1.4142), -6 * 1.4142) END, 4) AS yoy
FROM norm a JOIN norm b ON b.firm = a.firm AND b.qord = a.qord AND b.item = a.item AND b.lag = a.lag + 4 WHERE a.lag < 8""")
def q_yoy_changes(spark, d):
    n = F.transform("past", lambda v: E.normalize(v, F.col("scale"), F.col("k"), F.col("mu"), F.col("sigma")))
    c = _on_scale(spark, d).withColumn("z", n)
    y = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.round(E.clip(F.get("z", i) - F.get("z", i + 4), 6 * 1.4142), 4))
    return c.select("firm", "qord", "item", F.posexplode(y).alias("lag", "yoy")).withColumn("lag", F.col("lag").cast("long"))


@query(f"""WITH {PANEL_S} SELECT firm, qord, round((asinh(0.01 * rev) - 1.0) / (2.0 + 1e-8), 6) AS z,
round(sinh((asinh(0.01 * rev) - 1.0) / (2.0 + 1e-8) * 2.0 + 1.0) / (0.01 + 1e-8), 2) AS back,
round(0.01 / (2.0 * sqrt(1 + (0.01 * rev) * (0.01 * rev)) + 1e-8) * 1e6, 4) AS slope FROM panel_s""")
def q_transform_functions(spark, d):
    k, mu, sigma = F.lit(0.01), F.lit(1.0), F.lit(2.0)
    z = E.regularize(F.col("rev"), k, mu, sigma)
    return panel_s(spark, d).select("firm", "qord", r6(z).alias("z"), F.round(E.de_regularize(z, k, mu, sigma), 2).alias("back"), F.round(E.derivative(F.col("rev"), k, sigma) * 1e6, 4).alias("slope"))


@query(f"""SELECT DISTINCT {Q.format('o_orderdate')} AS qord, CAST(last_day(make_date(CAST(year(o_orderdate) AS BIGINT), CAST(quarter(o_orderdate) * 3 AS BIGINT), 1)) AS DATE) AS quarter_end,
{Q.format('o_orderdate')} - 7879 AS tuple_quarter, strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month FROM orders""")
def q_quarter_calendar(spark, d):
    q = E.quarter_ordinal(F.col("o_orderdate"))
    return read(spark, d, "orders").select(q.cast("long").alias("qord"), E.quarter_end(q).alias("quarter_end"), E.tuple_quarter(q).alias("tuple_quarter"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()


STAT_TASK = Task(items=("tot",), mu=StatLags(0, (0,)), sigma=StatLags(2, (0, 3)))
RATIOS = LONG_C + """, s AS (SELECT firm, qord, 1 + CAST(n AS DOUBLE) AS scale FROM panel_c),
base AS (SELECT l.firm, l.qord, l.item, l.value, s.scale FROM long_c l JOIN s USING (firm, qord)),
lagged AS (SELECT firm, qord, item, value, scale, lag(scale, 2) OVER w AS s2, lag(value, 3) OVER w AS v3 FROM base WINDOW w AS (PARTITION BY firm, item ORDER BY qord)),
r_mu AS (SELECT item, qord, value / scale AS r FROM lagged),
r_sig AS (SELECT item, qord, value / s2 AS r FROM lagged WHERE s2 IS NOT NULL UNION ALL SELECT item, qord, v3 / s2 FROM lagged WHERE s2 IS NOT NULL AND v3 IS NOT NULL)"""


def _ratio_base(spark, d) -> DataFrame:
    s = panel_c(spark, d).select("firm", "qord", (1 + F.col("n").cast("double")).alias("scale"))
    return long_c(spark, d).join(s, ["firm", "qord"])


@query(f"""WITH {RATIOS}, m AS (SELECT item, qord, avg(asinh(1.5 * r)) AS mu FROM r_mu GROUP BY 1, 2), g AS (SELECT item, qord, stddev_samp(asinh(1.5 * r)) AS sg FROM r_sig GROUP BY 1, 2),
j AS (SELECT m.item, m.qord, coalesce(mu, 0) AS mu, coalesce(nullif(sg, 0), 1.0) + 1e-8 AS sg FROM m JOIN g ON g.item = m.item AND g.qord = m.qord)
SELECT item, qord, round(avg(mu) OVER w, 6) AS mu, round(avg(sg) OVER w + 1e-8, 6) AS sigma FROM j WINDOW w AS (PARTITION BY item ORDER BY qord ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def q_reg_stats_mu_sigma(spark, d):
    b = _ratio_base(spark, d)
    k = b.select("item").distinct().withColumn("k", F.lit(1.5))
    out = stats.mu_sigma(stats.pool(b, STAT_TASK.mu), stats.pool(b, STAT_TASK.sigma), k)
    return out.select("item", "qord", r6(F.col("mu")).alias("mu"), r6(F.col("sigma")).alias("sigma"))


@query(f"""WITH {RATIOS}, k AS (SELECT unnest([{", ".join(f"CAST({k!r} AS DOUBLE)" for k in stats.K_GRID)}]) AS k), g AS (SELECT item, k, kurtosis(asinh(k * r)) AS g FROM r_sig, k GROUP BY 1, 2)
SELECT item, arg_min(k, round(abs(g - 3.0), 9)) AS k FROM (SELECT * FROM g ORDER BY item, k) GROUP BY item""")
def q_k_sweep(spark, d):
    return stats.sweep_k(stats.pool(_ratio_base(spark, d), STAT_TASK.sigma))


# ---- rows, masks, splits, views -------------------------------------------------------------


@query(f"""WITH {PANEL_C}, a AS (SELECT DISTINCT unnest(range(lo, hi + 1)) AS qord FROM (SELECT min(qord) AS lo, max(qord) AS hi FROM panel_c GROUP BY firm)),
st AS (SELECT max(qord) AS q FROM (SELECT qord FROM a ORDER BY qord LIMIT 4))
SELECT firm, qord FROM panel_c, st WHERE qord >= q AND n % 3 <> 0""")
def q_keep_mask(spark, d):
    p = panel_c(spark, d)
    c = C.calendar_arrays(C.melt(p, ITEMS), 3, 0).join(p.select("firm", "qord", F.when(F.col("n") % 3 != 0, 1.0).alias("scale")), ["firm", "qord"])
    c = c.withColumns({"level": F.slice("past", 1, 4), "yoy": F.array().cast("array<double>")})
    return C.keep_rows(c, panel.gap_fill(p.select("firm", "qord"), "firm"), TASK).select("firm", "qord").distinct()


@query(f"""WITH {TRUTH_C}, s AS (SELECT *, CASE WHEN origin // 4 <= {TRAIN_END} THEN {TRAIN_END * 4 + 3} WHEN origin // 4 <= {VAL_END} THEN {VAL_END * 4 + 3} END AS e FROM truth)
SELECT firm, target, origin, CAST(horizon AS BIGINT) AS horizon, CASE WHEN (e IS NULL OR origin + horizon <= e) AND base < 12 THEN actual END AS actual FROM s""")
def q_target_masks(spark, d):
    c = cells_c(spark, d).withColumn("split", C.split_of(F.col("qord"), TASK))
    c = c.withColumn("level", F.transform("level", lambda v: F.when(v < 12, v)))
    return baselines.truth_cells(C.mask_targets(c, TASK), HORIZON).select("firm", "target", "origin", "horizon", F.col("actual").cast("double").alias("actual"))


@query(f"""WITH {PANEL_C} SELECT firm, qord, CASE WHEN qord // 4 <= {TRAIN_END} THEN 'train' WHEN qord // 4 <= {VAL_END} THEN 'val' ELSE 'test' END AS split FROM panel_c""")
def q_split_calendar(spark, d):
    return panel_c(spark, d).select("firm", "qord", C.split_of(F.col("qord"), TASK).alias("split"))


@query(f"""WITH {PANEL_C}, t AS (SELECT firm, qord - 7879 AS quarter FROM panel_c)
SELECT firm, quarter, 'train' AS split FROM t WHERE quarter <= {TRAIN_END * 4 + 3 - E.TUPLE_ORIGIN}
UNION ALL SELECT firm, quarter, 'val' FROM t WHERE quarter > {TRAIN_END * 4 + 3 - E.TUPLE_ORIGIN - 11} AND quarter <= {VAL_END * 4 + 3 - E.TUPLE_ORIGIN}
UNION ALL SELECT firm, quarter, 'test' FROM t WHERE quarter > {VAL_END * 4 + 3 - E.TUPLE_ORIGIN - 11}""")
def q_split_tuple_overlap(spark, d):
    t = panel_c(spark, d).select("firm", E.tuple_quarter(F.col("qord")).alias("quarter"))
    return C.tuple_splits(t, TASK).select("firm", "quarter", "split")


@query(f"""WITH {PANEL_C}, l AS (SELECT firm, qord, 'tot' AS item, CAST(tot AS DOUBLE) AS value FROM panel_c UNION ALL SELECT firm, qord, 'n', CAST(nullif(n, 1) AS DOUBLE) FROM panel_c)
SELECT CAST(dense_rank() OVER (ORDER BY firm) - 1 AS BIGINT) AS firm_id, CAST(dense_rank() OVER (ORDER BY item) - 1 AS BIGINT) AS account_id, qord - 7879 AS quarter, value FROM l WHERE value IS NOT NULL""")
def q_melt_tuple(spark, d):
    long = C.melt(panel_c(spark, d).withColumn("n", F.nullif("n", F.lit(1).cast("long"))), ("tot", "n"))
    t = joins.lookup(joins.lookup(long, panel.dense_ids(long, "firm", "firm_id"), "firm", "firm_id"), panel.dense_ids(long, "item", "account_id"), "item", "account_id")
    return t.select("firm_id", "account_id", E.tuple_quarter(F.col("qord")).alias("quarter"), "value")


@query("SELECT p_partkey, " + ", ".join(f"CAST(p_size % 6 = {i} AS FLOAT) AS ind_{i}" for i in range(5)) + " FROM part")
def q_dummies(spark, d):
    return C.dummies(read(spark, d, "part").select("p_partkey", (F.col("p_size") % 6).alias("g")), "g", 5, "ind_").drop("g")


@query(f"""WITH {LONG_C} SELECT firm, qord, max(value) FILTER (item = 'tot') AS tot_level_0, max(value) FILTER (item = 'mx') AS mx_level_0,
(SELECT p.value FROM long_c p WHERE p.firm = l.firm AND p.item = 'tot' AND p.qord = l.qord - 2) AS tot_level_2,
(SELECT p.value FROM long_c p WHERE p.firm = l.firm AND p.item = 'tot' AND p.qord = l.qord + 3) AS tot_t3 FROM long_c l GROUP BY firm, qord""")
def q_wide_view(spark, d):
    w = C.wide_view(cells_c(spark, d), ("tot", "mx"), Task(horizon=HORIZON, yoy=0))
    return w.select("firm", "qord", "tot_level_0", "mx_level_0", "tot_level_2", "tot_t3")


@query(f"""WITH {TRUTH_C} SELECT firm, target, origin, CAST(horizon AS BIGINT) AS horizon, actual, base FROM truth""")
def q_wide_truth(spark, d):
    return reshape.wide_truth(C.wide_view(cells_c(spark, d), ITEMS, Task(horizon=HORIZON, yoy=0)))


@query(f"""WITH {TRUTH_C} SELECT firm, target, origin, CAST(horizon AS BIGINT) AS horizon, actual AS prediction FROM truth""")
def q_wide_predictions(spark, d):
    return reshape.wide_predictions(C.wide_view(cells_c(spark, d), ITEMS, Task(horizon=HORIZON, yoy=0)))


@query(f"""WITH {LONG_C}, s AS (SELECT firm, qord, item, value AS level FROM long_c WHERE value >= 12) SELECT l.firm, l.qord, l.item FROM long_c l
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.firm = l.firm AND s.item = l.item AND s.qord BETWEEN l.qord - 3 AND l.qord)""")
def q_all_null_rows(spark, d):
    # a level counts where it reaches 12; rows that know none of their four levels
    c = cells_c(spark, d).withColumn("level", F.transform("level", lambda v: F.when(v >= 12, v)))
    return c.where(E.all_null(F.col("level"))).select("firm", "qord", "item")


# ---- forecasts and scoring ------------------------------------------------------------------


@query(f"WITH {NAIVE_C} SELECT firm, target, origin, CAST(horizon AS BIGINT) AS horizon, prediction FROM naive")
def q_naive_forecast(spark, d):
    return baselines.naive(fit_and_test(spark, d)[1], HORIZON)


@query(f"WITH {FADE_C} SELECT target, CAST(horizon AS BIGINT) AS horizon, round(CAST(rho AS DOUBLE), 6) AS rho, round(CAST(b AS DOUBLE), 6) AS b FROM coefs")
def q_fade_coeffs(spark, d):
    c = baselines.fade_coefficients(fit_and_test(spark, d)[0], HORIZON)
    return c.select("target", "horizon", r6(F.col("rho")).alias("rho"), r6(F.col("b")).alias("b"))


@query(f"WITH {FADE_C} SELECT firm, target, origin, CAST(horizon AS BIGINT) AS horizon, round(prediction, 5) AS prediction FROM fade")
def q_fade_forecast(spark, d):
    f = baselines.fade(*fit_and_test(spark, d), HORIZON)
    return f.withColumn("prediction", F.round("prediction", 5))


@query(f"""WITH {TRUTH_C}, f AS (SELECT firm, target, origin, horizon, CASE WHEN actual >= base THEN base + k END AS prediction, k AS ord FROM truth CROSS JOIN (SELECT unnest(range(0, 3)) AS k)
UNION ALL SELECT firm + 10000000, target, origin, horizon, 1.0, 0 FROM truth),
g AS (SELECT firm, target, origin, horizon, max(CASE WHEN ord = 0 THEN prediction END) AS prediction FROM f GROUP BY 1, 2, 3, 4)
SELECT g.firm, g.target, g.origin, CAST(g.horizon AS BIGINT) AS horizon, round(CAST(CAST(prediction AS FLOAT) - CAST(actual AS FLOAT) AS DOUBLE), 5) AS residual
FROM g JOIN truth t ON t.firm = g.firm AND t.target = g.target AND t.origin = g.origin AND t.horizon = g.horizon""")
def q_residuals_first_wins(spark, d):
    # three rows a key, of which the first counts; predictions are missing where the value fell
    t = truth_c(spark, d)
    f = t.withColumn("k", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    f = f.select("firm", "target", "origin", "horizon", F.when(F.col("actual") >= F.col("base"), F.col("base") + F.col("k")).alias("prediction"), F.col("k").alias("ord"))
    off = t.select((F.col("firm") + 10000000).alias("firm"), "target", "origin", "horizon", F.lit(1.0).alias("prediction"), F.lit(0).cast("long").alias("ord"))
    r = scoring.residuals(scoring.first_wins(f.unionByName(off)), t)
    return r.select("firm", "target", "origin", "horizon", F.round(F.col("residual").cast("double"), 5).alias("residual"))


@query(f"""WITH {TRUTH_C}, f AS (SELECT *, CASE WHEN actual >= base THEN base END AS p FROM truth)
SELECT 3 * count(*) AS n_rows, count(*) AS n_unmatched, count(*) AS n_duplicate, CAST(2 * count(p) AS BIGINT) AS n_finite FROM f""")
def q_match_counts(spark, d):
    # ids with leading zeros and origins as dates meet numbers and quarters; one row in three is off the grid
    t = truth_c(spark, d)
    f = t.select(F.lpad(F.col("firm").cast("string"), 8, "0").alias("firm"), "target", E.quarter_end(F.col("origin")).alias("origin"), (F.col("horizon") + 0.5).alias("horizon"), F.when(F.col("actual") >= F.col("base"), F.col("base")).alias("prediction"))
    off = f.withColumn("firm", F.concat(F.lit("9"), "firm"))
    return scoring.match_counts(f.unionByName(f).unionByName(off), t)


@query(f"""WITH {TRUTH_C} SELECT firm, target, origin, CAST(horizon AS BIGINT) AS horizon FROM truth WHERE actual IS NOT NULL AND actual <= base""")
def q_build_mask(spark, d):
    # of two rows a key either may hold the value, unlike in scoring
    t = truth_c(spark, d)
    f = t.select(*scoring.KEYS, F.explode(F.array(F.lit(None).cast("double"), F.when(F.col("actual") <= F.col("base"), F.col("base")))).alias("prediction"))
    return masks.build_mask(f, t)


def _forecasts(spark, d) -> tuple[DataFrame, dict[str, DataFrame]]:
    fit, test = fit_and_test(spark, d)
    truth = baselines.truth_cells(test, HORIZON)
    return truth, {"naive": baselines.naive(test, HORIZON), "fade": baselines.fade(fit, test, HORIZON)}


JOINED = FADE_C + f""", tt AS (SELECT * FROM truth WHERE origin >= {(VAL_END + 1) * 4} AND actual IS NOT NULL), res AS (
  SELECT 'naive' AS model, t.*, CAST(CAST(prediction AS FLOAT) - CAST(actual AS FLOAT) AS FLOAT) AS residual FROM tt t JOIN naive USING (firm, target, origin, horizon)
  UNION ALL SELECT 'fade', t.*, CAST(CAST(prediction AS FLOAT) - CAST(actual AS FLOAT) AS FLOAT) FROM tt t JOIN fade USING (firm, target, origin, horizon)), scored AS (
  SELECT *, count(residual) OVER (PARTITION BY firm, target, origin, horizon) = 2 AND base IS NOT NULL AS common FROM res)"""


@query(f"WITH {JOINED} SELECT target, CAST(horizon AS BIGINT) AS horizon, model, count(*) FILTER (common) AS n_common, count(residual) AS n_obs FROM scored GROUP BY 1, 2, 3")
def q_common_sample(spark, d):
    c = scoring.scored_cells(*_forecasts(spark, d))
    return c.groupBy("target", "horizon", "model").agg(F.count_if("common").alias("n_common"), F.count("residual").alias("n_obs"))


GROUPS = """SELECT CASE grouping(target) * 2 + grouping(horizon) WHEN 0 THEN 'by_target_horizon' WHEN 1 THEN 'by_target' WHEN 2 THEN 'by_horizon' ELSE 'global' END AS level,
  target, CAST(horizon AS BIGINT) AS horizon, model,
  count(*) FILTER (common) AS n_complete, sum(CAST(residual AS DOUBLE) * residual) FILTER (common) AS ss, sum(abs(CAST(residual AS DOUBLE))) FILTER (common) AS sa,
  sum(actual - base) FILTER (common) AS sy, sum((actual - base) * (actual - base)) FILTER (common) AS syy, count(residual) AS n_obs, count(DISTINCT origin) AS nq
  FROM scored GROUP BY GROUPING SETS ((model, target, horizon), (model, target), (model, horizon), (model))"""
METRICS_SQL = f"""WITH {JOINED}, g AS ({GROUPS}) SELECT level, target, horizon, model,
round(CASE WHEN syy - sy * sy / n_complete > 1e-15 THEN 1 - ss / (syy - sy * sy / n_complete + 1e-12) END, 5) AS r2,
round(sa / n_complete, 5) AS mae, round(ss / n_complete, 5) AS mse, round(CAST(n_obs AS DOUBLE) / nq, 5) AS avg_obs, n_complete FROM g"""


def _metrics(spark, d) -> DataFrame:
    truth, forecasts = _forecasts(spark, d)
    m = scoring.metrics(scoring.scored_cells(truth, forecasts), truth)
    return m.select("level", "target", "horizon", "model", *[F.round(c, 5).alias(c) for c in ("r2", "mae", "mse", "avg_obs")], "n_complete")


@query(METRICS_SQL)
def q_metrics_grouping_sets(spark, d):
    return _metrics(spark, d)


@query(f"SELECT model, r2, mae, mse, avg_obs, n_complete FROM ({METRICS_SQL}) WHERE level = 'global' ORDER BY r2 DESC")
def q_leaderboard(spark, d):
    return scoring.leaderboard(_metrics(spark, d), "r2")


@query(f"SELECT target, max(mae) FILTER (model = 'naive') AS naive, max(mae) FILTER (model = 'fade') AS fade FROM ({METRICS_SQL}) WHERE level = 'by_target' GROUP BY target")
def q_pivot_metrics(spark, d):
    return scoring.pivot_metric(_metrics(spark, d), "by_target", "mae", ["naive", "fade"])


@query(f"""WITH {JOINED} SELECT target, count(*) AS n FROM scored s WHERE common AND model = 'fade' AND actual >= base GROUP BY target""")
def q_masked_sample(spark, d):
    truth, forecasts = _forecasts(spark, d)
    mask = truth.where("actual >= base")
    c = scoring.scored_cells(truth, forecasts, mask=mask)
    return c.where("common and model = 'fade'").groupBy("target").agg(F.count("*").alias("n"))


# ---- densities --------------------------------------------------------------------------


def _density(spark, d) -> DataFrame:
    return read(spark, d, "events").select("event_id", (F.col("value") / 10 - 5).alias("res"), (0.5 + F.col("user_id") % 7).cast("double").alias("sigma"))


DENSITY = "x AS (SELECT event_id, value / 10 - 5 AS res, CAST(0.5 + user_id % 7 AS DOUBLE) AS sigma FROM events)"


@query(f"WITH {DENSITY} SELECT event_id, round(0.5 * ln(2 * pi()) + ln(sigma) + 0.5 * (res / sigma) * (res / sigma), 6) AS nll FROM x")
def q_nll_gaussian(spark, d):
    return _density(spark, d).select("event_id", r6(D.nll(F.col("res"), F.col("sigma"))).alias("nll"))


@query(f"WITH {DENSITY} SELECT event_id, round(ln(2 * sigma / sqrt(2.0)) + abs(res) / (sigma / sqrt(2.0)), 6) AS nll FROM x")
def q_nll_laplace(spark, d):
    return _density(spark, d).select("event_id", r6(D.nll(F.col("res"), F.col("sigma"), "laplace")).alias("nll"))


@query(f"WITH {DENSITY} SELECT event_id, round(-(lgamma(3.0) - lgamma(2.5) - 0.5 * ln(5 * pi())) + ln(sigma) + 3 * ln(1 + res * res / (5 * sigma * sigma)), 6) AS nll FROM x")
def q_nll_student_t(spark, d):
    return _density(spark, d).select("event_id", r6(D.nll(F.col("res"), F.col("sigma"), "student_t", 5)).alias("nll"))


@query(f"WITH {DENSITY}, y AS (SELECT *, sigma / sqrt(2.0) AS b FROM x) SELECT event_id, round(b * (abs(res) / b + exp(-abs(res) / b) - 0.75), 6) AS crps FROM y")
def q_crps_laplace(spark, d):
    return _density(spark, d).select("event_id", r6(D.crps(F.col("res"), F.col("sigma"), "laplace")).alias("crps"))


@query(f"WITH {DENSITY} SELECT event_id, round((res / sigma) * (res / sigma), 6) AS z2, CAST(abs(res / sigma) <= 1.959963984540054 AS DOUBLE) AS cover95 FROM x")
def q_calibration(spark, d):
    return _density(spark, d).select("event_id", r6(D.z_squared(F.col("res"), F.col("sigma"))).alias("z2"), D.covered95(F.col("res"), F.col("sigma")).alias("cover95"))


@query(f"""WITH {DENSITY}, y AS (SELECT *, res / sigma AS w FROM x), e AS (SELECT *, w * w / 2 AS h,
CASE WHEN w = 0 THEN 0.0 WHEN abs(w) > 8 THEN 1.0 ELSE list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln(abs(w) / sqrt(2.0)) - lgamma(n + 1.5) - w * w / 2))) END AS series FROM y)
SELECT event_id, round(sigma * (abs(w) * series + 2 * exp(-h) / sqrt(2 * pi()) - 1 / sqrt(pi())), 6) AS crps FROM e""")
def q_crps_gaussian(spark, d):
    return _density(spark, d).select("event_id", r6(D.crps(F.col("res"), F.col("sigma"))).alias("crps"))


@query(f"""WITH {DENSITY}, y AS (SELECT *, res / sigma AS w, atan(res / sigma / sqrt(5.0)) AS a FROM x), e AS (SELECT *, 2 / pi() * (a + sin(a) * cos(a) * (1 + 2 * cos(a) * cos(a) / 3)) AS centre,
exp(lgamma(3.0) - lgamma(2.5)) / sqrt(5 * pi()) * power(1 + w * w / 5, -3.0) AS pdf,
exp(lgamma(4.5) + 2 * lgamma(3.0) - 0.5 * ln(pi()) - lgamma(5.0) - 2 * lgamma(2.5)) AS b FROM y)
SELECT event_id, round(sigma * (w * centre + 2 * pdf * (5 + w * w) / 4 - 2 * sqrt(5.0) / 4 * b), 6) AS crps FROM e""")
def q_crps_student_t(spark, d):
    return _density(spark, d).select("event_id", r6(D.crps(F.col("res"), F.col("sigma"), "student_t", 5)).alias("crps"))


# ---- validation, drift, masks -------------------------------------------------------------


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount")


def _stats(spark, d, where: str = "true") -> DataFrame:
    x = read(spark, d, "lineitem").where(where).withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return drift.column_stats(x, list(NUMERIC))


def _stats_sql(where: str = "true") -> str:
    one = "SELECT '{0}' AS \"column\", count(x) AS n_finite, round(count(x) / count(*), 6) AS coverage, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95 FROM (SELECT {1} AS x FROM lineitem WHERE {2})"
    return " UNION ALL ".join(one.format(c, "nullif(l_discount, 0)" if c == "l_discount" else c, where) for c in NUMERIC)


@query(_stats_sql())
def q_column_stats(spark, d):
    return _stats(spark, d)


@query(f"""WITH a AS ({_stats_sql()}), b AS ({_stats_sql("l_returnflag <> 'R'")}), j AS (SELECT a."column", abs(a.mean - b.mean) AS dm, abs(a.sd - b.sd) AS ds, abs(a.coverage - b.coverage) AS dc FROM a JOIN b ON a."column" = b."column")
SELECT "column", round(dm, 5) AS d_mean, round(ds, 5) AS d_sd, round(dc, 5) AS d_coverage, dm > 0.05 OR ds > 0.05 OR dc > 0.02 AS over FROM j""")
def q_drift_columns(spark, d):
    c = drift.compare_stats(_stats(spark, d), _stats(spark, d, "l_returnflag <> 'R'"))
    return c.select("column", *[F.round(x, 5).alias(x) for x in ("d_mean", "d_sd", "d_coverage")], "over")


@query(f"""WITH a AS ({_stats_sql()}), b AS ({_stats_sql("l_returnflag <> 'R'")}), j AS (SELECT a."column", abs(a.mean - b.mean) AS dm, abs(a.sd - b.sd) AS ds, abs(a.coverage - b.coverage) AS dc FROM a JOIN b ON a."column" = b."column")
SELECT count(*) AS n_cols, count(*) FILTER (dm > 0.05 OR ds > 0.05 OR dc > 0.02) AS n_over, arg_max("column", dm) AS worst_mean_column, CASE WHEN count(*) FILTER (dm > 0.05 OR ds > 0.05 OR dc > 0.02) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM j""")
def q_drift_verdict(spark, d):
    c = drift.compare_stats(_stats(spark, d), _stats(spark, d, "l_returnflag <> 'R'"))
    return drift.summarize(c).select("n_cols", "n_over", "worst_mean_column", "verdict")


@query("""WITH f AS (SELECT CAST(nullif(o_custkey, 7) AS VARCHAR) AS firm, CASE WHEN o_orderkey % 11 = 0 THEN 'bogus' ELSE 'niq' END AS target, o_orderdate AS origin, CAST(o_orderkey % 22 AS DOUBLE) / 2 + 0.0 AS horizon, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS prediction, CAST(o_orderkey % 5 AS DOUBLE) AS sigma FROM orders),
u AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE target = 'bogus'), k AS (SELECT count(*) - 1 AS extra FROM u GROUP BY firm, target, origin, horizon)
SELECT count(*) AS n_rows, count(*) FILTER (firm IS NULL) AS null_firm, count(*) FILTER (horizon <> round(horizon)) AS fractional_horizon, count(*) FILTER (horizon < 1 OR horizon > 20) AS horizon_out_of_range,
count(*) FILTER (prediction IS NULL) AS nonfinite, count(*) FILTER (sigma <= 0) AS bad_sigma, count(*) FILTER (target = 'bogus') AS unknown_target_rows, max(abs(prediction)) AS largest, CAST((SELECT sum(extra) FROM k) AS BIGINT) AS n_duplicate FROM u""")
def q_validate_submission(spark, d):
    o = read(spark, d, "orders")
    f = o.select(
        F.nullif("o_custkey", F.lit(7).cast("long")).cast("string").alias("firm"), F.when(F.col("o_orderkey") % 11 == 0, "bogus").otherwise("niq").alias("target"), F.col("o_orderdate").alias("origin"),
        ((F.col("o_orderkey") % 22).cast("double") / 2).alias("horizon"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("prediction"), (F.col("o_orderkey") % 5).cast("double").alias("sigma"),
    )
    c = validate.forecast_counters(f.unionByName(f.where("target = 'bogus'")))
    return c.select("n_rows", "null_firm", "fractional_horizon", "horizon_out_of_range", "nonfinite", "bad_sigma", "unknown_target_rows", "largest", "n_duplicate")


GRID_C = f"""g AS (SELECT firm, origin, row_number() OVER (ORDER BY firm, origin) - 1 AS grid_row FROM (SELECT DISTINCT firm, origin FROM truth)), n AS (SELECT count(*) AS n FROM g),
addressed AS (SELECT t.*, CAST((CASE t.target WHEN 'mx' THEN 0 WHEN 'n' THEN 1 ELSE 2 END * {HORIZON} + t.horizon - 1) * n.n + g.grid_row AS BIGINT) AS cell FROM truth t JOIN g USING (firm, origin), n)"""


def _grid_c(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, int, list[str]]:
    """(truth, its grid, the known cells' addresses, rows, targets); grid and addresses hang on one truth."""
    t = truth_c(spark, d)
    grid, names = masks.grid_rows(t), sorted(ITEMS)
    rows = t.select("firm", "origin").distinct().count()
    tid = F.array_position(F.array(*[F.lit(i) for i in names]), F.col("target")) - 1
    cells = t.where("actual is not null").join(grid, ["firm", "origin"]).select(masks.cell_address(tid, F.col("horizon"), F.col("grid_row"), HORIZON, rows).alias("cell"))
    return t, grid, cells, rows, names


@query(f"""WITH {TRUTH_C}, {GRID_C} SELECT firm, target, origin, CAST(horizon AS BIGINT) AS horizon, cell FROM addressed a
WHERE actual IS NOT NULL AND EXISTS (SELECT 1 FROM long_c n WHERE n.firm = a.firm AND n.qord = a.origin AND n.item = 'n' AND n.value > 0.7)""")
def q_mask_realign(spark, d):
    # the other build has only the firm-quarters with several orders
    t, grid, cells, rows, names = _grid_c(spark, d)
    there = t.where("target = 'n' and base > 0.7").select("firm", "origin")
    kept = masks.realign(masks.bits_to_keys(cells, grid, names, HORIZON, rows), there)
    tid = F.array_position(F.array(*[F.lit(i) for i in names]), F.col("target")) - 1
    return kept.join(grid, ["firm", "origin"]).select("firm", "target", "origin", "horizon", masks.cell_address(tid, F.col("horizon"), F.col("grid_row"), HORIZON, rows).alias("cell"))


@query(f"""WITH {TRUTH_C}, {GRID_C} SELECT cell FROM addressed WHERE actual IS NOT NULL""")
def q_mask_bits(spark, d):
    _, _, cells, rows, names = _grid_c(spark, d)
    total = len(names) * HORIZON * rows
    return masks.unpack(spark, masks.pack(cells, total), total)


# ---- dictionaries, types, sources ---------------------------------------------------------


@query("""WITH a AS (SELECT o_orderpriority AS name, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS id FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS name, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS id FROM orders WHERE o_orderpriority <> '3-MEDIUM' GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, a.name AS a_name, b.name AS b_name FROM a FULL JOIN b ON a.id = b.id WHERE a.name IS DISTINCT FROM b.name ORDER BY 1 LIMIT 5""")
def q_id_differences(spark, d):
    o = read(spark, d, "orders")
    ids = lambda x: panel.dense_ids(x, "o_orderpriority", "id")
    return drift.compare_ids(ids(o), ids(o.where("o_orderpriority <> '3-MEDIUM'")), "o_orderpriority", "id")


@query("""SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS firm, o_orderstatus AS target, o_orderdate AS origin, CAST(o_shippriority + 1 AS BIGINT) AS horizon,
round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 3) AS prediction, CAST(CAST(0.5 AS FLOAT) AS DOUBLE) AS sigma FROM (SELECT *, 1 AS o_shippriority FROM orders)""")
def q_forecast_payload(spark, d):
    o = read(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("firm_id"), F.col("o_orderstatus").alias("target"), F.col("o_orderdate").alias("quarter"), F.lit(2.0).alias("forecast_horizon"), F.col("o_totalprice").alias("prediction"), F.lit(0.5).alias("sigma"))
    return validate.forecast_payload(o).withColumns({"prediction": F.round(F.col("prediction").cast("double"), 3), "sigma": F.col("sigma").cast("double")})


@query("""WITH x AS (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS a, o_orderpriority AS b, CAST(o_totalprice AS VARCHAR) AS c FROM orders)
SELECT count(*) FILTER (try_cast(a AS BIGINT) IS NULL) AS a, count(*) FILTER (b IS NOT NULL) AS b, count(*) FILTER (try_cast(c AS DOUBLE) IS NULL) AS c, CAST(sum(try_cast(a AS BIGINT)) AS BIGINT) AS total FROM x""")
def q_declared_types(spark, d):
    x = read(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_totalprice").cast("string").alias("c"))
    typed, lost = readers.coerce_declared(x, {"a": "integer", "b": "numeric", "c": "double precision", "absent": "date"})
    return lost.crossJoin(typed.agg(F.sum("a").alias("total")))


@query("""SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(o_custkey AS BIGINT)) AS DOUBLE) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_clerk FROM orders GROUP BY 1""")
def q_union_chunks(spark, d):
    # one chunk has the customer as text and a column that the others lack
    o = read(spark, d, "orders").select("o_orderstatus", "o_custkey")
    parts = [o.where("o_orderstatus = 'F'").withColumns({"o_custkey": F.col("o_custkey").cast("string"), "clerk": F.lit("x")}), o.where("o_orderstatus = 'O'"), o.where("o_orderstatus not in ('F', 'O')")]
    u = readers.union_chunks(parts)
    return u.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"), F.count("clerk").alias("n_clerk"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderdate BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'""")
def q_source_filters(spark, d):
    o = read(spark, d, "orders")
    return readers.filter_source(o, (("o_orderstatus", "F"), ("o_orderpriority", "1-URGENT")), 1994, 1996, "o_orderdate").select("o_orderkey")


@query("""WITH h AS (SELECT o_custkey AS k, o_orderdate AS t, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS sich FROM orders WHERE o_orderstatus = 'F'),
j AS (SELECT o_orderkey, o_custkey, o_orderdate, (SELECT h.sich FROM h WHERE h.k = o.o_custkey AND h.t <= o.o_orderdate ORDER BY h.t DESC, h.sich DESC LIMIT 1) AS sich FROM orders o),
l AS (SELECT o_custkey AS k, min(o_orderdate) AS s, max(o_orderdate) AS e, min(o_orderkey) AS permno FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, sich, permno, CAST(year(o_orderdate) AS BIGINT) AS year FROM j LEFT JOIN l ON l.k = j.o_custkey WHERE (sich IS NULL OR NOT (sich BETWEEN 4 AND 5)) AND (l.k IS NULL OR o_orderdate BETWEEN s AND e)""")
def q_source_chain(spark, d):
    # industry codes as of each date, the sector filter, then links by their dates
    o = read(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    source = download.Source(key="gvkey", date="datadate", industry_codes=("sich",))
    raw = o.select("o_orderkey", F.col("o_custkey").alias("gvkey"), F.col("o_orderdate").alias("datadate"))
    done = o.where("o_orderstatus = 'F'")
    codes = done.select(F.col("o_custkey").alias("gvkey"), F.col("o_orderdate").alias("datadate"), F.substring("o_orderpriority", 1, 1).cast("long").alias("sich"))
    links = done.groupBy(F.col("o_custkey").alias("gvkey")).agg(F.min("o_orderdate").alias("linkdt"), F.max("o_orderdate").alias("linkenddt"), F.min("o_orderkey").alias("lpermno"), F.lit(1).alias("lpermco"))
    coded = panel.keep_unless_in(download.attach_industry(raw, codes, source), "sich", [(4, 5)])
    return download.attach_links(coded, links, source).select("o_orderkey", "sich", "permno", F.col("year").cast("long").alias("year"))


# ---- a whole build with given statistics --------------------------------------------------

SINGLE = "round(CAST(CAST({0} AS FLOAT) AS DOUBLE), 4)"
BUILD_TASK = Task(items=ITEMS, train_end=TRAIN_END, val_end=VAL_END, horizon=HORIZON, scale=Scale(("tot",), ("n",)), impute=False)


@query(f"""WITH {PANEL_C}, raw AS (SELECT firm, qord, 'tot' AS item, CAST(tot AS DOUBLE) AS value FROM panel_c UNION ALL SELECT firm, qord, 'n', CAST(n AS DOUBLE) FROM panel_c UNION ALL SELECT firm, qord, 'mx', mx FROM panel_c),
st AS (SELECT DISTINCT qord, i.item FROM panel_c, (SELECT unnest(['tot', 'n', 'mx']) AS item) i WHERE i.item <> 'mx' OR qord // 4 >= 1994),
sc AS (SELECT firm, qord, abs(tot) + 1e-3 AS scale FROM panel_c),
ax AS (SELECT DISTINCT unnest(range(lo, hi + 1)) AS q FROM (SELECT min(qord) AS lo, max(qord) AS hi FROM panel_c GROUP BY firm)), q4 AS (SELECT max(q) AS q FROM (SELECT q FROM ax ORDER BY q LIMIT 4)),
z AS (SELECT o.firm, o.qord, o.item, l.lag, (asinh(2.5 * (v.value / sc.scale)) - 0.5) / 0.75 AS z FROM raw o JOIN sc ON sc.firm = o.firm AND sc.qord = o.qord JOIN st ON st.item = o.item AND st.qord = o.qord
  CROSS JOIN (SELECT unnest(range(-{HORIZON}, 12)) AS lag) l JOIN raw v ON v.firm = o.firm AND v.item = o.item AND v.qord = o.qord - l.lag),
g AS (SELECT firm, qord, item, max(z) FILTER (lag = 0) AS l0, max(z) FILTER (lag = 3) AS l3, max(z) FILTER (lag = 0) - max(z) FILTER (lag = 4) AS y0, max(z) FILTER (lag = -1) AS t1, max(z) FILTER (lag = -{HORIZON}) AS t8,
  CASE WHEN qord // 4 <= {TRAIN_END} THEN 'train' WHEN qord // 4 <= {VAL_END} THEN 'val' ELSE 'test' END AS split, CASE WHEN qord // 4 <= {TRAIN_END} THEN {TRAIN_END * 4 + 3} WHEN qord // 4 <= {VAL_END} THEN {VAL_END * 4 + 3} END AS e FROM z GROUP BY 1, 2, 3)
SELECT r.firm, r.qord, r.item, {SINGLE.format('(asinh(0.001 * sc.scale) - 0.25) / 1.5')} AS size,
  CASE WHEN r.qord // 4 <= {TRAIN_END} THEN 'train' WHEN r.qord // 4 <= {VAL_END} THEN 'val' ELSE 'test' END AS split,
  {SINGLE.format('greatest(least(l0, 6.0), -6.0)')} AS level_0, {SINGLE.format('CASE WHEN l3 IS NOT NULL THEN greatest(least(l3, 6.0), -6.0) END')} AS level_3, {SINGLE.format('CASE WHEN y0 IS NOT NULL THEN greatest(least(y0, 8.4852), -8.4852) END')} AS yoy_0,
  {SINGLE.format('CASE WHEN t1 IS NOT NULL AND (e IS NULL OR r.qord + 1 <= e) THEN greatest(least(t1, 6.0), -6.0) END')} AS t1, {SINGLE.format(f'CASE WHEN t8 IS NOT NULL AND (e IS NULL OR r.qord + {HORIZON} <= e) THEN greatest(least(t8, 6.0), -6.0) END')} AS t8
FROM raw r JOIN sc ON sc.firm = r.firm AND sc.qord = r.qord JOIN q4 ON r.qord >= q4.q LEFT JOIN g ON g.firm = r.firm AND g.qord = r.qord AND g.item = r.item""")
def q_build_cells(spark, d):
    # levels, changes and targets in the origin's space; an item without statistics in early quarters
    p = panel_c(spark, d)
    raw = p.select(F.col("firm").cast("string").alias("gvkey"), E.quarter_end(F.col("qord")).alias("datadate"), F.floor(F.col("qord") / 4).alias("fyearq"), (F.col("qord") % 4 + 1).alias("fqtr"), *[F.col(i).cast("double").alias(i) for i in ITEMS])
    frozen = p.select("qord").distinct().withColumn("item", F.explode(F.array(*[F.lit(i) for i in (*ITEMS, "scale")])))
    own = F.col("item") == "scale"
    frozen = frozen.where((F.col("item") != "mx") | (F.col("qord") >= 1994 * 4)).select("item", "qord", F.when(own, 0.25).otherwise(0.5).alias("mu"), F.when(own, 1.5).otherwise(0.75).alias("sigma"), F.when(own, 0.001).otherwise(2.5).alias("k"))
    c = build.build(raw, BUILD_TASK, frozen).cells
    r4 = lambda x: F.round(x.cast("double"), 4)
    at = lambda a, i: r4(F.get(a, F.lit(i)))
    return c.select(F.col("firm").cast("long").alias("firm"), F.col("qord").cast("long").alias("qord"), "item", r4(F.col("size")).alias("size"), "split", at("level", 0).alias("level_0"), at("level", 3).alias("level_3"), at("yoy", 0).alias("yoy_0"), at("target", 0).alias("t1"), at("target", HORIZON - 1).alias("t8"))


# ---- imputation and linear models -----------------------------------------------------------

FACTORS, WIDTH = 2, 5


def _squared(m: str) -> str:
    each = f"range(1, {WIDTH + 1})"
    return f"list_transform({m}, lambda r: list_transform({each}, lambda j: list_sum(list_transform({each}, lambda i: r[i] * {m}[i][j]))))"


def _trace(m: str) -> str:
    return "(" + " + ".join(f"{m}[{i}][{i}]" for i in range(1, WIDTH + 1)) + ")"


def _leading(name: str, source: str) -> str:
    """The leading eigenvector's projector, by squaring 40 times, its value and the vector."""
    scaled = f"list_transform(m, lambda r: list_transform(r, lambda v: v / {_trace('m')}))"
    diag = ", ".join(f"m[{i}][{i}]" for i in range(1, WIDTH + 1))
    best = f"list_position([{diag}], list_max([{diag}]))"
    value = f"list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: list_sum(list_transform(range(1, {WIDTH + 1}), lambda j: a[i][j] * m[j][i]))))"
    return f"""{name}_r AS (SELECT 0 AS k, qord, a, shift, a AS m FROM {source}
  UNION ALL SELECT k + 1, qord, a, shift, {_squared('n')} FROM (SELECT k, qord, a, shift, {scaled} AS n FROM {name}_r WHERE k < 40)),
{name}_p AS (SELECT qord, a, shift, list_transform(m, lambda r: list_transform(r, lambda v: v / {_trace('m')})) AS m FROM {name}_r WHERE k = 40),
{name} AS (SELECT qord, a, shift, m, {value} AS lam, list_transform(m[{best}], lambda v: v / sqrt(m[{best}][{best}])) AS vec FROM {name}_p)"""


@query(f"""WITH RECURSIVE {PANEL_S}, x AS (SELECT firm, qord, [{", ".join(f"CASE WHEN n % {m} <> 0 THEN CAST(CAST(ln(1 + {c}) AS FLOAT) AS DOUBLE) END" for c, m in (("rev", 3), ("disc", 4), ("qty", 5), ("tax", 7)))}, CAST(CAST(ln(1 + CAST(n AS DOUBLE)) AS FLOAT) AS DOUBLE)] AS f FROM panel_s),
q AS (SELECT qord, count(*) AS rows, [{", ".join(f"avg(f[{i}])" for i in range(1, WIDTH + 1))}] AS mean FROM x GROUP BY 1),
c AS (SELECT firm, x.qord, f, rows, mean, list_transform(f, lambda v, i: v - mean[i]) AS d FROM x JOIN q ON q.qord = x.qord),
cov AS (SELECT qord, [{", ".join("[" + ", ".join(f"coalesce(sum(d[{i}] * d[{j}]) / count(d[{i}] * d[{j}]), 0)" for j in range(1, WIDTH + 1)) + "]" for i in range(1, WIDTH + 1))}] AS a FROM c GROUP BY 1 HAVING count(*) > {FACTORS}),
-- a multiple of the identity makes all values positive and keeps their order
up AS (SELECT qord, a, list_sum(list_transform(flatten(a), lambda v: abs(v))) AS shift FROM cov),
pos AS (SELECT qord, shift, list_transform(a, lambda r, i: list_transform(r, lambda v, j: v + CASE WHEN i = j THEN shift ELSE 0 END)) AS a FROM up),
{_leading("e1", "pos")}, rest AS (SELECT qord, shift, list_transform(a, lambda r, i: list_transform(r, lambda v, j: v - lam * m[i][j])) AS a FROM e1), {_leading("e2", "rest")},
l AS (SELECT e1.qord, list_transform(e1.vec, lambda v: v * sqrt(greatest(e1.lam - e1.shift, 1e-8))) AS u, list_transform(e2.vec, lambda v: v * sqrt(greatest(e2.lam - e2.shift, 1e-8))) AS w FROM e1 JOIN e2 ON e2.qord = e1.qord),
s AS (SELECT c.*, u, w, {", ".join(f"list_sum(list_transform(d, lambda v, i: CASE WHEN v IS NOT NULL THEN {e} ELSE 0 END)) / {WIDTH}{' + 0.01 / ' + str(WIDTH) if p else ''} AS {n}" for n, e, p in (("auu", "u[i] * u[i]", 1), ("auw", "u[i] * w[i]", 0), ("aww", "w[i] * w[i]", 1), ("bu", "u[i] * v", 0), ("bw", "w[i] * v", 0)))} FROM c JOIN l ON l.qord = c.qord),
t AS (SELECT *, (aww * bu - auw * bw) / (auu * aww - auw * auw) AS fu, (auu * bw - auw * bu) / (auu * aww - auw * auw) AS fw FROM s)
SELECT firm, qord, list_transform(f, lambda v, i: round(CAST(CAST(coalesce(v, fu * u[i] + fw * w[i] + mean[i]) AS FLOAT) AS DOUBLE), 4)) AS features FROM t
UNION ALL SELECT firm, qord, list_transform(f, lambda v: round(v, 4)) FROM c WHERE rows <= {FACTORS}""")
def q_impute_local_xs(spark, d):
    # four items with holes and the size, which is always known
    p = panel_s(spark, d)
    hole = lambda c, m: F.when(F.col("n") % m != 0, F.log1p(F.col(c))).cast("float")
    f = p.select("firm", "qord", F.lit("train").alias("split"), F.array(hole("rev", 3), hole("disc", 4), hole("qty", 5), hole("tax", 7), F.log1p(F.col("n").cast("double")).cast("float")).alias("features"))
    return impute.impute_features(f, FACTORS).select("firm", "qord", F.transform("features", lambda x: F.round(x.cast("double"), 4)).alias("features"))


LINEAR_ITEMS, REGIONS = ("rev", "qty"), 4
#: Ends later than the other queries' task, so that the longest horizon has rows to fit.
LINEAR_TASK = Task(train_end=TRAIN_END + 1, val_end=VAL_END + 1, present_in_q0=False)


def _linear(spark, d, kind: str) -> DataFrame:
    """All items as targets at all horizons; features are their levels, the size and the region's dummies."""
    region = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("firm"), F.col("n_regionkey").alias("industry_id"))
    p = panel_s(spark, d).select("firm", "qord", F.log1p(F.col("n").cast("double")).alias("size"), *[F.log1p(F.col(i)).alias(i) for i in LINEAR_ITEMS])
    c = C.calendar_arrays(C.melt(p, LINEAR_ITEMS), 3, HORIZON).join(p.select("firm", "qord", "size"), ["firm", "qord"]).join(region, "firm")
    c = c.select("firm", "qord", "size", "industry_id", "item", F.col("past").alias("level"), F.array().cast("array<double>").alias("yoy"), F.col("future").alias("target")).withColumn("split", C.split_of(F.col("qord"), LINEAR_TASK))
    c = C.mask_targets(c, LINEAR_TASK)
    part = lambda s: c.where(F.col("split") == s).drop("split")
    out = baselines.linear_family(part("train"), part("val"), part("test"), LINEAR_ITEMS, LINEAR_ITEMS, range(1, HORIZON + 1), kind, industries=REGIONS)
    return out.withColumn("prediction", F.round("prediction", 4))


N_X = 2 + 4 * len(LINEAR_ITEMS) + REGIONS


@query(f"""WITH RECURSIVE {PANEL_S}, p AS (SELECT firm, qord, ln(1 + rev) AS rev, ln(1 + qty) AS qty, ln(1 + CAST(n AS DOUBLE)) AS size, n_regionkey AS g FROM panel_s JOIN supplier ON s_suppkey = firm JOIN nation ON n_nationkey = s_nationkey),
x AS (SELECT p.firm, p.qord, [1.0, p.rev, a.rev, b.rev, c.rev, p.qty, a.qty, b.qty, c.qty, p.size, {", ".join(f"CAST(p.g = {i} AS DOUBLE)" for i in range(REGIONS))}] AS x, CASE WHEN p.qord // 4 <= {LINEAR_TASK.train_end} THEN {LINEAR_TASK.train_end * 4 + 3} WHEN p.qord // 4 <= {LINEAR_TASK.val_end} THEN {LINEAR_TASK.val_end * 4 + 3} END AS e
  FROM p JOIN p a ON a.firm = p.firm AND a.qord = p.qord - 1 JOIN p b ON b.firm = p.firm AND b.qord = p.qord - 2 JOIN p c ON c.firm = p.firm AND c.qord = p.qord - 3),
h AS (SELECT unnest(range(1, {HORIZON + 1})) AS horizon), t AS (SELECT unnest({list(LINEAR_ITEMS)}) AS target),
y AS (SELECT x.*, target, horizon, CASE target WHEN 'rev' THEN f.rev ELSE f.qty END AS y FROM x, h, t JOIN p f ON true WHERE f.firm = x.firm AND f.qord = x.qord + horizon AND x.qord + horizon <= x.e),
i AS (SELECT unnest(range(1, {N_X + 1})) AS i), j AS (SELECT unnest(range(1, {N_X + 2})) AS j),
g AS (SELECT target, horizon, i, j, sum(x[i] * CASE WHEN j <= {N_X} THEN x[j] ELSE y END) AS v FROM y, i, j GROUP BY ALL),
m0 AS (SELECT target, horizon, list(r ORDER BY i) AS m FROM (SELECT target, horizon, i, list(v ORDER BY j) AS r FROM g GROUP BY ALL) GROUP BY ALL),
s AS (SELECT 1 AS k, target, horizon, m FROM m0
  UNION ALL SELECT k + 1, target, horizon, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM s WHERE k <= {N_X}),
w AS (SELECT target, horizon, list_transform(m, lambda r: r[{N_X + 1}]) AS w FROM s WHERE k = {N_X + 1})
SELECT firm, target, qord AS origin, CAST(horizon AS BIGINT) AS horizon, round(list_sum(list_transform(x, lambda v, i: v * w[i])), 4) AS prediction FROM x, w WHERE e IS NULL""")
def q_linear(spark, d):
    return _linear(spark, d, "linear")


@query()
def q_elasticnet(spark, d):
    return _linear(spark, d, "elasticnet")


# ---- event windows ------------------------------------------------------------------------------


@query("""SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) AS window_start, CAST(time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS TIMESTAMP) AS window_end, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def q_event_windows(spark, d):
    return ingest.event_windows(read(spark, d, "events"), "6 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS session_start, CAST(max(ts) + INTERVAL 2 HOUR AS TIMESTAMP) AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k""")
def q_event_sessions(spark, d):
    return ingest.event_sessions(read(spark, d, "events"), "2 hours")
