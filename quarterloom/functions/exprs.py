"""Column expressions that keep nulls, large negatives and bounds right.

Missing is NULL in this engine; sources turn NaN into NULL. All functions take and
give Columns and stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def asinh(x: Column) -> Column:
    """Inverse hyperbolic sine by sign and size: the plain form cancels for large negatives."""
    return F.signum(x) * F.asinh(F.abs(x))


def clip(x: Column, bound: float) -> Column:
    """x within [-bound, bound]; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(bound))), F.lit(-float(bound))))


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def or_null(x: Column) -> Column:
    """x where finite, else null."""
    return F.when(finite(x), x)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def transform(v: Column, k: Column | float) -> Column:
    return asinh(v * k)


def regularize(v: Column, k, mu, sigma) -> Column:
    """(asinh(k v) - mu) / (sigma + 1e-8): the public form."""
    return (transform(v, k) - mu) / (sigma + EPS)


def de_regularize(x: Column, k, mu, sigma) -> Column:
    return F.sinh(x * sigma + mu) / (k + EPS)


def derivative(v: Column, k, sigma) -> Column:
    """d regularize / d v."""
    return k / (sigma * F.sqrt(1 + (v * k) * (v * k)) + EPS)


def normalize(v: Column, scale: Column, k, mu, sigma) -> Column:
    """(asinh(k v / scale) - mu) / sigma: the builder's form, where sigma holds its epsilon."""
    return (asinh(F.try_divide(v, scale) * k) - mu) / sigma


def quarter_ordinal(d: Column) -> Column:
    """year * 4 + quarter - 1: consecutive over quarters."""
    return (F.year(d) * 4 + F.quarter(d) - 1).cast("int")


def quarter_year(q: Column) -> Column:
    return F.floor(q / 4).cast("int")


def quarter_end(q: Column) -> Column:
    """The last day of a quarter ordinal."""
    return F.last_day(F.make_date(quarter_year(q), (F.pmod(q, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


#: Tuple views count quarters from this ordinal.
TUPLE_ORIGIN = 1969 * 4 + 3


def tuple_quarter(q: Column) -> Column:
    return q.cast("long") - TUPLE_ORIGIN


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis: null below four values, 0 without variance."""
    n, g = F.count(x).cast("double"), F.kurtosis(x)
    g = F.when(F.coalesce(F.var_pop(x), F.lit(0.0)) == 0, F.lit(None)).otherwise(F.when(F.isnan(g), None).otherwise(g))
    value = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g + 6)
    return F.when(n >= 4, F.coalesce(value, F.lit(0.0)))


def seasonal_lag(h: Column, period: int = 4) -> Column:
    """Quarters back from the origin to the season of origin + h."""
    return F.pmod(F.lit(period) - F.pmod(h, F.lit(period)), F.lit(period)).cast("int")


def all_null(arr: Column) -> Column:
    return F.forall(arr, lambda x: x.isNull())


def any_value(arr: Column) -> Column:
    return F.exists(arr, lambda x: x.isNotNull())
