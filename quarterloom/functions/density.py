"""Proper scores of predictive densities: NLL, CRPS, calibration.

``res`` is prediction - actual. ``sigma`` is the standard deviation of gaussian and laplace
densities and the scale of student_t. All scores are column expressions; only the t distribution
function with degrees of freedom that aren't whole is an Arrow UDF.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
FAMILIES = ("gaussian", "laplace", "student_t")


def check_family(family: str, df: float | None) -> None:
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}; one of {', '.join(FAMILIES)}")
    if family == "student_t" and df is None:
        raise ValueError("student_t needs df, its degrees of freedom")


def _log_t_const(nu: float) -> float:
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)


def nll(res: Column, sigma: Column, family: str = "gaussian", df: float | None = None) -> Column:
    """Negative log density, with its normalising constant."""
    check_family(family, df)
    if family == "gaussian":
        return 0.5 * math.log(2 * math.pi) + F.log(sigma) + 0.5 * (res / sigma) * (res / sigma)
    if family == "laplace":
        b = sigma / math.sqrt(2)
        return F.log(2 * b) + F.abs(res) / b
    nu = float(df)
    return -_log_t_const(nu) + F.log(sigma) + (nu + 1) / 2 * F.log1p(res * res / (nu * sigma * sigma))


# W. J. Cody's rational approximations of erf (below 0.46875) and erfc (to 4, and beyond),
# good to double precision; numerators from the constant term up, then denominators.
ERF = (
    (3209.37758913846947, 377.485237685302021, 113.864154151050156, 3.16112374387056560, 0.185777706184603153),
    (2844.23683343917062, 1282.61652607737228, 244.024637934444173, 23.6012909523441209, 1.0),
)
ERFC_NEAR = (
    (1230.33935479799725, 2051.07837782607147, 1712.04761263407058, 881.952221241769090, 298.635138197400131, 66.1191906371416295, 8.88314979438837594, 0.564188496988670089, 2.15311535474403846e-8),
    (1230.33935480374942, 3439.36767414372164, 4362.61909014324716, 3290.79923573345963, 1621.38957456669019, 537.181101862009858, 117.693950891312499, 15.7449261107098347, 1.0),
)
ERFC_FAR = (
    (-6.58749161529837803e-4, -0.0160837851487422766, -0.125781726111229246, -0.360344899949804439, -0.305326634961232344, -0.0163153871373020978),
    (2.33520497626869185e-3, 0.0605183413124413191, 0.527905102951428412, 1.87295284992346047, 2.56852019228982242, 1.0),
)


def _ratio(x, parts: tuple[tuple[float, ...], tuple[float, ...]]):
    """A rational function by Horner's rule, of columns or arrays."""
    out = []
    for coefs in parts:
        v = coefs[-1]
        for c in reversed(coefs[:-1]):
            v = v * x + c
        out.append(v)
    return out[0] / out[1]


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function."""
    z = np.asarray(x, dtype=float) / math.sqrt(2)
    a = np.abs(z)
    with np.errstate(all="ignore"):
        far = np.maximum(a, 1.0)
        near = np.exp(-a * a) * _ratio(a, ERFC_NEAR)
        tail = np.exp(-a * a) / far * (1 / math.sqrt(math.pi) + _ratio(1 / (far * far), ERFC_FAR) / (far * far))
        upper = np.where(a > 4, tail, near)
        return np.where(a <= 0.46875, 0.5 + 0.5 * z * _ratio(z * z, ERF), np.where(z > 0, 1 - 0.5 * upper, 0.5 * upper))


def erf(z: Column) -> Column:
    a = F.abs(z)
    far = F.greatest(a, F.lit(1.0))
    near = F.exp(-a * a) * _ratio(a, ERFC_NEAR)
    tail = F.exp(-a * a) / far * (1 / math.sqrt(math.pi) + _ratio(1 / (far * far), ERFC_FAR) / (far * far))
    return F.when(a <= 0.46875, z * _ratio(z * z, ERF)).otherwise(F.signum(z) * (1 - F.when(a > 4, tail).otherwise(F.when(a <= 4, near))))


def _beta_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function, vectorised."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + num * d)
            c = safe(1 + num / c)
            step = c * d
            h = h * step
        if np.abs(step - 1).max(initial=0) < 1e-14:
            break
    return h


def student_cdf(x: np.ndarray, nu: float) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    z = nu / (nu + x * x)
    a, b = nu / 2, 0.5
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(np.maximum(z, 1e-300)) + b * np.log(np.maximum(1 - z, 1e-300)))
    direct = z < (a + 1) / (a + b + 2)
    inc = np.where(direct, front * _beta_fraction(a, b, np.where(direct, z, 0.0)) / a, 1 - front * _beta_fraction(b, a, np.where(direct, 0.0, 1 - z)) / b)
    tail = np.where(x == 0, 0.5, inc / 2)
    return np.where(x > 0, 1 - tail, tail)


#: Up to so many whole degrees of freedom the t distribution function is a finite sum in columns.
MAX_TERMS = 100


def _t_centre(w: Column, nu: float) -> Column:
    """2 F(w) - 1 of the t distribution; for whole degrees of freedom in closed form."""
    if nu != int(nu) or nu > MAX_TERMS:
        return 2 * _t_cdf(nu)(w) - 1
    n = int(nu)
    theta = F.atan(w / math.sqrt(nu))
    c2 = F.lit(1.0) / (1 + w * w / nu)  # the squared cosine
    sine = w / F.sqrt(nu + w * w)
    odd = n % 2
    # sum of c_j cos^(2j), by Horner; each term's factor over the one before is known
    terms = (n - 1) // 2 if odd else n // 2
    total = F.lit(0.0)
    for j in reversed(range(terms)):
        step = (2 * j + 2) / (2 * j + 3) if odd else (2 * j + 1) / (2 * j + 2)
        total = 1 + total * c2 * step
    if not odd:
        return sine * total
    return (theta + sine * F.sqrt(c2) * total) * (2 / math.pi) if terms else theta * (2 / math.pi)


def _t_cdf(nu: float):
    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(student_cdf(x.fillna(0).to_numpy(), nu)).where(x.notna().to_numpy())

    return cdf


def crps(res: Column, sigma: Column, family: str = "gaussian", df: float | None = None) -> Column:
    """Continuous ranked probability score in closed form; null for student_t with df <= 1."""
    check_family(family, df)
    w = res / sigma
    if family == "gaussian":
        pdf = F.exp(-0.5 * w * w) / math.sqrt(2 * math.pi)
        return sigma * (w * erf(w / math.sqrt(2)) + 2 * pdf - 1 / math.sqrt(math.pi))
    if family == "laplace":
        b = sigma / math.sqrt(2)
        z = F.abs(res) / b
        return b * (z + F.exp(-z) - 0.75)
    nu = float(df)
    if nu <= 1:
        return F.lit(None).cast("double")
    pdf = math.exp(_log_t_const(nu)) * F.pow(1 + w * w / nu, F.lit(-(nu + 1) / 2))
    beta = math.exp(math.lgamma(nu - 0.5) + 2 * math.lgamma((nu + 1) / 2) - 0.5 * math.log(math.pi) - math.lgamma(nu) - 2 * math.lgamma(nu / 2))
    return sigma * (w * _t_centre(w, nu) + 2 * pdf * (nu + w * w) / (nu - 1) - 2 * math.sqrt(nu) / (nu - 1) * beta)


def z_squared(res: Column, sigma: Column) -> Column:
    return (res / sigma) * (res / sigma)


def covered95(res: Column, sigma: Column) -> Column:
    return (F.abs(res / sigma) <= Z95).cast("double")
