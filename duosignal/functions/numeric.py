"""Numeric expressions that Spark has no function for, as columns or as SQL text."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximations of the normal quantile (AS 241).
CENTRE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
          [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
MIDDLE = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
          [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
TAIL = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
        [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def _polynomial(coefficients: list[float], x: str) -> str:
    text = f"{coefficients[-1]!r}e0" if "e" not in repr(coefficients[-1]) else repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r}{'' if 'e' in repr(c) else 'e0'})"
    return text


def normal_quantile_sql(p: str) -> str:
    """The normal quantile of the SQL expression ``p`` (0 < p < 1)."""
    q, edge = f"({p} - 0.5e0)", f"sqrt(-ln(least({p}, 1e0 - {p})))"
    ratio = lambda pair, x: f"{_polynomial(pair[0], x)} / {_polynomial(pair[1], x)}"
    square = f"(0.180625e0 - {q} * {q})"
    near, far = f"({edge} - 1.6e0)", f"({edge} - 5e0)"
    return f"case when abs({q}) <= 0.425e0 then {q} * {ratio(CENTRE, square)} else sign({q}) * (case when {edge} <= 5e0 then {ratio(MIDDLE, near)} else {ratio(TAIL, far)} end) end"


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """The normal quantiles of an array, by the same polynomials."""
    q, edge = p - 0.5, np.sqrt(-np.log(np.minimum(p, 1 - p)))
    ratio = lambda pair, x: np.polyval(pair[0][::-1], x) / np.polyval(pair[1][::-1], x)
    far = np.where(edge <= 5, ratio(MIDDLE, edge - 1.6), ratio(TAIL, edge - 5))
    return np.where(np.abs(q) <= 0.425, q * ratio(CENTRE, 0.180625 - q * q), np.sign(q) * far)


def digamma_sql(x: str) -> str:
    """The digamma function of the SQL expression ``x`` (> 0), by recurrence to x + 6 and a series."""
    y = f"({x} + 6e0)"
    back = " + ".join(f"1e0 / ({x} + {i}e0)" for i in range(6))
    z = f"(1e0 / ({y} * {y}))"
    series = f"{z} * (1e0/12 - {z} * (1e0/120 - {z} * (1e0/252 - {z} * (1e0/240 - {z} * (1e0/132)))))"
    return f"(ln({y}) - 0.5e0 / {y} - {series} - ({back}))"


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation; null where a side has no spread (plain ``corr`` raises there in ANSI mode)."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.try_divide(F.covar_pop(x, y), sx * sy))


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def trunc_decimals(c: str | Column, decimals: int) -> Column:
    """Towards zero at so many decimals."""
    c, scale = F.col(c) if isinstance(c, str) else c, 10.0**decimals
    return F.signum(c) * F.floor(F.abs(c) * scale) / scale


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1e-300
    d = 1 / (d or tiny)
    total = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + top * d) or tiny), (1 + top / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    """The two-sided p-value of Student's t."""
    return beta_tail(df / (df + t * t), df / 2, 0.5)
