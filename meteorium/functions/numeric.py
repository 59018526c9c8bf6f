"""Numeric expressions that Spark has no built-in for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal distribution function (West 2005), highest power first.
CDF_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
           221.213596169931, 220.206867912376]
CDF_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
           637.333633378831, 793.826512519948, 440.413735824752]
CDF_SPLIT = 7.07106781186547
CDF_ROOT = 2.506628274631

# Normal quantile, Wichura's algorithm AS 241 (1988), lowest power first.
PPF_A = [3.3871328727963666080, 1.3314166789178437745e+2, 1.9715909503065514427e+3, 1.3731693765509461125e+4,
         4.5921953931549871457e+4, 6.7265770927008700853e+4, 3.3430575583588128105e+4, 2.5090809287301226727e+3]
PPF_B = [1.0, 4.2313330701600911252e+1, 6.8718700749205790830e+2, 5.3941960214247511077e+3,
         2.1213794301586595867e+4, 3.9307895800092710610e+4, 2.8729085735721942674e+4, 5.2264952788528545610e+3]
PPF_C = [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
         1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
PPF_D = [1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
         1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
PPF_E = [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
         2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
PPF_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
         7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _horner(coefs: list[float], x: Column) -> Column:
    """Polynomial with the highest power first."""
    return reduce(lambda acc, k: acc * x + F.lit(k), coefs[1:], F.lit(coefs[0]))


def norm_cdf(x: str | Column) -> Column:
    """Standard normal distribution function."""
    v = _c(x).cast("double")
    a = F.abs(v)
    e = F.exp(-a * a / 2)
    body = e * _horner(CDF_NUM, a) / _horner(CDF_DEN, a)
    tail_chain = reduce(lambda acc, k: a + F.lit(float(k)) / acc, [4, 3, 2, 1], a + F.lit(0.65))
    tail = e / tail_chain / F.lit(CDF_ROOT)
    lower = F.when(a > 37, F.lit(0.0)).when(a < CDF_SPLIT, body).otherwise(tail)
    return F.when(v > 0, 1 - lower).otherwise(lower)


def two_sided_p(z: str | Column) -> Column:
    """Two-sided p-value of a standard normal score."""
    return 2 * norm_cdf(-F.abs(_c(z)))


def _let(value: Column, body) -> Column:
    """Bind a value once inside an expression that reads it many times (keeps generated code small)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_ppf(p: str | Column) -> Column:
    """Standard normal quantile; null outside (0, 1)."""
    def tail(r: Column) -> Column:
        near, far = r - 1.6, r - 5.0
        return F.when(r <= 5, _horner(PPF_C[::-1], near) / _horner(PPF_D[::-1], near)).otherwise(
            _horner(PPF_E[::-1], far) / _horner(PPF_F[::-1], far))

    def value(v: Column) -> Column:
        q = v - 0.5
        center = _let(F.lit(0.180625) - q * q, lambda r: q * _horner(PPF_A[::-1], r) / _horner(PPF_B[::-1], r))
        side = _let(F.sqrt(-F.log(F.when(q < 0, v).otherwise(1 - v))), tail)
        return (F.when((v <= 0) | (v >= 1), F.lit(None).cast("double")).when(F.abs(q) <= 0.425, center)
                .otherwise(F.when(q < 0, -side).otherwise(side)))

    return _let(_c(p).cast("double"), value)


def clamp(x: str | Column, low: float, high: float) -> Column:
    """Value held inside [low, high]; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(low)), F.lit(high)))


def round_to(x: str | Column, digits: int = 0) -> Column:
    """Round half up on the binary value, the rule of ``floor(x * 10^n + 0.5) / 10^n``."""
    f = float(10 ** digits)
    return F.floor(_c(x) * f + 0.5).cast("double") / f


def kelvin_to_celsius(x: str | Column) -> Column:
    return _c(x) - 273.15


def lapse_corrected(value: str | Column, elevation_diff: str | Column, rate: float = 0.0065) -> Column:
    """Temperature moved from model height to station height at a fixed lapse rate."""
    return _c(value) + _c(elevation_diff) * rate


def number_or_zero(raw: str | Column) -> Column:
    """Numeric text as double, notation keys such as ``NO`` as 0."""
    return F.coalesce(_c(raw).try_cast("double"), F.lit(0.0))


def line_at(slope: str | Column, intercept: str | Column, x: str | Column) -> Column:
    return _c(slope) * _c(x) + _c(intercept)


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear interpolation; a zero-width segment gives its left value."""
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def sorted_percentile(sorted_values: str | Column, p: float) -> Column:
    """Linear-interpolated percentile at ``(n - 1) * p`` of an ascending array without nulls."""
    a = _c(sorted_values)
    pos = (F.size(a) - 1) * F.lit(float(p))
    lo = F.floor(pos).cast("int")
    low, high = F.get(a, lo), F.get(a, F.least(lo + 1, F.size(a) - 1))
    return F.when(F.size(a) > 0, low + (high - low) * (pos - lo))
