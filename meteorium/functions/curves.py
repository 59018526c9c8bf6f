"""Functions of a density curve, an ``array<struct<x: double, d: double>>`` ascending in x.

Between points the density is linear, hence the cumulative curve is piecewise quadratic and its inverse is solved in closed
form.  ``prepared`` turns a curve into its coordinates and prefix areas once, where the curve is stored; a read-out then finds
its segment by halving (eight steps for 200 points) and solves one segment, all in the JVM.

Edge cases: a curve that is null or has fewer than two points has no mass: density and percent are 0, the quantile is null; two points at the
same x are a step without area; a value that is null or NaN counts as outside (density and percent 0, quantile null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def prepared(curve) -> Column:
    """``struct<x, d, below>`` of a curve: coordinates, densities and the area before each point; null for fewer than two points."""
    points = _c(curve)
    zero = F.struct(F.lit(0.0).alias("sum"), F.array(F.lit(0.0)).alias("all"))
    steps = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1),
                       lambda p, q: (p["d"] + q["d"]) / 2 * (q["x"] - p["x"]))

    def add(acc: Column, area: Column) -> Column:
        total = acc["sum"] + area
        return F.struct(total.alias("sum"), F.array_append(acc["all"], total).alias("all"))

    below = F.aggregate(steps, zero, add, lambda acc: acc["all"])
    return F.when(F.size(points) >= 2, F.struct(F.transform(points, lambda p: p["x"]).alias("x"), F.transform(points, lambda p: p["d"]).alias("d"), below.alias("below")))


def _count(ascending: Column, holds: Callable[[Column], Column]) -> Column:
    """How many values of an ascending array fulfil a condition that holds up to some value and no further."""
    halvings = F.transform(F.sequence(F.ceil(F.log2(F.size(ascending) + 1)).cast("int"), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(halvings, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(ascending)) & holds(F.get(ascending, at + step - 1)), at + step).otherwise(at))


def _segment(curve: Column, v: Column) -> Column:
    """Index of the last point at or before a value."""
    return _count(curve["x"], lambda x: x <= v) - 1


def _at(array: Column, k: Column) -> Column:
    return F.get(array, k)


def _usable(curve: Column, v: Column) -> Column:
    return curve.isNotNull() & v.isNotNull() & ~F.isnan(v)


def density_at(curve, x) -> Column:
    """Linear interpolation on a ``prepared`` curve, 0 on and outside the ends."""
    c, v = _c(curve), _c(x).cast("double")

    def inside(k: Column) -> Column:
        x0, x1, d0, d1 = _at(c["x"], k), _at(c["x"], k + 1), _at(c["d"], k), _at(c["d"], k + 1)
        return F.when(x1 == x0, d0).otherwise(d0 + (v - x0) / (x1 - x0) * (d1 - d0))
    within = _usable(c, v) & (v > _at(c["x"], F.lit(0))) & (v < F.element_at(c["x"], -1))
    return F.when(within, _let(_segment(c, v), inside)).otherwise(0.0)


def cdf_percent(curve, value) -> Column:
    """Share of a ``prepared`` curve's mass at or below a value, 0..100 (0 for a curve without mass)."""
    c, v = _c(curve), _c(value).cast("double")
    total = F.element_at(c["below"], -1)

    def part(k: Column) -> Column:
        x0, x1, d0, d1 = _at(c["x"], k), _at(c["x"], k + 1), _at(c["d"], k), _at(c["d"], k + 1)
        dv = d0 + (d1 - d0) * (v - x0) / (x1 - x0)
        return _at(c["below"], k) + (d0 + dv) / 2 * (v - x0)
    percent = F.when(v >= F.element_at(c["x"], -1), 100.0).when(v < _at(c["x"], F.lit(0)), 0.0).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), _let(_segment(c, v), part) / total * 100)))
    return F.when(_usable(c, v) & (total > 0), percent).otherwise(0.0)


def quantile(curve, percent) -> Column:
    """Value whose ``cdf_percent`` on a ``prepared`` curve is ``percent``; null for a curve of fewer than two points."""
    c, p = _c(curve), _c(percent).cast("double")
    target = p / 100 * F.element_at(c["below"], -1)

    def solved(k: Column) -> Column:
        x0, x1, d0, d1, left = _at(c["x"], k), _at(c["x"], k + 1), _at(c["d"], k), _at(c["d"], k + 1), target - _at(c["below"], k)
        root = F.sqrt(F.greatest(d0 * d0 + 2 * (d1 - d0) / (x1 - x0) * left, F.lit(0.0)))
        return F.when(left <= 0, x0).when(d0 + root > 0, F.least(x0 + 2 * left / (d0 + root), x1)).otherwise(x1)
    # the segment before the first point with at least that area; on and outside the ends the first or the last segment
    k = F.greatest(F.least(_count(c["below"], lambda a: a < target), F.size(c["x"]) - 1) - 1, F.lit(0))
    return F.when(_usable(c, p), _let(k, solved))


def bin_days(curve, value, n) -> Column:
    """Expected days in the whole-degree bin that holds a value."""
    return F.floor(density_at(curve, F.floor(_c(value)) + 0.5) * _c(n) + 0.5)
