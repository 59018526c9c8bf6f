"""Category ladders and colours as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category colours and ladders.
SEASON_COLORS = {"cold": "#3a5a8a", "cool": "#6c8fb6", "normal": "#e7d9b8", "hot": "#c25a2c", "extreme": "#962c1a"}
DROUGHT_COLORS = {"extreme_dry": "#8b3a0f", "dry": "#c2713a", "normal": "#e7e0d0", "wet": "#4a80b0",
                  "extreme_wet": "#1e4d78"}
SEASON_LADDER = [(10.0, "cold"), (20.0, "cool"), (80.0, "normal"), (95.0, "hot")]
DROUGHT_LADDER = [(-1.5, "extreme_dry"), (-1.0, "dry"), (1.0, "normal"), (1.5, "wet")]
ELEVATION_BANDS = [(1500, "alpine"), (800, "mountain"), (400, "foothill")]
TREND_BANDS = [(0.30, "catastrophic"), (0.20, "extreme"), (0.10, "bad"), (0.05, "moderate")]
SIGNIFICANCE = [(0.001, "***"), (0.01, "**"), (0.05, "*")]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def below_ladder(x: str | Column, steps: list[tuple[float, str]], last: str) -> Column:
    """First label whose bound lies strictly above ``x``, else ``last``."""
    expr = F.when(_c(x) < F.lit(steps[0][0]), F.lit(steps[0][1]))
    for bound, label in steps[1:]:
        expr = expr.when(_c(x) < F.lit(bound), F.lit(label))
    return F.when(_c(x).isNotNull(), expr.otherwise(F.lit(last)))


def at_least_ladder(x: str | Column, steps: list[tuple[float | Column | str, str]], last: str) -> Column:
    """First label whose bound ``x`` reaches (``>=``), bounds descending; bounds may be columns."""
    def b(bound):
        return _c(bound) if isinstance(bound, (str, Column)) else F.lit(bound)
    expr = F.when(_c(x) >= b(steps[0][0]), F.lit(steps[0][1]))
    for bound, label in steps[1:]:
        expr = expr.when(_c(x) >= b(bound), F.lit(label))
    return F.when(_c(x).isNotNull(), expr.otherwise(F.lit(last)))


def above_ladder(x: str | Column, steps: list[tuple[float, str]], last: str) -> Column:
    """First label whose bound ``x`` exceeds (``>``)."""
    expr = F.when(_c(x) > F.lit(steps[0][0]), F.lit(steps[0][1]))
    for bound, label in steps[1:]:
        expr = expr.when(_c(x) > F.lit(bound), F.lit(label))
    return F.when(_c(x).isNotNull(), expr.otherwise(F.lit(last)))


def lookup(key: str | Column, mapping: dict[str, str]) -> Column:
    """Constant dictionary lookup; null for unknown keys."""
    items = list(mapping.items())
    expr = F.when(_c(key) == items[0][0], F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(_c(key) == k, F.lit(v))
    return expr


def season_category(percentile: str | Column) -> Column:
    return below_ladder(percentile, SEASON_LADDER, "extreme")


def drought_category(index: str | Column) -> Column:
    return below_ladder(index, DROUGHT_LADDER, "extreme_wet")


def season_color(category: str | Column) -> Column:
    return lookup(category, SEASON_COLORS)


def drought_color(category: str | Column) -> Column:
    return lookup(category, DROUGHT_COLORS)


def temperature_category(value, p95, p80, p20, p_cold) -> Column:
    """Five bands from row cut-offs; pass p10 or p05 as the cold cut-off."""
    return at_least_ladder(value, [(p95, "hell"), (p80, "hot"), (p20, "nope"), (p_cold, "cold")], "freezing")


def percentile_bucket(value, cutoffs: dict[str, str | Column]) -> Column:
    """Name of the highest cut-off not above the value, ``p00`` below the first."""
    names = list(cutoffs)
    return at_least_ladder(value, [(cutoffs[n], n) for n in reversed(names)], "p00")


def zone_label(value, p10, p20, p80, p95) -> Column:
    v = _c(value)
    return (F.when(v < _c(p10), "cold").when(v < _c(p20), "cool").when(v < _c(p80), "normal")
            .when(v < _c(p95), "hot").otherwise("extreme"))


def elevation_band(elevation) -> Column:
    return above_ladder(elevation, ELEVATION_BANDS, "lowland")


def trend_band(per_decade) -> Column:
    return at_least_ladder(per_decade, TREND_BANDS, "baseline")


def significance_mark(p) -> Column:
    return below_ladder(p, SIGNIFICANCE, "ns")


def variable_unit(variable) -> Column:
    return F.when(_c(variable).isin("precipitation_sum", "et0_evapotranspiration"), "mm").otherwise("°C")


def trend_verdict(z, p, alpha: float = 0.05) -> Column:
    """Sign of a trend that is significant at ``alpha``."""
    return (F.when((_c(p) < alpha) & (_c(z) > 0), "increasing")
            .when((_c(p) < alpha) & (_c(z) < 0), "decreasing").otherwise("no trend"))
