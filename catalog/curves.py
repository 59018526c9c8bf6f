"""Density curves, their distribution functions and read-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.functions import calendar as cal
from meteorium.functions import categories as cat
from meteorium.functions import curves
from meteorium.operators import density, quality, windows
from meteorium.session import materialize

from .inputs import DAILY, daily, slot_sql, window_sql


def _samples(spark, d):
    return windows.pooled_samples(daily(spark, d), ["entity"], "day", "v_max", 7)


def _gauss(spark, d):
    return density.gaussian_curve(_samples(spark, d))


def _stored(spark, d):
    """The curves as a stored table, each prepared for read-outs."""
    return materialize(_gauss(spark, d).withColumns({"n": F.size("samples"), "curve": curves.prepared("distribution")}).drop("samples", "distribution"))


def _month_samples(spark, d):
    """All daily maxima of a month as one sample: (entity, month), bounded by days x years."""
    return daily(spark, d).groupBy("entity", F.month("day").alias("month")).agg(F.sort_array(F.collect_list("v_max")).alias("samples"))


def gaussian_density(spark, d):
    """The 200-point curve of every slot, read at each tenth point."""
    c = _gauss(spark, d).select("entity", "slot", F.posexplode("distribution").alias("i", "p"))
    return c.groupBy("entity", "slot").agg(F.count(F.lit(1)).alias("points"), F.min(F.col("p")["x"]).alias("x_lo"), F.max(F.col("p")["x"]).alias("x_hi"),
                                           F.sum(F.col("p")["d"]).alias("mass"), F.max(F.col("p")["d"]).alias("peak"))


def _read_points(df):
    p = df.select("entity", "month", F.posexplode("distribution").alias("i", "p"))
    return p.select("entity", "month", "i", F.col("p")["x"].alias("x"), F.col("p")["d"].alias("d"))


def epanechnikov_density(spark, d):
    return _read_points(density.epanechnikov_curve(_month_samples(spark, d)))


def histogram_density(spark, d):
    return _read_points(density.histogram_curve(_month_samples(spark, d)))


def mixture_density(spark, d):
    """Mean curve over entities per slot on the union grid: ends, mass and peak."""
    m = density.mixture(_gauss(spark, d), ["slot"], "distribution")
    p = m.select("slot", F.posexplode("distribution").alias("i", "p"))
    return p.groupBy("slot").agg(F.count(F.lit(1)).alias("points"), F.min(F.col("p")["x"]).alias("x_lo"), F.max(F.col("p")["x"]).alias("x_hi"),
                                 F.sum(F.col("p")["d"]).alias("mass"))


def cdf_of_observations(spark, d):
    """Percentile of each daily maximum on its slot's curve."""
    obs = daily(spark, d).select("entity", cal.slot("day").alias("slot"), "day", "v_max")
    x = obs.join(_stored(spark, d), ["entity", "slot"]).withColumn("pct", curves.cdf_percent("curve", "v_max"))
    return x.groupBy("entity", "slot").agg(F.avg("pct").alias("mean_pct"), F.min("pct").alias("low"), F.max("pct").alias("high"))


def curve_cutoffs(spark, d):
    """Cut-offs read off the curve and the percentile of each cut-off, which must be the cut-off's own percent."""
    out = _stored(spark, d).select("entity", "slot", *[curves.quantile("curve", float(p)).alias(f"q{p}") for p in (5, 50, 95)], "curve")
    return out.select("entity", "slot", "q5", "q50", "q95", *[F.round(curves.cdf_percent("curve", f"q{p}"), 6).alias(f"back{p}") for p in (5, 50, 95)])


def density_at_values(spark, d):
    """Density at the daily mean by linear interpolation, zero outside."""
    obs = daily(spark, d).select("entity", cal.slot("day").alias("slot"), (F.col("v_max") * 2 - 40).alias("v"))
    x = obs.join(_stored(spark, d), ["entity", "slot"]).withColumn("den", curves.density_at("curve", "v"))
    return x.groupBy("entity", "slot").agg(F.sum("den").alias("total"), F.count_if(F.col("den") == 0).alias("outside"))


def bin_day_counts(spark, d):
    """Expected days per whole-degree bin of each observation."""
    obs = daily(spark, d).select("entity", cal.slot("day").alias("slot"), "v_max")
    x = obs.join(_stored(spark, d), ["entity", "slot"]).withColumn("days", curves.bin_days("curve", "v_max", "n"))
    return x.groupBy("entity", "slot").agg(F.sum("days").alias("days"), F.max("days").alias("top"))


def frequency_sanity(spark, d):
    """Bin counts that exceed the sample; the multiplier is wrong on purpose for every seventh slot."""
    g = _gauss(spark, d).withColumn("n", F.size("samples")).withColumn("use", F.when(F.col("slot") % 7 == 0, F.col("n") * 30).otherwise(F.col("n")))
    g = density.bin_counts(g, "distribution", "use").withColumn("one", F.lit(1))
    v = quality.frequency_sanity(g, ["entity", "slot"], "bins", "n", "one")
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def zone_labels(spark, d):
    """Zone of each daily maximum from the slot's cut-offs."""
    c = density.with_cutoffs(_samples(spark, d), {"p10": 0.1, "p20": 0.2, "p80": 0.8, "p95": 0.95}).drop("samples")
    x = daily(spark, d).select("entity", cal.slot("day").alias("slot"), "v_max").join(c, ["entity", "slot"])
    return x.groupBy("entity", cat.zone_label("v_max", "p10", "p20", "p80", "p95").alias("zone")).agg(F.count(F.lit(1)).alias("n"))


GAUSS = window_sql(7) + """, st AS (SELECT entity, target AS slot, count(*) AS n, min(v_max) AS lo, max(v_max) AS hi, stddev_samp(v_max) AS sd FROM win GROUP BY ALL),
 par AS (SELECT *, greatest((hi - lo) * 0.05, 0.5) AS pad, sd * n ** (-0.2::DOUBLE) AS h FROM st),
 grid AS (SELECT *, unnest(range(0, 200)) AS i FROM par),
 gx AS (SELECT *, (lo - pad) + i * ((hi - lo + 2 * pad) / 199) AS x FROM grid),
 cur AS (SELECT g.entity, g.slot, g.i, g.x, sum(exp(-0.5 * ((g.x - w.v_max) / g.h) ** 2)) / (any_value(g.n) * any_value(g.h) * sqrt(2 * pi())) AS d
   FROM gx g JOIN win w ON w.entity = g.entity AND w.target = g.slot GROUP BY g.entity, g.slot, g.i, g.x)"""
SEG = GAUSS + """, seg AS (SELECT entity, slot, i, x AS x0, d AS y0, lead(x) OVER w AS x1, lead(d) OVER w AS y1 FROM cur WINDOW w AS (PARTITION BY entity, slot ORDER BY i)),
 sg AS (SELECT *, (y0 + y1) / 2 * (x1 - x0) AS area FROM seg WHERE x1 IS NOT NULL),
 tot AS (SELECT entity, slot, sum(area) AS total FROM sg GROUP BY ALL),
 ob AS (SELECT entity, """ + slot_sql("day") + """ AS slot, day, v_max FROM daily)"""
MONTH = f"""WITH {DAILY}, s AS (SELECT entity, month(day)::INTEGER AS month, v_max AS v FROM daily),
 st AS (SELECT entity, month, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, stddev_pop(v) AS sdp,
   quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM s GROUP BY ALL)"""

QUERIES = {
    "gaussian_density": (gaussian_density, f"WITH {GAUSS} SELECT entity, slot::INTEGER AS slot, count(*) AS points, min(x) AS x_lo, max(x) AS x_hi, sum(d) AS mass, max(d) AS peak FROM cur GROUP BY ALL"),
    "epanechnikov_density": (epanechnikov_density, MONTH + """, g AS (SELECT *, unnest(range(0, 100)) AS i, 1.06 * sd * n ** (-0.2::DOUBLE) AS h FROM st),
      gx AS (SELECT *, lo - (hi - lo) * 0.1 + i * ((hi - lo) * 1.2 / 99) AS x FROM g)
      SELECT gx.entity, gx.month, i::INTEGER AS i, x, sum(greatest(0, 0.75 * (1 - ((x - v) / h) ** 2))) / (any_value(n) * any_value(h)) AS d
      FROM gx JOIN s ON s.entity = gx.entity AND s.month = gx.month GROUP BY ALL"""),
    "histogram_density": (histogram_density, MONTH + """, g AS (SELECT *, least(greatest(CASE WHEN iqr > 0 THEN 2 * iqr / cbrt(n) ELSE 1.06 * sdp / cbrt(n) END, 0.2), 2.5) AS h,
        unnest(range(0, floor((hi - lo + 4) / 0.1 + 1e-9)::BIGINT + 1)) AS i FROM st),
      gx AS (SELECT *, lo - 2 + 0.1::DOUBLE * i AS x FROM g),
      c AS (SELECT gx.entity, gx.month, i, x, any_value(n) AS n, sum(greatest(0, 0.75 * (1 - ((x - v) / h) ** 2))) / (any_value(n) * any_value(h)) AS d
        FROM gx JOIN s ON s.entity = gx.entity AND s.month = gx.month GROUP BY gx.entity, gx.month, i, x)
      SELECT entity, month, i::INTEGER AS i, x, d * n / (sum(d) OVER (PARTITION BY entity, month) * 0.1) AS d FROM c"""),
    "mixture_density": (mixture_density, f"""WITH {SEG}, ends AS (SELECT slot, min(x) AS a, max(x) AS b FROM cur GROUP BY slot),
      mg AS (SELECT *, unnest(range(0, 200)) AS k FROM ends), mx AS (SELECT *, a + (b - a) * k / 199 AS x FROM mg),
      es AS (SELECT entity, slot, min(x0) AS e0, max(x1) AS e1 FROM sg GROUP BY ALL),
      v AS (SELECT mx.slot, mx.k, mx.x, es.entity, CASE WHEN mx.x <= e0 OR mx.x >= e1 THEN 0 ELSE (SELECT any_value(y0 + (y1 - y0) * (mx.x - x0) / (x1 - x0)) FROM sg
        WHERE sg.entity = es.entity AND sg.slot = mx.slot AND sg.x0 <= mx.x AND mx.x < sg.x1) END AS d FROM mx JOIN es ON es.slot = mx.slot),
      av AS (SELECT slot, k, x, avg(d) AS d FROM v GROUP BY ALL)
      SELECT slot::INTEGER AS slot, count(*) AS points, min(x) AS x_lo, max(x) AS x_hi, sum(d) AS mass FROM av GROUP BY slot"""),
    "cdf_of_observations": (cdf_of_observations, f"""WITH {SEG}, part AS (SELECT ob.entity, ob.slot, ob.day, sum(CASE WHEN v_max >= x1 THEN area WHEN v_max > x0
        THEN (y0 + y0 + (y1 - y0) * (v_max - x0) / (x1 - x0)) / 2 * (v_max - x0) ELSE 0 END) AS p
        FROM ob JOIN sg ON sg.entity = ob.entity AND sg.slot = ob.slot GROUP BY ALL),
      pc AS (SELECT part.*, least(greatest(p / total * 100, 0), 100) AS pct FROM part JOIN tot ON tot.entity = part.entity AND tot.slot = part.slot)
      SELECT entity, slot::INTEGER AS slot, avg(pct) AS mean_pct, min(pct) AS low, max(pct) AS high FROM pc GROUP BY ALL"""),
    "curve_cutoffs": (curve_cutoffs, f"""WITH {SEG}, cm AS (SELECT sg.*, total, sum(area) OVER (PARTITION BY sg.entity, sg.slot ORDER BY i ROWS UNBOUNDED PRECEDING) AS c1 FROM sg JOIN tot
        ON tot.entity = sg.entity AND tot.slot = sg.slot), ps AS (SELECT *, c1 - area AS c0, unnest([5, 50, 95]) AS p FROM cm),
      hit AS (SELECT *, p / 100 * total AS t FROM ps WHERE c1 >= p / 100 * total AND c0 < p / 100 * total),
      q AS (SELECT entity, slot, p, x0 + 2 * (t - c0) / (y0 + sqrt(y0 * y0 + 2 * (y1 - y0) / (x1 - x0) * (t - c0))) AS q FROM hit)
      SELECT entity, slot::INTEGER AS slot, max(q) FILTER (WHERE p = 5) AS q5, max(q) FILTER (WHERE p = 50) AS q50, max(q) FILTER (WHERE p = 95) AS q95,
      5.0::DOUBLE AS back5, 50.0::DOUBLE AS back50, 95.0::DOUBLE AS back95 FROM q GROUP BY ALL"""),
    "density_at_values": (density_at_values, f"""WITH {SEG}, o2 AS (SELECT entity, slot, v_max * 2 - 40 AS v FROM ob),
      den AS (SELECT o2.entity, o2.slot, coalesce(y0 + (y1 - y0) * (v - x0) / (x1 - x0), 0) AS d FROM o2 LEFT JOIN sg ON sg.entity = o2.entity AND sg.slot = o2.slot AND x0 <= v AND v < x1)
      SELECT entity, slot::INTEGER AS slot, sum(d) AS total, count(*) FILTER (WHERE d = 0) AS outside FROM den GROUP BY ALL"""),
    "bin_day_counts": (bin_day_counts, f"""WITH {SEG}, o2 AS (SELECT entity, slot, floor(v_max) + 0.5 AS v FROM ob),
      den AS (SELECT o2.entity, o2.slot, coalesce(y0 + (y1 - y0) * (v - x0) / (x1 - x0), 0) AS d FROM o2 LEFT JOIN sg ON sg.entity = o2.entity AND sg.slot = o2.slot AND x0 <= v AND v < x1),
      b AS (SELECT den.entity, den.slot, floor(d * n + 0.5)::BIGINT AS days FROM den JOIN st ON st.entity = den.entity AND st.slot = den.slot)
      SELECT entity, slot::INTEGER AS slot, sum(days)::BIGINT AS days, max(days) AS top FROM b GROUP BY ALL"""),
    "frequency_sanity": (frequency_sanity, f"""WITH {SEG}, bn AS (SELECT entity, slot, unnest(range(floor(min(x0))::BIGINT, floor(max(x1))::BIGINT + 1)) + 0.5 AS v FROM sg GROUP BY entity, slot),
      den AS (SELECT bn.entity, bn.slot, bn.v, coalesce(y0 + (y1 - y0) * (v - x0) / (x1 - x0), 0) AS d FROM bn LEFT JOIN sg ON sg.entity = bn.entity AND sg.slot = bn.slot AND x0 <= v AND v < x1),
      b AS (SELECT den.entity, den.slot, n, floor(d * n * CASE WHEN den.slot % 7 = 0 THEN 30 ELSE 1 END + 0.5) AS days FROM den JOIN st ON st.entity = den.entity AND st.slot = den.slot),
      a AS (SELECT entity, slot, any_value(n) AS n, max(days) AS top, sum(days) AS total FROM b GROUP BY entity, slot)
      SELECT 'bin_above_sample' AS rule, count(*) AS n FROM a WHERE top > ceil(n * 1.02) HAVING count(*) > 0
      UNION ALL SELECT 'total_above_sample', count(*) FROM a WHERE total > ceil(n * 1.1) HAVING count(*) > 0"""),
    "zone_labels": (zone_labels, f"""WITH {window_sql(7)}, c AS (SELECT entity, target, quantile_cont(v_max, 0.1) AS p10, quantile_cont(v_max, 0.2) AS p20, quantile_cont(v_max, 0.8) AS p80,
      quantile_cont(v_max, 0.95) AS p95 FROM win GROUP BY ALL)
      SELECT d.entity, CASE WHEN v_max < p10 THEN 'cold' WHEN v_max < p20 THEN 'cool' WHEN v_max < p80 THEN 'normal' WHEN v_max < p95 THEN 'hot' ELSE 'extreme' END AS zone, count(*) AS n
      FROM daily d JOIN c ON c.entity = d.entity AND c.target = {slot_sql("d.day")} GROUP BY ALL"""),
}
