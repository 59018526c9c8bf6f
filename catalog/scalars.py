"""Scalar functions over the rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.functions import calendar as cal
from meteorium.functions import categories as cat
from meteorium.functions import geo
from meteorium.functions import numeric as num
from meteorium.functions import text as txt
from meteorium.operators import change, trends, windows
from meteorium.plans import emissions

from .inputs import DAILY, OBS, daily, observations, table, window_sql
from .polynomials import cdf_sql


def normal_cdf(spark, d):
    """Distribution function of scores between -10 and 10."""
    z = ((F.col("l_partkey") % 2001) - 1000) / 100
    o = observations(spark, d).select(z.alias("z")).distinct()
    return o.select("z", num.norm_cdf("z").alias("phi"))


def normal_quantile(spark, d):
    p = ((F.col("l_partkey") % 9999) + 0.5) / 10000
    o = observations(spark, d).select(p.alias("p")).distinct()
    return o.withColumn("z", num.norm_ppf("p")).withColumn("back", num.norm_cdf("z"))


def season_categories(spark, d):
    """Five-band category and colour of a percent."""
    c = observations(spark, d).select((F.col("qty") * 2).alias("pct"))
    k = cat.season_category("pct")
    return c.groupBy(k.alias("cat"), cat.season_color(k).alias("color")).agg(F.count(F.lit(1)).alias("n"))


def drought_categories(spark, d):
    c = observations(spark, d).select(((F.col("qty") - 25) / 8).alias("spei"))
    k = cat.drought_category("spei")
    return c.groupBy(k.alias("cat"), cat.drought_color(k).alias("color")).agg(F.count(F.lit(1)).alias("n"))


def temperature_categories(spark, d):
    """Both cold boundaries against the slot's cut-offs."""
    s = windows.pooled_samples(daily(spark, d), ["entity"], "day", "v_max", 7)
    c = s.select("entity", "slot", *[num.sorted_percentile("samples", p).alias(n) for n, p in
                                     (("p05", 0.05), ("p10", 0.1), ("p20", 0.2), ("p80", 0.8), ("p95", 0.95))])
    x = daily(spark, d).select("entity", cal.slot("day").alias("slot"), "v_max").join(c, ["entity", "slot"])
    return x.groupBy("entity", cat.temperature_category("v_max", "p95", "p80", "p20", "p10").alias("wide"),
                     cat.temperature_category("v_max", "p95", "p80", "p20", "p05").alias("narrow")).agg(F.count(F.lit(1)).alias("n"))


def percentile_buckets(spark, d):
    """Name of the cut-off a value falls on, cut-offs of its entity and month."""
    x = daily(spark, d).select("entity", F.month("day").alias("month"), "v_max")
    cuts = {"p05": 0.05, "p20": 0.2, "p40": 0.4, "p60": 0.6, "p80": 0.8, "p95": 0.95}
    ps = x.groupBy("entity", "month").agg(F.percentile("v_max", F.array(*[F.lit(p) for p in cuts.values()])).alias("p"))
    ps = ps.select("entity", "month", *[F.col("p")[i].alias(n) for i, n in enumerate(cuts)])
    j = x.join(ps, ["entity", "month"])
    return j.groupBy("entity", cat.percentile_bucket("v_max", {n: n for n in cuts}).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def elevation_bands(spark, d):
    return table(spark, d, "part").groupBy(cat.elevation_band(F.col("p_retailprice")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def tile_numbers(spark, d):
    """Mercator tile of a position and the corner of that tile."""
    e = table(spark, d, "events").select((F.col("user_id") / 4 - 18).alias("lat"), (F.col("event_id") % 360 - 180 + 0.25).alias("lon"))
    t = e.distinct().select("lat", "lon", geo.tile_x("lon", 10).alias("tx"), geo.tile_y("lat", 10).alias("ty"))
    return t.select("lat", "lon", "tx", "ty", geo.tile_lon("tx", 10).alias("west"), geo.tile_lat("ty", 10).alias("north"))


BOX = geo.Box(south=45.4, north=45.65, west=13.5, east=13.9)


def cells_of_points(spark, d):
    """Row and column of a position in a box and the area of a cell."""
    e = table(spark, d, "events").select((45.4 + F.col("event_id") % 256 / 1024).alias("lat"), (13.5 + F.col("user_id") / 1024).alias("lon"))
    r = e.select(geo.cell_row("lat", BOX, 50).alias("row"), geo.cell_col("lon", BOX, 80).alias("col"))
    g = r.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    return g.select("row", "col", "n", (F.col("n") * geo.hectares_per_cell(F.lit(50), F.lit(80), BOX)).alias("ha"))


def guarded_json(spark, d):
    """Parseable JSON and the value read from it; every seventh text is broken on purpose."""
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("props"))
    ok = txt.json_ok("props")
    return e.groupBy("event_type").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"),
                                       F.sum(F.when(ok, F.get_json_object("props", "$.k").cast("bigint"))).alias("total"))


def page_text(spark, d):
    """Length of each page without tags, brackets and spaces."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.length(txt.strip_tags("html")).alias("chars"), F.length(txt.strip_brackets(txt.strip_tags("html"))).alias("dense"))


def compact_dates(spark, d):
    """Dates found inside a text, some texts without a date."""
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, F.lit("no date here")).otherwise(
        F.concat(F.lit("updated "), F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" <b>"))).alias("t"))
    return o.groupBy(txt.compact_date("t").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def json_differences(spark, d):
    """First differing key of two JSON objects."""
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("a"), F.col("event_type").alias("b"))).alias("x"),
                                         F.to_json(F.struct(F.when(F.col("event_id") % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("a"),
                                                            F.when(F.col("event_id") % 3 == 0, F.lit("z")).otherwise(F.col("event_type")).alias("b"))).alias("y"))
    return change.first_json_difference(e, "x", "y").filter("difference is not null").select("event_id", "difference")


def nested_json_differences(spark, d):
    """First difference of two nested documents: numbers as text, list items, list lengths, and keys in another order, which count as equal."""
    k = F.col("event_id")
    pair = lambda tags, level, n: F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "data": {"tags": ['), tags, F.lit('], "level": '), level, F.lit(', "n": '), n, F.lit("}}"))
    left = pair(F.concat(F.lit('"x", "'), F.col("event_type"), F.lit('"')), F.lit("1"), F.col("user_id").cast("string"))
    right = F.when(k % 7 == 0, pair(F.concat(F.lit('"x", "'), F.col("event_type"), F.lit('", 3')), F.lit("1"), F.col("user_id").cast("string"))).when(
        k % 7 == 1, pair(F.lit('"x", "other"'), F.lit("1"), F.lit("-1"))).when(
        k % 7 == 2, pair(F.concat(F.lit('"x", "'), F.col("event_type"), F.lit('"')), F.lit('"1"'), F.col("user_id").cast("string"))).when(
        k % 7 == 3, F.concat(F.lit('{"data": {"n": '), F.col("user_id").cast("string"), F.lit(', "level": 1, "tags": ["x", "'), F.col("event_type"), F.lit('"]}, "id": '), k.cast("string"), F.lit("}"))).when(
        k % 7 == 4, F.lit("no JSON")).otherwise(F.regexp_replace(left, '"id": ', '"id": 9'))
    e = table(spark, d, "events").select("event_id", left.alias("x"), right.alias("y"))
    return change.first_json_difference(e, "x", "y").select("event_id", "difference")


def sea_levels(spark, d):
    """Rise at (scenario, year, probability) with its range; knots and surcharges come from the orders."""
    o = table(spark, d, "orders")
    s = F.element_at(F.array(F.lit("low"), F.lit("high")), (F.col("o_orderkey") % 2 + 1).cast("int"))
    knots = o.groupBy(s.alias("scenario"), (F.floor(F.year("o_orderdate") / 2) * 2).alias("year")).agg(
        F.sum("o_custkey").alias("median"), F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"))
    sur = o.groupBy(F.col("o_orderpriority").alias("probability")).agg(F.count(F.lit(1)).alias("cm"))
    req = o.groupBy(s.alias("scenario"), F.col("o_orderpriority").alias("probability"), (F.year("o_orderdate") + 0.5).alias("at_year")).agg(F.count(F.lit(1)).alias("n"))
    return emissions.sea_level(req, knots, sur).select("scenario", "probability", "at_year", "n", "rise_median", "rise_low", "rise_high", "total")


def legacy_levels(spark, d):
    o = table(spark, d, "orders")
    key = [F.col("o_orderstatus").alias("scenario"), F.col("o_orderpriority").alias("probability"), F.year("o_orderdate").alias("year")]
    t = o.groupBy(*key).agg((F.sum("o_custkey") / 64).alias("cm"))
    req = o.select(*key)
    return emissions.legacy_level(req, t, -200.0).groupBy("scenario", "probability", "year").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("level"))


def milestone_values(spark, d):
    """Least-squares line of each entity and month read at milestone years after the record."""
    o = observations(spark, d).select("entity", F.month("day").alias("month"), F.year("day").alias("year"), "value")
    f = trends.least_squares(o, ["entity", "month"], "year", "value")
    m = f.withColumn("year", F.explode(F.array(F.lit(1999), F.lit(2030), F.lit(2050)))).filter(F.col("year") > F.col("x_max"))
    return m.select("entity", "month", "year", num.line_at("slope", "intercept", "year").alias("value"))


def _ratio(coefs_n, coefs_d, x):
    def poly(cs):
        out = f"{cs[-1]!r}::DOUBLE"
        for k in cs[-2::-1]:
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out
    return f"{poly(coefs_n)} / {poly(coefs_d)}"


def ppf_sql(p: str) -> str:
    q, r2 = f"({p} - 0.5)", f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    side = f"(CASE WHEN {r2} <= 5 THEN {_ratio(num.PPF_C, num.PPF_D, f'({r2} - 1.6)')} ELSE {_ratio(num.PPF_E, num.PPF_F, f'({r2} - 5)')} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {_ratio(num.PPF_A, num.PPF_B, f'(0.180625::DOUBLE - {q} * {q})')} WHEN {q} < 0 THEN -{side} ELSE {side} END)"


QUERIES = {
    "normal_cdf": (normal_cdf, f"WITH o AS (SELECT DISTINCT (l_partkey % 2001 - 1000) / 100 AS z FROM lineitem) SELECT z, {cdf_sql('z')} AS phi FROM o"),
    "normal_quantile": (normal_quantile, f"""WITH o AS (SELECT DISTINCT (l_partkey % 9999 + 0.5::DOUBLE) / 10000 AS p FROM lineitem), z AS (SELECT p, {ppf_sql('p')} AS z FROM o)
      SELECT p, z, {cdf_sql('z')} AS back FROM z"""),
    "season_categories": (season_categories, """WITH o AS (SELECT l_quantity * 2 AS p FROM lineitem), k AS (SELECT CASE WHEN p < 10 THEN 'cold' WHEN p < 20 THEN 'cool' WHEN p < 80 THEN 'normal'
      WHEN p < 95 THEN 'hot' ELSE 'extreme' END AS cat FROM o) SELECT cat, CASE cat WHEN 'cold' THEN '#3a5a8a' WHEN 'cool' THEN '#6c8fb6' WHEN 'normal' THEN '#e7d9b8'
      WHEN 'hot' THEN '#c25a2c' ELSE '#962c1a' END AS color, count(*) AS n FROM k GROUP BY ALL"""),
    "drought_categories": (drought_categories, """WITH o AS (SELECT (l_quantity - 25) / 8 AS s FROM lineitem), k AS (SELECT CASE WHEN s < -1.5 THEN 'extreme_dry' WHEN s < -1 THEN 'dry' WHEN s < 1 THEN 'normal'
      WHEN s < 1.5 THEN 'wet' ELSE 'extreme_wet' END AS cat FROM o) SELECT cat, CASE cat WHEN 'extreme_dry' THEN '#8b3a0f' WHEN 'dry' THEN '#c2713a' WHEN 'normal' THEN '#e7e0d0'
      WHEN 'wet' THEN '#4a80b0' ELSE '#1e4d78' END AS color, count(*) AS n FROM k GROUP BY ALL"""),
    "temperature_categories": (temperature_categories, f"""WITH {window_sql(7)}, c AS (SELECT entity, target, {", ".join(f"quantile_cont(v_max, {p}) AS {n}" for n, p in
      (("p05", 0.05), ("p10", 0.1), ("p20", 0.2), ("p80", 0.8), ("p95", 0.95)))} FROM win GROUP BY ALL)
      SELECT d.entity, {", ".join(f"CASE WHEN v_max >= p95 THEN 'hell' WHEN v_max >= p80 THEN 'hot' WHEN v_max >= p20 THEN 'nope' WHEN v_max >= {p} THEN 'cold' ELSE 'freezing' END AS {n}"
      for n, p in (("wide", "p10"), ("narrow", "p05")))}, count(*) AS n FROM placed d JOIN c ON c.entity = d.entity AND c.target = d.slot GROUP BY ALL"""),
    "percentile_buckets": (percentile_buckets, f"""WITH {DAILY}, x AS (SELECT entity, month(day) AS m, v_max FROM daily), c AS (SELECT entity, m,
      {", ".join(f"quantile_cont(v_max, {p}) AS {n}" for n, p in (("p05", 0.05), ("p20", 0.2), ("p40", 0.4), ("p60", 0.6), ("p80", 0.8), ("p95", 0.95)))} FROM x GROUP BY ALL)
      SELECT entity, CASE WHEN v_max >= p95 THEN 'p95' WHEN v_max >= p80 THEN 'p80' WHEN v_max >= p60 THEN 'p60' WHEN v_max >= p40 THEN 'p40' WHEN v_max >= p20 THEN 'p20'
      WHEN v_max >= p05 THEN 'p05' ELSE 'p00' END AS bucket, count(*) AS n FROM x JOIN c USING (entity, m) GROUP BY ALL"""),
    "elevation_bands": (elevation_bands, """SELECT CASE WHEN p_retailprice > 1500 THEN 'alpine' WHEN p_retailprice > 800 THEN 'mountain' WHEN p_retailprice > 400 THEN 'foothill' ELSE 'lowland' END AS band,
      count(*) AS n FROM part GROUP BY ALL"""),
    "tile_numbers": (tile_numbers, """WITH e AS (SELECT DISTINCT user_id / 4 - 18 AS lat, event_id % 360 - 180 + 0.25::DOUBLE AS lon FROM events),
      t AS (SELECT lat, lon, floor((lon + 180) / 360 * 1024)::BIGINT AS tx, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 1024)::BIGINT AS ty FROM e)
      SELECT lat, lon, tx, ty, tx / 1024 * 360 - 180 AS west, degrees(atan(sinh(pi() * (1 - 2 * ty / 1024)))) AS north FROM t"""),
    "cells_of_points": (cells_of_points, f"""WITH e AS (SELECT 45.4::DOUBLE + event_id % 256 / 1024 AS lat, 13.5::DOUBLE + user_id / 1024 AS lon FROM events),
      r AS (SELECT trunc((45.65::DOUBLE - lat) / (45.65::DOUBLE - 45.4::DOUBLE) * 50)::INTEGER AS row, trunc((lon - 13.5::DOUBLE) / (13.9::DOUBLE - 13.5::DOUBLE) * 80)::INTEGER AS col FROM e)
      SELECT row, col, count(*) AS n, count(*) * ((45.65::DOUBLE - 45.4) / 50 * 111.32) * ((13.9::DOUBLE - 13.5) / 80 * (111.32 * cos(radians((45.65::DOUBLE + 45.4) / 2)))) * 100 AS ha FROM r GROUP BY ALL"""),
    "guarded_json": (guarded_json, """WITH e AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 4) ELSE props END AS p FROM events)
      SELECT event_type, count(*) FILTER (WHERE json_valid(p)) AS good, count(*) FILTER (WHERE NOT json_valid(p)) AS bad,
      sum(CASE WHEN json_valid(p) THEN json_extract_string(p, '$.k')::BIGINT END)::BIGINT AS total FROM e GROUP BY ALL"""),
    "page_text": (page_text, """WITH p AS (SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS t FROM pages)
      SELECT page_id, length(t)::INTEGER AS chars, length(regexp_replace(t, '[\\[\\]\\s]', '', 'g'))::INTEGER AS dense FROM p"""),
    "compact_dates": (compact_dates, """SELECT CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y%m%d') END AS date, count(*) AS n FROM orders GROUP BY ALL"""),
    "json_differences": (json_differences, """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'a: ' || user_id || ' vs ' || (user_id + 1) ELSE 'b: "' || event_type || '" vs "z"' END AS difference
      FROM events WHERE event_id % 5 = 0 OR event_id % 3 = 0"""),
    "nested_json_differences": (nested_json_differences, """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'data.tags: length 2 vs 3' WHEN 1 THEN 'data.n: ' || user_id || ' vs -1' WHEN 2 THEN 'data.level: 1 vs "1"'
      WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'id: ' || event_id || ' vs 9' || event_id END AS difference FROM events"""),
    "sea_levels": (sea_levels, """WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'low' ELSE 'high' END AS scenario FROM orders),
      k AS (SELECT scenario, (year(o_orderdate) // 2 * 2)::DOUBLE AS x, sum(o_custkey)::DOUBLE AS m, min(o_custkey)::DOUBLE AS l, max(o_custkey)::DOUBLE AS h FROM o GROUP BY ALL),
      s AS (SELECT *, lead(x) OVER w AS x1, lead(m) OVER w AS m1, lead(l) OVER w AS l1, lead(h) OVER w AS h1 FROM k WINDOW w AS (PARTITION BY scenario ORDER BY x)),
      sur AS (SELECT o_orderpriority AS probability, count(*) AS cm FROM orders GROUP BY ALL),
      r AS (SELECT scenario, o_orderpriority AS probability, year(o_orderdate) + 0.5::DOUBLE AS at_year, count(*) AS n FROM o GROUP BY ALL)
      SELECT r.scenario, r.probability, r.at_year, r.n, CASE WHEN x1 IS NULL THEN m ELSE m + (at_year - x) / (x1 - x) * (m1 - m) END AS rise_median,
      CASE WHEN x1 IS NULL THEN l ELSE l + (at_year - x) / (x1 - x) * (l1 - l) END AS rise_low, CASE WHEN x1 IS NULL THEN h ELSE h + (at_year - x) / (x1 - x) * (h1 - h) END AS rise_high,
      CASE WHEN x1 IS NULL THEN m ELSE m + (at_year - x) / (x1 - x) * (m1 - m) END + cm AS total
      FROM r JOIN s ON s.scenario = r.scenario AND x <= at_year AND (at_year < x1 OR x1 IS NULL) JOIN sur ON sur.probability = r.probability"""),
    "legacy_levels": (legacy_levels, """WITH t AS (SELECT o_orderstatus AS scenario, o_orderpriority AS probability, year(o_orderdate) AS year, sum(o_custkey) / 64 AS cm FROM orders GROUP BY ALL),
      r AS (SELECT o_orderstatus AS scenario, o_orderpriority AS probability, year(o_orderdate) AS year FROM orders)
      SELECT scenario, probability, year::INTEGER AS year, count(*) AS n, max(cm - 200) AS level FROM r JOIN t USING (scenario, probability, year) GROUP BY ALL"""),
    "milestone_values": (milestone_values, f"""WITH {OBS}, f AS (SELECT entity, month(day)::INTEGER AS month, regr_slope(value, year(day)) AS b, regr_intercept(value, year(day)) AS a, max(year(day)) AS hi FROM obs GROUP BY ALL),
      m AS (SELECT *, unnest([1999, 2030, 2050]) AS year FROM f) SELECT entity, month, year::INTEGER AS year, b * year + a AS value FROM m WHERE year > hi"""),
}
