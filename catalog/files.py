"""Sources and sinks, on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from meteorium import session
from meteorium.functions import geo
from meteorium.operators import change, grids
from meteorium.sources import readers, sinks
from meteorium.streaming import rollup

from .inputs import DAILY, OBS, daily, day_text, observations, table

STATION = T.StructType([T.StructField("entity", T.StringType()), T.StructField("date", T.DateType()), T.StructField("value", T.DoubleType()),
                        T.StructField("qty", T.DoubleType()), T.StructField("source", T.StringType())])


def csv_station_files(spark, d):
    """Daily CSV files with and without a source column, read back into one table."""
    o = observations(spark, d).select("entity", F.col("day").alias("date"), "value", "qty", "l_linenumber")
    root = session.scratch_path(spark, "stations")
    plain = o.filter("l_linenumber > 2").drop("l_linenumber")
    tagged = o.filter("l_linenumber <= 2").drop("l_linenumber").withColumn("source", F.lit("era5t"))
    sinks.write_csv(plain, f"{root}/plain")
    sinks.write_csv(tagged, f"{root}/tagged")
    both = readers.read_station_files(spark, f"{root}/*", STATION)
    return both.groupBy("entity", "source", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def swapped_station_files(spark, d):
    """Daily CSV files whose columns stand in different orders, read by the names in their headers."""
    o = observations(spark, d).select("entity", F.col("day").alias("date"), "value", "qty", "l_linenumber")
    root = session.scratch_path(spark, "swapped")
    sinks.write_csv(o.filter("l_linenumber > 3").drop("l_linenumber"), f"{root}/plain")
    sinks.write_csv(o.filter("l_linenumber <= 3").select("qty", F.lit("era5t").alias("source"), "value", "entity", "date"), f"{root}/swapped")
    both = readers.read_station_files(spark, f"{root}/*", STATION)
    return both.groupBy("entity", "source", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.sum("qty").alias("qty"))


def strict_dates(spark, d):
    """Text dates in three spellings; only yyyy-MM-dd counts."""
    s = observations(spark, d).select("l_linenumber", F.when(F.col("l_linenumber") == 1, F.date_format("day", "yyyy/MM/dd")).when(
        F.col("l_linenumber") == 2, F.date_format("day", "yyyy-MM")).otherwise(day_text("day")).alias("text"))
    ok = F.when(F.col("text").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp("text", F.lit("yyyy-MM-dd"))))
    return s.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count(ok).alias("parsed"), day_text(F.max(ok)).alias("last"))


def payload_rows(spark, d):
    """Parallel arrays of a JSON document to rows."""
    e = table(spark, d, "embeddings")
    ints = F.transform("embedding", lambda v: F.floor(v * 1024 + 0.5).cast("int"))
    steps = F.sequence(F.lit(0), F.size("embedding") - 1)
    doc = e.select("vec_id", F.to_json(F.struct(steps.alias("step"), ints.alias("value"))).alias("doc"))
    rows = readers.read_payload(doc, "doc", ["vec_id"], "step array<int>, value array<int>", ["step", "value"])
    return rows.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("bigint").alias("total"), F.max("value").alias("high"))


def configured_dimension(spark, d):
    """Facts joined with a configured entity dimension."""
    dim = readers.station_dimension(spark, [{"code": c, "band": b} for c, b in
                                            (("1-URGENT", "fast"), ("2-HIGH", "fast"), ("3-MEDIUM", "normal"))], "code string, band string")
    o = table(spark, d, "orders").join(dim, F.col("o_orderpriority") == F.col("code"), "left")
    return o.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def newest_version(spark, d):
    """Newest order per customer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return readers.newest_version(o, ["o_custkey"], "o_orderdate", ["o_orderkey"]).select(
        "o_custkey", day_text("o_orderdate").alias("date"), "o_orderkey")


def ascii_grids(spark, d):
    """Text grids with six header lines, written as files and read as cells."""
    e = table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: F.floor(x * 1024 + 0.5).cast("int").cast("string"))
    lines = [F.lit(h) for h in ("ncols 8", "nrows 8", "xllcorner 0", "yllcorner 0", "cellsize 1", "NODATA_value -9999")]
    lines += [F.array_join(F.slice(v, 8 * k + 1, 8), " ") for k in range(8)]
    cells = readers.ascii_grid_cells(e.select("vec_id", F.concat_ws("\n", *lines).alias("text")), "text", ["vec_id"])
    return cells.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def cube_cells(spark, d):
    """Cube slices to long cells."""
    e = grids.cells_from_rows(table(spark, d, "embeddings"), ["label"], "embedding", "v")
    return e.groupBy("label", "x").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("v").cast("double")).alias("high"))


def _rgb():
    return [(F.col("l_linenumber") + 126).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_suppkey") % 256).alias("b")]


def terrain_heights(spark, d):
    p = observations(spark, d).select("entity", *_rgb())
    m = geo.terrain_metres("r", "g", "b")
    return p.groupBy("entity", "r").agg(F.count(F.lit(1)).alias("n"), F.min(m).alias("low"), F.max(m).alias("high"), F.sum(m).alias("total"))


def packed_heights(spark, d):
    """Heights from packed colours; the no-data value and everything below it are left out."""
    p = observations(spark, d).select(F.lit(0).alias("r"), (F.col("l_partkey") % 8).alias("g"), (F.col("l_suppkey") % 256).alias("b"), "entity")
    h = geo.packed_height("r", "g", "b")
    return p.withColumn("h", h).filter("h is not null").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.sum("h").alias("total"), F.count_if(F.col("h") < 300).alias("under_300"))


def tile_mosaic(spark, d):
    """Tiles joined to one grid and cut to a box of cells."""
    p = observations(spark, d).select((F.col("l_suppkey") % 4).alias("tile_x"), (F.col("l_linenumber") % 3).alias("tile_y"),
                                      (F.col("l_partkey") % 16).alias("px"), (F.col("l_orderkey") % 16).alias("py"), "value")
    c = readers.crop_cells(readers.global_cells(p, 16), 5, 40, 3, 30)
    return c.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"))


def map_elements(spark, d):
    """Map elements with own position, center, or neither."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 3
    lat, lon = 45 + F.col("user_id") / 64, 13 + (F.col("event_id") % 64) / 64
    doc = e.select("event_id", F.to_json(F.struct(F.array(F.struct(
        F.lit("way").alias("type"), F.col("event_id").alias("id"), F.when(k == 0, lat).alias("lat"), F.when(k == 0, lon).alias("lon"),
        F.when(k == 1, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"),
        F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("building"), F.col("event_type"))).alias("tags"))).alias("elements"))).alias("doc"))
    c = readers.map_elements(doc, "doc", ["event_id"])
    return c.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.sum("lat").alias("lats"))


def sheet_cells(spark, d):
    """Cells at fixed positions; text becomes null."""
    o = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("file_year"), (F.col("o_custkey") % 40).alias("row"), (F.col("o_orderkey") % 12).alias("col"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("NE")).otherwise(F.col("o_custkey").cast("string")).alias("raw"))
    c = readers.cells_at(o, F.col("row") > 6, F.col("col") == 10)
    return c.groupBy("file_year", "row").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("numbers"), F.sum("value").alias("total"))


def sheet_block(spark, d):
    """A fixed range of rows and columns, renumbered from its corner."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 60).alias("row"), (F.col("o_orderkey") % 70).alias("col"),
                                         F.col("o_custkey").cast("string").alias("raw"))
    return readers.block(o, 23, 44, 20, 27).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def file_patterns(spark, d):
    """File names that fit the pattern and the suffix."""
    o = table(spark, d, "orders").select(F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, "HRV_").otherwise("SVN_"), F.year("o_orderdate"), F.lit("_"),
        F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.when(F.col("o_orderkey") % 2 == 0, "_v1.XLSX").otherwise(".csv")).alias("name"))
    return readers.files_like(o, "name").groupBy(F.substring("name", 5, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def changed_inputs(spark, d):
    """Documents whose hash is not in the manifest; a third of the manifest is stale."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.sha1("text").alias("sha1"), "source")
    manifest = docs.select("name", F.when(F.col("name") % 3 == 0, F.reverse("sha1")).otherwise(F.col("sha1")).alias("sha1"))
    return change.changed_inputs(docs, manifest).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("name").alias("ids"))


def measurement_rows(spark, d):
    """Sub-hourly measurements in their nine declared columns; events stand for readings, users for stations."""
    ts, value = F.col("ts"), F.col("value")
    named = {"station_id": F.col("user_id") % 40, "timestamp": ts, "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "temperature_interval_2m": value,
             "temperature_average_2m": value / 2, "temperature_min_2m": value / 4, "temperature_max_2m": value * 2}
    m = rollup.read_measurements(spark, f"{d}/events.parquet", named)
    assert m.schema.names == rollup.MEASUREMENTS.names
    return m.groupBy("station_id", F.hour("timestamp").alias("hour"), "month").agg(
        F.count(F.lit(1)).alias("n"), F.max("temperature_max_2m").alias("high"), F.min("temperature_min_2m").alias("low"), F.max("temperature_average_2m").alias("mean"),
        F.max("temperature_interval_2m").alias("interval"), F.min("day").alias("first_day"), F.max("year").alias("year"))


def fixed_decimals(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"))
    return sinks.fixed_decimals(o, 2)


def inventory(spark, d):
    return sinks.inventory({n: table(spark, d, n) for n in ("lineitem", "orders", "events", "documents", "supplier")})


def stats_document(spark, d):
    """One JSON document of a level table."""
    q = observations(spark, d).groupBy((F.floor(F.col("qty") / 10) * 10 + 10).alias("level")).agg(
        F.count(F.lit(1)).alias("px"), F.count_distinct("l_suppkey").alias("buildings"))
    return sinks.stats_document(q, "level", ["px", "buildings"])


def series_json(spark, d):
    """Yearly series of each entity as JSON text."""
    y = observations(spark, d).groupBy("entity", F.year("day").alias("x")).agg(F.count(F.lit(1)).alias("y"))
    s = y.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("series"))
    return sinks.series_as_json(s)


def published_lookup(spark, d):
    """Daily rows written in read order and looked up by key."""
    path = session.scratch_path(spark, "daily")
    sinks.write_for_reads(daily(spark, d).withColumn("date", day_text("day")), path, ["entity", "date"])
    got = spark.read.parquet(path).filter((F.col("entity") == "R") & F.col("date").between("1997-01-01", "1997-01-31"))
    return got.select("entity", "date", "v_max", "v_min")


QUERIES = {
    "csv_station_files": (csv_station_files, f"""WITH {OBS} SELECT entity, CASE WHEN l_linenumber <= 2 THEN 'era5t' ELSE 'era5' END AS source,
      year(day)::INTEGER AS year, count(*) AS n, sum(value) AS value FROM obs GROUP BY ALL"""),
    "swapped_station_files": (swapped_station_files, f"""WITH {OBS} SELECT entity, CASE WHEN l_linenumber <= 3 THEN 'era5t' ELSE 'era5' END AS source,
      year(day)::INTEGER AS year, count(*) AS n, sum(value) AS value, sum(qty)::DOUBLE AS qty FROM obs GROUP BY ALL"""),
    "strict_dates": (strict_dates, f"""WITH {OBS} SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_linenumber > 2) AS parsed,
      strftime(max(day) FILTER (WHERE l_linenumber > 2), '%Y-%m-%d') AS last FROM obs GROUP BY l_linenumber"""),
    "payload_rows": (payload_rows, """WITH c AS (SELECT unnest(range(0, len(embedding))) AS step, unnest(embedding) AS v FROM embeddings)
      SELECT step::INTEGER AS step, count(*) AS n, sum(floor(v::DOUBLE * 1024 + 0.5))::BIGINT AS total, max(floor(v::DOUBLE * 1024 + 0.5))::INTEGER AS high FROM c GROUP BY ALL"""),
    "configured_dimension": (configured_dimension, """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast'
      WHEN o_orderpriority = '3-MEDIUM' THEN 'normal' END AS band, count(*) AS n FROM orders GROUP BY ALL"""),
    "newest_version": (newest_version, """SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""),
    "ascii_grids": (ascii_grids, """WITH c AS (SELECT unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings)
      SELECT (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y, count(*) AS n, sum(floor(v::DOUBLE * 1024 + 0.5)) AS total FROM c GROUP BY ALL"""),
    "cube_cells": (cube_cells, """WITH c AS (SELECT label, unnest(range(0, len(embedding))) AS x, unnest(embedding) AS v FROM embeddings)
      SELECT label, x::INTEGER AS x, count(*) AS n, max(v::DOUBLE) AS high FROM c GROUP BY ALL"""),
    "terrain_heights": (terrain_heights, f"""WITH {OBS}, p AS (SELECT entity, l_linenumber + 126 AS r, (l_linenumber + 126) * 256.0::DOUBLE + l_partkey % 256
      + (l_suppkey % 256) / 256.0::DOUBLE - 32768.0::DOUBLE AS m FROM obs)
      SELECT entity, r::INTEGER AS r, count(*) AS n, min(m) AS low, max(m) AS high, sum(m) AS total FROM p GROUP BY ALL"""),
    "packed_heights": (packed_heights, f"""WITH {OBS}, p AS (SELECT entity, (l_partkey % 8) * 256.0::DOUBLE + l_suppkey % 256 - 1000.0::DOUBLE AS h FROM obs)
      SELECT entity, count(*) AS n, min(h) AS low, sum(h) AS total, count(*) FILTER (WHERE h < 300) AS under_300 FROM p WHERE h > -900 GROUP BY entity"""),
    "tile_mosaic": (tile_mosaic, f"""WITH {OBS}, p AS (SELECT (l_suppkey % 4) * 16 + l_partkey % 16 AS gx, (l_linenumber % 3) * 16 + l_orderkey % 16 AS gy, value FROM obs)
      SELECT gx - 5 AS gx, gy - 3 AS gy, count(*) AS n, max(value) AS high FROM p WHERE gx >= 5 AND gx < 40 AND gy >= 3 AND gy < 30 GROUP BY ALL"""),
    "map_elements": (map_elements, """WITH e AS (SELECT 45 + user_id / 64 AS lat, 13 + (event_id % 64) / 64 AS lon,
      CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'yes' END AS type FROM events WHERE event_id % 3 < 2)
      SELECT type, count(*) AS n, min(lat) AS south, max(lon) AS east, sum(lat) AS lats FROM e GROUP BY type"""),
    "sheet_cells": (sheet_cells, """SELECT year(o_orderdate)::INTEGER AS file_year, o_custkey % 40 AS row, count(*) AS n,
      count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS numbers, sum(CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END)::DOUBLE AS total
      FROM orders WHERE o_custkey % 40 > 6 AND o_orderkey % 12 = 10 GROUP BY ALL"""),
    "sheet_block": (sheet_block, """SELECT o_custkey % 60 - 23 AS row, o_orderkey % 70 - 20 AS col, count(*) AS n, sum(o_custkey)::DOUBLE AS total
      FROM orders WHERE o_custkey % 60 BETWEEN 23 AND 43 AND o_orderkey % 70 BETWEEN 20 AND 26 GROUP BY ALL"""),
    "file_patterns": (file_patterns, """SELECT year(o_orderdate)::VARCHAR AS year, count(*) AS n FROM orders
      WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 GROUP BY ALL"""),
    "changed_inputs": (changed_inputs, """SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 3 = 0 GROUP BY source"""),
    "measurement_rows": (measurement_rows, """SELECT (user_id % 40)::INTEGER AS station_id, hour(ts)::INTEGER AS hour, month(ts)::DOUBLE AS month, count(*) AS n, max(value * 2) AS high,
      min(value / 4) AS low, max(value / 2) AS mean, max(value) AS interval, min(day(ts))::DOUBLE AS first_day, max(year(ts))::DOUBLE AS year FROM events GROUP BY ALL"""),
    "fixed_decimals": (fixed_decimals, """SELECT o_custkey, printf('%.2f', max(o_totalprice)) AS high, printf('%.2f', min(o_totalprice)) AS low
      FROM orders GROUP BY o_custkey"""),
    "inventory": (inventory, " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n_rows FROM {n}"
                                                for n in ("lineitem", "orders", "events", "documents", "supplier"))),
    "stats_document": (stats_document, f"""WITH {OBS}, q AS (SELECT (floor(qty / 10) * 10 + 10)::BIGINT::VARCHAR AS level, count(*) AS px,
      count(DISTINCT l_suppkey) AS b FROM obs GROUP BY ALL)
      SELECT '{{' || string_agg('"' || level || '":{{"px":' || px || ',"buildings":' || b || '}}', ',' ORDER BY level) || '}}' AS document FROM q"""),
    "series_json": (series_json, f"""WITH {OBS}, y AS (SELECT entity, year(day) AS x, count(*) AS y FROM obs GROUP BY ALL)
      SELECT entity, '[' || string_agg('{{"x":' || x || ',"y":' || y || '}}', ',' ORDER BY x) || ']' AS series FROM y GROUP BY entity"""),
    "published_lookup": (published_lookup, f"""WITH {DAILY} SELECT entity, strftime(day, '%Y-%m-%d') AS date, v_max, v_min FROM daily
      WHERE entity = 'R' AND daily.day BETWEEN DATE '1997-01-01' AND DATE '1997-01-31'"""),
}
