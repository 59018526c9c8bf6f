import datetime as dt

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from meteorium.streaming import refresh, rollup

EVENTS = "/root/testdata/sf0.001/events.parquet"


def _files(spark, df, path, n):
    """Split rows into files that arrive in order of time."""
    cut = df.withColumn("_f", F.ntile(n).over(Window.orderBy("ts")))
    for k in range(1, n + 1):
        cut.filter(F.col("_f") == k).drop("_f").coalesce(1).write.mode("append").parquet(path)


def test_stream_rollup_equals_batch(spark, tmp_path):
    e = spark.read.parquet(EVENTS).select("event_type", "ts", "value")
    _files(spark, e, str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rollup.start_daily_extremes(stream, ["event_type"], "ts", "value", str(tmp_path / "out"), str(tmp_path / "ck"), "Europe/Ljubljana").awaitTermination()
    got = {(r.event_type, r.date): (r.value_min, r.value_max, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.event_type, r.date): (r.value_min, r.value_max, r.n) for r in rollup.daily_extremes(e, ["event_type"], "ts", "value", "Europe/Ljubljana").collect()}
    closed = max(d for _, d in batch) - dt.timedelta(days=3)  # days behind the watermark are emitted
    assert {k: v for k, v in batch.items() if k[1] <= closed} == {k: v for k, v in got.items() if k[1] <= closed}
    assert got.items() <= batch.items()


def test_stream_classification_equals_batch(spark, tmp_path):
    e = spark.read.parquet(EVENTS).select("event_id", "event_type", "ts", "value")
    clim = e.select("event_type", F.date_format("ts", "MM-dd").alias("month_day"), "value").groupBy("event_type", "month_day").agg(
        F.percentile("value", 0.1).alias("p10"), F.percentile("value", 0.2).alias("p20"), F.percentile("value", 0.8).alias("p80"), F.percentile("value", 0.95).alias("p95"))
    clim = clim.withColumn("distribution", F.array(F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("d")), F.struct(F.lit(50.0).alias("x"), F.lit(1.0).alias("d"))))
    _files(spark, e, str(tmp_path / "in"), 2)
    live = rollup.classify_live(rollup.valid_measurements(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "ts", "value"), clim, ["event_type"], "ts", "value")
    q = live.select("event_id", "category_key", "percentile").writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    want = rollup.classify_live(e, clim, ["event_type"], "ts", "value").select("event_id", "category_key", "percentile")
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, want.collect()))


def test_stream_upsert_keeps_new_histories_and_files_late_rows(spark, tmp_path):
    d = lambda m, k: dt.datetime(2023, m, k)
    schema = "entity string, ts timestamp, day string, value double, arrival long"
    batches = [[("a", d(3, 1), "2023-03-01", 1.0, 1), ("a", d(3, 20), "2023-03-20", 2.0, 2), ("b", d(3, 20), "2023-03-20", 5.0, 3)],
               [("a", d(3, 20), "2023-03-20", 9.0, 4), ("b", d(4, 20), "2023-04-20", 7.0, 5), ("a", d(3, 6), "2023-03-06", 6.0, 9)],
               [("b", d(3, 20), "2023-03-20", 99.0, 6), ("b", d(4, 20), "2023-04-20", 8.0, 7), ("b", d(4, 20), "2023-04-20", 8.5, 8),
                ("new", d(1, 1), "2023-01-01", 10.0, 10), ("new", d(4, 20), "2023-04-20", 11.0, 11)]]
    table, ck = str(tmp_path / "table"), str(tmp_path / "ck")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        refresh.upsert_stream(stream, table, ck, ["entity", "day"], "ts", "day").awaitTermination()
    got = {(r.entity, str(r.day)): r.value for r in spark.read.parquet(table).collect()}
    assert got == {("a", "2023-03-01"): 1.0, ("a", "2023-03-06"): 6.0, ("a", "2023-03-20"): 9.0, ("b", "2023-03-20"): 5.0, ("b", "2023-04-20"): 8.5,
                   ("new", "2023-01-01"): 10.0, ("new", "2023-04-20"): 11.0}
    assert [(r.entity, r.value, r.batch) for r in refresh.refused_rows(spark, table).collect()] == [("b", 99.0, 2)]


def test_newest_days_stay_one_row_per_entity_and_batches_can_run_twice(spark, tmp_path):
    d = lambda k: dt.datetime(2023, 3, 1) + dt.timedelta(days=k)
    table = str(tmp_path / "table")
    merge = refresh.upsert_into(table, ["entity", "day"], "day", "ts")
    schema = "entity string, ts timestamp, day string, value double, arrival long"
    sizes = []
    for number in range(6):
        rows = [(e, d(20 * number), str(d(20 * number).date()), float(number), number) for e in "abc"] + [("a", d(20 * number - 40), "old", -1.0, number)]
        batch = spark.createDataFrame(rows, schema)
        for _ in range(2):  # delivered twice
            merge(batch, number)
        newest = spark.read.parquet(f"{table}.newest")
        assert {(r.entity, r.newest, r.batch) for r in newest.collect()} == {(e, d(20 * number), number) for e in "abc"}
        sizes.append(newest.count())
    assert sizes == [3] * 6
    assert sorted(r.batch for r in refresh.refused_rows(spark, table).collect()) == [1, 2, 3, 4, 5]
    assert spark.read.parquet(table).filter("entity = 'b'").count() == 6


def test_trim_counts_in_the_same_pass(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2000, 1, k),) for k in range(1, 11)] + [(None,)], "d date")
    counts = Observation()
    refresh.trim_range(df, "d", F.to_date(F.lit("2000-01-03")), F.to_date(F.lit("2000-01-06")), counts).write.parquet(str(tmp_path / "t"))
    assert counts.get == {"kept": 4, "dropped": 7} and spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_a_batch_reads_only_the_partitions_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, f"2023-05-{k:02d}") for k in range(1, 29)], "v int, day string").write.partitionBy("day").parquet(path)
    read = refresh.touched_rows(spark.read.parquet(path), "day", spark.createDataFrame([("2023-05-03",), ("2023-05-04",)], "day string"))
    assert len(read.inputFiles()) > 0 and sorted(r.v for r in read.collect()) == [3, 4]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2023-05-03" in plan.split("PartitionFilters: [")[1]


def test_batch_upsert(spark):
    old = spark.createDataFrame([("a", 1, "era5t", 1.0), ("a", 2, "era5", 2.0)], "e string, d int, source string, v double")
    new = spark.createDataFrame([("a", 1, "era5", 1.5), ("a", 3, "era5t", 3.0)], "e string, d int, source string, v double")
    got = {r.d: (r.source, r.v) for r in refresh.upsert(old, new, ["e", "d"]).collect()}
    assert got == {1: ("era5", 1.5), 2: ("era5", 2.0), 3: ("era5t", 3.0)}


def test_fetch_plan(spark):
    have = spark.createDataFrame([("fresh", dt.date(2024, 7, 1)), ("stale", dt.date(2024, 3, 1)), ("ahead", dt.date(2024, 8, 1))], "k string, d date")
    who = spark.createDataFrame([("fresh",), ("stale",), ("new",), ("ahead",)], "k string")
    today, end = F.to_date(F.lit("2024-07-05")), F.to_date(F.lit("2024-07-04"))
    p = {r.k: (str(r.fetch_from), r.action) for r in refresh.fetch_plan(have, who, "k", "d", today, end, "1950-01-01").collect()}
    assert p == {"fresh": ("2024-06-20", "refresh"), "stale": ("2024-03-02", "refresh"), "new": ("1950-01-01", "full"), "ahead": ("2024-06-20", "refresh")}
    early = refresh.fetch_plan(have, who, "k", "d", today, F.to_date(F.lit("2024-06-01")), "1950-01-01")
    assert {r.k: r.action for r in early.collect()}["fresh"] == "skip"


def test_quarantine_partitions_the_rows(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(1970, 1, 1), 1.0), (None, 2.0), (dt.datetime(2024, 1, 1), None), (dt.datetime(2024, 1, 1), float("nan"))], "ts timestamp, v double")
    assert rollup.valid_measurements(df, "ts", "v").count() == 1 and rollup.quarantined(df, "ts", "v").count() == 4
