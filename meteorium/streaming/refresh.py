"""Incremental refresh: what to fetch, how revisions are merged, and who is late."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import series


#: Buckets of the table of newest event times.
BUCKETS = 64


def fetch_plan(existing: DataFrame, entities: DataFrame, entity: str, date: str, today: Column, end: Column,
               start: str, refresh_days: int = 15) -> DataFrame:
    """Date range to fetch per entity: everything new plus the revision window; up-to-date entities are marked."""
    last = existing.groupBy(entity).agg(F.max(F.to_date(date)).alias("last_day"))
    plan = entities.select(entity).distinct().join(last, entity, "left")
    # least() skips nulls, so entities without data are told apart first
    begin = F.when(F.col("last_day").isNull(), F.to_date(F.lit(start))).otherwise(
        F.least(F.date_add("last_day", 1), F.date_sub(today, refresh_days)))
    return plan.withColumns({"fetch_from": begin, "fetch_to": end}).withColumn(
        "action", F.when(F.col("last_day").isNull(), "full").when(F.col("fetch_from") <= F.col("fetch_to"), "refresh").otherwise("skip"))


def trim_range(rows: DataFrame, date: str, start: Column, end: Column, counts: Observation | None = None) -> DataFrame:
    """Rows inside a date range, ends included; rows without a date go.

    ``counts`` gets ``kept`` and ``dropped`` while the rows pass, without a second reading: ask it after the rows are written.
    """
    inside = F.coalesce((F.col(date) >= start) & (F.col(date) <= end), F.lit(False))
    if counts is not None:
        rows = rows.observe(counts, F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))
    return rows.filter(inside)


def upsert(existing: DataFrame, arriving: DataFrame, key: list[str]) -> DataFrame:
    """Merge with last write winning per key; a repeated key inside the arriving rows is settled by ``arrival``."""
    old = existing.withColumn("_gen", F.lit(0))
    new = arriving.withColumn("_gen", F.lit(1))
    for name in ("arrival",):
        if name not in existing.columns:
            old = old.withColumn(name, F.lit(0).cast("bigint"))
        if name not in arriving.columns:
            new = new.withColumn(name, F.lit(0).cast("bigint"))
    merged = series.keep_last(old.unionByName(new, allowMissingColumns=True), key, ["_gen", "arrival"])
    return merged.drop("_gen") if "arrival" in existing.columns else merged.drop("_gen", "arrival")


def apply_arrivals(existing: DataFrame, arriving: DataFrame, plan: DataFrame, entity: str, date: str, today: Column,
                   preliminary_days: int = 7) -> DataFrame:
    """One refresh: trim arrivals to the planned range, tag their provenance by age, and merge them over the old rows.

    ``arriving`` are payload rows (see ``sources.readers.read_payload``); ``plan`` comes from ``fetch_plan``.  Entities
    the plan skips keep their rows untouched.
    """
    ranges = plan.filter(F.col("action") != "skip").select(entity, "fetch_from", "fetch_to")
    inside = arriving.join(ranges, entity).filter(F.col(date).between(F.col("fetch_from"), F.col("fetch_to")))
    tagged = inside.drop("fetch_from", "fetch_to").withColumn("source", cal.provenance_tag(date, today, preliminary_days))
    return upsert(existing, tagged, [entity, date])


def late_entities(updated: DataFrame, expected: DataFrame, entity: str) -> DataFrame:
    """Expected entities that were not updated."""
    return expected.select(entity).distinct().join(updated.select(entity).distinct(), entity, "left_anti")


def freshness(rows: DataFrame, entity: str, date: str, today: Column) -> DataFrame:
    """Last day, age in days and number of days per entity."""
    return rows.groupBy(entity).agg(F.max(F.to_date(date)).alias("last_day"), F.count_distinct(F.to_date(date)).alias("n_days")).withColumn(
        "age_days", F.datediff(today, "last_day"))


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _replace(df: DataFrame, path: str, partition: str) -> None:
    """Write the partitions that the rows lie in; running it twice gives the same files."""
    df.write.mode("overwrite").partitionBy(partition).option("partitionOverwriteMode", "dynamic").parquet(path)


def touched_rows(table: DataFrame, partition: str, batch: DataFrame) -> DataFrame:
    """Rows of the table's partitions that a batch touches; the values stand in the plan, so no other partition is read."""
    return table.filter(F.col(partition).isin([r[0] for r in batch.select(F.col(partition).cast("string")).distinct().collect()]))


def upsert_into(table_path: str, key: list[str], partition: str, event_time: str, late: str = "15 days", order: str = "arrival"):
    """``foreachBatch`` function that merges a micro-batch into a Parquet table, one partition value at a time.

    Only the partitions the batch touches are read and rewritten.  Rows that are younger in arrival win.  A row that lies more than
    ``late`` behind the newest row its own entity (``key[0]``) had before the batch is refused: it goes to ``<table>.refused`` instead.  A new
    entity, or one that lags behind the others, is never refused.  ``<table>.newest`` holds one row per entity, in ``BUCKETS`` buckets of which
    a batch rewrites those it touches: the newest event time, the batch that brought it, and the newest before that batch.  So a batch that
    runs twice sees what it saw the first time, and the table grows with the entities, not with the batches.
    """
    from ..session import materialize

    entity, newest_path, refused_path = key[0], f"{table_path}.newest", f"{table_path}.refused"
    bucket = F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch)
        newest = _read_or_none(spark, newest_path)
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        known = None
        if newest is not None:
            earlier = F.when(F.col("batch") < number, F.col("newest")).otherwise(F.col("before"))
            known = newest.filter(F.col("bucket").isin(touched)).withColumn("_last", earlier)
            dated = batch.join(known.select(entity, "_last"), entity, "left").withColumn(
                "_late", F.coalesce(F.col(event_time) < F.col("_last") - F.expr(f"INTERVAL {late}"), F.lit(False)))
            dated = materialize(dated)
            refused = dated.filter("_late").drop("_late", "_last").withColumn("batch", F.lit(number))
            if not refused.isEmpty():
                _replace(refused, refused_path, "batch")
            batch = dated.filter("NOT _late").drop("_late", "_last")
        fresh = batch.groupBy(entity).agg(F.max(event_time).alias("_fresh"))
        rows = series.keep_last(batch, key, [order])
        have = _read_or_none(spark, table_path)
        if have is not None:
            rows = series.keep_last(touched_rows(have, partition, batch).select(*batch.columns).unionByName(rows), key, [order])
        _replace(materialize(rows), table_path, partition)
        if known is None:
            state = fresh.select(entity, F.col("_fresh").alias("newest"), F.lit(None).cast(fresh.schema["_fresh"].dataType).alias("before"), F.lit(number).cast("long").alias("batch"))
        else:
            both, there = known.join(fresh, entity, "full_outer"), F.col("_fresh").isNotNull()
            state = both.select(entity, F.when(there, F.greatest("_last", "_fresh")).otherwise(F.col("newest")).alias("newest"),
                                F.when(there, F.col("_last")).otherwise(F.col("before")).alias("before"), F.when(there, F.lit(number)).otherwise(F.col("batch")).alias("batch"))
        _replace(materialize(state.withColumn("bucket", bucket)), newest_path, "bucket")
    return merge


def refused_rows(spark: SparkSession, table_path: str) -> DataFrame | None:
    """Rows that came too late, with their batch; None if there were none."""
    return _read_or_none(spark, f"{table_path}.refused")


def upsert_stream(rows: DataFrame, table_path: str, checkpoint: str, key: list[str], event_time: str, partition: str,
                  late: str = "15 days"):
    """Start the streaming upsert over all available input; see ``upsert_into`` for rows that come too late.

    Re-delivered rows need no state of their own: merging a row twice changes nothing.
    """
    return (rows.writeStream.foreachBatch(upsert_into(table_path, key, partition, event_time, late)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
