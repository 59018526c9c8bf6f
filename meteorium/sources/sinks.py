"""Writers and table inventories."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import quality
from ..session import materialize, remove

# The key columns each derived table is read by.
READ_KEYS = {
    "daily": ["era5_name", "date"], "daily_percentiles": ["station_id", "date"],
    "daily_window": ["era5_name", "month", "day"], "annual_trend": ["era5_name", "variable", "month", "day"],
    "annual_trend_windows": ["era5_name", "variable", "month", "day", "window"], "season_heatmap": ["era5_name", "y"],
    "tropical": ["era5_name", "kind", "threshold", "streak"], "spei": ["x", "y"], "spei_station": ["era5_name", "series"],
}


def write_for_reads(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet laid out for point reads: range-partitioned and sorted by the read keys.

    Each file then covers a narrow key range and its row-group statistics skip almost everything on a lookup.  Range
    partitioning on all keys splits a hot first key over several files.  The result is staged first, because finding the
    ranges reads the rows once more and would otherwise compute them twice.
    """
    materialize(df).repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def stage(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table computed once, into the shared folder, and read from there."""
    return {name: materialize(df) for name, df in tables.items()}


_POINTER = "number bigint, folder string, tables array<string>"


def publish(tables: dict[str, DataFrame], violations: Callable[[dict[str, DataFrame]], DataFrame], root: str) -> int:
    """Replace all derived tables at once, only after every rule passed on the very rows that are written; the new version's number.

    Tables are staged first; ``violations`` gets the staged ones.  Each version has a folder of its own, and a row that names the folder is
    added to the pointer table after the last table is written.  Readers follow the newest row, so they see all old or all new tables:
    a failed rule, or a write that fails half way, leaves the old version as it is.  Old versions stay until ``retire``.
    """
    staged = stage(tables)
    quality.gate(materialize(violations(staged)))
    spark, root = next(iter(staged.values())).sparkSession, root.rstrip("/")
    newest = versions(spark, root).agg(F.max("number")).first()[0]
    number = 1 if newest is None else newest + 1
    folder = f"versions/{number:08d}-{uuid.uuid4().hex[:8]}"
    for name, df in staged.items():
        keys = READ_KEYS.get(name, [])
        laid = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys) if keys else df
        laid.write.parquet(f"{root}/{folder}/{name}")
    spark.createDataFrame([(number, folder, sorted(staged))], _POINTER).coalesce(1).write.mode("append").parquet(f"{root}/published")
    return number


def versions(spark: SparkSession, root: str) -> DataFrame:
    """number, folder and tables of every version that was published whole."""
    try:
        return spark.read.schema(_POINTER).parquet(f"{root.rstrip('/')}/published")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _POINTER)


def published(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest version, or of a given one; two writers that took the same number are told apart by folder."""
    rows = versions(spark, root)
    row = (rows if number is None else rows.filter(F.col("number") == number)).orderBy(F.desc("number"), "folder").first()
    if row is None:
        raise LookupError(f"nothing is published at {root}" if number is None else f"no version {number} at {root}")
    return {name: spark.read.parquet(f"{root.rstrip('/')}/{row['folder']}/{name}") for name in row["tables"]}


def retire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the tables of all but the newest versions; their folders.  Their pointer rows stay, as a history."""
    old = [r["folder"] for r in versions(spark, root).orderBy(F.desc("number"), "folder").collect()[keep:]]
    for folder in old:
        remove(spark, f"{root.rstrip('/')}/{folder}")
    return old


def fixed_decimals(df: DataFrame, digits: int) -> DataFrame:
    """Floating columns as text with a fixed number of decimals; the number's shortest decimal text is rounded half up (1.005 -> 1.01)."""
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))) for c in real})


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with header and empty nulls; nested columns become JSON text."""
    flat = series_as_json(df)
    (fixed_decimals(flat, digits) if digits is not None else flat).write.mode("overwrite").option("header", True).option(
        "nullValue", "").option("emptyValue", "").csv(path)


def series_as_json(df: DataFrame) -> DataFrame:
    """Array and struct columns as JSON text."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def documented(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Attach titles and units of a declared schema to the columns."""
    meta = {f.name: f.metadata for f in schema.fields if f.metadata}
    return df.select(*[F.col(c).alias(c, metadata=meta[c]) if c in meta else F.col(c) for c in df.columns])


def column_documentation(df: DataFrame, table: str) -> DataFrame:
    rows = [(table, f.name, f.dataType.simpleString(), f.metadata.get("title"), f.metadata.get("unit")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "table string, column string, type string, title string, unit string")


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of all tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def stats_document(levels: DataFrame, level: str, columns: list[str]) -> DataFrame:
    """One JSON document: level -> values.  The table has one row per water level, a fixed small number."""
    entry = F.struct(F.col(level).cast("string").alias("key"), F.struct(*columns).alias("value"))
    return levels.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("document"))


def create_commented_table(spark: SparkSession, name: str, df: DataFrame, schema: T.StructType, path: str) -> None:
    """External table whose column comments carry title and unit."""
    parts = []
    for f in df.schema.fields:
        meta = next((s.metadata for s in schema.fields if s.name == f.name), {})
        note = " ".join(str(meta[k]) for k in ("title", "unit") if k in meta).replace("'", "''")
        parts.append(f"`{f.name}` {f.dataType.simpleString()}" + (f" COMMENT '{note}'" if note else ""))
    df.write.mode("overwrite").parquet(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(parts)}) USING parquet LOCATION '{path}'")
