"""Readers: declared schemas, station files, payloads, grids, tiles, spreadsheet cells."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Descriptor type names.
DESCRIPTOR_TYPES = {"string": T.StringType(), "integer": T.IntegerType(), "number": T.DoubleType(),
                    "date": T.DateType(), "year": T.IntegerType(), "datetime": T.TimestampType(),
                    "boolean": T.BooleanType()}


def schema_from_descriptor(text: str) -> dict[str, T.StructType]:
    """Schemas of a tabular package descriptor (YAML): resource name -> StructType with title and unit metadata."""
    out = {}
    for resource in yaml.safe_load(text).get("resources", []):
        fields = resource.get("schema", {}).get("fields")
        if fields is None:
            raise ValueError(f"resource {resource.get('name')!r} declares no fields")
        out[resource["name"]] = T.StructType([
            T.StructField(f["name"], DESCRIPTOR_TYPES[f.get("type", "string")], True,
                          {k: f[k] for k in ("title", "unit", "description") if k in f}) for f in fields])
    return out


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and head, the first line of each file that has one.

    A task reads a file's first block in one go, from its begin, so the head is the row where the file changes.  An aggregate by file would
    sort all lines of the block, each with its path, since a text is no fixed-width buffer.
    """
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            runs = batch.column(0).to_numpy(zero_copy_only=False)
            begins = [0, *((runs[1:] != runs[:-1]).nonzero()[0] + 1).tolist()] if len(runs) else []
            if begins and runs[0] == last:
                del begins[0]
            if begins:
                yield batch.take(pa.array(begins))
            last = runs[-1] if len(runs) else last

    lines = spark.read.text(path).filter("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("head"))
    return lines.mapInArrow(heads, "file string, head string")


def read_station_files(spark: SparkSession, path: str, schema: T.StructType, default_source: str = "era5",
                       strict: bool = True) -> DataFrame:
    """Union of daily CSV files with their file name; columns are found by the names in each file's header line.

    Files may order their columns differently; a column that a file lacks is null (``source``: the default), and one that the schema does
    not have is left out.  Files with equal headers are read together.  A malformed value fails the job if ``strict``; else it is null
    and the whole line stands in ``corrupt``, for ``corrupt_rows``.
    """
    names = schema.fieldNames()
    heads = first_lines(spark, path).groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    frames = []
    for r in heads:
        columns = [c.strip().strip('"').removeprefix("\ufeff") for c in (r["head"] or "").split(",")]
        declared = T.StructType([T.StructField(c, schema[c].dataType if c in names else T.StringType()) for c in columns])
        read = spark.read.option("header", True).option("enforceSchema", False).option("dateFormat", "yyyy-MM-dd")
        if strict:
            df = read.schema(declared).option("mode", "FAILFAST").csv(r["files"])
        else:
            df = read.schema(declared.add("corrupt", T.StringType())).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").csv(r["files"])
            # the mark names every column, so that none is skipped when only the mark is asked for
            every = F.substring(F.concat_ws("", *[F.col(c).cast("string") for c in columns]), 1, 0)
            df = df.withColumn("corrupt", F.when(F.col("corrupt").isNotNull(), F.concat("corrupt", every)))
        have = [F.col(c) if c in columns else F.lit(None).cast(schema[c].dataType).alias(c) for c in names]
        frames.append(df.select(*have, F.col("_metadata.file_name").alias("file_name"), *([] if strict else ["corrupt"])))
    if not frames:
        empty = schema.add("file_name", T.StringType()) if strict else schema.add("file_name", T.StringType()).add("corrupt", T.StringType())
        return spark.createDataFrame([], empty)
    return read_union(frames, {"source": default_source})


def corrupt_rows(rows: DataFrame) -> DataFrame:
    """file_name and line of every row that ``read_station_files`` could not read completely."""
    return rows.filter("corrupt IS NOT NULL").select("file_name", F.col("corrupt").alias("line"))


def read_union(frames: list[DataFrame], defaults: dict[str, str]) -> DataFrame:
    """Union by name where some frames lack a column; the missing values take a default."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def columns_for(features: dict[str, bool], base: list[str], optional: dict[str, list[str]]) -> list[str]:
    """Column list from feature flags."""
    return base + [c for flag, cols in optional.items() if features.get(flag) for c in cols]


def rows_from_columns(df: DataFrame, key: list[str], arrays: list[str]) -> DataFrame:
    """Parallel value arrays of a payload to rows."""
    return (df.select(*key, F.explode(F.arrays_zip(*arrays)).alias("_z"))
            .select(*key, *[F.col("_z")[a].alias(a) for a in arrays]))


def read_payload(df: DataFrame, text: str, key: list[str], schema: str, arrays: list[str]) -> DataFrame:
    """JSON text with parallel arrays to rows; ``schema`` is the DDL of the document."""
    parsed = df.select(*key, F.from_json(text, schema, {"mode": "FAILFAST"}).alias("_j")).select(*key, "_j.*")
    return rows_from_columns(parsed, key, arrays)


def station_dimension(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Configured entities; a local relation, so its size is known to the planner."""
    names = [part.split()[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def newest_files(spark: SparkSession, path: str, pattern: str, group: int = 1) -> DataFrame:
    """Newest file per name group, from file metadata only."""
    meta = (spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length"))
    name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, group)
    return newest_version(meta.withColumn("name", name).filter("name != ''"), ["name"], "modificationTime", ["path", "length"])


def newest_version(df: DataFrame, key: list[str], stamp: str, columns: list[str]) -> DataFrame:
    """Latest version per key by a map-side combinable aggregate."""
    return (df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(stamp, *columns)).alias("_r"), F.max(stamp).alias(stamp))
            .select(*key, stamp, *[F.col("_r")[c].alias(c) for c in columns]))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Name and sha1 of every file under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha1("content").alias("sha1"))


def ascii_grid_cells(df: DataFrame, text: str, key: list[str], header: int = 6) -> DataFrame:
    """Whole-file ASCII grids to cells (x, y from the top, value); the header lines are skipped."""
    lines = F.slice(F.split(F.regexp_replace(F.col(text), r"\s+$", ""), r"\r?\n"), header + 1, 2_000_000_000)
    rows = df.select(*key, F.posexplode(lines).alias("y", "_line"))
    cells = F.split(F.trim(F.col("_line")), r"\s+")
    return (rows.select(*key, "y", F.posexplode(cells).alias("x", "_v"))
            .select(*key, "x", "y", F.col("_v").cast("double").alias("value")))


def read_ascii_grids(spark: SparkSession, path: str, header: int = 6) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    return ascii_grid_cells(files, "value", ["file_name"], header)


def global_cells(df: DataFrame, tile: int = 256) -> DataFrame:
    """Tile and pixel numbers to one grid (gx, gy)."""
    return df.withColumns({"gx": F.col("tile_x") * tile + F.col("px"), "gy": F.col("tile_y") * tile + F.col("py")})


def crop_cells(df: DataFrame, west: int, east: int, north: int, south: int) -> DataFrame:
    """Cells with west <= gx < east and north <= gy < south, renumbered from the north-west corner."""
    return (df.filter((F.col("gx") >= west) & (F.col("gx") < east) & (F.col("gy") >= north) & (F.col("gy") < south))
            .withColumns({"gx": F.col("gx") - west, "gy": F.col("gy") - north}))


def map_elements(df: DataFrame, text: str, key: list[str], default_type: str = "yes") -> DataFrame:
    """Map elements (JSON) to centroids: own position, else the center's; elements without a position are dropped."""
    schema = ("elements array<struct<type:string,id:bigint,lat:double,lon:double,"
              "center:struct<lat:double,lon:double>,tags:map<string,string>>>")
    e = df.select(*key, F.explode(F.from_json(text, schema)["elements"]).alias("e"))
    kind = F.coalesce(F.try_element_at(F.col("e")["tags"], F.lit("building")), F.lit(default_type))
    return (e.select(*key, F.coalesce(F.col("e")["lat"], F.col("e")["center"]["lat"]).alias("lat"),
                     F.coalesce(F.col("e")["lon"], F.col("e")["center"]["lon"]).alias("lon"), kind.alias("type"))
            .na.drop(subset=["lat", "lon"]))


def cells_at(df: DataFrame, rows: Column, cols: Column, value: str = "raw", name: str = "value") -> DataFrame:
    """Spreadsheet cells at fixed positions; text that is no number becomes null."""
    return df.filter(rows & cols).withColumn(name, F.col(value).try_cast("double"))


def block(df: DataFrame, row_from: int, row_to: int, col_from: int, col_to: int, value: str = "raw",
          name: str = "value") -> DataFrame:
    """A fixed range (ends excluded) with positions counted from its corner."""
    inside = cells_at(df, F.col("row").between(row_from, row_to - 1), F.col("col").between(col_from, col_to - 1), value, name)
    return inside.withColumns({"row": F.col("row") - row_from, "col": F.col("col") - col_from})


def files_like(df: DataFrame, name: str, pattern: str = r"^SVN_\d{4}_\d{4}.*", suffix: str = ".xlsx") -> DataFrame:
    return df.filter(F.lower(F.col(name)).endswith(suffix) & F.col(name).rlike(pattern))


def station_rows(df: DataFrame, allowed: list[str], today: Column, rate: float = 0.0065) -> DataFrame:
    """Raw station rows ready for the derived tables: no future rows, calendar parts, lapse-corrected temperatures.

    A provenance value outside the allow-list fails the job instead of flowing on.
    """
    guard = F.when(F.col("source").isin(allowed), F.col("source")).otherwise(
        F.raise_error(F.concat(F.lit("unrecognised source value: "), F.coalesce("source", F.lit("null")))).cast("string"))
    out = df.filter(F.col("date") <= today).withColumn("source", guard)
    return out.withColumns({
        "year": F.year("date"), "month": F.month("date"),
        **{f"{c}_corr": F.col(c) + F.col("elevation_diff_m") * rate
           for c in ("temperature_max", "temperature_min", "temperature_mean")}})
