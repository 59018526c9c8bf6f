"""Helpers shared by the text operators."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def shard_count(rows: int, per_shard: int) -> int:
    return max(1, math.ceil(rows / per_shard))


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the table has it (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch where rows hold whole texts.
TEXT_ROWS = 500


def text_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch for tables with whole texts, so that a Python worker holds a few megabytes at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))
