"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings the library is tuned for.  Parallelism is left to the cluster: AQE coalesces small shuffles and splits
#: skewed ones, so the initial partition number only has to be large enough.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def apply_recommended(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables: the one the session names, else a new local one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="meteorium-"))
        current = context.getCheckpointDir()
    return current


#: Paths in the shared folder that were handed out and not released.
_in_use: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _in_use.append(path)
    return path


def scratch_paths() -> list[str]:
    """Paths in use, in the order in which they were handed out."""
    return list(_in_use)


def materialize(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and continue from the files.

    This cuts the lineage and survives the loss of an executor.  Compared with ``checkpoint`` the plan runs once (an eager
    checkpoint runs it a second time to save it), and the files give the planner true sizes and column pruning.  The shuffle
    files of the written plan are of no more use and are removed when the write ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path  # for release
    return out


#: Bytes up to which ``small`` lets a side of a join be sent to all executors.  The driver builds such a side in its heap; two of
#: nearly twice the bound made a heap of 235 MB grow to 407 MB.
SMALL_BYTES = 8 << 20


def small(written: DataFrame, bytes_of_text: int = 64) -> DataFrame:
    """A written result, marked for broadcast if its rows fit ``SMALL_BYTES`` (counted, at eight bytes a number and the given ones a text).

    For joins whose other side holds whole texts: below the bound these need not be shuffled, beyond it both sides are.
    """
    width = sum(16 + (8 if isinstance(f.dataType, T.NumericType | T.BooleanType) else bytes_of_text) for f in written.schema.fields)
    return F.broadcast(written) if written.count() * width <= SMALL_BYTES else written


def release(spark: SparkSession, *written: str | DataFrame) -> None:
    """Delete intermediate results that no plan will read again: paths, or results of ``materialize``."""
    for one in written:
        path = one if isinstance(one, str) else one.scratch
        if path in _in_use:
            _in_use.remove(path)
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark reads it with."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, keys: list[str], at_most: int | None = None) -> DataFrame:
    """Hash rows over at least as many tasks as the cluster has cores.

    For steps whose work per byte is high (fits, density curves, tile solving).  A shuffle with a given number of
    partitions is not merged by adaptive execution, which judges partitions by their bytes only.  ``at_most`` is the
    number of keys where it is known to be small.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(n, at_most)) if at_most is not None else n, *keys)
