"""The folder that driver and executors share, and tables in it that cut lineages."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Upper bound of the bytes of an Arrow batch of texts.
BATCH_BYTES = 8 << 20

#: Rows that a task gets of a table that is dealt out by its size.
TASK_ROWS = 250_000

_folders: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder of a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return _folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass


def bounded_batches(df: DataFrame) -> DataFrame:
    """Bounds what one Arrow batch may hold for what reads texts in Python, so that long ones do not fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deals a table out by its keys to as many tasks as ``rows`` ask for.

    Adaptive execution leaves these partitions as they are, so what a task holds does not grow with the table.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared(spark)}/spanloom/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
