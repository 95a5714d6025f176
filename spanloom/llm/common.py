"""What the operators of this subpackage share: table access, lineage cuts, Arrow batching."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Upper bound of the bytes of one Arrow batch sent to a Python worker.
ARROW_BATCH_BYTES = 8 << 20
#: Upper bound of the text bytes that an operator unfolds into Python objects at a time.
CHUNK_BYTES = 1 << 20

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read through Spark's own readers only (the path may be in any store)."""
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bounds what one Arrow batch may hold, so that very long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent a temporary folder takes its place, on a local master alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return _own_dirs[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one. It is removed when the program ends."""
    path = f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    A lost executor costs no recomputation beyond this table.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spanloom_path = path
    return out


def discard(table: DataFrame) -> None:
    """Removes a table of ``written`` before the program ends: nothing that is still to run may read it."""
    _remove(table.sparkSession, table._spanloom_path)


def merged(table: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and never sent whole to the driver, however small it looks.

    Spark takes a table for as large as its files, and no larger after an explode. What is exploded or aggregated
    into structs, and sketches that files hold in a few bytes, can be a hundred times that in memory.
    """
    return table.hint("merge")


def quoted(name: str) -> str:
    """A column's name as it stands, dots and marks included."""
    return "`" + name.replace("`", "``") + "`"


def release() -> None:
    """Gives freed memory back to the system: workers outlive tasks, and an executor's share is small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batch: pa.RecordBatch, column: str | int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``most`` bytes each, one row at least."""
    values = batch.column(column)
    start = size = 0
    for i in range(batch.num_rows):
        value = values[i]
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
    release()
