"""Shared scratch tables and byte files.

Everything that outlives a task goes under ``spark.checkpoint.dir``, which every executor can
reach. Only where that setting is absent *and* Spark runs in local mode (tests) is a temporary
folder used instead.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Python gets batches of at most so many bytes (one row at least), unless the session says otherwise.
BATCH_BYTES = 2 << 20
#: Has Spark delete an execution's shuffle files at its end: what is saved doesn't need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _LOCAL[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    atexit.register(_quietly_remove, path)
    return path


def _quietly_remove(path: str) -> None:
    with contextlib.suppress(Exception):
        remove(path)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._scratch_path = path
    return saved


def discard(*saved: DataFrame) -> None:
    """Delete tables that ``save`` returned, once what was made of them is saved itself."""
    for df in saved:
        _quietly_remove(df._scratch_path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` bears."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; rows alone say little where texts may be very long."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Return this worker's free memory to the system: workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def give_back_heap(spark: SparkSession) -> None:
    """Have every executor's JVM collect its garbage and return the heap that it doesn't need: between long steps
    of one application, else each begins with all that those before it have touched. A task for each core reaches
    every executor, if it is idle."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` in bounded batches, with free memory given back after each task."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI (``file:``, ``hdfs:``, ``s3:``) or a plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, *parts: bytes) -> None:
    """Write one new file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        for part in parts:
            out.write(part)


def remove(uri: str) -> None:
    """Delete a folder if it is there."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)
