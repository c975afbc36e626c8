"""Files and folders under any scheme that Spark reads, through Hadoop's file systems.

Only small things go through the driver (a manifest, one page); tables and listings stay DataFrames.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="weftline-engine-")
    return _LOCAL[key]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver ends."""
    path = f"{shared(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    """Best effort, and without a session: it may have ended."""
    import pyarrow.fs as pafs

    with contextlib.suppress(Exception):
        fs, inner = (pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else pafs.FileSystem.from_uri(path)
        if fs.get_file_info(inner).type != pafs.FileType.NotFound:
            fs.delete_dir(inner)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: one deal of its rows, whatever executor is lost."""
    path = fresh(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def qualified(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    return fs.makeQualified(p).toString()


def write(spark: SparkSession, path: str, data: bytes | str) -> None:
    """One file, overwritten."""
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).head()
    return row.value if row else ""


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` (relative), ``size`` of every file below a folder, listed by Spark without reading contents.
    Spark passes over names that begin with ``_`` or ``.``."""
    root = qualified(spark, folder).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.expr(f"substring(path, {len(root) + 1})").alias("path"), F.col("length").alias("size"))
