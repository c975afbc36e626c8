"""Scan orders that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.curate import with_position


def scan_order(rows: DataFrame, seed: int, shard: str = "shard", key: str = "global_index") -> DataFrame:
    """Adds ``position``: shards in a hashed order, and each shard's rows in one too."""
    mark = lambda c: F.md5(F.concat_ws(",", F.lit(str(seed)), F.col(c).cast("string")))
    marked = rows.withColumn("_s", mark(shard)).withColumn("_k", mark(key))
    return with_position(marked, "_s", shard, "_k", key).drop("_s", "_k")
