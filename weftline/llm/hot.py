"""Keys that hold very many rows, so that these needn't come together in one task.

A sample of a fixed size finds the keys that hold a large share of all rows. It decides how rows are dealt,
never which rows count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nodes in a sample, on average at least.
NODES = 8000
#: A key is hot if it holds at least this many rows of the sample (one node in twenty to forty has it); there are
#: at most so many fewer hot keys than rows in the sample.
LEAST = 400


def sampled(node: str, n: int) -> Column:
    """True for about NODES of ``n`` nodes, always the same ones."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(node)), F.lit(max(1, n // NODES))) == 0


def hot_keys(sample: DataFrame, key: str) -> np.ndarray:
    """The hot keys, sorted: at most one for LEAST rows of the sample."""
    rows = sample.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select(key).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64))


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the values are keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values
