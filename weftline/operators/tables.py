"""Joins, dedupes and small relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def locate(ids: DataFrame, shards: DataFrame) -> DataFrame:
    """Range join of ``global_index`` with half-open shards; ``within`` counts from the shard's start.
    Shards are few: their number is checked before they are broadcast, and beyond it the sorted
    shard starts are searched by an as-of join over a union and a window."""
    if shards.count() <= BROADCAST_ROWS:
        s = F.broadcast(shards)
        met = ids.join(s, (F.col("global_index") >= F.col("start_index")) & (F.col("global_index") < F.col("end_index")))
        return met.select("global_index", "tar_path", (F.col("global_index") - F.col("start_index")).alias("within"))
    width = shards.agg(F.max(F.col("end_index") - F.col("start_index"))).head()[0]
    cells = shards.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start_index") / width), F.floor((F.col("end_index") - 1) / width))))
    met = ids.withColumn("_cell", F.floor(F.col("global_index") / width)).join(cells, "_cell")
    met = met.where((F.col("global_index") >= F.col("start_index")) & (F.col("global_index") < F.col("end_index")))
    return met.select("global_index", "tar_path", (F.col("global_index") - F.col("start_index")).alias("within"))


def rewritten_path(path: Column, prefix: str, by: str) -> Column:
    return F.when(path.startswith(prefix), F.concat(F.lit(by), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))).otherwise(path)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows, with ``priority`` the source's place; missing columns become null."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def first_per_key(rows: DataFrame, key: str | Column, *order: str | Column) -> DataFrame:
    """The first row of each key. An aggregation (partial sums first) instead of a window keeps hot keys apart."""
    columns = rows.columns
    lead = F.min_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy((F.col(key) if isinstance(key, str) else key).alias("_key")).agg(lead.alias("_r")).select("_r.*")


def falsy_coalesce(*columns: Column) -> Column:
    """The first value that is neither null nor empty; else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def dense_ids_problems(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Ids missing from 0..n-1 or outside it: ``row_id, problem``."""
    n = rows.count()
    want = rows.sparkSession.range(n).select(F.col("id").alias(key))
    have = rows.select(key).distinct()
    missing = want.join(have, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.union(have.join(want, key, "left_anti").select(key, F.lit("unexpected").alias("problem")))


def file_name(url: Column) -> Column:
    """``laion_<16 hex>.jpeg`` for a url."""
    return F.concat(F.lit("laion_"), F.substring(F.md5(url), 1, 16), F.lit(".jpeg"))


def suffix(url: Column, default: str = ".jpeg") -> Column:
    found = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"^.*/[^/]*[^/.](\.[A-Za-z0-9]+)$", 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def snippet(text: Column, n: int) -> Column:
    """Cut to n characters, then HTML-escaped."""
    t = F.substring(F.coalesce(text, F.lit("")), 1, n)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return t


def sample_pairs(ids: DataFrame, axes: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` unordered pairs of different ids per axis, in a pseudo-random order that any engine can
    repeat: each id meets partners at hashed distances, so no table of all pairs is built."""
    pos = with_dense(ids)
    count = pos.count()
    tries = max(1, -(-4 * n // max(1, count)))
    a = pos.select(F.col("row_id").alias("a"), F.col("dense").alias("i"))
    dealt = a.crossJoin(F.broadcast(ids.sparkSession.createDataFrame([(x, t) for x in axes for t in range(tries)], "axis string, t int")))
    step = F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(seed), "axis", "t", "a")), 1, 8), 16, 10).cast("long")
    met = dealt.withColumn("j", (F.col("i") + 1 + step % F.lit(max(1, count - 1))) % count).where(F.lit(count > 1))
    met = met.join(pos.select(F.col("row_id").alias("b"), F.col("dense").alias("j")), "j")
    pairs = met.select("axis", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    h = F.md5(F.concat_ws(",", F.lit(seed), "axis", "lo", "hi"))
    w = Window.partitionBy("axis").orderBy("h")
    ranked = pairs.withColumn("h", h).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    flip = F.substring("h", 1, 1) < "8"
    return ranked.select("axis", F.when(flip, F.col("lo")).otherwise(F.col("hi")).alias("image_a_row_id"), F.when(flip, F.col("hi")).otherwise(F.col("lo")).alias("image_b_row_id"))


def with_dense(ids: DataFrame) -> DataFrame:
    from weftline.operators.curate import with_position

    return with_position(ids.select("row_id"), "row_id").withColumnRenamed("position", "dense")
