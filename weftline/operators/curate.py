"""Scoring, filtering, ranking and summarising captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import folders
from weftline.functions import lexicon as lx


def scored(records: DataFrame, lexicon: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Adds ``caption_score``, ``excluded`` and ``excluded_term``; one map."""
    s = records.withColumn("_low", F.lower("caption")).withColumn("_s", lx.score_caption(F.col("caption"), lexicon, F.col("_low")))
    return s.select(*records.columns, F.col("_s.score").alias("caption_score"), F.col("_s.excluded").alias("excluded"), F.col("_s.excluded_term").alias("excluded_term"))


def filtered(records: DataFrame, lexicon: lx.Lexicon = lx.DEFAULT, strict: bool = False, mode: str | None = None, min_score: float | None = None) -> DataFrame:
    """Adds ``accepted, reason, matched_term``."""
    low = records.withColumn("_low", F.lower("caption"))
    f = low.withColumn("_f", lx.filter_caption(F.col("caption"), lexicon, strict, lx.resolve_min_score(mode, min_score), F.col("_low")))
    return f.select(*records.columns, "_f.accepted", "_f.reason", "_f.matched_term")


def image_gate(records: DataFrame, min_score: float) -> DataFrame:
    """Rejects rows whose image score is under ``min_score`` or missing."""
    s = F.col("image_outfit_score")
    ok = F.coalesce((s >= min_score) & ~F.isnan(s), F.lit(False))
    shown = F.concat(F.format_string("image_score=%.4f", s), F.lit(f"<{min_score}"))
    return records.select("*", ok.alias("gate_accepted"), F.when(~ok & s.isNotNull(), shown).alias("gate_term"))


def harvest(records: DataFrame, min_score: float = lx.MODES["strict"]) -> DataFrame:
    """Captioned rows with a url and enough score."""
    return scored(records.where("caption <> '' and url <> ''")).where(F.col("caption_score") >= min_score)


def large_enough(records: DataFrame, least: int = 512) -> DataFrame:
    return records.where(F.least("width", "height") >= least)


def diagnostics(filtered_rows: DataFrame) -> DataFrame:
    """One row: scanned, accepted, the count of each reason, accept rate."""
    n, ok = F.count(F.lit(1)), F.count_if("accepted")
    reasons = [F.count_if(F.col("reason") == r).alias(r) for r in ("empty", "excluded", "no_person_context", "no_fashion_signal", "below_score_threshold")]
    return filtered_rows.agg(n.alias("scanned"), ok.alias("n_accepted"), *reasons, (ok / F.greatest(n, F.lit(1))).alias("accept_rate"))


def samples_per_reason(filtered_rows: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` rows of each reason in scan order."""
    w = Window.partitionBy("reason").orderBy("row_id")
    return filtered_rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def score_summary(rows: DataFrame, score: str) -> DataFrame:
    """min, max, mean, count of finite scores."""
    s = F.col(score)
    return rows.where(s.isNotNull() & ~F.isnan(s) & (s > float("-inf"))).agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.avg(s).alias("mean"), F.count(s).alias("n"))


def picked_quartiles(rows: DataFrame, score: str) -> DataFrame:
    """Quartiles by index on the sorted scores: places n//4, n//2, 3n//4. Ranks come from a range
    partitioned sort with offsets, so no task holds all scores."""
    ranked = with_position(rows.where(F.col(score).isNotNull()).select(score), score)
    n = ranked.count()
    at = {"p25": n // 4, "median": n // 2, "p75": 3 * n // 4}
    return ranked.agg(*(F.max(F.when(F.col("position") == k, F.col(score))).alias(name) for name, k in at.items()), F.min(score).alias("lo"), F.max(score).alias("hi"), F.avg(score).alias("mean"))


def quartiles(rows: DataFrame, score: str) -> DataFrame:
    """Interpolated quartiles and mean."""
    p = F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.agg(p.alias("p"), F.avg(score).alias("mean")).select(F.get("p", 0).alias("p25"), F.get("p", 1).alias("median"), F.get("p", 2).alias("p75"), "mean")


def with_position(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Adds ``position`` (from 0) in the order of ``keys``, without one task for all rows: a range
    partitioned sort, a window inside each partition, and the sizes of the partitions before."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).select("*", F.spark_partition_id().alias("_part")).sortWithinPartitions(*keys)
    dealt = folders.durable(dealt)  # sizes and rows must come from the same deal
    before, base = 0, []
    for r in sorted(dealt.groupBy("_part").count().collect()):  # a row per partition
        base.append((r[0], before))
        before += r[1]
    bases = spark.createDataFrame(base, "_part int, _base long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return dealt.join(F.broadcast(bases), "_part").withColumn("position", F.col("_base") + local).drop("_part", "_base")


def scan_until(filtered_rows: DataFrame, n_images: int, candidate_scan: int) -> DataFrame:
    """The accepted rows that a scan in row order takes until it has ``n_images`` or has seen
    ``candidate_scan`` rows, with ``position`` in the scan. Only the rows taken, at most ``n_images``, are
    numbered a second time."""
    seen = with_position(filtered_rows.select("row_id", "accepted"), "row_id").where(F.col("position") < candidate_scan)
    taken = seen.where("accepted").orderBy("position").limit(n_images).withColumnRenamed("position", "scan_position")
    place = F.row_number().over(Window.orderBy("scan_position")) - 1
    return taken.select("row_id", "scan_position", place.cast("long").alias("position"))


def rank_candidates(rows: DataFrame, score: str, n: int) -> DataFrame:
    """The ``n`` best by score (then id), numbered from 0; null and NaN scores drop out."""
    best = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).orderBy(F.desc(score), "row_id").limit(n)
    w = Window.orderBy(F.desc(score), "row_id")  # over at most n rows
    return best.select((F.row_number().over(w) - 1).cast("long").alias("new_row_id"), "row_id", score)
