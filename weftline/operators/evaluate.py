"""Retrieval metrics, annotation agreement, audits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.knn import BLOCK_ROWS, DIGITS, QUERY_ROWS


def eval_queries(garments: DataFrame, least: int = 2) -> DataFrame:
    """One per garment of an outfit with ``least`` garments or more: ``qid, outfit_id, category, truth``."""
    g = garments.select("garment_id", "outfit_id", "category")
    sizes = g.groupBy("outfit_id").count().where(F.col("count") >= least).select("outfit_id")
    own = g.join(sizes, "outfit_id", "left_semi")
    other = own.select("outfit_id", F.col("garment_id").alias("gid"))
    truth = own.join(other, "outfit_id").where("garment_id <> gid").groupBy("garment_id").agg(F.array_sort(F.collect_list("gid")).alias("truth"))
    return own.join(truth, "garment_id", "left").select(F.col("garment_id").alias("qid"), "outfit_id", "category", F.coalesce("truth", F.array().cast("array<bigint>")).alias("truth"))


def evaluate(garments: DataFrame, k_values: tuple[int, ...] = (1, 5, 10), mode: str = "cooccurrence", mrr_at: int | None = None, target_categories: tuple[str, ...] | None = None) -> DataFrame:
    """Per category and overall (``category`` null): queries, hit@k, mean reciprocal rank over the queries
    that have candidates: at any rank, or with ranks beyond ``mrr_at`` counted as no hit. Candidates are
    of other categories than the query's, or of ``target_categories`` where they are given.

    ``reference`` leaves the query's own outfit out of the candidates, so nothing can be found and
    every figure is 0; ``cooccurrence`` keeps it, leaving out the query alone.
    """
    if mode not in ("reference", "cooccurrence"):
        raise ValueError(f"unknown mode {mode}")
    q = eval_queries(garments)
    group = "outfit_id" if mode == "reference" else "garment_id"
    own = "outfit_id" if mode == "reference" else "qid"
    pool = garments if target_categories is None else garments.where(F.col("category").isin(*target_categories))
    vectors = pool.select("garment_id", F.col(group).alias("cgroup"), F.coalesce("category", F.lit("")).alias("tag"), "e")
    not_tag = F.coalesce("category", F.lit("\0")) if target_categories is None else F.lit("\0")
    asks = q.join(garments.select(F.col("garment_id").alias("qid"), "e"), "qid").select("qid", F.col(own).alias("qgroup"), not_tag.alias("not_tag"), "e")
    hits = q.select("qid", F.explode("truth").alias("cid")).join(vectors.select(F.col("garment_id").alias("cid"), "cgroup", "tag", F.col("e").alias("ce")), "cid")
    ranks = first_ranks(asks, vectors.withColumnRenamed("garment_id", "cid"), hits)
    rows = q.select("qid", "category").join(ranks, "qid", "left")
    met = F.coalesce("candidates", F.lit(0)) > 0
    rank = F.when(F.col("first") > 0, F.col("first"))
    counted = rank if mrr_at is None else F.when(rank <= mrr_at, rank)
    measures = [F.count(F.lit(1)).alias("n_queries"), *(F.avg(F.coalesce(rank <= x, F.lit(False)).cast("double")).alias(f"hit_at_{x}") for x in k_values), F.coalesce(F.avg(F.when(met, F.coalesce(1 / counted, F.lit(0.0)))), F.lit(0.0)).alias("mrr")]
    return rows.groupBy("category").agg(*measures).unionByName(rows.agg(*measures).withColumn("category", F.lit(None).cast("string")))


def first_ranks(asks: DataFrame, candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """``qid, candidates, first``: how many candidates a query has, and the rank of its best hit among all
    of them (null without one). The best hit is found first, then the candidates above it are counted in
    blocks; equal similarities rank by cid.

    ``asks``: qid, qgroup, not_tag, e as in ``top_k``; ``candidates``: cid, cgroup, tag, e; ``hits``: qid,
    cid, cgroup, tag, ce.
    """
    held = hits.join(asks, "qid").where("cgroup <> qgroup and tag <> not_tag").select("qid", "cid", "e", "ce")
    schema = "qid long, candidates long, above long"

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            s = [np.round(np.asarray(a, np.float64) @ np.asarray(b, np.float64), DIGITS) for a, b in zip(x.e, x.ce, strict=True)]
            yield pd.DataFrame({"qid": x.qid, "cid": x.cid, "s": np.array(s, np.float64)})

    best = held.mapInPandas(scored, "qid long, cid long, s double").groupBy("qid").agg(F.min(F.struct((-F.col("s")).alias("low"), "cid")).alias("b"))
    q = asks.join(best.select("qid", (-F.col("b.low")).alias("s"), F.col("b.cid").alias("hit")), "qid", "left")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"qid": np.zeros(0, np.int64), "candidates": np.zeros(0, np.int64), "above": np.zeros(0, np.int64)})]
        if len(a) and len(b):
            m, ids = np.stack(b.e.to_numpy()).astype(np.float64), b.cid.to_numpy()
            for at in range(0, len(a), QUERY_ROWS):
                x = a.iloc[at : at + QUERY_ROWS]
                sims = np.round(np.stack(x.e.to_numpy()).astype(np.float64) @ m.T, DIGITS)
                free = (b.cgroup.to_numpy()[None] != x.qgroup.to_numpy()[:, None]) & (b.tag.to_numpy()[None] != x.not_tag.to_numpy()[:, None])
                s, hit = x.s.to_numpy(np.float64)[:, None], x.hit.fillna(-1).to_numpy(np.int64)[:, None]
                above = free & ((sims > s) | ((sims == s) & (ids[None] < hit)))
                parts.append(pd.DataFrame({"qid": x.qid.to_numpy(), "candidates": free.sum(1), "above": above.sum(1)}))
        return pd.concat(parts)

    blocks = lambda t: max(1, -(-t.count() // BLOCK_ROWS))
    qb, cb = blocks(asks), blocks(candidates)
    c = candidates.select(*(F.col(x).alias(x) for x in candidates.columns))  # the sides may come from one table
    left = q.select("*", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("cb"))
    right = c.select("*", F.pmod(F.xxhash64("cid"), F.lit(cb)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    counts = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(meet, schema)
    counts = counts.groupBy("qid").agg(F.sum("candidates").alias("candidates"), F.sum("above").alias("above"))
    return counts.join(best.select("qid", F.lit(1).alias("found")), "qid", "left").select("qid", "candidates", F.when(F.col("found") == 1, F.col("above") + 1).alias("first"))


def compare_models(scores: dict[str, DataFrame], axes: list[str]) -> DataFrame:
    """``model, axis, lo, hi, mean, sd, width`` of each model's scores (wide tables with a row_id)."""
    rows = [t.unpivot(["row_id"], axes, "axis", "score").withColumn("model", F.lit(m)) for m, t in scores.items()]
    s = F.col("score")
    return reduce(DataFrame.unionByName, rows).groupBy("model", "axis").agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), (F.max(s) - F.min(s)).alias("width"))


def agreement(annotations: DataFrame, scores_long: DataFrame) -> DataFrame:
    """Per axis: agree, disagree, evaluated, accuracy. Ties and blanks are skipped; equal scores and
    NaN disagree; rows whose images lack a score drop out."""
    a = scores_long.select(F.col("row_id").alias("image_a_row_id"), "axis", F.col("score").alias("sa"))
    b = scores_long.select(F.col("row_id").alias("image_b_row_id"), "axis", F.col("score").alias("sb"))
    rows = annotations.where(F.col("choice").isin("a", "b")).join(a, ["image_a_row_id", "axis"]).join(b, ["image_b_row_id", "axis"])
    number = ~F.isnan("sa") & ~F.isnan("sb")
    agree = number & F.when(F.col("choice") == "a", F.col("sa") > F.col("sb")).otherwise(F.col("sb") > F.col("sa"))
    out = rows.groupBy("axis").agg(F.count_if(agree).alias("agree"), F.count_if(~agree).alias("disagree"))
    n = F.col("agree") + F.col("disagree")
    return out.select("*", n.alias("n_evaluated"), F.when(n > 0, F.col("agree") / n).otherwise(0.0).alias("accuracy"))


def low_scores(records: DataFrame, score: str = "image_outfit_score", quantile: float = 0.05, floor: float = 0.15) -> DataFrame:
    """Rows at or under the larger of the quantile and the floor."""
    rows = records.where(F.col(score).isNotNull() & ~F.isnan(score))
    limit = rows.agg(F.greatest(F.percentile(score, F.lit(quantile)), F.lit(floor)).alias("limit"))
    return rows.crossJoin(F.broadcast(limit)).where(F.col(score) <= F.col("limit")).select("row_id", score, "limit")


def images_without_garments(records: DataFrame, garments: DataFrame) -> DataFrame:
    return records.select("row_id").join(garments.select(F.col("outfit_id").alias("row_id")).distinct(), "row_id", "left_anti")


def axis_score_problems(scores: DataFrame, records: DataFrame) -> DataFrame:
    """``row_id, problem``: rows that scores or records lack. Scores need a row_id and an axis besides."""
    if "row_id" not in scores.columns:
        raise ValueError("scores need a row_id")
    if len(scores.columns) < 2:
        raise ValueError("scores need an axis")
    a, b = scores.select("row_id").distinct(), records.select("row_id").distinct()
    return b.join(a, "row_id", "left_anti").select("row_id", F.lit("no score").alias("problem")).union(a.join(b, "row_id", "left_anti").select("row_id", F.lit("no record").alias("problem")))


GARMENT_COLUMNS = ("outfit_id", "garment_id", "category", "crop_path")


def garment_problems(garments: DataFrame, records: DataFrame, required: tuple[str, ...] = ("outfit_id", "garment_id")) -> DataFrame:
    """``garment_id, problem``: outfits that no record has, ids given twice. ``required`` columns must be there
    (GARMENT_COLUMNS for a whole bundle)."""
    absent = [c for c in required if c not in garments.columns]
    if absent:
        raise ValueError(f"garments lack {', '.join(absent)}")
    known = records.select(F.col("row_id").alias("outfit_id")).distinct()
    lost = garments.join(known, "outfit_id", "left_anti").select("garment_id", F.lit("unknown outfit").alias("problem"))
    twice = garments.groupBy("garment_id").count().where("count > 1").select("garment_id", F.lit("repeated id").alias("problem"))
    return lost.union(twice)


def small_clusters(clusters: DataFrame, least: int = 3) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") < least)


def failure_report(cases: list[DataFrame]) -> DataFrame:
    """One row per case (``category, severity, row_id``): how many, and its first 20 ids; errors first."""
    rows = reduce(DataFrame.unionByName, cases)
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    # the rank's limit is applied before the shuffle, so a case with very many rows is no single task's work
    w = Window.partitionBy("category", "severity").orderBy("row_id")
    first = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 20").groupBy("category", "severity").agg(F.array_sort(F.collect_list("row_id")).alias("examples"))
    out = rows.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n")).join(first, ["category", "severity"])
    return out.orderBy(order, "category")
