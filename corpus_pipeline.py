"""A corpus pipeline of five operators: quality, near duplicates, passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and all but
the last return the columns of ``documents``. Tables are written as Parquet between stages, and executors give
back heap before each stage.

Defined cases are those of the operators, and of each stage: a text that is null or empty scores 0 and goes
in ``quality``, ties at 0.5 stay; ``near_duplicates`` keeps the smallest doc_id of a group, one row of each
repeated doc_id and every row without one; ``passages`` leaves rows without a doc_id as they are and
drops texts of which nothing is left; ``decontaminate`` judges every row by its own text; an empty table
stays empty; columns beyond those of ``documents`` are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import jaccard_groups, knn_quality, pack_pow2, paragraph_dedup, queries, scratch, spaced_seeds

#: Id lists of at most so many rows are broadcast, longer ones joined by key.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """``docs`` whose ``key`` is not among ``ids`` (null too)."""
    own = scratch.free_name(docs, "gone")
    gone = scratch.save(ids.select(F.col(key).alias(own)).distinct(), name)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, F.col(key).eqNullSafe(F.col(own)), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    scratch.give_back_heap(spark)
    model = queries.quality_model(docs, spark, sf_dir)
    return docs.where(knn_quality.scores(docs, model, F.col("text")) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked ones."""
    scratch.give_back_heap(spark)
    joined = scratch.save(jaccard_groups.join(docs), "components")
    kept = _without(docs, joined.where("doc_id <> component_id").select("doc_id"), "near-duplicates")
    repeated = scratch.save(joined.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    return _without(kept, repeated, "repeated").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds."""
    scratch.give_back_heap(spark)
    return paragraph_dedup.cut(docs, scratch.save(paragraph_dedup.find(docs), "passages"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows that share a doc_id, or have none, are judged by their
    own texts."""
    scratch.give_back_heap(spark)
    key = scratch.free_name(docs, "row")
    marked = docs.withColumn(key, F.struct("doc_id", F.sha1(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text")))
    leaks = spaced_seeds.find(marked.select(key, "text"), queries.table(spark, sf_dir, "benchmark"), doc_id=key)
    return _without(marked, leaks.select(F.col("doc_id").alias(key)), "leaks", key).drop(key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per power-of-two piece, with its ids."""
    scratch.give_back_heap(spark)
    pieces = pack_pow2.pack(docs, queries.tokenizer("word_bpe_49k.json"), end_id=2)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Neither the neighbour votes nor the token ids can be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
