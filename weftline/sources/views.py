"""Engine relations derived from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import vectors

CATEGORIES = ("top", "bottom", "dress", "outer", "shoes", "hat", "bag")
#: Captions that reach every branch of scorer and filter.
CAPTIONS = (
    "street style outfit", "a woman in a red dress", "Model wearing a blazer", "dressed up in silk", "catalogue price list", "what i wore today",
    "the man ", "leather jacket", "surgical coat", "a dog with a hat", "fashion blog portrait", "just a landscape", "", None, "streetwear hoodie girl on sale, discount price",
    "half-dressed undress", "Lady in a gown at the runway", "   ",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("caption"), "source", F.col("n_chars").alias("width"))


def templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose captions come from CAPTIONS, most followed by a part's name."""
    p = table(spark, sf_dir, "part")
    t = F.get(F.array(*map(F.lit, CAPTIONS)), (F.col("p_partkey") % len(CAPTIONS)).cast("int"))
    return p.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 2 == 0, t).otherwise(F.concat(t, F.lit(" "), "p_name")).alias("caption"), (F.col("p_size") * 20).alias("width"), (F.col("p_partkey") % 1000).alias("height"), F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("http://x/"), F.col("p_partkey") % 700)).otherwise("").alias("url"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("cluster_id"), vectors.doubles(F.col("embedding")).alias("e"))


def garments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, n = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    return v.select(
        n.alias("garment_id"),
        F.expr("vec_id div 3").alias("outfit_id"),
        F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("label") % 7).cast("int")).alias("category"),
        F.when(n % 11 != 0, (n * 37 % 100) / 100.0).alias("confidence"),
        F.format_string("garment_crops/%06d.jpg", n).alias("crop_path"),
        vectors.doubles(F.col("embedding")).alias("e"),
    )
