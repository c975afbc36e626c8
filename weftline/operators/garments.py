"""Garment regions as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_regions(images: DataFrame) -> DataFrame:
    """Upper and lower part of every image of at least 20 pixels a side: ``row_id, category, x, y, w, h``."""
    w, h = F.col("width"), F.col("height")
    top = F.greatest(F.lit(1), F.floor(h * 0.55)).cast("int")
    low = F.floor(h * 0.40).cast("int")
    box = lambda name, y, hh: F.struct(F.lit(name).alias("category"), F.lit(0).alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), hh.cast("int").alias("h"))
    rows = images.where((w >= 20) & (h >= 20)).select("row_id", F.explode(F.array(box("upper", F.lit(0), top), box("lower", low, h - low))).alias("r"))
    return rows.select("row_id", "r.*")


def clamp(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """A box cut to the image; at least one pixel."""
    x0, y0 = F.greatest(F.lit(0), box["x"]), F.greatest(F.lit(0), box["y"])
    x1, y1 = F.least(width, box["x"] + box["w"]), F.least(height, box["y"] + box["h"])
    return {"x0": x0, "y0": y0, "x1": F.greatest(x0 + 1, x1), "y1": F.greatest(y0 + 1, y1)}


def thumbnail_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Long edge at most ``most``, never larger than the image, aspect kept."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.greatest(F.lit(1), F.round(width * scale)).cast("int"), F.greatest(F.lit(1), F.round(height * scale)).cast("int")


def with_garment_ids(regions: DataFrame) -> DataFrame:
    """Running ids in the order of image and region."""
    from weftline.operators.curate import with_position

    return with_position(regions, "row_id", "category").withColumnRenamed("position", "garment_id")


def phash_bits(v: Column) -> Column:
    """A bit per pair of neighbours: whether the right one is larger."""
    pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.when(b > a, F.lit("1")).otherwise(F.lit("0")))
    return F.array_join(pairs, "")
