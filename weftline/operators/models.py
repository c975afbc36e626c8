"""Models as Arrow maps: scorers, detectors and embedders that a factory makes once per Python worker.

A factory is any picklable callable without arguments; its product has ``score(images) -> floats``,
``detect(images) -> lists of regions`` or ``embed(images) -> matrix`` over lists of image bytes (or texts).
The test doubles here need no weights and give the same values on every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import vectors
from weftline.operators.curate import with_position

#: Rows that a model gets at once.
ROWS = 64
#: What stands for a missing crop: a black square of this side, three bytes a pixel.
BLANK_SIDE = 64
BLANK = bytes(3 * BLANK_SIDE * BLANK_SIDE)
_MADE: dict = {}


def _model(factory: Callable):
    """One product per worker and factory."""
    key = getattr(factory, "__qualname__", None), repr(factory)
    if key not in _MADE:
        _MADE[key] = factory()
    return _MADE[key]


@dataclass(frozen=True)
class WithFallback:
    """The first factory's product, or the second's where the first can't load."""

    first: Callable
    second: Callable

    def __call__(self):
        try:
            return self.first()
        except Exception:  # whatever a model's loader raises
            return self.second()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def score_images(rows: DataFrame, factory: Callable, key: str = "row_id", content: str = "content") -> DataFrame:
    """``key, image_outfit_score``; a missing image has a null score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(factory)
        for part in _parts(batches):
            images = part.column(1).to_pylist()
            some = [k for k, x in enumerate(images) if x is not None]
            out: list = [None] * len(images)
            for k, s in zip(some, model.score([images[k] for k in some]) if some else [], strict=True):
                out[k] = float(s)
            yield pa.record_batch([part.column(0), pa.array(out, pa.float64())], [key, "image_outfit_score"])

    return rows.select(F.col(key).cast("long").alias(key), content).mapInArrow(run, f"{key} long, image_outfit_score double")


REGIONS = "category string, confidence double, x int, y int, w int, h int"


def detect_regions(rows: DataFrame, factory: Callable, threshold: float = 0.5, key: str = "row_id", content: str = "content") -> DataFrame:
    """A row per region of at least ``threshold`` confidence: key, REGIONS; box corners are cut to integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(factory)
        for part in _parts(batches):
            out = []
            here = [(k, x) for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if x is not None]
            for (k, _), found in zip(here, model.detect([x for _, x in here]) if here else [], strict=True):
                for category, confidence, x, y, w, h in found:
                    if confidence is None or confidence >= threshold:
                        out.append({key: k, "category": category, "confidence": confidence, "x": int(x), "y": int(y), "w": int(w), "h": int(h)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(key, pa.int64()), ("category", pa.string()), ("confidence", pa.float64()), *((c, pa.int32()) for c in "xywh")]))

    return rows.select(F.col(key).cast("long").alias(key), content).mapInArrow(run, f"{key} long, {REGIONS}")


def embed(rows: DataFrame, factory: Callable, key: str = "row_id", content: str = "content", missing: bytes | str | None = None) -> DataFrame:
    """``key, embedding``, normalised; ``missing`` stands for absent content, or those rows drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(factory)
        for part in _parts(batches):
            pairs = [(k, missing if x is None else x) for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            pairs = [(k, x) for k, x in pairs if x is not None]
            m = np.asarray(model.embed([x for _, x in pairs]), np.float32) if pairs else np.zeros((0, 0), np.float32)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), vectors.EPSILON) if len(m) else m
            yield pa.record_batch([pa.array([k for k, _ in pairs], pa.int64()), pa.array(list(m), pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(F.col(key).cast("long").alias(key), content).mapInArrow(run, f"{key} long, embedding array<float>")


def embed_crops(garments: DataFrame, crops: DataFrame, factory: Callable) -> DataFrame:
    """``garment_id, embedding`` for every garment; one without a crop (``crop_path, content``) gets that of
    a blank square."""
    held = garments.select("garment_id", "crop_path").join(crops.select("crop_path", "content"), "crop_path", "left")
    return embed(held, factory, "garment_id", missing=BLANK)


@dataclass(frozen=True)
class HashEmbedder:
    """Vectors that follow from the content's hash alone: a double for any encoder."""

    dim: int = 32

    def __call__(self) -> HashEmbedder:
        return self

    def embed(self, contents: list) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.sha256(x.encode() if isinstance(x, str) else x).digest()[:8], "little") for x in contents]
        return np.stack([np.random.default_rng(s).standard_normal(self.dim) for s in seeds])


@dataclass(frozen=True)
class FixedDetector:
    """The same regions for every image."""

    regions: tuple = (("top", 0.9, 0, 0, 40, 40), ("bottom", 0.85, 0, 40, 40, 40), ("shoes", 0.7, 0, 80, 40, 20))

    def __call__(self) -> FixedDetector:
        return self

    def detect(self, images: list) -> list:
        return [list(self.regions) for _ in images]


@dataclass(frozen=True)
class ConstantScorer:
    value: float = 1.0

    def __call__(self) -> ConstantScorer:
        return self

    def score(self, images: list) -> list[float]:
        return [self.value] * len(images)


def listed_scores(rows: DataFrame, scores: list[float], key: str = "row_id") -> DataFrame:
    """Scores from a list by the row's place in key order, from its start again where it ends: what a
    scorer with a running count gives to a scan in that order, without the count."""
    if not scores:
        raise ValueError("no scores")
    at = with_position(rows.select(key), key)
    return at.select(key, F.get(F.array(*map(F.lit, scores)), (F.col("position") % len(scores)).cast("int")).alias("image_outfit_score"))


def alternating_scores(rows: DataFrame, high: float = 0.5, low: float = -0.5, key: str = "row_id") -> DataFrame:
    return listed_scores(rows, [high, low], key)


def prompt_scores(images: DataFrame, prompts: DataFrame) -> DataFrame:
    """``row_id, image_outfit_score``: mean similarity to the positive prompts less that to the negative ones,
    as one dot product with the difference of their means (``polarity, e``: a few vectors)."""
    from weftline.operators.embeddings import means

    held = {r.polarity: list(r.e) for r in means(prompts, "polarity").collect()}
    away = [p - n for p, n in zip(held["positive"], held["negative"], strict=True)]
    return images.select("row_id", vectors.dot(F.col("e"), F.array(*map(F.lit, away))).alias("image_outfit_score"))


def extract_garments(records: DataFrame, regions: DataFrame, files: DataFrame, method: str = "split") -> DataFrame:
    """Garments of the images that are there, with running ids in image and region order.

    ``regions``: row_id, category, x, y, w, h, and confidence where a detector found them; ``files``: path.
    The detection image is preferred where its file exists, else the thumbnail; without either the image
    has no garments."""
    if method not in ("split", "detector"):
        raise ValueError(f"unknown method {method}")
    have = files.select(F.col("path").alias("_p"), F.lit(True).alias("_there")).distinct()
    best = records
    for column in ("detection_image_path", "thumbnail_path"):
        here = have.select(F.col("_p").alias(column), F.col("_there").alias(f"_{column}"))
        best = best.join(here, column, "left")
    source = F.when(F.col("_detection_image_path"), F.col("detection_image_path")).when(F.col("_thumbnail_path"), F.col("thumbnail_path"))
    best = best.select("row_id", source.alias("source_image_path")).where("source_image_path is not null")
    if "confidence" not in regions.columns:
        regions = regions.withColumn("confidence", F.lit(None).cast("double"))
    place = F.col("confidence").isNull().cast("int")
    met = regions.join(best, "row_id").select("row_id", "category", "confidence", "x", "y", "w", "h", "source_image_path", place.alias("_k"))
    numbered = with_position(met, "row_id", "_k", F.desc_nulls_last("confidence"), "y", "x", "category").withColumnRenamed("position", "garment_id")
    crop = F.format_string("garment_crops/%06d_%d_%s.jpg", "row_id", "garment_id", "category")
    return numbered.select("garment_id", F.col("row_id").alias("outfit_id"), "category", F.col("x").alias("bbox_x"), F.col("y").alias("bbox_y"), F.col("w").alias("bbox_w"), F.col("h").alias("bbox_h"), "confidence", crop.alias("crop_path"), "source_image_path", F.lit(method).alias("method"))


def image_hashes(images: DataFrame, key: str = "path") -> DataFrame:
    """``key, phash`` of decoded images (Spark's ``image`` source: height, width, nChannels, data): grey, nine
    by eight by area means, and a bit for each pair of neighbours, whether the right one is brighter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, c, data in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
                grey = x[:, :, 0] if c == 1 else x[:, :, :3] @ np.array([0.114, 0.587, 0.299])  # blue, green, red
                small = _area(_area(grey, 8, 0), 9, 1)
                out.append("".join("1" if b else "0" for b in (small[:, 1:] > small[:, :-1]).ravel()))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], [key, "phash"])

    return images.select(F.col(key).cast("string").alias(key), "height", "width", "nChannels", "data").mapInArrow(run, f"{key} string, phash string")


def _area(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Means over ``n`` equal stretches of one axis, parts of a pixel by their share."""
    total = np.concatenate([np.zeros_like(x.take([0], axis)), np.cumsum(x, axis)], axis)
    edges = np.linspace(0, x.shape[axis], n + 1)
    low = np.minimum(np.floor(edges).astype(int), x.shape[axis] - 1)
    part = (edges - low).reshape([-1 if k == axis else 1 for k in range(2)])
    at = total.take(low, axis) + part * x.take(low, axis)
    return np.diff(at, axis=axis) / (x.shape[axis] / n)
