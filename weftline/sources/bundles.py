"""Bundles: a folder with records, vectors and optional tables, as Parquet or else CSV."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import folders

REQUIRED_FILES, REQUIRED_FOLDERS = ("records", "embeddings"), ("thumbnails",)
#: What a bundle may hold besides.
OPTIONAL = ("garments", "garment_embeddings", "projection", "axis_scores", "manifest.json", "filter_summary.json", "contact_sheet.html", "garment_review.html", "retrieval_review.html", "eval_results.json", "detection_images", "garment_crops")
#: Columns of relative paths, and the key that orders their table.
PATHS = {"records": ("row_id", "thumbnail_path", "detection_image_path"), "garments": ("garment_id", "crop_path", "source_image_path")}


class BundleError(ValueError):
    """A bundle lacks something or contradicts itself."""


def find_table(spark: SparkSession, folder: str, name: str) -> tuple[str, str] | None:
    """Kind and path of a table: Parquet before CSV before a numpy array."""
    for kind, ending in (("parquet", "parquet"), ("csv", "csv"), ("npy", "npy")):
        path = f"{folder}/{name}.{ending}"
        if folders.exists(spark, path):
            return kind, path
    return None


def load_table(spark: SparkSession, folder: str, name: str, schema: str | None = None, key: str = "row_id") -> DataFrame | None:
    """A table of a bundle, or None. CSV types come from ``schema`` where it is given, else from the file; a
    numpy array becomes ``key, embedding``."""
    found = find_table(spark, folder, name)
    if found is None:
        return None
    kind, path = found
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)
    from weftline.sources.shards import NpyVectors

    spark.dataSource.register(NpyVectors)
    return spark.read.format(NpyVectors.name()).load(path).withColumnRenamed("global_index", key)


@dataclass
class Bundle:
    folder: str
    records: DataFrame
    embeddings: DataFrame
    garments: DataFrame | None = None
    garment_embeddings: DataFrame | None = None

    def garments_for_outfit(self, outfit_id: int) -> DataFrame | None:
        return None if self.garments is None else self.garments.where(F.col("outfit_id") == outfit_id)

    def path_of(self, column: str, row_id: int) -> str | None:
        """A record's file, or None where it has none."""
        row = self.records.where(F.col("row_id") == row_id).select(column).head()
        return None if row is None or not row[0] else f"{self.folder}/{row[0]}"


def load_bundle(spark: SparkSession, folder: str) -> Bundle:
    """Records and as many vectors; garments and theirs where they are."""
    if not folders.is_folder(spark, folder):
        raise FileNotFoundError(f"no bundle folder {folder}")
    records, vectors = load_table(spark, folder, "records"), load_table(spark, folder, "embeddings")
    for name, table in (("records", records), ("embeddings", vectors)):
        if table is None:
            raise FileNotFoundError(f"no {name} in {folder}")
    n, m = records.count(), vectors.count()
    if n != m:
        raise BundleError(f"{n} records but {m} embeddings")
    return Bundle(folder, records, as_floats(vectors), load_table(spark, folder, "garments"), as_floats(load_table(spark, folder, "garment_embeddings", key="garment_id")))


def as_floats(vectors: DataFrame | None) -> DataFrame | None:
    return None if vectors is None else vectors.withColumn("embedding", F.col("embedding").cast("array<float>"))


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotated pairs from CSV; a blank choice is null."""
    schema = "pair_id long, image_a_row_id long, image_b_row_id long, axis string, choice string"
    return spark.read.option("header", "true").option("emptyValue", "").schema(schema).csv(path).withColumn("choice", F.nullif("choice", F.lit("")))


def load_source(spark: SparkSession, metadata: DataFrame, images: str) -> DataFrame:
    """The rows of a source's metadata whose image is there: ``source_id, url, width, height`` and the
    rest. Empty strings count as missing, missing sizes as 0."""
    have = folders.listing(spark, images).select(F.element_at(F.split("path", "/"), -1).alias("filename")).distinct()
    some = lambda *names: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in metadata.columns), F.lit(""))
    size = lambda name: F.coalesce(F.col(name).cast("int"), F.lit(0)).alias(name)
    kept = metadata.join(have, "filename", "left_semi")
    rest = [c for c in metadata.columns if c not in ("source_id", "url", "width", "height")]
    return kept.select(*rest, some("pexels_id", "unsplash_id", "url").alias("source_id"), some("url_page", "url").alias("url"), size("width"), size("height"))


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    artifacts: dict[str, bool] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.errors


def path_problems(table: DataFrame, key: str, column: str, files: DataFrame) -> DataFrame:
    """At most one row, ``problem, path``: the first path in key order that is absolute or isn't there."""
    rows = table.where(F.col(column).isNotNull()).select(F.col(key).alias("_key"), F.col(column).cast("string").alias("path"))
    met = rows.join(files.select("path", F.lit(True).alias("_here")), "path", "left")
    problem = F.when(F.startswith("path", F.lit("/")), "absolute path").when(F.col("_here").isNull(), "missing file")
    first = met.withColumn("problem", problem).where("problem is not null").agg(F.min(F.struct("_key", "problem", "path")).alias("m"))
    return first.where("m is not null").select("m.problem", "m.path")


def validate_bundle(spark: SparkSession, folder: str) -> Report:
    """Whether a bundle can move as it is: what it holds, paths that lead somewhere, equal counts. Missing
    optional parts are a warning."""
    report = Report()
    if not folders.is_folder(spark, folder):
        report.errors.append(f"no bundle folder {folder}")
        return report
    tables = {n: find_table(spark, folder, n) for n in ("records", "embeddings", "garments", "garment_embeddings", "projection", "axis_scores")}
    here = lambda n: tables[n] is not None if n in tables else folders.exists(spark, f"{folder}/{n}")
    for name in (*REQUIRED_FILES, *REQUIRED_FOLDERS, *OPTIONAL):
        report.artifacts[name] = here(name)
    report.errors += [f"missing: {n}" for n in (*REQUIRED_FILES, *REQUIRED_FOLDERS) if not report.artifacts[n]]
    absent = [n for n in OPTIONAL if not report.artifacts[n]]
    if absent:
        report.warnings.append("missing optional parts: " + ", ".join(absent))
    files = folders.listing(spark, folder)
    for name, (key, *columns) in PATHS.items():
        table = load_table(spark, folder, name)
        for column in columns if table is not None else ():
            if column in table.columns:
                report.errors += [f"{r.problem} in {name}.{column}: {r.path}" for r in path_problems(table, key, column, files).collect()]
        vectors = load_table(spark, folder, "embeddings" if name == "records" else "garment_embeddings")
        if table is not None and vectors is not None and table.count() != vectors.count():
            report.errors.append(f"{name} and its embeddings differ in number")
    return report


def list_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size`` of a bundle's files, in path order."""
    return folders.listing(spark, folder).orderBy("path")


def newest_first(spark: SparkSession, parent: str) -> list[str]:
    """The bundles below a folder that hold records, the latest changed first."""
    fs, p = folders._at(spark, parent)
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory()]
    return [path for _, path in sorted(found, reverse=True) if find_table(spark, path, "records")]


def axis_names(scores: DataFrame) -> list[str]:
    """All columns but the key, in order."""
    return [c for c in scores.columns if c != "row_id"]


def showcase_order(axis: Column, first: list[str]) -> Column:
    """Sorts the axes of a fixed list before all others, which keep their order."""
    place = F.array_position(F.array(*map(F.lit, first)), axis)
    return F.when(place > 0, place).otherwise(F.lit(len(first) + 1))
