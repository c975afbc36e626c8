"""Tables, task lists, manifests, vector indexes and output folders."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import folders


def save_table(df: DataFrame, folder: str, name: str) -> str:
    """``name.parquet`` below ``folder``; as CSV where a column's type can't be kept in Parquet."""
    path = f"{folder}/{name}.parquet"
    try:
        df.write.mode("overwrite").parquet(path)
    except Exception:  # whatever the Parquet writer refuses
        flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes]
        path = f"{folder}/{name}.csv"
        df.select(*flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return path


def save_annotation_tasks(pairs: DataFrame, path: str) -> None:
    """Pairs with an empty choice, as one CSV file: a list for one person is small."""
    tasks = pairs if "choice" in pairs.columns else pairs.withColumn("choice", F.lit(""))
    tasks.coalesce(1).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_review_artifacts(filtered_rows: DataFrame, folder: str, n: int = 100) -> None:
    """``accepted.csv``, ``rejected.csv`` (the first ``n`` of each reason) and ``filter_summary.json``."""
    from weftline.operators.curate import diagnostics, samples_per_reason

    picked = samples_per_reason(filtered_rows, n)
    for name, rows in (("accepted", picked.where("accepted")), ("rejected", picked.where("not accepted"))):
        rows.coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{folder}/{name}.csv")
    summary = diagnostics(filtered_rows).head().asDict()
    folders.write(filtered_rows.sparkSession, f"{folder}/filter_summary.json", json.dumps(summary, indent=2))


def update_manifest(spark: SparkSession, folder: str, section: str, values: dict, create: bool = False) -> bool:
    """Sets one section of ``manifest.json``; a manifest that isn't there is only made with ``create``."""
    path = f"{folder}/manifest.json"
    if folders.exists(spark, path):
        manifest = json.loads(folders.read_text(spark, path))
    elif create:
        manifest = {}
    else:
        return False
    manifest[section] = values
    folders.write(spark, path, json.dumps(manifest, indent=2))
    return True


def save_index(images: DataFrame, path: str, parts: int = 16) -> None:
    """Vectors dealt into ``parts`` folders by key; what a search index is here, as search is exact."""
    dealt = images.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int"))
    dealt.repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def output_folder(spark: SparkSession, base: str, stem: str) -> str:
    """A new ``<base>/<stem>/<date>_<time>_<8 hex>``; an existing one is an error."""
    path = f"{base.rstrip('/')}/{stem}/{datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
    if folders.exists(spark, path):
        raise FileExistsError(path)
    fs, p = folders._at(spark, path)
    fs.mkdirs(p)
    return path


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's bytes under its name; ``name, size`` of what was written. Ranked copies are new
    files, nothing is renamed, so a retried task does no harm."""
    import pyarrow as pa

    def run(batches):
        import pyarrow.fs as pafs

        fs, inner = (pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")) if folder.startswith("file:") else pafs.FileSystem.from_uri(folder)
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for file, data in zip(names, contents, strict=True):
                path = f"{inner}/{file}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(data)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array([len(x) for x in contents], pa.int64())], ["name", "size"])

    return rows.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).where("content is not null").mapInArrow(run, "name string, size long")


def resized(rows: DataFrame, most: int = 256, quality: int = 90, content: str = "content") -> DataFrame:
    """``rows`` with JPEG content whose long edge is at most ``most``; smaller pictures keep their size. Needs
    Pillow on the executors."""
    import pandas as pd

    @F.pandas_udf("binary")
    def shrink(batches: pd.Series) -> pd.Series:
        import io

        from PIL import Image

        def one(data):
            if data is None:
                return None
            image, out = Image.open(io.BytesIO(data)).convert("RGB"), io.BytesIO()
            image.thumbnail((most, most), Image.LANCZOS)
            image.save(out, "JPEG", quality=quality)
            return out.getvalue()

        return batches.map(one)

    return rows.withColumn(content, shrink(F.col(content)))
