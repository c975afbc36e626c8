"""A run of named steps with a skip list and a status table; a failing step doesn't stop the rest."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[], object]


def run(steps: Iterable[Step], skip: Iterable[str] = ()) -> list[dict]:
    """``step, status, seconds, error`` of each step in order; status is ok, failed or skipped."""
    steps, skip = list(steps), set(skip)
    unknown = skip - {s.name for s in steps}
    if unknown:
        raise ValueError(f"no such step: {', '.join(sorted(unknown))}")
    out = []
    for step in steps:
        began, status, error = time.perf_counter(), "skipped", None
        if step.name not in skip:
            try:
                step.run()
                status = "ok"
            except Exception as e:  # reported in the table; later steps go on
                status, error = "failed", "".join(traceback.format_exception_only(e)).strip()
        out.append({"step": step.name, "status": status, "seconds": round(time.perf_counter() - began, 3), "error": error})
    return out


def enrich(spark: SparkSession, folder: str, k: int = 8, axes: DataFrame | None = None) -> list[Step]:
    """The steps that enrich a bundle of records and vectors: projection, axes, clusters with labels, index,
    failure report, validation. ``axes``: axis, e as directions; without them keyword axes are made."""
    from pyspark.sql import functions as F

    from weftline.operators import embeddings, evaluate
    from weftline.sinks import files, publish
    from weftline.sources import bundles

    def parts() -> tuple[bundles.Bundle, DataFrame]:
        b = bundles.load_bundle(spark, folder)
        return b, b.embeddings.select("row_id", F.col("embedding").cast("array<double>").alias("e"))

    def projection() -> None:
        files.save_table(embeddings.project(parts()[1]), folder, "projection")
        files.update_manifest(spark, folder, "projection", {"method": "pca"})

    def scores() -> None:
        b, images = parts()
        if axes is not None:
            wide = embeddings.axis_scores(images, axes, [r.axis for r in axes.select("axis").orderBy("axis").collect()])
        else:
            wide = embeddings.demo_axes(embeddings.pca(images, 4), b.records.select("row_id", "caption"))
        files.save_table(wide, folder, "axis_scores")
        files.update_manifest(spark, folder, "axis_scores", {"axes": bundles.axis_names(wide)})

    def clusters() -> None:
        images, wide = parts()[1], bundles.load_table(spark, folder, "axis_scores")
        found = embeddings.kmeans(images, k)
        names = bundles.axis_names(wide)
        labels = embeddings.cluster_labels(embeddings.cluster_axis_means(wide, found, names), found, names)
        files.save_table(found.join(F.broadcast(labels), "cluster_id").select("row_id", "cluster_id", F.col("label").alias("cluster_label")), folder, "clusters")
        files.update_manifest(spark, folder, "clusters", {"k": k}, create=True)

    def index() -> None:
        files.save_index(parts()[1], f"{folder}/index")
        files.update_manifest(spark, folder, "search_index", {"kind": "exact"})

    def report() -> None:
        images = parts()[1].join(bundles.load_table(spark, folder, "clusters").select("row_id", "cluster_id"), "row_id")
        cases = [embeddings.outliers(images).select(F.lit("outlier embeddings").alias("category"), F.lit("info").alias("severity"), "row_id")]
        folders_text = publish.failure_markdown(evaluate.failure_report(cases))
        from weftline import folders

        folders.write(spark, f"{folder}/failures.md", folders_text)

    def validate() -> None:
        found = bundles.validate_bundle(spark, folder)
        if not found.ok:
            raise bundles.BundleError("; ".join(found.errors))

    return [Step(n, f) for n, f in (("projection", projection), ("axis_scores", scores), ("clusters", clusters), ("index", index), ("failures", report), ("validate", validate))]
