import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import folders
from weftline.operators import evaluate, models
from weftline.plans import inventory, stages
from weftline.sinks import files, publish
from weftline.sources import bundles


def make_bundle(spark, path, n=5, dim=16, csv=False, npy=False, garments=True):
    """Records with thumbnails, vectors, two garments an outfit with crops."""
    rng = np.random.default_rng(42)
    records = spark.createDataFrame([(i, 100 * i, f"person wearing outfit {i}, \"new\"", f"thumbnails/{i}.jpg") for i in range(n)], "row_id long, global_index long, caption string, thumbnail_path string")
    url = f"file://{path}"
    for folder in ("thumbnails", "garment_crops"):
        (path / folder).mkdir(parents=True)
    for i in range(n):
        (path / "thumbnails" / f"{i}.jpg").write_bytes(b"jpg%d" % i)
    if csv:
        records.coalesce(1).write.option("header", "true").option("escape", '"').csv(f"{url}/records.csv")
    else:
        records.write.parquet(f"{url}/records.parquet")
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if npy:
        np.save(path / "embeddings.npy", x)
    else:
        spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, embedding array<float>").write.parquet(f"{url}/embeddings.parquet")
    if garments:
        rows = [(i // 2, i, ("top", "bottom")[i % 2], f"garment_crops/{i}.jpg", f"thumbnails/{i // 2}.jpg") for i in range(2 * n)]
        spark.createDataFrame(rows, "outfit_id long, garment_id long, category string, crop_path string, source_image_path string").write.parquet(f"{url}/garments.parquet")
        for i in range(2 * n):
            (path / "garment_crops" / f"{i}.jpg").write_bytes(b"c")
        np.save(path / "garment_embeddings.npy", rng.standard_normal((2 * n, dim)).astype(np.float32))
    (path / "manifest.json").write_text(json.dumps({"n_exported": n}))
    return url


@pytest.mark.parametrize("csv,npy", [(False, False), (True, True)])
def test_load_bundle(spark, tmp_path, csv, npy):
    url = make_bundle(spark, tmp_path / "b", csv=csv, npy=npy)
    b = bundles.load_bundle(spark, url)
    assert sorted((r.row_id, r.caption) for r in b.records.collect())[1] == (1, 'person wearing outfit 1, "new"')
    assert dict(b.embeddings.dtypes)["embedding"] == "array<float>" and b.embeddings.count() == 5
    assert b.garments_for_outfit(2).count() == 2 and b.garment_embeddings.columns[0] == "garment_id"
    assert b.path_of("thumbnail_path", 3) == f"{url}/thumbnails/3.jpg" and b.path_of("thumbnail_path", 99) is None
    assert bundles.load_table(spark, url, "projection") is None


def test_broken_bundles(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bundles.load_bundle(spark, f"file://{tmp_path}/none")
    url = make_bundle(spark, tmp_path / "b", garments=False)
    spark.read.parquet(f"{url}/records.parquet").limit(3).write.parquet(f"{url}/records2.parquet")
    folders_path = tmp_path / "b"
    (folders_path / "records.parquet").rename(folders_path / "old")
    with pytest.raises(FileNotFoundError):
        bundles.load_bundle(spark, url)
    (folders_path / "records2.parquet").rename(folders_path / "records.parquet")
    with pytest.raises(bundles.BundleError):
        bundles.load_bundle(spark, url)
    assert not bundles.validate_bundle(spark, url).ok


def test_validation(spark, tmp_path):
    url = make_bundle(spark, tmp_path / "b")
    report = bundles.validate_bundle(spark, url)
    assert report.ok and report.errors == [] and "projection" in report.warnings[0] and report.artifacts["garments"] and not report.artifacts["projection"]
    (tmp_path / "b" / "thumbnails" / "1.jpg").unlink()
    (tmp_path / "b" / "thumbnails" / "3.jpg").unlink()
    report = bundles.validate_bundle(spark, url)
    assert report.errors == ["missing file in records.thumbnail_path: thumbnails/1.jpg", "missing file in garments.source_image_path: thumbnails/1.jpg"]
    table = spark.createDataFrame([(2, "a"), (1, "/abs"), (0, None), (3, "gone")], "row_id long, p string")
    files_here = spark.createDataFrame([("a", 1)], "path string, size long")
    assert [tuple(r) for r in bundles.path_problems(table, "row_id", "p", files_here).collect()] == [("absolute path", "/abs")]
    assert bundles.path_problems(table.where("row_id = 2"), "row_id", "p", files_here).count() == 0
    assert not bundles.validate_bundle(spark, f"file://{tmp_path}/none").ok


def test_listing_packing_and_order(spark, tmp_path):
    url = make_bundle(spark, tmp_path / "all" / "b")
    (tmp_path / "all" / "b" / "detection_images").mkdir()
    (tmp_path / "all" / "b" / "detection_images" / "1.jpg").write_bytes(b"d" * 9)
    sizes = {r.path: r.size for r in bundles.list_artifacts(spark, url).collect()}
    assert sizes["thumbnails/0.jpg"] == 4 and sizes["detection_images/1.jpg"] == 9
    tops = {r.top: (r.n, r.bytes) for r in publish.pack_bundle(spark, url, f"file://{tmp_path}/b.tar.gz").collect()}
    assert tops["thumbnails"] == (5, 20) and "detection_images" not in tops
    with tarfile.open(tmp_path / "b.tar.gz") as t:
        names = t.getnames()
        assert names == sorted(names) and "b/thumbnails/2.jpg" in names and t.extractfile("b/thumbnails/2.jpg").read() == b"jpg2"
    assert bundles.newest_first(spark, f"file://{tmp_path}/all") == [f"file:{tmp_path}/all/b"]


def test_sources_keep_rows_with_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    (tmp_path / "b.jpg").write_bytes(b"x")
    meta = spark.createDataFrame([("a.jpg", "7", "", "page", "u", "600", None), ("b.jpg", "", "", "", "v", None, "x"), ("c.jpg", "8", "", "", "", "1", "1")], "filename string, pexels_id string, unsplash_id string, url_page string, url string, width string, height string")
    got = {r.filename: (r.source_id, r.url, r.width) for r in bundles.load_source(spark, meta.withColumn("height", F.lit(None)), f"file://{tmp_path}").collect()}
    assert got == {"a.jpg": ("7", "page", 600), "b.jpg": ("v", "v", 0)}


def test_tables_manifest_and_folders(spark, tmp_path):
    url = f"file://{tmp_path}"
    files.save_table(spark.range(3), url, "t")
    assert bundles.load_table(spark, url, "t").count() == 3
    assert not files.update_manifest(spark, url, "x", {"a": 1}) and files.update_manifest(spark, url, "x", {"a": 1}, create=True)
    assert files.update_manifest(spark, url, "y", {"b": 2}) and json.loads((tmp_path / "manifest.json").read_text()) == {"x": {"a": 1}, "y": {"b": 2}}
    a, b = (files.output_folder(spark, url, "run") for _ in range(2))
    assert a != b and folders.is_folder(spark, a) and folders.exists(spark, b)
    pairs = spark.createDataFrame([(0, 1, 2, "x"), (1, 3, 4, "x")], "pair_id long, image_a_row_id long, image_b_row_id long, axis string")
    files.save_annotation_tasks(pairs, f"{url}/tasks.csv")
    assert [r.choice for r in bundles.load_annotations(spark, f"{url}/tasks.csv").collect()] == [None, None]
    written = files.write_files(spark.createDataFrame([("p/0.bin", b"ab"), ("1.bin", None)], "name string, content binary"), url).collect()
    assert [tuple(r) for r in written] == [("p/0.bin", 2)] and (tmp_path / "p" / "0.bin").read_bytes() == b"ab"


def test_review_artifacts(spark, tmp_path):
    from weftline.operators import curate

    rows = curate.filtered(spark.createDataFrame([(0, "woman in a dress"), (1, "baby"), (2, "rock")], "row_id long, caption string"))
    files.write_review_artifacts(rows, f"file://{tmp_path}", 1)
    assert json.loads((tmp_path / "filter_summary.json").read_text())["n_accepted"] == 1
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/rejected.csv").count() == 2


def test_pages_and_report(spark):
    rows = spark.createDataFrame([(2, "b & c" * 40, b"z"), (1, "<i>", b"xy")], "row_id long, caption string, content binary")
    page = publish.sheet(rows, "Sheet", 1)
    assert "#1 &lt;i&gt;" in page and "base64,eHk=" in page and "#2" not in page
    assert publish.sheet(rows, "Sheet").count("&amp;") == 24
    cases = spark.createDataFrame([("low", "info", i) for i in range(12)] + [("bad", "error", 5)], "category string, severity string, row_id long")
    text = publish.failure_markdown(evaluate.failure_report([cases]))
    assert text.index("[ERROR] bad") < text.index("[INFO] low") and "0, 1, 2, 3, 4, 5, 6, 7, 8, 9\n  ... and 2 more" in text
    assert publish.failure_markdown(evaluate.failure_report([cases.limit(0)])) == "# Failure Report\n\nNo issues detected.\n"
    tasks = spark.createDataFrame([(0, 1, 2, "x")], "pair_id long, image_a_row_id long, image_b_row_id long, axis string")
    assert "data-pair='0'" in publish.annotation_page(tasks, rows)


def test_dashboard(spark, tmp_path):
    url = make_bundle(spark, tmp_path / "b")
    b = bundles.load_bundle(spark, url)
    images = b.embeddings.select("row_id", F.col("embedding").cast("array<double>").alias("e"))
    ids = b.records.select("row_id")
    g = b.garments.join(b.garment_embeddings.withColumnRenamed("embedding", "e"), "garment_id").withColumn("confidence", F.lit(0.12345))
    clusters = ids.select("row_id", (F.col("row_id") % 2).alias("cluster_id"), F.concat(F.lit("C"), F.col("row_id") % 2).alias("cluster_label"))
    publish.dashboard(spark, f"{url}/out", b.records, images, ids.withColumn("x", F.lit(0.0)), clusters, ids.withColumn("warm", F.col("row_id") / 7), g, {"axis_scores": {"n": 1}}, k=2)
    c = json.loads((tmp_path / "b" / "out" / "config.json").read_text())
    assert (c["n_images"], c["n_garments"], c["embedding_dim"], c["cluster_labels"], c["categories"], c["axis_info"]) == (5, 10, 16, {"0": "C0", "1": "C1"}, ["bottom", "top"], {"n": 1})
    assert (tmp_path / "b" / "out" / "gn" / "outfit_id=3").is_dir()
    near = spark.read.json(f"{url}/out/neighbors").where("row_id = 0").head()
    assert len(near.neighbors) == 2 and near.neighbors[0].similarity >= near.neighbors[1].similarity


def test_models(spark):
    rows = spark.createDataFrame([(i, b"i%d" % i if i != 2 else None) for i in range(5)], "row_id long, content binary")
    assert sorted(tuple(r) for r in models.score_images(rows, models.ConstantScorer(0.3)).collect()) == [(i, 0.3 if i != 2 else None) for i in range(5)]
    found = models.detect_regions(rows, models.FixedDetector(), 0.8)
    assert found.count() == 8 and {r.category for r in found.collect()} == {"top", "bottom"}
    a, b = ({r.row_id: r.embedding for r in models.embed(rows, models.HashEmbedder(8)).collect()} for _ in range(2))
    assert a == b and set(a) == {0, 1, 3, 4} and abs(sum(x * x for x in a[0]) - 1) < 1e-5
    garments = spark.createDataFrame([(0, "a"), (1, "b")], "garment_id long, crop_path string")
    crops = spark.createDataFrame([("a", b"x")], "crop_path string, content binary")
    got = {r.garment_id: r.embedding for r in models.embed_crops(garments, crops, models.HashEmbedder(4)).collect()}
    blank = models.HashEmbedder(4).embed([models.BLANK])[0]
    assert np.allclose(got[1], blank / np.linalg.norm(blank), atol=1e-6)
    assert models.WithFallback(_fails, models.ConstantScorer())().value == 1.0
    assert [r.image_outfit_score for r in models.alternating_scores(rows).orderBy("row_id").collect()] == [0.5, -0.5, 0.5, -0.5, 0.5]
    with pytest.raises(ValueError):
        models.listed_scores(rows, [])


def _fails():
    raise OSError("no weights")


def test_extracted_garments(spark):
    records = spark.createDataFrame([(0, "d/0", "t/0"), (1, "d/1", "t/1"), (2, None, "t/2")], "row_id long, detection_image_path string, thumbnail_path string")
    here = spark.createDataFrame([("d/0",), ("t/0",), ("t/1",)], "path string")
    regions = spark.createDataFrame([(i, "top", 0.9, 0, 0, 5, 5) for i in range(3)] + [(0, "shoes", 0.95, 0, 9, 5, 5)], "row_id long, category string, confidence double, x int, y int, w int, h int")
    got = [(r.garment_id, r.outfit_id, r.category, r.source_image_path) for r in models.extract_garments(records, regions, here, "detector").orderBy("garment_id").collect()]
    assert got == [(0, 0, "shoes", "d/0"), (1, 0, "top", "d/0"), (2, 1, "top", "t/1")]
    with pytest.raises(ValueError):
        models.extract_garments(records, regions, here, "other")


def test_image_hashes(spark):
    ramp = np.tile(np.arange(90, dtype=np.uint8), (16, 1))
    rows = [("a", 16, 90, 1, ramp.tobytes()), ("b", 16, 90, 3, np.repeat(ramp[:, ::-1, None], 3, 2).tobytes())]
    got = {r.path: r.phash for r in models.image_hashes(spark.createDataFrame(rows, "path string, height int, width int, nChannels int, data binary")).collect()}
    assert got == {"a": "1" * 64, "b": "0" * 64}


def test_inventory(tmp_path):
    found = inventory.write_inventory(str(tmp_path / "i.json"), [str(tmp_path), "/none"])
    assert json.loads((tmp_path / "i.json").read_text()) == found and found["packages"]["numpy"] == np.__version__
    assert found["paths"]["/none"] == {"exists": False, "readable": False} and inventory.package_version("no-such-package") is None


def test_projection_choice():
    from weftline.operators.embeddings import UMAP_ROWS, choose_projection

    assert [choose_projection(n, True) for n in (0, 2, 3, 14, 15, UMAP_ROWS + 1)] == ["trivial", "trivial", "pca", "pca", "umap", "pca"]
    assert choose_projection(100, False) == "pca"


def test_stage_runner(spark, tmp_path):
    done = []
    steps = [stages.Step("a", lambda: done.append("a")), stages.Step("b", lambda: 1 / 0), stages.Step("c", lambda: done.append("c")), stages.Step("d", lambda: done.append("d"))]
    table = stages.run(steps, ["c"])
    assert [(r["step"], r["status"]) for r in table] == [("a", "ok"), ("b", "failed"), ("c", "skipped"), ("d", "ok")] and "ZeroDivisionError" in table[1]["error"] and done == ["a", "d"]
    with pytest.raises(ValueError):
        stages.run(steps, ["x"])
    url = make_bundle(spark, tmp_path / "b", n=12)
    got = stages.run(stages.enrich(spark, url, k=3))
    assert [(r["step"], r["status"], r["error"]) for r in got] == [(s, "ok", None) for s in ("projection", "axis_scores", "clusters", "index", "failures", "validate")]
    assert spark.read.parquet(f"{url}/clusters.parquet").where("cluster_label <> ''").count() == 12
    assert "clusters" in json.loads((tmp_path / "b" / "manifest.json").read_text()) and io.open(tmp_path / "b" / "failures.md").read().startswith("# Failure Report")
