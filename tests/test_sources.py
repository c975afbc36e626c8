import io
import json
import tarfile
from datetime import datetime, timedelta

import numpy as np

from weftline.sources import web
from weftline.sources.shards import NpyVectors, TarShards, VectorFile
from weftline.streaming import captions


def _tar(path, members):
    with tarfile.open(path, "w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_tar_shards(spark, tmp_path):
    meta = lambda k: json.dumps({"caption": f"c{k}", "url": f"u{k}"}).encode()
    _tar(tmp_path / "a.tar", [("0.jpg", b"p0"), ("0.json", meta(0)), ("1.jpg", b"p1"), ("2.json", meta(2)), ("3.jpg", b"p3"), ("3.json", b"{broken"), ("4.jpg", b"p4"), ("4.json", meta(4))])
    (tmp_path / "b.tar").write_bytes(b"no archive")
    spark.dataSource.register(TarShards)
    path = f"file://{tmp_path}/a.tar,file://{tmp_path}/b.tar"
    rows = sorted(spark.read.format("tar_shards").load(path).collect(), key=lambda r: r.within_shard_index)
    assert [(r.key, r.within_shard_index, r.caption, bytes(r.image)) for r in rows] == [("0", 0, "c0", b"p0"), ("4", 2, "c4", b"p4")]
    assert all(r.image is None for r in spark.read.format("tar_shards").option("metadata", "true").load(path).collect())


def test_vector_file(spark, tmp_path):
    x = np.arange(70, dtype="<f2").reshape(10, 7)
    (tmp_path / "v").write_bytes(x.tobytes())
    spark.dataSource.register(VectorFile)
    df = spark.read.format("float16_vectors").option("dim", 7).option("rows_per_partition", 4).load(f"file://{tmp_path}/v")
    got = sorted(df.collect())
    assert [r.global_index for r in got] == list(range(10)) and np.array_equal(np.array([r.embedding for r in got]), x)


def test_stream_resumes(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "ts timestamp, caption string, url string"
    put = lambda rows, k: spark.createDataFrame([(t + timedelta(minutes=m), c, u) for m, c, u in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    put([(0, "woman in a dress", "a"), (1, "woman in a dress", "a"), (2, "baby", "b"), (3, "outfit", "")], 1)
    src, out, ck = f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/ck"
    captions.run(spark, src, schema, out, ck).awaitTermination(60)
    put([(5, "runway outfit", "c"), (6, "woman in a dress", "a")], 2)
    captions.run(spark, src, schema, out, ck).awaitTermination(60)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "c"]


def _pages(folder, pages):
    for (query, page), data in pages.items():
        (folder / query).mkdir(exist_ok=True, parents=True)
        (folder / query / f"{page}.json").write_text(json.dumps(data))


def test_paged_search(spark, tmp_path):
    photo = lambda k, w=600, h=700, **src: {"id": k, "width": w, "height": h, "photographer": "p", "url": f"u{k}", "alt": f"c{k}", "src": src or {"large2x": f"l{k}", "original": f"o{k}"}}
    _pages(tmp_path, {
        ("a", 1): {"photos": [photo(1), photo(2, w=100)], "next_page": "x"}, ("a", 2): {"status": 429}, ("a", 3): {"photos": [photo(3, large2x="", original="o")], "next_page": ""}, ("a", 4): {"photos": [photo(9)]},
        ("b", 1): {"photos": [photo(1), photo(4, large2x="")], "next_page": "x"}, ("b", 2): {"status": 500}, ("b", 3): {"photos": [photo(8)]},
    })
    spark.dataSource.register(web.PagedSearch)
    read = spark.read.format("paged_search").option("api", "pexels").option("queries", "a\nb").option("fixture", f"file://{tmp_path}")
    found = read.load()
    assert sorted((r.query, r.page) for r in found.collect()) == [("a", 1), ("a", 1), ("a", 3), ("b", 1), ("b", 1)]
    rows = {r.pexels_id: r for r in web.pexels_rows(found).collect()}
    assert {k: (r.query, r.image_url, r.caption) for k, r in rows.items()} == {"1": ("a", "l1", "c1"), "3": ("a", "o", "c3")}
    assert read.option("max_per_query", 1).load().count() == 4
    _pages(tmp_path, {("c", 1): {"total_pages": 2, "results": [{"id": "x", "width": 900, "height": 900, "urls": {"regular": "r"}, "alt_description": "alt", "description": "", "user": {"name": "n"}, "links": {"html": "h"}}]}, ("c", 2): {"total_pages": 2, "results": []}})
    got = web.unsplash_rows(spark.read.format("paged_search").option("api", "unsplash").option("queries", "c").option("fixture", f"file://{tmp_path}").load()).collect()
    assert [(r.unsplash_id, r.caption, r.photographer, r.url_page) for r in got] == [("x", "alt", "n", "h")]


def test_download(spark):
    def get(url):
        if url == "broken":
            raise OSError(url)
        kind, n = url.split(":")
        return kind, b"x" * int(n)

    urls = spark.createDataFrame([("image/png:2000",), ("image/png:2000",), ("image/png:10",), ("text/html:5000",), ("application/octet-stream:1000",), ("broken",), ("",), (None,)], "url string")
    got = {r.url: (r.size, len(r.content)) for r in web.download(urls, get, threads=2).collect()}
    assert got == {"image/png:2000": (2000, 2000), "application/octet-stream:1000": (1000, 1000)}


def test_metadata_reads_every_readable_json(spark, tmp_path):
    meta = lambda k: json.dumps({"caption": f"c{k}"}).encode()
    _tar(tmp_path / "a.tar", [("0.json", meta(0)), ("1.jpg", b"p"), ("2.json", b"{broken"), ("3.json", meta(3)), ("3.jpg", b"p")])
    whole = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[:700])
    spark.dataSource.register(TarShards)
    read = spark.read.format("tar_shards").option("metadata", "true")
    assert [(r.key, r.within_shard_index, r.caption) for r in read.load(f"file://{tmp_path}/a.tar").collect()] == [("0", 0, "c0"), ("3", 2, "c3")]
    assert [r.key for r in read.load(f"file://{tmp_path}/cut.tar").collect()] in ([], ["0"])


def test_npy_vectors(spark, tmp_path):
    spark.dataSource.register(NpyVectors)
    for kind in ("<f2", "<f4", "<f8"):
        x = np.arange(60).reshape(10, 6).astype(kind)
        np.save(tmp_path / "v.npy", x)
        got = sorted(spark.read.format("npy_vectors").option("rows_per_partition", 4).load(f"file://{tmp_path}/v.npy").collect())
        assert [r.global_index for r in got] == list(range(10)) and np.array_equal(np.array([r.embedding for r in got]), x.astype(np.float32))
    np.save(tmp_path / "v.npy", np.zeros((0, 6), np.float32))
    assert spark.read.format("npy_vectors").load(f"file://{tmp_path}/v.npy").count() == 0
