import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import lexicon as lx
from weftline.operators import curate, embeddings, evaluate, tables
from weftline.operators import garments as gm
from weftline.operators.knn import top_k


def captions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, caption string")


def reasons(df):
    return [r.reason for r in df.orderBy("row_id").collect()]


def test_tiers(spark):
    c = captions(spark, "street style outfit", "a woman in a dress", "dress on a table", "surgical coat", "", None, "a red hat")
    assert reasons(curate.filtered(c)) == ["accepted", "accepted", "no_fashion_signal", "excluded", "empty", "empty", "no_fashion_signal"]
    strict = curate.filtered(captions(spark, "outfit ideas", "woman in outfit"), strict=True)
    assert reasons(strict) == ["no_person_context", "accepted"]


def test_scores(spark):
    rows = curate.scored(captions(spark, "outfit", "wearing", "catalogue", "woman in a dress", "baby outfit", "", "   ")).orderBy("row_id").collect()
    got = [r.caption_score for r in rows]
    # "wearing" is a person hint too; "catalogue" holds two penalty terms
    assert got == [3.0, 2.5, -3.0, 2.5, -math.inf, -math.inf, 0.0]
    assert rows[4].excluded_term == "baby"


def test_signals_and_matching_order(spark):
    r = captions(spark, "runway outfit").select(lx.score_caption(F.col("caption")).alias("s"), lx.filter_caption(F.col("caption")).alias("f")).head()
    assert r.s.signals == {"strong_outfit": 3.0}
    assert r.f.matched_term == "outfit"  # list order, not text order


def test_score_mode_and_modes(spark):
    r = curate.filtered(captions(spark, "woman in a dress", "plain"), mode="strict").orderBy("row_id").collect()
    assert [(x.reason, x.matched_term) for x in r] == [("accepted", "score=2.5"), ("below_score_threshold", "score=0.0<1.5")]
    assert lx.resolve_min_score("outfit", 0.7) == 0.7 and lx.resolve_min_score("outfit") == 2.5 and lx.resolve_min_score() is None


def test_own_exclusion_list(spark, tmp_path):
    (tmp_path / "terms").write_text("cat \nmoon\n")
    lexicon = lx.Lexicon(exclusion=lx.read_terms(str(tmp_path / "terms")))
    assert reasons(curate.filtered(captions(spark, "moon outfit", "baby outfit"), lexicon)) == ["excluded", "accepted"]


def test_axis_labels(spark):
    df = spark.createDataFrame([("formal_vs_casual", 1.0), ("formal_vs_casual", -1.0), ("colorful_proxy", 0.5), ("big_SIZE_score", 0.0)], "a string, s double")
    assert [r[0] for r in df.select(lx.axis_label(F.col("a"), F.col("s"))).collect()] == ["Formal", "Casual", "Colorful", "Big size"]


def test_positions_and_scan(spark):
    df = spark.range(100).select((F.col("id") * 7 % 101).alias("row_id"))
    got = curate.with_position(df, "row_id").orderBy("row_id").collect()
    assert [r.position for r in got] == list(range(100))
    f = spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).alias("accepted"))
    assert [(r.row_id, r.position) for r in curate.scan_until(f, 3, 50).orderBy("row_id").collect()] == [(0, 0), (3, 1), (6, 2)]
    assert curate.scan_until(f, 30, 4).count() == 2


def test_quartile_conventions(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "s double")
    p = curate.picked_quartiles(df, "s").head()
    assert (p.p25, p.median, p.p75) == (2.0, 3.0, 4.0)
    assert curate.quartiles(df, "s").head().median == 2.5


def test_rank_drops_nan_and_null(spark):
    df = spark.createDataFrame([(0, 0.1), (1, float("nan")), (2, None), (3, 0.9), (4, 0.9)], "row_id long, s double")
    assert [r.row_id for r in curate.rank_candidates(df, "s", 3).orderBy("new_row_id").collect()] == [3, 4, 0]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_top_k_ties_and_groups(spark, limit):
    rows = [(0, 0, "a", [1.0, 0.0]), (1, 0, "b", [1.0, 0.0]), (2, 1, "b", [1.0, 0.0]), (3, 2, "b", [1.0, 0.0]), (4, 3, "c", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, g long, t string, e array<double>")
    q = df.select(F.col("id").alias("qid"), F.col("g").alias("qgroup"), F.col("t").alias("not_tag"), "e")
    c = df.select(F.col("id").alias("cid"), F.col("g").alias("cgroup"), F.col("t").alias("tag"), "e")
    got = {(r.qid, r.tag, r.rank): r.cid for r in top_k(q, c, 2, limit).collect()}
    assert got[(0, "b", 1)] == 2 and got[(0, "b", 2)] == 3 and got[(0, "c", 1)] == 4
    assert not any(k[0] == 0 and k[1] == "a" for k in got)
    assert top_k(q, c.limit(0), 2, limit).count() == 0


def test_evaluation_modes(spark):
    rows = [(i, i // 2, "ab"[i % 2], [float(i // 2), 1.0]) for i in range(8)]
    g = spark.createDataFrame(rows, "garment_id long, outfit_id long, category string, e array<double>")
    ref = evaluate.evaluate(g, mode="reference").where("category is null").head()
    assert ref.hit_at_10 == 0 and ref.mrr == 0 and ref.n_queries == 8
    co = evaluate.evaluate(g).where("category is null").head()
    assert 0 < co.hit_at_1 <= co.hit_at_5 <= co.hit_at_10 == 1
    with pytest.raises(ValueError):
        evaluate.evaluate(g, mode="x")


@pytest.mark.parametrize("block", [20_000, 7])
def test_mrr_counts_every_rank(spark, block, monkeypatch):
    """The only hit of each query in outfit 0 ranks 31st; outfit 99 is of one category, its queries find nothing."""
    monkeypatch.setattr(evaluate, "BLOCK_ROWS", block)
    rows = [(0, 0, "a", [1.0, 0.0]), (1, 0, "b", [0.5, 0.0]), *((10 + i, 100 + i, "ab"[i % 2], [0.9, 0.0]) for i in range(60)), (90, 99, "a", [1.0, 0.0]), (91, 99, "a", [1.0, 0.0])]
    g = spark.createDataFrame(rows, "garment_id long, outfit_id long, category string, e array<double>")
    got = {r.category: r for r in evaluate.evaluate(g).collect()}
    assert got["a"].hit_at_10 == 0 and abs(got["a"].mrr - 1 / 31 / 3) < 1e-12 and got["a"].n_queries == 3
    assert abs(got["b"].mrr - 1) < 1e-12 and abs(got[None].mrr - (1 / 31 + 1) / 4) < 1e-12
    alone = evaluate.evaluate(g.where("outfit_id = 99")).where("category is null").head()
    assert alone.mrr == 0 and alone.n_queries == 2


def test_agreement_counts_nan_and_equal_as_disagreement(spark):
    s = spark.createDataFrame([(0, "x", 0.8), (1, "x", 0.2), (2, "x", 0.2), (3, "x", float("nan"))], "row_id long, axis string, score double")
    a = spark.createDataFrame([(0, 1, "x", "a"), (1, 0, "x", "b"), (1, 2, "x", "a"), (3, 0, "x", "a"), (0, 1, "x", "tie"), (0, 9, "x", "a")], "image_a_row_id long, image_b_row_id long, axis string, choice string")
    r = evaluate.agreement(a, s).head()
    assert (r.agree, r.disagree, r.n_evaluated) == (2, 2, 4)


def test_audits(spark):
    rec = spark.createDataFrame([(0, 0.01), (1, 0.9), (2, float("nan")), (3, None)], "row_id long, image_outfit_score double")
    assert [r.row_id for r in evaluate.low_scores(rec).collect()] == [0]
    g = spark.createDataFrame([(0, 0), (0, 7)], "garment_id long, outfit_id long")
    assert {r.problem for r in evaluate.garment_problems(g, rec).collect()} == {"unknown outfit", "repeated id"}
    assert tables.dense_ids_problems(rec).count() == 0
    report = evaluate.failure_report([rec.select(F.lit("i").alias("category"), F.lit("info").alias("severity"), "row_id"), rec.select(F.lit("w").alias("category"), F.lit("error").alias("severity"), "row_id")])
    assert [r.category for r in report.collect()] == ["w", "i"]


def test_regions_and_sizes(spark):
    i = spark.createDataFrame([(0, 100, 100), (1, 10, 100)], "row_id long, width int, height int")
    rows = {r.category: r for r in gm.split_regions(i).collect()}
    assert (rows["upper"].h, rows["lower"].y, rows["lower"].h) == (55, 40, 60)
    w, h = gm.thumbnail_size(F.lit(1000), F.lit(500), 256)
    assert spark.range(1).select(w, h).head()[:] == (256, 128)


def test_projection_and_clusters(spark):
    rows = [(i, i % 2, [float(i % 2) * 10 + i / 100, 1.0, float(i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, cluster_id int, e array<double>")
    a, b = (sorted(map(tuple, embeddings.project(df).collect())) for _ in range(2))
    assert a == b and abs(sum(x for _, x, _ in a)) < 1e-9  # centred and repeatable
    assert embeddings.project(df.limit(2)).count() == 2
    assert embeddings.kmeans(df, 50).select("cluster_id").distinct().count() <= 20
    assert embeddings.exemplars(df, 1).count() == 2
    assert embeddings.outliers(df.limit(3)).count() == 0


def test_file_names_and_snippets(spark):
    df = spark.createDataFrame([("http://x/a.png?q=1",), ("http://x/a",), ("http://x.com/b.JPG#t",)], "u string")
    assert [r[0] for r in df.select(tables.suffix(F.col("u"))).collect()] == [".png", ".jpeg", ".JPG"]
    assert spark.range(1).select(tables.snippet(F.lit("<a&b>"), 3)).head()[0] == "&lt;a&amp;"


def test_locate_without_broadcast(spark, monkeypatch):
    shards = spark.createDataFrame([("a", 0, 2), ("b", 2, 5)], "tar_path string, start_index long, end_index long")
    ids = spark.range(6).withColumnRenamed("id", "global_index")
    want = sorted(map(tuple, tables.locate(ids, shards).collect()))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, tables.locate(ids, shards).collect())) == want
    assert ("b" , 2) == want[4][1:]


def test_pairs(spark):
    ids = spark.range(30).withColumnRenamed("id", "row_id")
    p = tables.sample_pairs(ids, ["x", "y"], 20).collect()
    assert len(p) == 40 and all(r.image_a_row_id != r.image_b_row_id for r in p)
    assert len({(r.axis, *sorted((r.image_a_row_id, r.image_b_row_id))) for r in p}) == 40


def test_entry_runs_without_llm(monkeypatch):
    import builtins
    import importlib

    real = builtins.__import__

    def block(name, globals=None, locals=None, fromlist=(), level=0):  # noqa: A002
        if name.startswith("weftline.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", block)
    e = importlib.import_module("__spark_entry__")
    assert "w2_topk_per_category" in e.queries() and not any(k.startswith("op") for k in e.queries())
