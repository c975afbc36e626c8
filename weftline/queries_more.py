"""More queries over the driver's tables: bundles, models, sinks, and the remaining relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import folders
from weftline.functions import lexicon as lx
from weftline.functions import vectors as v
from weftline.operators import curate, embeddings, evaluate, models, sampling
from weftline.operators import garments as gm
from weftline.queries import AXIS, GAR, IMG, METRICS, NAMES, ORACLES, QUERIES, SCO, TPL, _any, _image_scores, _rounded, _scored, _wide, query
from weftline.sinks import files, publish
from weftline.sources import bundles
from weftline.sources import views as vw
from weftline.sources.web import acceptable

__all__ = ["ORACLES", "QUERIES"]


@query("select doc_id as row_id, source, n_chars as width, e.label from documents d join embeddings e on e.vec_id = d.doc_id")
def s6_load_bundle(spark, d):
    path = folders.fresh(spark, "bundle")
    images = vw.table(spark, d, "embeddings")
    records = vw.records(spark, d).join(images.select(F.col("vec_id").alias("row_id"), "label"), "row_id").drop("caption")
    records.write.parquet(f"{path}/records.parquet")
    vw.images(spark, d).select("row_id", F.col("e").alias("embedding")).join(records.select("row_id"), "row_id", "left_semi").write.parquet(f"{path}/embeddings.parquet")
    b = bundles.load_bundle(spark, path)
    return b.records.join(b.embeddings.where(F.size("embedding") > 0), "row_id", "left_semi").select("row_id", "source", "width", "label")


@query("select p_partkey as row_id, p_brand as source, p_size as width from part")
def s7_table_from_csv(spark, d):
    path = folders.fresh(spark, "tables")
    p = vw.table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("source"), F.col("p_size").alias("width"))
    p.write.option("header", "true").csv(f"{path}/records.csv")
    return bundles.load_table(spark, path, "records", "row_id long, source string, width int")


@query(f"select vec_id as pair_id, vec_id as image_a_row_id, ['x', 'y', 'z'][vec_id % 3 + 1] as axis, nullif(['a', 'b', 'tie', ''][vec_id % 4 + 1], '') as choice from embeddings")
def s8_annotations(spark, d):
    path, i = folders.fresh(spark, "annotations"), F.col("vec_id")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (i % n).cast("int"))
    rows = vw.table(spark, d, "embeddings").select(i.alias("pair_id"), i.alias("image_a_row_id"), (i + 1).alias("image_b_row_id"), pick("xyz", 3).alias("axis"), pick(("a", "b", "tie", ""), 4).alias("choice"))
    rows.write.option("header", "true").option("emptyValue", "").csv(path)
    return bundles.load_annotations(spark, path).select("pair_id", "image_a_row_id", "axis", "choice")


@query("select vec_id as row_id, [0.1::double, 0.5, 0.3, 0.9][(row_number() over (order by vec_id) - 1) % 4 + 1] as image_outfit_score from embeddings")
def s13_listed_scores(spark, d):
    return models.listed_scores(vw.images(spark, d), [0.1, 0.5, 0.3, 0.9])


@query(f"with {AXIS} select i.row_id, i.cluster_id, round(a.score, 9) as axis_a_vs_b from img i left join axl a on a.row_id = i.row_id and a.axis = 'axis_a_vs_b' and i.row_id % 2 = 0")
def j2_one_axis(spark, d):
    axis = _rounded(_wide(spark, d), *NAMES).where("row_id % 2 = 0").select("row_id", "axis_a_vs_b")
    return vw.images(spark, d).select("row_id", "cluster_id").join(axis, "row_id", "left")


@query(f"with {SCO} select s.row_id, d.source, s.image_outfit_score from sco s join documents d on d.doc_id = s.row_id")
def j3_points_with_scores(spark, d):
    return vw.records(spark, d).select("row_id", "source").join(_image_scores(spark, d), "row_id").select("row_id", "source", "image_outfit_score")


@query(f"with {IMG} select r.page_id as row_id, round(list_sum(i.e), 9) as total from pages r join img i on i.row_id = r.page_id")
def j13_gather_vectors(spark, d):
    wanted = vw.table(spark, d, "pages").select(F.col("page_id").alias("row_id"))
    return wanted.join(vw.images(spark, d), "row_id").select("row_id", F.round(v.total(F.col("e")), 9).alias("total"))


@query(f"with {IMG} select row_id, len(e) as dim, round(e[1], 9) as first from img where row_id % 5 = 0")
def v19_gather_features(spark, d):
    keys = vw.images(spark, d).select("row_id").where("row_id % 5 = 0")
    return keys.join(vw.images(spark, d), "row_id").select("row_id", F.size("e").alias("dim"), F.round(F.get("e", 0), 9).alias("first"))


ANY_RANK = (
    GAR
    + ", q as (select *, count(*) over (partition by outfit_id) as n from gar), qs as (select * from q where n >= 2)"
    + ", sims as (select q.garment_id as qid, c.garment_id as cid, c.outfit_id = q.outfit_id as hit, round(list_dot_product(q.e, c.e), 9) as s from qs q, gar c where c.garment_id <> q.garment_id and {target})"
    + ", rk as (select *, row_number() over (partition by qid order by s desc, cid) as r from sims)"
    + ", fst as (select qid, min(r) filter (hit) as f from rk group by qid)"
    + ", res as (select category, garment_id, qid is not null as met, f from qs left join fst on qid = garment_id)"
    + " select category, count(*) as n_queries, {hits}, round(coalesce(avg(coalesce(1.0 / f, 0)) filter (met), 0), 9) as mrr from res group by rollup (category)"
)


def _any_rank(ks, target="c.category <> q.category") -> str:
    return "with " + ANY_RANK.replace("{target}", target).replace("{hits}", ", ".join(f"round(avg(coalesce(f <= {k}, false)::int), 9) as hit_at_{k}" for k in ks))


@query(_any_rank((1, 5, 10)))
def e2_evaluate_any_rank(spark, d):
    return _rounded(evaluate.evaluate(vw.garments(spark, d)), *METRICS)


@query(_any_rank((1, 5), "c.category in ('top', 'shoes')"))
def e2_evaluate_targets(spark, d):
    return _rounded(evaluate.evaluate(vw.garments(spark, d), (1, 5), target_categories=("top", "shoes")), "hit_at_1", "hit_at_5", "mrr")


@query(_any_rank((2, 20)))
def a15_other_k(spark, d):
    return _rounded(evaluate.evaluate(vw.garments(spark, d), (2, 20)), "hit_at_2", "hit_at_20", "mrr")


@query("select count(distinct label) as n_clusters, array_to_string(list_sort(list(distinct label::varchar)), ',') as ids from embeddings")
def a20_distinct_clusters(spark, d):
    c = vw.images(spark, d).select(F.col("cluster_id").cast("string").alias("c")).distinct()
    return c.agg(F.count(F.lit(1)).alias("n_clusters"), F.array_join(F.array_sort(F.collect_list("c")), ",").alias("ids"))


@query("select doc_id as row_id, source from documents order by doc_id limit 25")
def t7_head(spark, d):
    return vw.records(spark, d).orderBy("row_id").limit(25).select("row_id", "source")


@query("select axis, row_number() over (order by k, p) - 1 as place from (select unnest(['axis_a_vs_b', 'axis_c_vs_d', 'axis_e_vs_f']) as axis, unnest([3, 1, 2]) as k, unnest([0, 1, 2]) as p)")
def t8_showcase_order(spark, d):
    names = spark.createDataFrame(list(enumerate(NAMES)), "p int, axis string")
    at = curate.with_position(names.select("axis", bundles.showcase_order(F.col("axis"), ["axis_c_vs_d", "axis_e_vs_f"]).alias("k"), "p"), "k", "p")
    return at.select("axis", F.col("position").alias("place"))


@query("select vec_id as global_index, row_number() over (order by md5('42,' || (vec_id // 50)), vec_id // 50, md5('42,' || vec_id), vec_id) - 1 as position from embeddings")
def n1_scan_order(spark, d):
    ids = vw.table(spark, d, "embeddings").select(F.col("vec_id").alias("global_index"), F.expr("vec_id div 50").alias("shard"))
    return sampling.scan_order(ids, 42).select("global_index", "position")


E12 = " union all ".join(f"select '{m}' as model, axis, round(min({s}), 9) as lo, round(max({s}), 9) as hi, round(avg({s}), 9) as mean, round(stddev_samp({s}), 9) as sd, round(max({s}) - min({s}), 9) as width from axl group by axis" for m, s in (("first", "score"), ("second", "-2 * score")))


@query(f"with {AXIS} select * from ({E12})")
def e12_model_comparison(spark, d):
    w = _wide(spark, d)
    second = w.select("row_id", *((-2 * F.col(n)).alias(n) for n in NAMES))
    return _rounded(evaluate.compare_models({"first": w, "second": second}, NAMES), "lo", "hi", "mean", "sd", "width")


@query(f"with {IMG}, p as (select row_id, e, row_id < 4 as pos from img where row_id < 9), s as (select i.row_id, avg(list_dot_product(i.e, p.e)) filter (pos) - avg(list_dot_product(i.e, p.e)) filter (not pos) as s from img i, p group by 1) select row_id, round(s, 9) as image_outfit_score from s")
def v9_prompt_scores(spark, d):
    i = vw.images(spark, d)
    prompts = i.where("row_id < 9").select(F.when(F.col("row_id") < 4, "positive").otherwise("negative").alias("polarity"), "e")
    return _rounded(models.prompt_scores(i, prompts), "image_outfit_score")


@query("select a as axis, upper(n[1]) || lower(n[2:]) as label from (select a, replace(regexp_replace(regexp_replace(lower(a), '_proxy$', ''), '_score$', ''), '_', ' ') as n from (values ('formal_proxy'), ('image_outfit_score'), ('a_vs_b'), ('Plain')) t(a))")
def x9_axis_names(spark, d):
    a = spark.createDataFrame([("formal_proxy",), ("image_outfit_score",), ("a_vs_b",), ("Plain",)], "axis string")
    return a.select("axis", lx.axis_name(F.col("axis")).alias("label"))


@query(f"with {GAR} select garment_id, printf('%06d_%d.jpg', garment_id, outfit_id) as image, printf('%06d_%d_%s.jpg', outfit_id, garment_id, category) as crop from gar")
def x10_file_names(spark, d):
    g = vw.garments(spark, d)
    return g.select("garment_id", F.format_string("%06d_%d.jpg", "garment_id", "outfit_id").alias("image"), F.format_string("%06d_%d_%s.jpg", "outfit_id", "garment_id", "category").alias("crop"))


@query("select page_id, 'data:text/html;base64,' || base64(encode(html)) as uri from pages")
def x16_data_uri(spark, d):
    return vw.table(spark, d, "pages").select("page_id", publish.data_uri(F.col("html").cast("binary"), "text/html").alias("uri"))


SIGNALS = "case when caption is null or caption = '' then 'empty=-Infinity' when ex is not null then 'excluded=-Infinity' else array_to_string(list_filter([case when ga and pe then 'combo=0.5' end, case when ga then 'garment=1.0' end, case when not st and md then 'medium_context=2.0' end, case when pen > 0 then 'penalty=' || format('{:.1f}', -1.5 * pen) end, case when pe then 'person=1.0' end, case when st then 'strong_outfit=3.0' end, case when not st and not md and we then 'wearing=1.5' end], lambda x: x is not null), ';') end"


@query(f"with {TPL}, {_scored('tpl')} select row_id, {SIGNALS} as signals from sc")
def x5_signals(spark, d):
    s = vw.templated(spark, d).withColumn("_low", F.lower("caption")).select("row_id", lx.score_caption(F.col("caption"), low=F.col("_low")).signals.alias("m"))
    entries = F.array_sort(F.map_entries("m"))
    return s.select("row_id", F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ";").alias("signals"))


@query("select p_partkey as row_id, round_even(p_retailprice / 8, 2) as r2, round_even(p_retailprice * 10 / 4, 0) as r0 from part")
def y13_half_even(spark, d):
    p = vw.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("row_id"), F.bround(F.col("p_retailprice") / 8, 2).alias("r2"), F.bround(F.col("p_retailprice") * 10 / 4, 0).alias("r0"))


@query("select 'axis_a_vs_b' as axis, 0 as place union all select 'axis_c_vs_d', 1 union all select 'axis_e_vs_f', 2")
def f15_axis_names(spark, d):
    return spark.createDataFrame(list(enumerate(bundles.axis_names(_wide(spark, d)))), "place int, axis string").select("axis", "place")


M4 = """with im as (select p_partkey as row_id, p_size * 20 as w, p_partkey % 1000 as h, case when p_partkey % 3 = 0 then 'detection_images/' || p_partkey when p_partkey % 3 = 1 then 'thumbnails/' || p_partkey end as src from part),
r as (select row_id, src, w, unnest(['upper', 'lower']) as category, unnest([0, floor(h * 0.40)::int]) as y, unnest([greatest(1, floor(h * 0.55)::int), h - floor(h * 0.40)::int]) as bh from im where src is not null and w >= 20 and h >= 20)
select row_number() over (order by row_id, y, category) - 1 as garment_id, row_id as outfit_id, category, y as bbox_y, w as bbox_w, bh as bbox_h, src as source_image_path, printf('garment_crops/%06d_%d_%s.jpg', row_id, row_number() over (order by row_id, y, category) - 1, category) as crop_path from r"""


@query(M4)
def m4_extract_garments(spark, d):
    t, key = vw.templated(spark, d), F.col("row_id")
    name = lambda folder: F.concat(F.lit(f"{folder}/"), key.cast("string"))
    records = t.select("row_id", name("detection_images").alias("detection_image_path"), name("thumbnails").alias("thumbnail_path"))
    files = t.where("row_id % 3 = 0").select(name("detection_images").alias("path")).union(t.where("row_id % 3 <> 2").select(name("thumbnails")))
    g = models.extract_garments(records, gm.split_regions(t), files)
    return g.select("garment_id", "outfit_id", "category", "bbox_y", "bbox_w", "bbox_h", "source_image_path", "crop_path")


@query(f"with {GAR}, s as (select q.garment_id, q.outfit_id, c.category, c.garment_id as cid, round(list_dot_product(q.e, c.e), 9) as sim from gar q join gar c on q.outfit_id <> c.outfit_id and q.category <> c.category), r as (select *, row_number() over (partition by garment_id, category order by sim desc, cid) as rank from s) select outfit_id, garment_id, category, array_to_string(list(cid::varchar order by rank), ',') as neighbors from r where rank <= 3 group by all")
def k5_garment_neighbours(spark, d):
    n = publish.garment_neighbours(vw.garments(spark, d), 3)
    return n.select("outfit_id", "garment_id", "category", F.array_join(F.transform("neighbors", lambda x: x.garment_id.cast("string")), ",").alias("neighbors"))


@query(f"with {AXIS} select axis, row_number() over (partition by axis order by round(score, 9), row_id) - 1 as place, row_id from axl")
def k5_axis_sorted(spark, d):
    return publish.sorted_axes(_rounded(_wide(spark, d), *NAMES), NAMES)


def _blend(n: int, flag: str) -> str:
    c = f"(2 * (e[{n}] - min(e[{n}]) over ()) / (max(e[{n}]) over () - min(e[{n}]) over ()) - 1)"
    return f"0.3 * ({flag})::int::double + 0.7 * {c}"


V10 = f"with {IMG}, r as (select i.row_id, e, lower(coalesce(d.text, '')) as low from img i join documents d on d.doc_id = i.row_id), b as (select row_id, " + ", ".join(f"{_blend(k, _any(t))} as {n}" for k, (n, t) in enumerate(lx.PROXY_AXES.items(), 1)) + " from r) select row_id, " + ", ".join(f"round(2 * ({n} - min({n}) over ()) / (max({n}) over () - min({n}) over ()) - 1, 9) as {n}" for n in lx.PROXY_AXES) + " from b"


@query(V10)
def v10_blend(spark, d):
    """The keyword blend over fixed components; v10_demo_axes has principal ones."""
    fixed = vw.images(spark, d).select("row_id", F.slice("e", 1, 4).alias("pc"))
    return _rounded(embeddings.demo_axes(fixed, vw.records(spark, d).select("row_id", "caption")), *lx.PROXY_AXES)


@query("select row_id, x0, y0, greatest(x0 + 1, least(w, x + bw)) as x1, greatest(y0 + 1, least(h, y + bh)) as y1 from (select *, greatest(0, x) as x0, greatest(0, y) as y0 from (select p_partkey as row_id, p_size * 20 as w, p_partkey % 1000 as h, (p_partkey % 7 - 3)::int as x, (p_partkey % 11 - 5)::int as y, p_size * 25 as bw, (p_partkey % 900)::int as bh from part))")
def m5_clamp(spark, d):
    t, k = vw.templated(spark, d), F.col("row_id")
    box = {"x": (k % 7 - 3).cast("int"), "y": (k % 11 - 5).cast("int"), "w": (F.col("width") / 20 * 25).cast("int"), "h": (k % 900).cast("int")}
    return t.select("row_id", *(c.cast("int").alias(n) for n, c in gm.clamp(box, F.col("width"), F.col("height")).items()))


@query("select case when contains(p, '/') then split_part(p, '/', 1) else p end as top, count(*) as n, sum(size) as bytes from (select case when p_partkey % 5 = 0 then 'f' || (p_partkey % 3) else 'dir' || (p_partkey % 4) || '/x' || p_partkey end as p, p_size as size from part) group by 1")
def k8_size_by_top(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("f"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("dir"), (k % 4).cast("string"), F.lit("/x"), k.cast("string")))
    return publish.size_by_top(vw.table(spark, d, "part").select(path.alias("path"), F.col("p_size").cast("long").alias("size")))


@query(f"with {IMG}, q as (select e as q from img where row_id = 3) select row_id, list_dot_product(e, q) as similarity from img, q order by similarity desc, row_id limit 7")
def k9_index_round_trip(spark, d):
    path = folders.fresh(spark, "index")
    files.save_index(vw.images(spark, d).select("row_id", "e"), path)
    index = files.load_index(spark, path)
    q = F.broadcast(index.where("row_id = 3").select(F.col("e").alias("q")))
    return embeddings.exact_scan(index.crossJoin(q), F.col("q"), 7)


@query("select p_partkey as row_id, ctype, size, (ctype like '%image%' or ctype like '%octet%') and size between 1000 and 50000000 as ok from (select p_partkey, ['image/jpeg', 'text/html', 'application/octet-stream', ''][p_partkey % 4 + 1] as ctype, floor(p_retailprice * 1.1)::bigint as size from part)")
def s12_acceptable(spark, d):
    k = F.col("p_partkey")
    t = vw.table(spark, d, "part").select(k.alias("row_id"), F.get(F.array(*map(F.lit, ("image/jpeg", "text/html", "application/octet-stream", ""))), (k % 4).cast("int")).alias("ctype"), F.floor(F.col("p_retailprice") * 1.1).cast("long").alias("size"))
    return t.select("*", acceptable(F.col("ctype"), F.col("size")).alias("ok"))


@query("select vec_id as row_id, case when vec_id % 10 = 0 then 'no score' else 'no record' end as problem from embeddings where (vec_id % 10 = 0) <> (vec_id % 7 = 0)")
def e8_axis_score_problems(spark, d):
    w = _wide(spark, d)
    records = vw.images(spark, d).where("row_id % 7 <> 0").select("row_id")
    return evaluate.axis_score_problems(w.where("row_id % 10 <> 0"), records)
