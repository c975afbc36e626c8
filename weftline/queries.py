"""Queries over the driver's tables, keyed by operator, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import lexicon as lx
from weftline.functions import vectors as v
from weftline.operators import curate, embeddings, evaluate, tables
from weftline.operators import garments as gm
from weftline.operators.knn import top_k
from weftline.sources import views as vw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AXES = [("axis_a_vs_b", 0, 1), ("axis_c_vs_d", 2, 3), ("axis_e_vs_f", 4, 5)]
NAMES = [a for a, *_ in AXES]


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(terms) -> str:
    return "[" + ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in terms) + "]"


# DuckDB forms of the derived relations
TPL = f"tpl as (select p_partkey as row_id, case when p_partkey % 2 = 0 then t else t || ' ' || p_name end as caption, p_size * 20 as width, p_partkey % 1000 as height, case when p_partkey % 5 > 0 then 'http://x/' || (p_partkey % 700) else '' end as url from (select *, {_quoted(vw.CAPTIONS)}[p_partkey % {len(vw.CAPTIONS)} + 1] as t from part))"
REC = "rec as (select doc_id as row_id, text as caption, source, n_chars as width from documents)"
IMG = "img as (select vec_id as row_id, label as cluster_id, embedding::double[] as e from embeddings)"
GAR = f"gar as (select vec_id as garment_id, vec_id // 3 as outfit_id, {_quoted(vw.CATEGORIES)}[label % 7 + 1] as category, case when vec_id % 11 <> 0 then (vec_id * 37 % 100) / 100.0::double end as confidence, embedding::double[] as e from embeddings)"


def _any(terms) -> str:
    return f"len(list_filter({_quoted(terms)}, lambda t: contains(low, t))) > 0"


def _first(terms) -> str:
    return f"list_filter({_quoted(terms)}, lambda t: contains(low, t))[1]"


def _scored(source: str) -> str:
    return f"""low as (select *, lower(caption) as low from {source}),
hit as (select *, {_first(lx.EXCLUSION)} as ex, {_any(lx.STRONG)} as st, {_any(lx.MEDIUM)} as md, contains(low, 'wearing') as we, {_any(lx.GARMENT)} as ga, {_any(lx.PERSON)} as pe, len(list_filter({_quoted(lx.PENALTY)}, lambda t: contains(low, t))) as pen, {_first(lx.CONTEXT)} as ctx, {_first(lx.GARMENT)} as gterm from low),
sc as (select *, case when caption is null or caption = '' or ex is not null then '-infinity'::double else (case when st then 3.0 when md then 2.0 when we then 1.5 else 0.0 end + case when ga then 1.0 else 0.0 end + case when pe then 1.0 else 0.0 end + case when ga and pe then 0.5 else 0.0 end - 1.5 * pen)::double end as caption_score from hit),
fl as (select *, case when caption is null or caption = '' then 'empty' when ex is not null then 'excluded' when ctx is not null or (pe and ga) then 'accepted' else 'no_fashion_signal' end as reason from sc)"""


@query(f"with {REC}, {_scored('rec')} select row_id, caption_score, caption <> '' and ex is not null as excluded, ex as excluded_term from sc")
def f1_score_caption(spark, d):
    return curate.scored(vw.records(spark, d)).select("row_id", "caption_score", "excluded", "excluded_term")


@query(f"with {TPL}, {_scored('tpl')} select row_id, caption_score, coalesce(ex is not null, false) as excluded, ex as excluded_term from sc")
def f1_score_templated(spark, d):
    return curate.scored(vw.templated(spark, d)).select("row_id", "caption_score", "excluded", "excluded_term")


@query(f"with {TPL}, {_scored('tpl')} select row_id, reason = 'accepted' as accepted, reason, case when reason = 'excluded' then ex when ctx is not null and reason = 'accepted' then ctx when reason = 'accepted' then gterm end as matched_term from fl")
def f2_filter_tiers(spark, d):
    return curate.filtered(vw.templated(spark, d)).select("row_id", "accepted", "reason", "matched_term")


@query(f"with {TPL}, {_scored('tpl')} select row_id, case when reason in ('empty', 'excluded') then reason when ctx is not null and not pe then 'no_person_context' else reason end as reason from fl")
def f2_filter_strict(spark, d):
    return curate.filtered(vw.templated(spark, d), strict=True).select("row_id", "reason")


@query(f"with {TPL}, {_scored('tpl')} select row_id, case when reason in ('empty', 'excluded') then reason when caption_score >= 1.5 then 'accepted' else 'below_score_threshold' end as reason, case when reason = 'excluded' then ex when reason = 'empty' then null when caption_score >= 1.5 then format('score={{:.1f}}', caption_score) else format('score={{:.1f}}<1.5', caption_score) end as matched_term from fl")
def f3_filter_score(spark, d):
    return curate.filtered(vw.templated(spark, d), mode="strict").select("row_id", "reason", "matched_term")


@query(f"with {TPL}, {_scored('tpl')} select row_id from fl where reason = 'accepted'")
def f4_matches_fashion(spark, d):
    return curate.filtered(vw.templated(spark, d)).where("accepted").select("row_id")


@query(f"with {TPL}, {_scored('tpl')} select m.mode as mode, count(*) as n from sc, (values ('broad', 0.5), ('strict', 1.5), ('outfit', 2.5)) m(mode, t) where caption_score >= t group by 1")
def f5_modes(spark, d):
    s = curate.scored(vw.templated(spark, d))
    counts = s.agg(*(F.count_if(F.col("caption_score") >= t).alias(m) for m, t in lx.MODES.items()))
    return counts.unpivot([], list(lx.MODES), "mode", "n")


def _image_scores(spark, d):
    first = vw.images(spark, d).where("row_id = 0").select(F.col("e").alias("q"))
    s = vw.images(spark, d).crossJoin(F.broadcast(first))
    return s.select("row_id", F.when(F.col("row_id") % 13 != 0, F.round(v.dot(F.col("e"), F.col("q")), 9)).alias("image_outfit_score"))


SCO = IMG + ", sco as (select i.row_id, case when i.row_id % 13 <> 0 then round(list_dot_product(i.e, q.e), 9) end as image_outfit_score from img i, img q where q.row_id = 0)"


@query(f"with {SCO} select row_id, coalesce(image_outfit_score >= 0.1, false) as gate_accepted, case when image_outfit_score < 0.1 then format('image_score={{:.4f}}<0.1', image_outfit_score) end as gate_term from sco")
def f6_image_gate(spark, d):
    return curate.image_gate(_image_scores(spark, d), 0.1).select("row_id", "gate_accepted", "gate_term")


@query(f"with {TPL}, {_scored('tpl')} select row_id, caption_score from sc where caption_score >= 1.5 and url <> ''")
def f7_harvest(spark, d):
    return curate.harvest(vw.templated(spark, d)).select("row_id", "caption_score")


@query(f"with {TPL} select row_id from tpl where least(width, height) >= 512")
def f8_dimensions(spark, d):
    return curate.large_enough(vw.templated(spark, d)).select("row_id")


@query(f"with {GAR} select g.garment_id from gar g, gar q where q.garment_id = 5 and g.garment_id <> 5 and g.outfit_id <> q.outfit_id and g.category <> q.category")
def f9_candidates(spark, d):
    g = vw.garments(spark, d)
    q = F.broadcast(g.where("garment_id = 5").select(F.col("outfit_id").alias("o"), F.col("category").alias("c")))
    return g.where("garment_id <> 5").crossJoin(q).where("outfit_id <> o and category <> c").select("garment_id")


@query("select vec_id as row_id from embeddings where vec_id % 4 in (0, 1)")
def f10_annotated(spark, d):
    return _annotations(spark, d).where(F.col("choice").isin("a", "b")).select(F.col("image_a_row_id").alias("row_id"))


@query(f"with {GAR} select garment_id, category, printf('garment_crops/%06d.jpg', garment_id) as crop_path from gar where outfit_id = 7")
def f11_lookup(spark, d):
    return vw.garments(spark, d).where("outfit_id = 7").select("garment_id", "category", "crop_path")


@query("select page_id, regexp_matches(url, '(^|/)(__pycache__|\\.DS_Store)(/|$)|\\.pyc(/|$)|^detection_images/') as excluded from pages")
def f12_exclude_paths(spark, d):
    return vw.table(spark, d, "pages").select("page_id", F.col("url").rlike(r"(^|/)(__pycache__|\.DS_Store)(/|$)|\.pyc(/|$)|^detection_images/").alias("excluded"))


@query(f"with {SCO} select count(*) as n from sco where image_outfit_score is not null")
def f13_dropna(spark, d):
    s = _image_scores(spark, d)
    return s.na.drop(subset=["image_outfit_score"]).where(~F.isnan("image_outfit_score")).agg(F.count(F.lit(1)).alias("n"))


@query("select vec_id as image_a_row_id, label as cluster, '' as annotator from embeddings")
def f14_project(spark, d):
    return vw.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_a_row_id"), F.col("label").alias("cluster"), F.lit("").alias("annotator"))


SHARDS = [(f"/raven/ptmp/s{k}.tar", 31 * k * k, 31 * (k + 1) * (k + 1)) for k in range(7)]
SHARD_SQL = "shards as (select * from (values " + ", ".join(map(str, SHARDS)) + ") s(tar_path, start_index, end_index))"


def _shards(spark):
    s = spark.createDataFrame(SHARDS, "tar_path string, start_index long, end_index long")
    return s.withColumn("tar_path", tables.rewritten_path(F.col("tar_path"), "/raven/ptmp/", "/ptmp/"))


@query(f"with {SHARD_SQL} select replace(tar_path, '/raven/ptmp/', '/ptmp/') as tar_path, end_index - start_index as n_images from shards")
def s1_shards(spark, d):
    return _shards(spark).select("tar_path", (F.col("end_index") - F.col("start_index")).alias("n_images"))


@query(f"with {SHARD_SQL} select vec_id as global_index, replace(tar_path, '/raven/ptmp/', '/ptmp/') as tar_path, vec_id - start_index as within from embeddings join shards on vec_id >= start_index and vec_id < end_index")
def s2_locate(spark, d):
    return tables.locate(vw.table(spark, d, "embeddings").select(F.col("vec_id").alias("global_index")), _shards(spark))


@query("select nullif(nullif(url, ''), 'x') as u, coalesce(nullif(url, ''), 'none') as source_id, page_id from pages")
def s9_source_ids(spark, d):
    p = vw.table(spark, d, "pages")
    return p.select(F.nullif(F.nullif("url", F.lit("")), F.lit("x")).alias("u"), F.coalesce(F.nullif("url", F.lit("")), F.lit("none")).alias("source_id"), "page_id")


@query("select p_partkey as row_id, coalesce(nullif(case when p_partkey % 3 = 0 then '' else p_brand end, ''), nullif(p_name, ''), '') as source_id from part")
def x14_falsy(spark, d):
    p = vw.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("row_id"), tables.falsy_coalesce(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")), F.col("p_name")).alias("source_id"))


@query(f"with {IMG} select row_id, round(n, 9) as norm from (select row_id, sqrt(list_dot_product(u, u)) as n from (select row_id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) as u from img))")
def k2_export_normalised(spark, d):
    return vw.images(spark, d).select("row_id", F.round(v.norm(v.normalise(F.col("e"))), 9).alias("norm"))


@query(f"with {TPL}, {_scored('tpl')} select row_id, reason from (select *, row_number() over (partition by reason order by row_id) as rn from fl) where rn <= 100")
def k4_samples(spark, d):
    return curate.samples_per_reason(curate.filtered(vw.templated(spark, d))).select("row_id", "reason")


@query(f"with {TPL}, {_scored('tpl')} select count(*) as scanned, count(*) filter (reason = 'accepted') as n_accepted, count(*) filter (reason = 'empty') as empty, count(*) filter (reason = 'excluded') as excluded, count(*) filter (reason = 'no_person_context') as no_person_context, count(*) filter (reason = 'no_fashion_signal') as no_fashion_signal, count(*) filter (reason = 'below_score_threshold') as below_score_threshold, count(*) filter (reason = 'accepted') / greatest(count(*), 1) as accept_rate from fl")
def a1_diagnostics(spark, d):
    return curate.diagnostics(curate.filtered(vw.templated(spark, d)))


@query(f"with {TPL}, {_scored('tpl')} select min(caption_score) as lo, max(caption_score) as hi, avg(caption_score) as mean, count(*) as n from fl where reason = 'accepted' and caption_score > '-infinity'::double")
def a2_score_summary(spark, d):
    t = curate.scored(curate.filtered(vw.templated(spark, d)).where("accepted"))
    return curate.score_summary(t, "caption_score")


@query("with s as (select list(p_retailprice order by p_retailprice) as l from part) select l[len(l) // 4 + 1] as p25, l[len(l) // 2 + 1] as median, l[3 * len(l) // 4 + 1] as p75, l[1] as lo, l[len(l)] as hi, round((select avg(p_retailprice) from part), 6) as mean from s")
def a3_picked_quartiles(spark, d):
    return curate.picked_quartiles(vw.table(spark, d, "part"), "p_retailprice").withColumn("mean", F.round("mean", 6))


@query("select quantile_cont(p_retailprice, 0.25) as p25, quantile_cont(p_retailprice, 0.5) as median, quantile_cont(p_retailprice, 0.75) as p75, round(avg(p_retailprice), 6) as mean from part")
def a4_quartiles(spark, d):
    return curate.quartiles(vw.table(spark, d, "part"), "p_retailprice").withColumn("mean", F.round("mean", 6))


def _axes(spark, d):
    """Directions between the means of pairs of labels."""
    m = embeddings.means(vw.images(spark, d), "cluster_id")
    rows = None
    for name, a, b in AXES:
        part = m.where(F.col("cluster_id").isin(a, b)).select(F.lit(name).alias("axis"), F.when(F.col("cluster_id") == a, "positive").otherwise("negative").alias("polarity"), "e")
        rows = part if rows is None else rows.union(part)
    return embeddings.directions(rows)


AXIS = (
    IMG
    + ", cen as (select cluster_id, list(m order by d) as e from (select cluster_id, d, avg(x) as m from (select cluster_id, unnest(e) as x, generate_subscripts(e, 1) as d from img) group by 1, 2) group by 1)"
    + ", pair as (select * from (values "
    + ", ".join(map(str, AXES))
    + ") p(axis, a, b)), dif as (select axis, list_transform(list_zip(x.e, y.e), lambda z: z[1] - z[2]) as df from pair join cen x on x.cluster_id = a join cen y on y.cluster_id = b)"
    + ", dir as (select axis, list_transform(df, lambda z: z / greatest(sqrt(list_dot_product(df, df)), 1e-12)) as e from dif)"
    + ", axl as (select row_id, axis, list_dot_product(i.e, r.e) as score from img i, dir r)"
)


def _wide(spark, d):
    return embeddings.axis_scores(vw.images(spark, d), _axes(spark, d), NAMES)


def _long(spark, d):
    return _wide(spark, d).unpivot(["row_id"], NAMES, "axis", "score")


@query(f"with {AXIS} select axis, round(min(score), 9) as lo, round(max(score), 9) as hi, round(avg(score), 9) as mean, round(stddev_samp(score), 9) as sd, round(max(score) - min(score), 9) as width from axl group by axis")
def a5_axis_summary(spark, d):
    r = lambda c: F.round(c, 9)
    return _long(spark, d).groupBy("axis").agg(r(F.min("score")).alias("lo"), r(F.max("score")).alias("hi"), r(F.avg("score")).alias("mean"), r(F.stddev_samp("score")).alias("sd"), r(F.max("score") - F.min("score")).alias("width"))


@query(f"with {GAR} select category, count(*) as n from gar group by category")
def a6_per_category(spark, d):
    return vw.garments(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {GAR} select min(confidence) as lo, round(avg(confidence), 9) as mean, max(confidence) as hi from gar")
def a7_confidence(spark, d):
    g = vw.garments(spark, d).where(~F.isnan("confidence") | F.col("confidence").isNull())
    return g.agg(F.min("confidence").alias("lo"), F.round(F.avg("confidence"), 9).alias("mean"), F.max("confidence").alias("hi"))


@query(f"with {GAR} select min(n) as lo, round(avg(n), 9) as mean, max(n) as hi, (select count(*) from embeddings) - count(*) as without_garments from (select outfit_id, count(*) as n from gar group by 1)")
def a8_per_outfit(spark, d):
    n = vw.table(spark, d, "embeddings").count()
    s = vw.garments(spark, d).groupBy("outfit_id").count()
    return s.agg(F.min("count").alias("lo"), F.round(F.avg("count"), 9).alias("mean"), F.max("count").alias("hi"), (F.lit(n) - F.count(F.lit(1))).alias("without_garments"))


@query("select label as cluster_id, count(*) as size from embeddings group by 1 having count(*) < 51")
def a9_cluster_sizes(spark, d):
    return evaluate.small_clusters(vw.images(spark, d), 51)


@query(f"with {AXIS} select cluster_id, axis, round(avg(score), 9) as mean from axl join img using (row_id) group by 1, 2")
def a10_cluster_axis_means(spark, d):
    m = embeddings.cluster_axis_means(_wide(spark, d), vw.images(spark, d).select("row_id", "cluster_id"), NAMES)
    return m.withColumn("mean", F.round("mean", 9))


@query(f"with {AXIS} select cluster_id, list_transform(e, lambda x: round(x, 9)) as e from cen")
def a11_centroids(spark, d):
    return embeddings.means(vw.images(spark, d), "cluster_id").withColumn("e", F.transform("e", lambda x: F.round(x, 9)))


DIST = AXIS + ", dst as (select row_id, i.cluster_id, round(sqrt(list_sum(list_transform(list_zip(i.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) as distance from img i join cen c on i.cluster_id = c.cluster_id)"


@query(f"with {DIST} select row_id, cluster_id, distance from dst, (select avg(distance) + 2 * stddev_pop(distance) as l from dst) where distance > l")
def a12_outliers(spark, d):
    return embeddings.outliers(vw.images(spark, d))


@query(f"with {SCO} select row_id, image_outfit_score from sco, (select greatest(quantile_cont(image_outfit_score, 0.05), 0.15) as l from sco) where image_outfit_score <= l")
def a13_low_scores(spark, d):
    return evaluate.low_scores(_image_scores(spark, d)).select("row_id", "image_outfit_score")


EVAL = (
    GAR
    + ", q as (select *, count(*) over (partition by outfit_id) as n from gar)"
    + ", qs as (select * from q where n >= 2)"
    + ", sims as (select q.garment_id as qid, c.garment_id as cid, c.outfit_id = q.outfit_id as hit, round(list_dot_product(q.e, c.e), 9) as s from qs q, gar c where {pool} and c.category <> q.category)"
    + ", rk as (select *, row_number() over (partition by qid order by s desc, cid) as r from sims)"
    + ", fst as (select qid, min(r) as f from rk where hit and r <= 10 group by qid)"
    + ", res as (select category, garment_id, f from qs left join fst on qid = garment_id)"
    + " select category, count(*) as n_queries, round(avg((coalesce(f, 11) <= 1)::int), 9) as hit_at_1, round(avg((coalesce(f, 11) <= 5)::int), 9) as hit_at_5, round(avg((coalesce(f, 11) <= 10)::int), 9) as hit_at_10, round(avg(coalesce(1.0 / f, 0)), 9) as mrr from res group by rollup (category)"
)


def _rounded(df, *columns):
    return df.select(*(F.round(c, 9).alias(c) if c in columns else F.col(c) for c in df.columns))


METRICS = ("hit_at_1", "hit_at_5", "hit_at_10", "mrr")


@query("with " + EVAL.replace("{pool}", "c.garment_id <> q.garment_id"))
def e2_evaluate_cooccurrence(spark, d):
    return _rounded(evaluate.evaluate(vw.garments(spark, d), mrr_at=10), *METRICS)


@query("with " + EVAL.replace("{pool}", "c.outfit_id <> q.outfit_id"))
def e2_evaluate_reference(spark, d):
    return _rounded(evaluate.evaluate(vw.garments(spark, d), mode="reference"), *METRICS)


@query(f"with {GAR} select a.garment_id as qid, a.outfit_id, a.category, coalesce(list(b.garment_id order by b.garment_id) filter (b.garment_id is not null), []) as truth from gar a left join gar b on a.outfit_id = b.outfit_id and a.garment_id <> b.garment_id group by all having count(b.garment_id) >= 1")
def e1_eval_queries(spark, d):
    return evaluate.eval_queries(vw.garments(spark, d))


def _annotations(spark, d):
    n = vw.table(spark, d, "embeddings").count()
    i = F.col("vec_id")
    rows = vw.table(spark, d, "embeddings").select(i.alias("pair_id"), i.alias("image_a_row_id"), ((i * 7 + 13) % n).alias("image_b_row_id"), F.get(F.array(*map(F.lit, NAMES)), (i % 3).cast("int")).alias("axis"), F.get(F.array(*map(F.lit, ("a", "b", "tie", ""))), (i % 4).cast("int")).alias("choice"))
    return rows


ANN = f"ann as (select vec_id as a, (vec_id * 7 + 13) % (select count(*) from embeddings) as b, {_quoted(NAMES)}[vec_id % 3 + 1] as axis, ['a', 'b', 'tie', ''][vec_id % 4 + 1] as choice from embeddings)"


@query(f"with {AXIS}, {ANN}, j as (select ann.axis, case when choice = 'a' then round(x.score, 12) > round(y.score, 12) else round(y.score, 12) > round(x.score, 12) end as ok from ann join axl x on x.row_id = a and x.axis = ann.axis join axl y on y.row_id = b and y.axis = ann.axis where choice in ('a', 'b')) select axis, count(*) filter (ok) as agree, count(*) filter (not ok) as disagree, count(*) as n_evaluated, count(*) filter (ok) / count(*) as accuracy from j group by axis")
def e3_agreement(spark, d):
    return evaluate.agreement(_annotations(spark, d), _long(spark, d).withColumn("score", F.round("score", 12)))


@query(f"with {GAR} select vec_id as row_id from embeddings where vec_id not in (select outfit_id from gar)")
def e4_no_garments(spark, d):
    return evaluate.images_without_garments(vw.images(spark, d), vw.garments(spark, d))


@query("select 'outliers' as category, 'info' as severity, count(*) as n, list(vec_id order by vec_id)[1:20] as examples from embeddings where vec_id % 7 = 0 union all select 'low', 'warning', count(*), list(vec_id order by vec_id)[1:20] from embeddings where vec_id % 100 = 3")
def k7_failure_report(spark, d):
    i = vw.images(spark, d)
    a = i.where("row_id % 7 = 0").select(F.lit("outliers").alias("category"), F.lit("info").alias("severity"), "row_id")
    return evaluate.failure_report([a, i.where("row_id % 100 = 3").select(F.lit("low").alias("category"), F.lit("warning").alias("severity"), "row_id")])


@query("select count(*) as n from (select doc_id from documents where doc_id % 10 <> 0 union all select n_nationkey from nation where false) having count(*) < 0")
def e8_dense_ids_ok(spark, d):
    n = tables.dense_ids_problems(vw.records(spark, d)).agg(F.count(F.lit(1)).alias("n"))
    return n.where("n > 0")


@query("select doc_id as row_id, 'unexpected' as problem from documents where doc_id % 10 <> 0 and doc_id >= (select count(*) from documents where doc_id % 10 <> 0) union all select doc_id, 'missing' from documents where doc_id % 10 = 0 and doc_id < (select count(*) from documents where doc_id % 10 <> 0)")
def e8_dense_ids_gaps(spark, d):
    return tables.dense_ids_problems(vw.records(spark, d).where("row_id % 10 <> 0"))


@query(f"with {GAR}, g2 as (select garment_id // 2 as garment_id, outfit_id from gar) select garment_id, 'unknown outfit' as problem from g2 where outfit_id not in (select vec_id from embeddings where vec_id < 100) union all select garment_id, 'repeated id' from g2 group by 1 having count(*) > 1")
def e9_garment_problems(spark, d):
    g = vw.garments(spark, d).withColumn("garment_id", F.expr("garment_id div 2"))
    return evaluate.garment_problems(g, vw.images(spark, d).where("row_id < 100"))


@query("select e.vec_id as row_id, d.text as caption, e.label from embeddings e left join documents d on d.doc_id = e.vec_id and d.doc_id % 2 = 0")
def j1_left_join(spark, d):
    right = vw.table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("caption"))
    return vw.table(spark, d, "embeddings").join(right, "vec_id", "left").select(F.col("vec_id").alias("row_id"), "caption", "label")


@query("select doc_id as row_id from documents where doc_id in (select doc_id from labels)")
def j8_semi(spark, d):
    return vw.table(spark, d, "documents").join(vw.table(spark, d, "labels"), "doc_id", "left_semi").select(F.col("doc_id").alias("row_id"))


@query("select doc_id as row_id from documents where doc_id not in (select doc_id from labels)")
def j9_anti(spark, d):
    return vw.table(spark, d, "documents").join(vw.table(spark, d, "labels"), "doc_id", "left_anti").select(F.col("doc_id").alias("row_id"))


@query(f"with {AXIS} select row_id, " + ", ".join(f"round(max(score) filter (axis = '{a}'), 9) as {a}" for a in NAMES) + " from axl group by row_id")
def v8_axis_scores(spark, d):
    return _rounded(_wide(spark, d), *NAMES)


@query(f"with {AXIS} select axis, list_transform(e, lambda x: round(x, 9)) as e from dir")
def v7_directions(spark, d):
    return _axes(spark, d).withColumn("e", F.transform("e", lambda x: F.round(x, 9)))


@query(f"with {GAR} select g.garment_id, c.label from gar g left join (select label as k, 'Cluster ' || label as label from embeddings group by 1) c on c.k = g.garment_id % 10")
def j14_map(spark, d):
    labels = vw.images(spark, d).select("cluster_id").distinct().select(F.col("cluster_id").cast("long").alias("k"), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")).alias("label"))
    return vw.garments(spark, d).withColumn("k", F.col("garment_id") % 10).join(F.broadcast(labels), "k", "left").select("garment_id", "label")


@query(f"with {IMG}, s as (select a.row_id as qid, b.row_id as cid, round(list_dot_product(a.e, b.e), 9) as similarity from img a join img b on a.row_id <> b.row_id), r as (select *, row_number() over (partition by qid order by similarity desc, cid) as rank from s) select qid, cid, rank, round(similarity, 6) as similarity from r where rank <= 12")
def w1_knn_all(spark, d):
    i = vw.images(spark, d)
    q = i.select(F.col("row_id").alias("qid"), F.col("row_id").alias("qgroup"), F.lit(None).alias("not_tag"), "e")
    c = i.select(F.col("row_id").alias("cid"), F.col("row_id").alias("cgroup"), F.lit(None).alias("tag"), "e")
    return top_k(q, c, 12).select("qid", "cid", "rank", F.round("similarity", 6).alias("similarity"))


def _per_category(spark, d, k=5, broadcast_bytes=64 << 20):
    g = vw.garments(spark, d)
    q = g.select(F.col("garment_id").alias("qid"), F.col("outfit_id").alias("qgroup"), F.col("category").alias("not_tag"), "e")
    c = g.select(F.col("garment_id").alias("cid"), F.col("outfit_id").alias("cgroup"), F.col("category").alias("tag"), "e")
    return top_k(q, c, k, broadcast_bytes).select("qid", F.col("tag").alias("ccat"), "cid", "rank", F.round("similarity", 6).alias("similarity"))


W2 = f"with {GAR}, s as (select q.garment_id as qid, c.garment_id as cid, c.category as ccat, round(list_dot_product(q.e, c.e), 9) as similarity from gar q join gar c on q.outfit_id <> c.outfit_id and q.category <> c.category), r as (select *, row_number() over (partition by qid, ccat order by similarity desc, cid) as rank from s) select qid, ccat, cid, rank, round(similarity, 6) as similarity from r where rank <= 5"


@query(W2)
def w2_topk_per_category(spark, d):
    return _per_category(spark, d)


@query(W2)
def w2_topk_in_blocks(spark, d):
    return _per_category(spark, d, broadcast_bytes=0)


@query(f"with {GAR}, q as (select * from gar where garment_id = 4) select g.garment_id, g.outfit_id, g.category, list_dot_product(q.e, g.e) as similarity from gar g, q where g.garment_id <> 4 and g.outfit_id <> q.outfit_id and g.category <> q.category order by similarity desc, g.garment_id limit 10")
def v4_retrieve_similar(spark, d):
    g = vw.garments(spark, d)
    q = F.broadcast(g.where("garment_id = 4").select(F.col("outfit_id").alias("o"), F.col("category").alias("c"), F.col("e").alias("q")))
    met = g.where("garment_id <> 4").crossJoin(q).where("outfit_id <> o and category <> c")
    return met.select("garment_id", "outfit_id", "category", v.dot(F.col("e"), F.col("q")).alias("similarity")).orderBy(F.desc("similarity"), "garment_id").limit(10)


@query(f"with {IMG}, q as (select e as q from img where row_id = 3) select row_id, list_dot_product(e, q) as similarity from img, q order by similarity desc, row_id limit 10")
def t4_search_index(spark, d):
    q = F.broadcast(vw.images(spark, d).where("row_id = 3").select(F.col("e").alias("q")))
    return embeddings.exact_scan(vw.images(spark, d).crossJoin(q), F.col("q"), 10)


@query(f"with {IMG}, q as (select e as q from img where row_id = 3) select row_id, list_dot_product(e, q) / greatest(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)), 1e-12) as similarity from img, q where row_id <> 3 order by similarity desc, row_id limit 10")
def t3_nearest_neighbors(spark, d):
    q = F.broadcast(vw.images(spark, d).where("row_id = 3").select(F.col("e").alias("q")))
    return embeddings.exact_scan(vw.images(spark, d).where("row_id <> 3").crossJoin(q), F.col("q"), 10, "cosine")


@query(f"with {SCO} select row_number() over (order by image_outfit_score desc, row_id) - 1 as new_row_id, row_id, image_outfit_score from sco where image_outfit_score is not null order by image_outfit_score desc, row_id limit 50")
def t1_rank_candidates(spark, d):
    return curate.rank_candidates(_image_scores(spark, d), "image_outfit_score", 50)


@query(f"with {AXIS}, s as (select row_id, round(score, 9) as axis_a_vs_b from axl where axis = 'axis_a_vs_b') (select row_id, 'top' as side, axis_a_vs_b from s order by axis_a_vs_b desc, row_id limit 20) union all (select row_id, 'bottom', axis_a_vs_b from s order by axis_a_vs_b, row_id limit 20)")
def t2_top_bottom(spark, d):
    return embeddings.top_bottom(_rounded(_wide(spark, d), *NAMES), "axis_a_vs_b", 20)


@query(f"with {AXIS} select axis, row_id, row_number() over (partition by axis order by round(score, 9), row_id) as place from axl")
def t5_argsort(spark, d):
    w = Window.partitionBy("axis").orderBy(F.round("score", 9), "row_id")
    return _long(spark, d).select("axis", "row_id", F.row_number().over(w).alias("place"))


@query(f"with {TPL}, {_scored('tpl')} select row_id, caption_score from sc where caption_score >= 1.5 order by caption_score desc, row_id limit 100")
def t6_sorted_candidates(spark, d):
    return curate.scored(vw.templated(spark, d)).where("caption_score >= 1.5").orderBy(F.desc("caption_score"), "row_id").limit(100).select("row_id", "caption_score")


@query(f"with {DIST} select cluster_id, row_id, distance, rank from (select *, row_number() over (partition by cluster_id order by distance, row_id) as rank from dst) where rank <= 5")
def w4_exemplars(spark, d):
    return embeddings.exemplars(vw.images(spark, d)).select("cluster_id", "row_id", "distance", "rank")


@query(f"with {TPL}, {_scored('tpl')}, p as (select row_id, reason, row_number() over (order by row_id) - 1 as scan_position from fl), a as (select row_id, scan_position, row_number() over (order by row_id) - 1 as position from p where reason = 'accepted' and scan_position < 1500) select * from a where position < 200")
def w6_scan_until(spark, d):
    return curate.scan_until(curate.filtered(vw.templated(spark, d)), 200, 1500)


@query("select doc_id as row_id, row_number() over (order by n_chars desc, doc_id) - 1 as position from documents")
def w7_reindex(spark, d):
    return curate.with_position(vw.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "n_chars"), F.desc("n_chars"), F.asc("row_id")).select("row_id", "position")


@query("select doc_id from (select doc_id, row_number() over (partition by text order by source, doc_id) as rn from documents) where rn = 1")
def w8_first_per_text(spark, d):
    return tables.first_per_key(vw.table(spark, d, "documents").select("doc_id", "source", "text"), "text", "source", "doc_id").select("doc_id")


@query(f"with {GAR} select garment_id from (select garment_id, row_number() over (partition by category order by garment_id) as rn, category from gar) where rn % 4 = 1 order by category, garment_id limit 30")
def w9_sample_queries(spark, d):
    w = Window.partitionBy("category").orderBy("garment_id")
    return vw.garments(spark, d).withColumn("rn", F.row_number().over(w)).where("rn % 4 = 1").orderBy("category", "garment_id").limit(30).select("garment_id")


@query(f"with {AXIS}, m as (select cluster_id, axis, avg(score) as mean from axl join img using (row_id) group by 1, 2), t as (select *, row_number() over (partition by cluster_id order by round(abs(mean), 9) desc, axis) as rn from m), n as (select cluster_id, rn, case when mean >= 0 then split_part(axis, '_vs_', 1) else split_part(axis, '_vs_', 2) end as s from t where rn <= 2) select cluster_id, string_agg(upper(replace(s, '_', ' ')[1]) || lower(replace(s, '_', ' ')[2:]), ' ' order by rn) as label from n group by 1")
def x8_cluster_labels(spark, d):
    clusters = vw.images(spark, d).select("row_id", "cluster_id")
    return embeddings.cluster_labels(embeddings.cluster_axis_means(_wide(spark, d), clusters, NAMES), clusters, NAMES)


@query("select doc_id % 500 as k, source from documents where doc_id % 3 = 0 union all select doc_id % 500, source from documents where doc_id % 3 = 1")
def u1_union(spark, d):
    p = vw.table(spark, d, "documents").select((F.col("doc_id") % 500).alias("k"), "source", "doc_id")
    return tables.union_sources(p.where("doc_id % 3 = 0").drop("doc_id"), p.where("doc_id % 3 = 1").drop("doc_id")).select("k", "source")


@query(f"with {TPL}, u as (select url, 0 as priority, row_id from tpl where row_id % 2 = 0 union all select url, 1, row_id from tpl where row_id % 2 = 1) select url, row_id, priority from (select *, row_number() over (partition by url order by priority, row_id) as rn from u) where rn = 1")
def u2_dedupe_urls(spark, d):
    t = vw.templated(spark, d).select("url", "row_id")
    return tables.first_per_key(tables.union_sources(t.where("row_id % 2 = 0"), t.where("row_id % 2 = 1")), "url", "priority", "row_id").select("url", "row_id", "priority")


@query("select vec_id as row_id from embeddings except select doc_id from labels")
def u3_except(spark, d):
    return vw.images(spark, d).select("row_id").subtract(vw.table(spark, d, "labels").select("doc_id"))


@query("with b as (select vec_id as row_id, array_to_string(list_transform(range(1, len(embedding)), lambda k: case when embedding[k + 1] > embedding[k] then '1' else '0' end), '') as h from embeddings) select min(row_id) as row_id, h from b group by h")
def u4_phash_dedupe(spark, d):
    i = vw.images(spark, d).select("row_id", gm.phash_bits(F.col("e")).alias("h"))
    return tables.first_per_key(i, F.coalesce("h", F.concat(F.lit("fail"), "row_id")), "row_id").select("row_id", "h")


@query(f"with {TPL}, l as (select row_id, lower(coalesce(caption, '')) as low from tpl) select row_id, " + ", ".join(f"({_any(t)})::int::double as {n}" for n, t in lx.PROXY_AXES.items()) + " from l")
def x6_proxy_flags(spark, d):
    return vw.templated(spark, d).select("row_id", *(c.alias(n) for n, c in lx.proxy_flags(F.col("caption")).items()))


@query("select page_id, 'laion_' || substr(md5(url), 1, 16) || '.jpeg' as file from pages")
def x11_file_names(spark, d):
    return vw.table(spark, d, "pages").select("page_id", tables.file_name(F.col("url")).alias("file"))


@query(r"""select page_id, coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^.*/[^/]*[^/.](\.[A-Za-z0-9]+)$', 1), ''), '.jpeg') as suffix from pages""")
def x12_suffix(spark, d):
    return vw.table(spark, d, "pages").select("page_id", tables.suffix(F.col("url")).alias("suffix"))


@query("select page_id, replace(replace(replace(replace(replace(substr(html, 1, 120), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as cell from pages")
def x13_snippets(spark, d):
    return vw.table(spark, d, "pages").select("page_id", tables.snippet(F.col("html"), 120).alias("cell"))


@query("select page_id, starts_with(url, '/') as absolute, list_last(string_split(url, '/')) as base from pages")
def x15_paths(spark, d):
    return vw.table(spark, d, "pages").select("page_id", F.startswith("url", F.lit("/")).alias("absolute"), F.element_at(F.split("url", "/"), -1).alias("base"))


@query("select vec_id as row_id, 2 * (embedding[1]::double - lo) / (hi - lo) - 1 as s from embeddings, (select min(embedding[1]::double) as lo, max(embedding[1]::double) as hi from embeddings)")
def y5_min_max(spark, d):
    return embeddings.scale_columns(vw.images(spark, d).select("row_id", F.get("e", 0).alias("s")), ["s"])


@query("select p_partkey as row_id, category, 0 as x, y, w, h from (select p_partkey, p_size * 20 as w, unnest(['upper', 'lower']) as category, unnest([0, floor((p_partkey % 1000) * 0.40)::int]) as y, unnest([greatest(1, floor((p_partkey % 1000) * 0.55)::int), (p_partkey % 1000) - floor((p_partkey % 1000) * 0.40)::int]) as h from part where p_size * 20 >= 20 and p_partkey % 1000 >= 20)")
def m3_split_regions(spark, d):
    return gm.split_regions(vw.templated(spark, d))


@query("select p_partkey as row_id, greatest(1, round(w * s)) ::int as tw, greatest(1, round(h * s))::int as th from (select p_partkey, w, h, least(1.0::double, 256.0::double / greatest(w, h)) as s from (select p_partkey, p_size * 20 as w, p_partkey % 1000 as h from part))")
def m9_thumbnails(spark, d):
    w, h = gm.thumbnail_size(F.col("width"), F.col("height"), 256)
    return vw.templated(spark, d).select("row_id", w.alias("tw"), h.alias("th"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, d):
    return vw.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select case when min(e) < 0 and max(e) > 0 then -greatest(abs(min(e)), abs(max(e))) else min(e) end as lo, case when min(e) < 0 and max(e) > 0 then greatest(abs(min(e)), abs(max(e))) else max(e) end as hi from (select embedding[1]::double as e from embeddings)")
def a22_colour_bounds(spark, d):
    b = vw.images(spark, d).agg(F.min(F.get("e", 0)).alias("lo"), F.max(F.get("e", 0)).alias("hi"))
    m, both = F.greatest(F.abs("lo"), F.abs("hi")), (F.col("lo") < 0) & (F.col("hi") > 0)
    return b.select(F.when(both, -m).otherwise(F.col("lo")).alias("lo"), F.when(both, m).otherwise(F.col("hi")).alias("hi"))


@query("select source, count(*) as n from documents group by source")
def a19_sources(spark, d):
    return vw.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as top, count(*) as n, sum(octet_length(encode(html))) as bytes from pages group by 1")
def a21_bytes_per_path(spark, d):
    return vw.table(spark, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("top")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("bytes"))


N2 = f"""with p as (select vec_id as a, row_number() over (order by vec_id) - 1 as i, count(*) over () as n from embeddings),
d as (select p.*, x.axis, t.t from p, (select unnest({_quoted(NAMES)}) as axis) x, (select unnest(range(cast(greatest(1, ceil(200.0 / count(*))) as bigint))) as t from embeddings) t where n > 1),
m as (select axis, a, (i + 1 + ('0x' || substr(md5('42,' || axis || ',' || t || ',' || a), 1, 8))::bigint % greatest(1, n - 1)) % n as j from d),
q as (select distinct axis, least(m.a, p.a) as lo, greatest(m.a, p.a) as hi from m join p on p.i = j),
h as (select *, md5('42,' || axis || ',' || lo || ',' || hi) as h from q),
r as (select *, row_number() over (partition by axis order by h) as rn from h)
select axis, case when h < '8' then lo else hi end as image_a_row_id, case when h < '8' then hi else lo end as image_b_row_id from r where rn <= 50"""


@query(N2)
def n2_annotation_pairs(spark, d):
    return tables.sample_pairs(vw.images(spark, d), NAMES, 50)


@query()
def v10_demo_axes(spark, d):
    i = vw.images(spark, d)
    captions = vw.records(spark, d).select("row_id", "caption")
    return embeddings.demo_axes(embeddings.pca(i, 4), captions)


@query()
def v11_projection(spark, d):
    return embeddings.project(vw.images(spark, d))


@query()
def v15_kmeans(spark, d):
    return embeddings.kmeans(vw.images(spark, d), 8)


@query(f"with {AXIS}, x as (select i.row_id, c.cluster_id, round(sqrt(list_sum(list_transform(list_zip(i.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) as ds from img i, cen c) select row_id, cluster_id from (select *, row_number() over (partition by row_id order by ds, cluster_id) as rn from x) where rn = 1")
def v16_assign(spark, d):
    i = vw.images(spark, d)
    return embeddings.assign(i, embeddings.means(i, "cluster_id"))
