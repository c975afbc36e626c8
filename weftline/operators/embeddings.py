"""Axes, clusters, projection and outliers over vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import lexicon as lx
from weftline.functions import vectors as v


def means(rows: DataFrame, *keys: str) -> DataFrame:
    """The per-dimension mean vector of each group; sums are partial per task, then by (group, dimension)."""
    parts = rows.select(*keys, F.posexplode("e").alias("d", "x")).groupBy(*keys, "d").agg(F.avg("x").alias("m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p.m).alias("e"))


def directions(prompts: DataFrame) -> DataFrame:
    """``axis, e``: normalised positive minus negative prompt vectors (``axis, polarity, e``)."""
    p = prompts.where("polarity = 'positive'").select("axis", F.col("e").alias("p"))
    n = prompts.where("polarity = 'negative'").select("axis", F.col("e").alias("n"))
    d = p.join(n, "axis").select("axis", v.minus(F.col("p"), F.col("n")).alias("d"))
    return d.select("axis", F.when(v.norm(F.col("d")) > v.EPSILON, v.normalise(F.col("d"))).otherwise(F.col("d")).alias("e"))


def axis_scores(images: DataFrame, axes: DataFrame, names: list[str]) -> DataFrame:
    """Wide table: one dot product per axis and row. The directions (one per axis) are constants."""
    held = {r.axis: list(r.e) for r in axes.collect()}  # a handful of axes
    return images.select("row_id", *(v.dot(F.col("e"), F.array(*map(F.lit, held[a]))).alias(a) for a in names))


def demo_axes(projected: DataFrame, captions: DataFrame) -> DataFrame:
    """Proxy axes: 0.3 keyword flag + 0.7 scaled component, scaled to [-1, 1]. ``projected``: row_id, pc."""
    rows = projected.join(captions, "row_id")
    flags = lx.proxy_flags(F.col("caption"))
    comps = rows.select("row_id", *(c.alias(f"k_{n}") for n, c in flags.items()), *(F.get("pc", F.lit(i) % F.size("pc")).alias(f"p_{n}") for i, n in enumerate(flags)))
    scaled = scale_columns(comps, [f"p_{n}" for n in flags])
    blend = scaled.select("row_id", *((0.3 * F.col(f"k_{n}") + 0.7 * F.col(f"p_{n}")).alias(n) for n in flags))
    return scale_columns(blend, list(flags))


def scale_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Min-max to [-1, 1]; a column without range becomes 0. The bounds are one broadcast row."""
    bounds = rows.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns))
    width = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    value = lambda c: F.when(width(c) > 1e-12, 2 * (F.col(c) - F.col(f"lo_{c}")) / width(c) - 1).otherwise(0.0)
    return rows.crossJoin(F.broadcast(bounds)).select(*(value(c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def pca(images: DataFrame, k: int = 2) -> DataFrame:
    """``row_id, pc``: centred principal components; each axis points where its largest loading is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = images.select("row_id", array_to_vector("e").alias("f"))
    centred = StandardScaler(inputCol="f", outputCol="c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loadings.T]
    return model.transform(centred).select("row_id", F.zip_with(vector_to_array("p"), F.array(*map(F.lit, signs)), lambda x, s: x * s).alias("pc"))


#: Rows that UMAP, which runs on the driver, is given at most; more are projected by principal components.
UMAP_ROWS = 200_000


def choose_projection(n: int, umap_there: bool) -> str:
    """What ``auto`` means for so many rows."""
    return "trivial" if n < 3 else "umap" if 15 <= n <= UMAP_ROWS and umap_there else "pca"


def project(images: DataFrame, method: str = "auto", seed: int = 42) -> DataFrame:
    """``row_id, x, y``: fewer than three rows get seeded normals, others UMAP where it is installed and
    fits the driver, else principal components."""
    if method not in ("auto", "pca", "trivial", "umap"):
        raise ValueError(f"unknown projection {method}")
    if method in ("auto", "umap"):
        from importlib.util import find_spec

        chosen = choose_projection(images.count(), find_spec("umap") is not None)
        method = "pca" if method == "umap" and chosen != "umap" else chosen
    if method == "umap":
        return umap_projection(images, seed)
    if method == "trivial":
        return images.select("row_id", F.randn(seed).alias("x"), F.randn(seed + 1).alias("y"))
    return pca(images).select("row_id", F.get("pc", 0).alias("x"), F.coalesce(F.get("pc", 1), F.lit(0.0)).alias("y"))


def umap_projection(images: DataFrame, seed: int = 42) -> DataFrame:
    """At most UMAP_ROWS vectors through the ``umap`` package, on the driver."""
    import numpy as np
    import umap

    rows = images.select("row_id", "e").orderBy("row_id").toPandas()
    found = umap.UMAP(n_neighbors=min(15, len(rows) - 1), min_dist=0.1, metric="cosine", random_state=seed).fit_transform(np.stack(rows.e.to_numpy()))
    return images.sparkSession.createDataFrame([(int(k), float(x), float(y)) for k, (x, y) in zip(rows.row_id, found, strict=True)], "row_id long, x double, y double")


def kmeans(images: DataFrame, k: int, seed: int = 42, restarts: int = 3) -> DataFrame:
    """``row_id, cluster_id`` of the cheapest of several seeded runs; k is clamped to the row count."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = images.select("row_id", array_to_vector("e").alias("features")).cache()
    k = max(1, min(k, rows.count()))
    if k == 1:
        return rows.select("row_id", F.lit(0).alias("cluster_id"))
    models = [KMeans(k=k, seed=seed + i).fit(rows) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("row_id", F.col("prediction").alias("cluster_id"))


def assign(images: DataFrame, centroids: DataFrame) -> DataFrame:
    """The nearest of a few centroids (``cluster_id, e``), the lowest id on ties."""
    c = F.broadcast(centroids.select(F.col("cluster_id").alias("c"), F.col("e").alias("ce")))
    d = images.crossJoin(c).select("row_id", "c", F.round(v.distance(F.col("e"), F.col("ce")), 9).alias("d"))
    return d.groupBy("row_id").agg(F.min(F.struct("d", "c")).alias("m")).select("row_id", F.col("m.c").alias("cluster_id"))


def cluster_distances(images: DataFrame) -> DataFrame:
    """Each row's distance to its own cluster's centroid."""
    c = means(images, "cluster_id").withColumnRenamed("e", "ce")
    return images.join(F.broadcast(c), "cluster_id").select("row_id", "cluster_id", F.round(v.distance(F.col("e"), F.col("ce")), 9).alias("distance"))


def exemplars(images: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy("distance", "row_id")
    return cluster_distances(images).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def outliers(images: DataFrame) -> DataFrame:
    """Rows further from their centroid than mean + 2 population deviations; none under four rows."""
    d = cluster_distances(images)
    limit = d.agg((F.avg("distance") + 2 * F.stddev_pop("distance")).alias("limit"), F.count(F.lit(1)).alias("n"))
    return d.crossJoin(F.broadcast(limit)).where("n >= 4 and distance > `limit`").select("row_id", "cluster_id", "distance")


def cluster_axis_means(wide: DataFrame, clusters: DataFrame, names: list[str]) -> DataFrame:
    long = wide.join(clusters, "row_id").unpivot(["cluster_id"], names, "axis", "score")
    return long.where(~F.isnan("score")).groupBy("cluster_id", "axis").agg(F.avg("score").alias("mean"))


def cluster_labels(axis_means: DataFrame, clusters: DataFrame, names: list[str]) -> DataFrame:
    """Two axes of the largest absolute mean name a cluster; ``Cluster <id>`` where there is none."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("axis"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.round(F.abs("mean"), 9)), place)
    top = axis_means.withColumn("rn", F.row_number().over(w)).where("rn <= 2").withColumn("name", lx.axis_label(F.col("axis"), F.col("mean")))
    named = top.groupBy("cluster_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"])).alias("label"))
    ids = clusters.select("cluster_id").distinct()
    return ids.join(named, "cluster_id", "left").select("cluster_id", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("label"))


def top_bottom(scores: DataFrame, axis: str, n: int) -> DataFrame:
    """The n highest and the n lowest rows of an axis; NaN counts as lowest."""
    key = F.when(F.isnan(axis), F.lit(float("-inf"))).otherwise(F.col(axis))
    pick = lambda side, *order: scores.orderBy(*order).limit(n).select("row_id", F.lit(side).alias("side"), axis)
    return pick("top", F.desc(key), "row_id").union(pick("bottom", F.asc(key), "row_id"))


def exact_scan(images: DataFrame, query: Column, k: int, kind: str = "dot") -> DataFrame:
    """The k nearest rows to one query vector: a scan with a bounded heap per task."""
    s = v.cosine(F.col("e"), query) if kind == "cosine" else v.dot(F.col("e"), query)
    return images.select("row_id", s.alias("similarity")).orderBy(F.desc("similarity"), "row_id").limit(k)
