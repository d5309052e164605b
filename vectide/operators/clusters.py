"""Clusters, routing and shard placement."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from vectide.functions.numbers import hash_bucket
from vectide.functions.vectors import dense, unit_rows, usable
from vectide.operators.similarity import nearest_cell
from vectide.session import cut_lineage

# Clusters and seed of the semantic routing.
CLUSTERS, SEED = 16, 42
MAX_CENTROIDS = 4096


def kmeans_clusters(store: DataFrame, k: int = CLUSTERS, seed: int = SEED,
                    max_iter: int = 20) -> tuple[DataFrame, np.ndarray] | None:
    """(entries with their Euclidean `cluster`, centres), or None with fewer entries than clusters."""
    if store.limit(k).count() < k:
        return None
    data = store.select("embedding_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(data)
    labelled = model.transform(data).select("embedding_id", F.col("prediction").alias("cluster"))
    return labelled, np.array(model.clusterCenters())


def group_means(store: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean vector per group; partial means are combined before the shuffle."""
    means = store.groupBy(group).agg(Summarizer.mean(array_to_vector(vector)).alias("_mean"))
    return means.select(group, vector_to_array("_mean").alias("centroid"))


def refreshed_means(store: DataFrame, group: str, seconds: int, ts: str = "created_at", vector: str = "embedding") -> DataFrame:
    """(refreshed_at, group, entries, centroid): at the end of each window of `seconds` the mean of all entries so far.

    Sums per window, group and element are combined before the shuffle; what runs on from window to window has one row
    for each of them. A group has a row from the first window that has one of its entries on. Entries without a time
    or a vector are left out.
    """
    end = F.window(ts, f"{seconds} seconds")["end"].alias("_end")
    parts = store.filter(F.col(ts).isNotNull()).select(group, end, F.posexplode(vector).alias("_i", "_x")).groupBy(group, "_end", "_i").agg(
        F.sum(F.col("_x").cast("double")).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    parts = cut_lineage(parts)
    # every group in every window from its first on that has entries of any group
    last = parts.agg(F.max("_end")).first()[0]
    first = parts.groupBy(group, "_i").agg(F.min("_end").alias("_first"))
    windows = F.sequence("_first", F.lit(last).cast("timestamp"), F.make_dt_interval(secs=F.lit(seconds)))
    grid = first.select(group, "_i", F.explode(windows).alias("_end")).join(parts.select("_end").distinct(), "_end", "left_semi")
    so_far = Window.partitionBy(group, "_i").orderBy("_end").rowsBetween(Window.unboundedPreceding, 0)
    running = grid.join(parts, [group, "_i", "_end"], "left").select(
        group, "_i", "_end", F.sum("_sum").over(so_far).alias("_sum"), F.sum("_rows").over(so_far).alias("_rows"))
    elements = F.array_sort(F.collect_list(F.struct("_i", (F.col("_sum") / F.col("_rows")).alias("x"))))
    return running.groupBy(F.col("_end").alias("refreshed_at"), group).agg(
        F.max("_rows").alias("entries"), F.transform(elements, lambda e: e["x"]).alias("centroid"))


def centroid_matrix(centroids: DataFrame, group: str) -> tuple[list, np.ndarray]:
    """(labels in order, matrix) of a centroid table of checked size."""
    rows = centroids.orderBy(group).limit(MAX_CENTROIDS + 1).select(group, "centroid").toArrow()
    if rows.num_rows > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    return rows.column(group).to_pylist(), dense(rows.column("centroid"))


def route_to_cluster(store: DataFrame, labels: list[int], centroids: np.ndarray | None,
                     vector: str = "embedding", clusters: int = CLUSTERS) -> DataFrame:
    """Adds `cluster`: the centroid with the highest cosine, the lower label on a tie.

    One matrix product per Arrow batch; the centroids go out with the function. Without centroids, and for a vector
    that is missing, of another length, zero or not finite, the cluster is one of `clusters` by the vector's hash.
    """
    if centroids is None or not len(centroids):
        return store.withColumn("cluster", hash_route(vector, clusters))
    names = F.array(*[F.lit(label) for label in labels])
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    good = F.coalesce(usable(vector, centroids.shape[1]) & finite, F.lit(False))
    kind = dict(store.dtypes)[vector]
    stand_in = F.array_repeat(F.lit(0.0), centroids.shape[1]).cast(kind)
    lean = store.withColumn("_vector", F.when(good, F.col(vector)).otherwise(stand_in))
    at = nearest_cell("_vector", unit_rows(centroids))["cell"]
    return lean.withColumn("cluster", F.when(good, F.element_at(names, at + 1)).otherwise(hash_route(vector, clusters))).drop("_vector")


def hash_route(vector: Column | str, clusters: int = CLUSTERS) -> Column:
    """Cluster of a vector while there are no centroids."""
    return hash_bucket(vector, clusters)


def assign_shard(cluster: Column | str, shards: int, key: Column | str | None = None) -> Column:
    """Shard of a cluster; where the cluster is null, and with a `key`, the shard is by the hash of the key."""
    cluster = F.col(cluster) if isinstance(cluster, str) else cluster
    by_cluster = F.pmod(cluster, F.lit(shards)).cast("int")
    return by_cluster if key is None else F.coalesce(by_cluster, hash_bucket(key, shards))
