"""Centroid clustering by sort-means, on exact integers.

Each round the other centroids are ordered by their distance from each centroid. A vector is compared with centroids in the
order of the one it was assigned to, and stops at the first that lies strictly beyond twice its distance from that one:
by the triangle inequality none further on can be nearer, nor as near. Vectors of a batch that share an assignment are
scanned together, the furthest first, so that each step of the scan takes a run of them.

Vectors are written anew each round with their assignment, which nothing shuffles; only partial sums of each task and
cluster are. The driver holds centroids and their sums: clusters x components numbers, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import read
from rollbook.session import drop_folder, new_folder, table_of

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, 2
#: Integer components are held to +-HELD, so that distances fit 64 bits: 64 x (2 x HELD)^2 = 2^62.
HELD = 1 << 27
#: Vectors that are scanned together.
BATCH = 8192


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """(_id, v): vectors of exactly `components` finite components, as floor(scale * x)."""
    v = F.col(vector_col)
    whole = (F.size(v) == components) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = F.transform(v, lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(float(HELD))), F.lit(float(-HELD)))).cast("int"))
    return table.where(v.isNotNull() & whole).select(F.col(id_col).alias("_id"), held.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose ids have the least digests, in order; of equal digests those with the least components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    return [list(r[0]) for r in vectors.orderBy(digest, "v").limit(clusters).select("v").collect()]


def nearest(x: np.ndarray, held: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; ties go to the smaller number. held: the clusters they had."""
    gaps = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    order = np.argsort(gaps, 1, kind="stable")
    best, dist = held.copy(), ((x - centroids[held]) ** 2).sum(1)
    for a in np.unique(held):
        own = np.flatnonzero(held == a)
        own = own[np.argsort(-dist[own], kind="stable")]
        reach = -4 * dist[own]  # rises: a run of the first reaches any centroid
        for j in order[a]:
            if j == a:
                continue
            run = own[: np.searchsorted(reach, -gaps[a, j], side="right")]
            if not len(run):
                break
            d = ((x[run] - centroids[j]) ** 2).sum(1)
            better = (d < dist[run]) | ((d == dist[run]) & (j < best[run]))
            best[run[better]], dist[run[better]] = j, d[better]
    return best, dist


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (_id, v, cluster) with the nearest cluster, and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                x = b.column(1).flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)
                best, dist = nearest(x, b.column(2).to_numpy().astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int32()), pa.array(dist)], names=["_id", "v", "cluster", "distance"])

    return vectors.select("_id", "v", "cluster").mapInArrow(run, f"_id {dict(vectors.dtypes)['_id']}, v array<int>, cluster int, distance long")


def _moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; one without vectors as it was."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)
            at = np.argsort(cluster, kind="stable")
            own, first, n = np.unique(cluster[at], return_index=True, return_counts=True)
            sums = np.add.reduceat(x[at], first, axis=0) if len(own) else x
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, dims, dtype=np.int32)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n.astype(np.int64)), flat], names=["cluster", "n", "sums"])

    parts = assigned.select("cluster", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    # exact beyond 64 bits
    sums = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # at most a row a cluster
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out


def sort_means(
    table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): rows with id_col, vector (integers), cluster, distance of every vector that is kept.

    Left out are vectors of another length, and those with a null or non-finite component. Centroids start as the vectors
    whose `seed:id` have the least SHA-256 (a null id counts as empty, repeated ids take the least vector first); fewer
    vectors than clusters make fewer clusters, none make an empty table. Every round assigns all vectors and moves each
    centroid to the floor of the mean of its vectors; ties go to the smaller number. Components beyond 2^27 are held there.
    Other columns are ignored, whatever their names.
    """
    spark = table.sparkSession
    vectors = integer_vectors(table, id_col, vector_col, components, scale)
    path = new_folder(spark, "vectors")
    held = table_of(vectors.withColumn("cluster", F.lit(0)), "vectors", path)
    start = first_centroids(held, clusters, seed)
    centroids = np.array(start, np.int64).reshape(len(start), components)
    if len(start):
        for turn in range(rounds + 1):
            last, path = path, new_folder(spark, "vectors")
            held = table_of(_assigned(held, centroids), "vectors", path)
            drop_folder(spark, last)  # what follows reads the new folder alone
            if turn < rounds:
                centroids = _moved(held, centroids)
    else:
        held = held.withColumn("distance", F.lit(0).cast("long"))
    return held.select(F.col("_id").alias(id_col), F.col("v").alias("vector"), "cluster", "distance"), centroids


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = sort_means(read(spark, sf_dir, "embeddings"))
    sums = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.sum("distance")).collect()}  # at most a row a cluster
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(i, s, sum(sums.values()), shas[i]) for i, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> str:
    """Plain Lloyd rounds over all pairs of vectors and centroids: on small tables only."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1)::INTEGER AS cluster, v AS c FROM (SELECT * FROM v ORDER BY sha256('{seed}:' || vec_id), v LIMIT {clusters}))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"d{r} AS (SELECT vec_id, v, cluster, list_sum(list_transform(range(1, {components + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS distance FROM v, c{r}), "
            f"a{r} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS k FROM d{r}) WHERE k = 1)"
        )
        if r < rounds:
            parts.append(
                f"u{r} AS (SELECT cluster, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {components + 1})) AS i) GROUP BY cluster, i), "
                f"n{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM u{r} GROUP BY cluster), "
                f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (cluster))"
            )
    return "WITH " + ", ".join(parts) + (
        f" SELECT vec_id, a.cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} USING (cluster)"
    )


QUERIES = {"op13_clustering": op13_clustering}
ORACLES = {"op13_clustering": oracle()}
