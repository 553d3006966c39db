"""Centroid clustering of whole-number vectors with a distance matrix that is kept and updated, not made anew.

Beside each vector stand its exact integer dot products with all centroids. A round assigns every vector to the nearest
centroid, |v|^2 - 2 v.c + |c|^2, sums the vectors of each cluster and moves the centroids; then only the components in
which a centroid has changed are multiplied with the vectors' and added to the kept products, and the argmin is taken
again. A centroid that stays costs nothing. Vectors, products and clusters are one Parquet table a round in the shared
folder: the next round reads it, and the one before is removed. The driver sees the centroids alone (k times dim sums).

Vectors that are null, have another number of components than dim, or hold null or non-finite ones, take no part and are
not returned; nor are those with a component further from 0 than MOST / 256, whose squared distances would leave a long.
Every row is a vector: repeated rows count as often as they stand, and one with a null id counts too, but starts no
centroid. Starts with equal hashes (rows of one id) go by their components. Fewer vectors than k: as many centroids.
Two equal centroids stay two; the smaller number gets all. An empty table, or one without fitting vectors, gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vectors as vec
from quarry.llm.common import Scratch, write_scratch

#: 64 squared differences of components under 2 * MOST stay under 2^62.
MOST = 1 << 27
FOUND = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
STATE = "id long, v array<long>, dots array<long>, cluster int, distance long"


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def changes(old: np.ndarray, new: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each centroid that moved: its number, the components that changed, and by how much."""
    moved = new - old
    return [(c, at, moved[c, at]) for c in range(len(new)) if len(at := np.flatnonzero(moved[c]))]


def updated(v: np.ndarray, dots: np.ndarray, moved: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The dot products after the centroids' changes."""
    for c, at, by in moved:
        dots[:, c] += v[:, at] @ by
    return dots


def assigned(v: np.ndarray, dots: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, ties to the smaller number, and its squared distance."""
    beyond = squares - 2 * dots
    best = beyond.argmin(1)
    return best, beyond[np.arange(len(v)), best] + (v * v).sum(1)


def _step(dim: int, k: int, moved: list, centroids: np.ndarray, first: bool):
    squares = (centroids * centroids).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1), dim)
                dots = np.zeros((len(v), k), dtype=np.int64) if first else _matrix(batch.column(2), k).copy()
                dots = updated(v, dots, moved)
                best, distance = assigned(v, dots, squares)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(dots), pa.array(best.astype(np.int32)), pa.array(distance)], ["id", "v", "dots", "cluster", "distance"])

    return run


def _sums(dim: int, k: int):
    """Of each batch the number and the componentwise sum of each cluster's vectors, one row a component; component -1 is the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), dtype=object), np.zeros(k, dtype=np.int64)
        for batch in batches:
            v, own = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
            part = np.zeros((k, dim), dtype=np.int64)  # a batch has too few rows to leave a long
            np.add.at(part, own, v)
            total += part
            count += np.bincount(own, minlength=k)
        some = np.flatnonzero(count)
        if len(some):
            sums = np.concatenate([count[some, None].astype(object), total[some]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dim), len(some)).astype(np.int32)), pa.array([str(x) for x in sums.ravel()])], ["cluster", "at", "total"])

    return run


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of means, empty ones unchanged. k times (dim + 1) sums reach the driver."""
    k, dim = centroids.shape
    parts = state.select("cluster", "v").mapInArrow(_sums(dim, k), "cluster int, at int, total string")
    sums = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {(r["cluster"], r["at"]): int(r["total"]) for r in sums}
    new = centroids.copy()
    for c in range(k):
        if (c, -1) in found:
            new[c] = [found[c, at] // found[c, -1] for at in range(dim)]
    return new


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector."""
    spark = vectors.sparkSession
    some = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    with Scratch(spark) as s:
        fitting = s.table(some.where(F.size("x") == dim).where(vec.finite(F.col("x")) & vec.within(F.col("x"), MOST)).select("id", vec.whole(F.col("x")).alias("v")), "whole")
        own = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
        starts = fitting.where("id is not null").orderBy(own, "v").limit(k).collect()
        if not starts:
            return spark.createDataFrame([], FOUND)
        centroids = np.array([r["v"] for r in starts], dtype=np.int64)
        k, state, before = len(centroids), fitting, np.zeros_like(centroids)
        for turn in range(rounds + 1):
            step = _step(dim, k, changes(before, centroids), centroids, turn == 0)
            after = s.table(state.mapInArrow(step, STATE), "assigned")
            s.drop(state)
            state, before = after, centroids
            if turn < rounds:
                centroids = moved_centroids(state, centroids)
        names = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
        inertia = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
        total, own = sum(r["own"] for r in inertia), {r["cluster"]: r["own"] for r in inertia}
        of = spark.createDataFrame([(c, int(own.get(c, 0)), int(total), name) for c, name in names], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        # k rows
        told = state.join(F.broadcast(of), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
        path = write_scratch(told, "clusters")
    return spark.read.schema(FOUND).parquet(path)


def clusters_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """The same in DuckDB SQL, each round from whole distances."""
    steps = [f"""k AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM k WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, k.v, c{r}.c AS c, list_sum(list_transform(list_zip(k.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, c{r} QUALIFY row_number() OVER (PARTITION BY vec_id, k.v ORDER BY d, c{r}.c) = 1)""")
        if r < rounds:
            steps.append(f"""u{r} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY ALL),
  c{r + 1} AS MATERIALIZED (SELECT c{r}.c AS c, coalesce(w.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM u{r} GROUP BY c) w ON w.c = c{r}.c)""")
    return f"""WITH {", ".join(steps)} SELECT vec_id, CAST(a{rounds}.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""
