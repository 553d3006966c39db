"""An inverted-file vector index as Parquet: cells around centroids, segments, versions.

`vectors/segment=S/cell=C` holds the vectors, `manifest/version=N` says for each segment and cell how many there are and how
far they lie from the centroid. A build or an append writes a segment of its own and then a version that names it, so a
reader sees all of an append or nothing, and a writer that died leaves only files that no version names.

A search asks the nearest cells of each question and reads no other cell (partition filters). With `exact`, cells whose ball
could still hold a better one than the k-th found are read as well, so the answer is that of a full scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scores
from quarry.operators import retrieval, vector_blocks
from quarry.sources import versions

#: Below this, two doubles are the same distance.
SLACK = 1e-9


@dataclass(frozen=True)
class VectorIndex:
    place: str

    def manifest(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """segment, cell, n, reach, centroid, version."""
        return versions.read(spark, f"{self.place}/manifest", version)

    def vectors(self, spark: SparkSession, manifest: DataFrame, cells: list[int] | None = None) -> DataFrame:
        """vec_id, embedding, segment, cell of the manifest's segments; of the named cells alone, by filters on the folders."""
        segments = [r["segment"] for r in manifest.select("segment").distinct().collect()]
        rows = spark.read.parquet(f"{self.place}/vectors").where(F.col("segment").isin(segments))
        return rows if cells is None else rows.where(F.col("cell").isin(cells))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the smaller number, and its distance."""
    beyond = (centroids * centroids).sum(1) - 2 * (x @ centroids.T)
    cell = np.round(beyond, 12).argmin(1)
    return cell, np.linalg.norm(x - centroids[cell], axis=1)


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = nearest(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["vec_id", "embedding", "cell", "far"])

    return run


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, embedding, cell, far."""
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_assign(centroids), "vec_id long, embedding array<double>, cell int, far double")


def fit(vectors: DataFrame, cells: int, sample_rows: int, rounds: int) -> np.ndarray:
    """Centroids of k-means on the sample_rows vectors with smallest hash of their ids; the first of them are the starts.

    Each round is a job over the sample; the driver holds cells times dimensions numbers, not the sample.
    """
    order = F.sha2(F.col("vec_id").cast("string"), 256)
    sample = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(order, "vec_id").limit(sample_rows).cache()
    try:
        centroids = np.array([r["embedding"] for r in sample.orderBy(order, "vec_id").limit(cells).collect()])
        for _ in range(rounds):
            parts = assigned(sample, centroids).select("cell", F.posexplode("embedding").alias("at", "x"))
            for r in parts.groupBy("cell", "at").agg(F.avg("x").alias("mean")).collect():
                centroids[r["cell"], r["at"]] = r["mean"]
    finally:
        sample.unpersist()
    return centroids


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))


def _lengths(vectors: DataFrame) -> list[int]:
    return sorted(r["n"] for r in vectors.select(F.size("embedding").alias("n")).distinct().limit(3).collect())


def build(vectors: DataFrame, place: str, cells: int = 1024, sample_rows: int = 200_000, rounds: int = 3) -> VectorIndex:
    """Indexes vectors(vec_id, embedding); rows with nulls or NaN are left out. cells is at most a quarter of the rows."""
    fine = usable(vectors)
    if len(lengths := _lengths(fine)) > 1:
        raise ValueError(f"vectors have other lengths: {lengths}")
    n = fine.count()
    if not n:
        raise ValueError("no vectors to index")
    return _write(VectorIndex(place), fine, fit(fine, max(1, min(cells, n // 4)), sample_rows, rounds), None, 0)


def append(index: VectorIndex, vectors: DataFrame) -> VectorIndex:
    """Adds vectors to their cells as a new segment. Vectors of another length, repeated ids and ids that are there are refused."""
    spark = vectors.sparkSession
    fine, before = usable(vectors), versions.latest(spark, f"{index.place}/manifest")
    old = index.manifest(spark, before).drop("version")
    at = {r["cell"]: r["centroid"] for r in old.select("cell", "centroid").distinct().collect()}
    centroids = np.array([at[c] for c in sorted(at)])
    if (lengths := _lengths(fine)) not in ([], [centroids.shape[1]]):
        raise ValueError(f"vectors have other lengths than the index: {lengths}")
    ids = fine.select("vec_id")
    twice = ids.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    known = ids.join(index.vectors(spark, old).select("vec_id"), "vec_id", "left_semi")
    if clash := sorted({r["vec_id"] for r in twice.union(known).limit(5).collect()}):
        raise ValueError(f"ids are there already or come twice, such as {clash}")
    return _write(index, fine, centroids, old, before)


def _write(index: VectorIndex, vectors: DataFrame, centroids: np.ndarray, old: DataFrame | None, before: int) -> VectorIndex:
    """A segment, dealt by ranges of (cell, id), so that a large cell lies in several files; then the version that names it."""
    spark, segment = vectors.sparkSession, f"{before + 1:06d}-{uuid.uuid4().hex[:8]}"
    folder = f"{index.place}/vectors/segment={segment}"
    assigned(vectors, centroids).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").parquet(folder)
    cells = spark.createDataFrame([(c, v) for c, v in enumerate(centroids.tolist())], "cell int, centroid array<double>")
    rows = spark.read.parquet(folder).groupBy(F.col("cell").cast("int").alias("cell")).agg(F.count("*").alias("n"), F.max("far").alias("reach")) if vectors.head(1) else spark.createDataFrame([], "cell int, n long, reach double")
    new = cells.join(rows, "cell", "left").select(F.lit(segment).alias("segment"), "cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("reach", F.lit(0.0)).alias("reach"), "centroid")
    versions.commit((new if old is None else old.select(*new.columns).union(new)).coalesce(1), f"{index.place}/manifest", before)
    return index


def checked(spark: SparkSession, index: VectorIndex, version: int | None = None) -> DataFrame:
    """segment, listed, stored, distinct_ids, cells, consistent: whether what the manifest says is there, once, in its cell's reach."""
    manifest = index.manifest(spark, version)
    rows = index.vectors(spark, manifest)
    places = manifest.select("segment", F.col("cell").cast("int").alias("cell"), "n", "reach")
    stored = rows.groupBy("segment", F.col("cell").cast("int").alias("cell")).agg(F.count("*").alias("m"), F.max("far").alias("far"))
    both = places.join(stored, ["segment", "cell"], "full").withColumn("fits", F.col("n").eqNullSafe(F.coalesce("m", F.lit(0))) & (F.coalesce("far", F.lit(0.0)) <= F.col("reach") + SLACK))
    per = both.groupBy("segment").agg(F.sum("n").alias("listed"), F.coalesce(F.sum("m"), F.lit(0)).alias("stored"), F.count_if(F.col("m") > 0).alias("cells"), F.every("fits").alias("fits"))
    once = rows.select("segment", "vec_id").groupBy("segment", "vec_id").agg(F.count("*").alias("n")).groupBy("segment").agg(F.count("*").alias("distinct_ids"))
    told = per.join(once, "segment", "left").withColumn("distinct_ids", F.coalesce("distinct_ids", F.lit(0)))
    return told.select("segment", "listed", "stored", "distinct_ids", "cells", (F.coalesce("fits", F.lit(False)) & (F.col("stored") == F.col("distinct_ids"))).alias("consistent"))


def load(spark: SparkSession, index: VectorIndex, version: int | None = None) -> VectorIndex:
    """The index, if it is consistent."""
    if bad := checked(spark, index, version).where("not consistent").limit(1).collect():
        raise ValueError(f"the index and its manifest disagree: {bad[0].asDict()}")
    return index


def probes(manifest: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, cell, turn (from 1, the nearest centroid first), most: no vector of the cell has a larger inner product with q."""
    cells = manifest.groupBy("cell").agg(F.first("centroid").alias("centroid"), F.max("reach").alias("reach"), F.sum("n").alias("n")).where("n > 0")
    q, c = F.col("q"), F.col("centroid")
    met = queries.crossJoin(F.broadcast(cells))  # a row for each cell; build() bounds them
    length = lambda x: F.sqrt(scores.dot(x, x))
    gap = F.round(scores.dot(c, c) - 2 * scores.dot(q, c), 12)
    return met.select("query_id", "cell", F.row_number().over(Window.partitionBy("query_id").orderBy(gap, "cell")).alias("turn"), (scores.dot(q, c) + length(q) * F.col("reach") + SLACK).alias("most"))


def _met(spark: SparkSession, index: VectorIndex, manifest: DataFrame, queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the vectors in the asked cells of each question, as far as they can be among its k best of a block."""
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]
    wanted = asked.select("query_id", "cell").join(queries, "query_id").repartition("cell").sortWithinPartitions("cell")
    return vector_blocks.candidates(vector_blocks.packed(index.vectors(spark, manifest, cells), "cell", "vec_id", "embedding"), vector_blocks.packed(wanted, "cell", "query_id", "q"), k, parts=True)


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int, nprobe: int = 16, exact: bool = False, version: int | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: of queries(query_id, q) the k nearest found by inner product, itself aside."""
    manifest = index.manifest(spark, version)
    queries = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
    asked = probes(manifest, queries).cache()
    first = retrieval.top_k(_met(spark, index, manifest, queries, asked.where(F.col("turn") <= nprobe), k), "query_id", "vec_id", k)
    if not exact:
        return first
    floors = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    more = asked.where(F.col("turn") > nprobe).join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor")))
    rest = _met(spark, index, manifest, queries, more, k)
    return retrieval.top_k(first.drop("rank").union(rest), "query_id", "vec_id", k)


def least_probes(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int, recall: float = 0.98, sample: int = 200, version: int | None = None) -> int:
    """The least number of cells at which the mean recall of a bounded sample of the questions reaches `recall`, for search()."""
    manifest = index.manifest(spark, version)
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("query_id", F.col("q").cast("array<double>").alias("q"))
    best = search(spark, index, some, k, exact=True, version=version)
    cells = index.vectors(spark, manifest).select("vec_id", "cell")
    turns = best.join(cells, "vec_id").join(probes(manifest, some).select("query_id", "cell", "turn"), ["query_id", "cell"])
    total = best.count()
    reached = turns.groupBy("turn").agg(F.count("*").alias("n")).orderBy("turn").collect()  # a row for each cell
    held = 0
    for r in reached:
        held += r["n"]
        if held >= recall * total:
            return r["turn"]
    return manifest.select("cell").distinct().count()


def gate(measured: DataFrame, least_recall: float = 0.98, least_gain: float = 0.30) -> DataFrame:
    """recall, recall_ok, gain, gain_ok, passed of measured(recall, exact_p95, ann_p95); a side that was not measured is null and doesn't pass."""
    won = F.greatest(F.lit(0.0), F.try_divide(F.col("exact_p95") - F.col("ann_p95"), F.col("exact_p95")))
    gain = F.when((F.col("exact_p95") > 0) & F.col("ann_p95").isNotNull(), won)
    held = measured.withColumn("recall_ok", F.col("recall") >= least_recall).withColumn("gain_ok", gain >= least_gain).withColumn("gain", F.round(gain, 4))
    return held.withColumn("passed", F.coalesce(F.col("recall_ok") & F.col("gain_ok"), F.lit(False)))
