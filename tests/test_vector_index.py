"""The inverted-file vector index: builds, searches, appends, versions and checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import extraction, vector_index
from quarry.sources import versions


def rows(spark, n=400, seed=1, first=0, dim=8):
    r = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(8, dim))
    x = centres[np.arange(n) % 8] + 0.2 * r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def asked(df):
    return df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def brute(df, k):
    data = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect()}
    return {(q, v) for q in data if q % 20 == 0 for v in sorted((v for v in data if v != q), key=lambda v: (-round(float(data[q] @ data[v]), 9), v))[:k]}


def pairs(found):
    return {(r["query_id"], r["vec_id"]) for r in found.collect()}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    df = rows(spark)
    return df, vector_index.build(df, f"file://{tmp_path_factory.mktemp('ivf')}/index", cells=16)


def test_exact_search_equals_a_scan(spark, built):
    df, index = built
    assert pairs(vector_index.search(spark, index, asked(df), 10, nprobe=1, exact=True)) == brute(df, 10)


def test_few_cells_hold_nearly_all_neighbours_of_clustered_vectors(spark, built):
    df, index = built
    exact = spark.createDataFrame(list(brute(df, 10)), "query_id long, vec_id long")
    n = vector_index.least_probes(spark, index, asked(df), 10)
    r = extraction.recall(vector_index.search(spark, index, asked(df), 10, n), exact).collect()[0]
    assert n <= 6 and r["queries"] == 20 and r["recall"] >= 0.98


def test_cells_are_read_by_partition_filters(spark, built):
    df, index = built
    one = asked(df).where("query_id = 0")
    found = vector_index.search(spark, index, one, 5, nprobe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "PartitionFilters" in line and "cell" in line]
    filters = [line.split("PartitionFilters: [")[1].split("PushedFilters")[0] for line in scans if "embedding" in line]
    assert any("cell" in f and (" IN (" in f or "cell#" in f) for f in filters), plan


def test_append_is_one_version_and_finds_the_new(spark, tmp_path):
    df, more = rows(spark), rows(spark, 80, 5, 1000)
    index = vector_index.build(df, f"file://{tmp_path}/index", cells=16)
    before = versions.latest(spark, f"{index.place}/manifest")
    vector_index.append(index, more)
    assert versions.latest(spark, f"{index.place}/manifest") == before + 1
    both = df.union(more)
    assert pairs(vector_index.search(spark, index, asked(both), 5, 2, exact=True)) == brute(both, 5)
    # the version before is still there, and has nothing of it
    assert {v for _, v in pairs(vector_index.search(spark, index, asked(df), 5, 2, exact=True, version=before))} <= set(range(400))
    told = vector_index.checked(spark, index).orderBy("segment").collect()
    assert [(r["listed"], r["stored"], r["distinct_ids"], r["consistent"]) for r in told] == [(400, 400, 400, True), (80, 80, 80, True)]


def test_append_refuses(spark, tmp_path):
    index = vector_index.build(rows(spark), f"file://{tmp_path}/index", cells=4)
    with pytest.raises(ValueError, match="already"):
        vector_index.append(index, rows(spark, 3, 2, 398))
    with pytest.raises(ValueError, match="already"):
        vector_index.append(index, rows(spark, 3, 2, 900).union(rows(spark, 1, 2, 900)))
    with pytest.raises(ValueError, match="lengths"):
        vector_index.append(index, rows(spark, 3, 2, 900, dim=5))
    assert versions.latest(spark, f"{index.place}/manifest") == 1
    vector_index.append(index, rows(spark, 3, 2, 900).where("false"))  # nothing to add is a version without rows
    assert vector_index.checked(spark, index).agg(F.sum("stored")).collect()[0][0] == 400


def test_two_writers_of_one_version(spark, tmp_path):
    place = f"file://{tmp_path}/m"
    one = spark.range(1)
    assert versions.latest(spark, place) == 0
    assert versions.commit(one, place, 0) == 1
    with pytest.raises(Exception, match="(?i)exists"):
        versions.commit(one, place, 0)
    assert versions.latest(spark, place) == 1
    with pytest.raises(FileNotFoundError):
        versions.read(spark, f"file://{tmp_path}/none")


def test_what_an_unfinished_writer_left_is_not_seen(spark, tmp_path):
    index = vector_index.build(rows(spark), f"file://{tmp_path}/index", cells=4)
    rows(spark, 5, 3, 5000).select("vec_id", "embedding", F.lit(0.0).alias("far")).write.parquet(f"{index.place}/vectors/segment=000002-left/cell=0")
    (tmp_path / "index/manifest/version=2").mkdir()
    assert vector_index.checked(spark, index).select("stored").collect()[0][0] == 400
    vector_index.load(spark, index)


def test_load_refuses_what_disagrees(spark, tmp_path):
    import glob
    import os

    index = vector_index.build(rows(spark), f"file://{tmp_path}/index", cells=4)
    os.remove(glob.glob(f"{tmp_path}/index/vectors/segment=*/cell=0/*.parquet")[0])
    with pytest.raises(ValueError, match="disagree"):
        vector_index.load(spark, index)


def test_nulls_and_small_tables(spark, tmp_path):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (None, [1.0, 1.0]), (4, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    index = vector_index.build(odd, f"file://{tmp_path}/index")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.0, 1.0])], "query_id long, q array<double>")
    found = vector_index.search(spark, index, q, 5, exact=True).collect()
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in found) == [(1, 2, 1), (9, 1, 2), (9, 2, 1)]
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.build(odd.where("false"), f"file://{tmp_path}/none")


def test_gate(spark):
    told = [(0.98, 100.0, 70.0), (0.97, 100.0, 10.0), (0.99, 100.0, 71.0), (None, 100.0, 10.0), (0.99, 0.0, 0.0), (0.99, 10.0, 20.0)]
    found = vector_index.gate(spark.createDataFrame(told, "recall double, exact_p95 double, ann_p95 double").coalesce(1)).collect()
    assert [(r["gain"], r["passed"]) for r in found] == [(0.3, True), (0.9, False), (0.29, False), (0.9, False), (None, False), (0.0, False)]


def test_blocks_keep_scores_and_ties_of_a_scan(spark):
    """Equal vectors, several blocks, a null, another length: as pair by pair."""
    from quarry.functions import scores
    from quarry.operators import retrieval, vector_blocks

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=5), 1)]) for i in range(vector_blocks.BLOCK + 900)]
    rows += [(10_000 + i, [1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(300)] + [(20_000, None), (20_001, [1.0, None, 1.0, 1.0, 1.0]), (20_002, [9.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    q = v.where("vec_id % 500 = 0 OR vec_id > 20000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    met = v.crossJoin(q).where("vec_id <> query_id").select("query_id", "vec_id", F.round(scores.dot(F.col("q"), F.col("embedding")), 9).alias("score"))
    own = retrieval.vector_scores(v, q, 7)
    assert sorted(map(repr, own.collect())) == sorted(map(repr, retrieval.top_k(met, "query_id", "vec_id", 7).collect()))
    assert "zip_with" not in own._jdf.queryExecution().executedPlan().toString()
