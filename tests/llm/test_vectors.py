"""The operators on vectors against brute force: nulls, odd components, other lengths, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import centroids, embedding_dedup, hard_negatives, substring_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, dim int, v string, node string, rank int, id string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, 1, 2, "clash", "n", 3, "x") for i, v, c in rows], SCHEMA).repartition(parts)


def odd(dim):
    return [(1, None, 1), (2, [NAN] + [1.0] * (dim - 1), 1), (3, [None] + [1.0] * (dim - 1), 1), (4, [INF] + [1.0] * (dim - 1), 2), (5, [1.0] * (dim - 1), 1), (6, [], 1)]


def clustered_brute(rows, k, rounds, dim):
    kept = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None))[:k]
    c = np.array([v for _, v in starts])
    x = np.array([v for _, v in kept])
    for turn in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if turn < rounds:
            c = np.array([[int(s) // int((own == j).sum()) for s in x[own == j].sum(0)] if (own == j).any() else c[j] for j in range(len(c))])
    d = d[np.arange(len(x)), own]
    names = [hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for v in c]
    return sorted((i if i is not None else -1, int(o), int(e), int(d[own == o].sum()), int(d.sum()), names[o]) for (i, _), o, e in zip(kept, own, d))


def test_centroids(spark):
    r = np.random.default_rng(1)
    rows = [(i + 10, v.tolist(), 0) for i, v in enumerate(r.normal(size=(150, 8)))] + odd(8) + [(10, r.normal(size=8).tolist(), 0), (None, [0.5] * 8, 0), (7, [0.0] * 8, None), (8, [-1e5] * 8, 0)]
    rows += [rows[0], rows[0]]
    found = centroids.clusters(frame(spark, rows), 12, 3, 8).collect()
    assert sorted((x["vec_id"] if x["vec_id"] is not None else -1, *x[1:]) for x in found) == clustered_brute(rows, 12, 3, 8)


def test_centroids_few_far_and_none(spark):
    few = [(3, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (5, [9e9, 0.0], 0)]
    got = centroids.clusters(frame(spark, few), 5, 2, 2).collect()
    assert sorted((x["vec_id"], x["cluster"], x["distance"]) for x in got) == [(3, 0, 0), (4, 0, 0)]  # equal centroids: the smaller number; the far one takes no part
    assert centroids.clusters(frame(spark, few).where("false"), 5, 2, 2).count() == 0


def test_kept_products_equal_new_ones():
    r = np.random.default_rng(2)
    v, old = r.integers(-500, 500, (40, 6)), r.integers(-500, 500, (5, 6))
    new = old.copy()
    new[1, 2] += 7
    new[4] -= 3
    moved = centroids.changes(old, new)
    assert [(c, at.tolist()) for c, at, _ in moved] == [(1, [2]), (4, [0, 1, 2, 3, 4, 5])]
    assert (centroids.updated(v, v @ old.T, moved) == v @ new.T).all()


def linked_brute(rows, threshold):
    unique = list({(i, None if v is None else tuple(v), c): (i, v, c) for i, v, c in rows if i is not None}.values())
    fine = [v is not None and c is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, c in unique]
    n = len(unique)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = unique[i], unique[j]
            if fine[i] and fine[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        first = min(unique[j][0] for j in seen)
        out.append((unique[i][0], len(near[i]), first, unique[i][0] == first))
    return sorted(out)


def near_rows(dim, seed=4):
    r = np.random.default_rng(seed)
    rows = [(100 + i, r.normal(size=dim).tolist(), i % 3) for i in range(60)]
    at = 1000
    for size, noise in ((40, 0.06), (25, 0.02), (5, 0.1)):  # groups about the threshold, well inside it, and some that straddle it
        centre = r.normal(size=dim)
        for _ in range(size):
            rows.append((at, (centre + noise * np.linalg.norm(centre) / np.sqrt(dim) * r.normal(size=dim)).tolist(), 1))
            at += 1
    step = r.normal(size=(2, dim))
    step[1] -= step[0] * (step[1] @ step[0]) / (step[0] @ step[0])
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    rows += [(2000 - i, (np.cos(0.15 * i) * step[0] + np.sin(0.15 * i) * step[1]).tolist(), 2) for i in range(12)]  # a chain: neighbours alone are linked
    same = rows[70][1]
    rows += [(3000 + i, same, 1) for i in range(6)] + [(3100, [2 * x for x in same], 1), (3101, same, 0), (3102, same, None), (3103, [0.0] * dim, 1), (rows[0][0], rows[3][1], 0), (None, same, 1), rows[0], rows[70]]
    return rows + [(3200, [1e-200] * dim, 1), (3201, [1e200] * dim, 1)] + odd(dim)


@pytest.mark.parametrize("dim", [8, 64, 96])
def test_near_vectors(spark, dim):
    rows = near_rows(dim)
    brute = [(i, None if v is None else [x / 1e200 if x and x > 1e100 and x < INF else x * 1e200 if x and x < 1e-100 and x > 0 else x for x in v], c) for i, v, c in rows]
    found = embedding_dedup.near_duplicates(frame(spark, rows), block_rows=7)
    assert sorted(tuple(x) for x in found.collect()) == linked_brute(brute, 0.98)


def test_near_vectors_none(spark):
    assert embedding_dedup.near_duplicates(frame(spark, odd(8)).where("false")).count() == 0
    got = embedding_dedup.near_duplicates(frame(spark, odd(8)[:4])).collect()
    assert sorted(tuple(x) for x in got) == [(i, 0, i, True) for i in (1, 2, 3, 4)]


def test_estimates_of_codes_are_unbiased_and_bounded():
    r = np.random.default_rng(6)
    a = embedding_dedup.units(r.normal(size=(400, 64)))
    b = embedding_dedup.units(a + 0.18 * embedding_dedup.units(r.normal(size=(400, 64))))
    errors = []
    for seed in range(40):
        turn = embedding_dedup.rotations(64, 1, seed)[0]
        x, y = a @ turn, b @ turn
        estimate = (np.sign(x) * y).sum(1) / np.abs(x).sum(1)
        errors.append(estimate - (a * b).sum(1))
    assert abs(np.mean(errors)) < 1e-3
    factors = embedding_dedup.coded(a, 2)[1]
    assert (np.array(errors) > -embedding_dedup.spread(factors[:, :1], 64, 0.98, 6.0)).all()


def test_bands_miss_as_seldom_as_said():
    for n in (100, 10**5, 10**11):
        bits, count = embedding_dedup.bands(n, 0.98, 1e-7)
        p = 1 - np.arccos(0.98) / np.pi
        assert (1 - p**bits) ** count <= 1e-7 < (1 - p**bits) ** (count - 1)
    assert 20 < embedding_dedup.most_differing(0.98, 1e-7) < 40


def test_scratch_of_near_vectors_is_removed(spark):
    import os

    place = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    embedding_dedup.near_duplicates(frame(spark, near_rows(8)))
    before = set(os.listdir(place))
    embedding_dedup.near_duplicates(frame(spark, near_rows(8)))
    assert [x.split("-")[0] for x in set(os.listdir(place)) - before] == ["near"]  # the result alone


def mined_brute(rows, every, positives, negatives):
    first = {}
    for i, v, c in rows:
        if i is None or v is None or c is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        own = (c, [int(np.floor(256 * x)) for x in v])
        if i not in first or own < first[i]:
            first[i] = own
    out = []
    for a, (label, v) in first.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, c == label) for i, (c, w) in first.items() if i != a and len(w) == len(v))
        for p, i, _ in [s for s in scores if s[2]][:positives]:
            fits = [s for s in scores if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(a, i, rank, s[1], -p, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(6, 8))
    rows = [(i + 10, (centres[i % 6] + 0.4 * r.normal(size=8)).tolist(), i % 4) for i in range(400)]
    rows += odd(8) + [(20, [0.0] * 8, 1), (500, rows[3][1], 0), (501, rows[3][1], 2), (502, rows[3][1], 2), (600, [1.0, 2.0], 0), (610, [1.0, 1.0], 0), (611, [1.0, 1.0], 1), (None, [1.0] * 8, 1), (700, [1.0] * 8, None), rows[0], (10, [9.0] * 8, 3)]
    found = hard_negatives.mine(frame(spark, rows), every=10, block_rows=16, group_rows=4).collect()
    brute = mined_brute(rows, 10, 5, 5)
    assert len(brute) > 400 and sorted(tuple(x) for x in found) == brute


def test_hard_negatives_few_and_none(spark):
    few = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 2), (3, [0.9, 1.0], 3), (4, [-1.0, 0.0], 1)]
    got = hard_negatives.mine(frame(spark, few), every=100)
    assert sorted(tuple(x) for x in got.collect()) == mined_brute(few, 100, 5, 5)
    assert hard_negatives.mine(frame(spark, few).where("false")).count() == 0
    assert hard_negatives.mine(frame(spark, [(0, [1.0], 1)])).count() == 0


def test_bounds_hold_and_choose():
    r = np.random.default_rng(9)
    a, x = r.integers(-300, 300, (20, 5)).astype(float), r.integers(-300, 300, (30, 5)).astype(float)
    least, most = hard_negatives.bounds(a, x.min(0)[None], x.max(0)[None])
    scores = a @ x.T
    assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all()
    one, same = hard_negatives.bounds(a, x[:1], x[:1])
    assert (one == scores[:, :1]).all() and (same == one).all()


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 3), (3, 2)):
        places = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")], 1)
        at = hilbert = hard_negatives.hilbert(places, bits)
        assert sorted(hilbert.tolist()) == list(range(1 << (n * bits)))
        assert (np.abs(np.diff(places[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_windows_read_few_blocks_of_clustered_vectors(spark):
    from quarry.llm.common import Scratch

    r = np.random.default_rng(10)
    centres = r.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.05 * r.normal(size=16)).tolist(), i % 2) for i in range(800)]
    with Scratch(spark) as s:
        own = frame(spark, rows).select("vec_id", F.expr("label * 1L").alias("label"), F.transform("embedding", lambda x: F.floor(256 * x)).alias("v"))
        fits = hard_negatives.fit([[int(256 * x) for x in v] for _, v, _ in rows[:200]], 3, 5)
        placed = own.mapInArrow(hard_negatives._ordered(fits, 5), "id long, label long, v array<long>, place long").withColumn("dim", F.size("v"))
        blocks = s.table(placed.repartitionByRange(2, "dim", "label", "place").sortWithinPartitions("dim", "label", "place").select("id", "label", "v", "dim").mapInArrow(hard_negatives._cut(25), hard_negatives.BLOCK), "blocks")
        zones = blocks.select("block", "dim", "label", "low", "high").mapInArrow(hard_negatives._zones(64), "z_dim int, blocks binary, z_labels binary, z_low binary, z_high binary")
        anchors = blocks.mapInArrow(hard_negatives._anchors(10, 5), hard_negatives.ANCHOR)
        groups = anchors.mapInArrow(hard_negatives._groups(1, 1), hard_negatives.GROUP)
        chosen = groups.crossJoin(zones).mapInArrow(hard_negatives._chosen(True), "group long, block long, mask binary").count()
        n_blocks, n_anchors = blocks.count(), anchors.count()
    assert n_anchors == 80 and chosen < 0.3 * n_anchors * n_blocks / 2


def test_alignment_of_very_many_regular_blocks():
    """5,000 blocks, 12 words shared and 28 changed, have no passage; with few words changed they are one."""
    r = random.Random(3)
    k, n = 8, 5000
    x = np.array([r.randrange(1 << 40) for _ in range(40 * n)])
    y = x.copy()
    for block in range(n):
        y[40 * block + 12 : 40 * block + 40] += 1
    a = np.concatenate([np.arange(40 * b, 40 * b + 5) for b in range(n)])
    assert substring_dedup.aligned(x, y, a, a, k, 50, 0.8) == []
    z = x.copy()
    z[39::40] += 1
    assert [p[:4] for p in substring_dedup.aligned(x, z, a, a, k, 50, 0.8)] == [(0, 40 * n - 1, 0, 40 * n - 1)]


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_by_short_lists(spark, clustered):
    """50,000 vectors, 20 neighbours of each of 100: lists of 400, under a hundredth of the rows, grow where scores are dense."""
    from quarry.llm import nearest

    r, n = np.random.default_rng(1), 50_000
    x = r.normal(size=(n, 64))
    if clustered:
        c = r.normal(size=(10, 64))
        x = (c / np.linalg.norm(c, axis=1, keepdims=True))[r.integers(0, 10, n)] + 0.33 * x / 8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = {(a["query_id"], a["vec_id"]) for a in nearest.search(df, every=500).collect()}
    asked = np.arange(0, n, 500)
    score = x[asked] @ x.T
    score[np.arange(100), asked] = -9
    wanted = {(q, v) for q, row in zip(asked.tolist(), np.argpartition(-score, 20, 1)[:, :20].tolist()) for v in row}
    assert len(found) == 2000 and len(found & wanted) >= 0.97 * len(wanted)
