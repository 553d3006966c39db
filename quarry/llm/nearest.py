"""Nearest neighbours by inner product over score-aware quantised vectors.

A vector is its cell's centre and a rest; the rest is cut into pairs of dimensions, each coded in four bits. Codes and
codebooks minimise the anisotropic loss: the residual along the vector counts eta times as much as the residual across it,
since it moves the largest inner products most. Centres and codebooks are fitted on a bounded sample (fit_rows, by hash of
the id); every vector is coded. Blocks of queries then meet blocks of codes, and codes alone: the inner product with the
centre and a table of 16 inner products for each pair of dimensions give approximate scores. A query's shortlist are its
best rerank * k, and more, up to SPARE times as many, whose scores lie within the codes' error (GAP times its deviation in
the sample) under the k-th best: where scores are dense, it grows. They meet their vectors in joins by id and are scored
exactly in double precision; the best k are kept.

Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components take no
part; nor do null ids. Of rows with equal id the one with the least vector counts. Ties go to the smaller id. Fewer than
k candidates: all of them. An empty table, or one without usable vectors, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, write_scratch

CODES = 16
#: Centres of cells; a cell's number is one byte.
CELLS = 64
#: Shortlists end this many deviations of the codes' error under the k-th best score, or at SPARE times rerank * k.
GAP, SPARE = 2.0, 8
FOUND = "query_id long, rank int, vec_id long, score double"


def eta(dim: int, threshold: float) -> float:
    """Weight of the parallel residual for scores above threshold times the vector's length."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def cells_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def centres_of(x: np.ndarray, cells: int = CELLS, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of a sample by k-means, a cell for each 32 rows at most; cells that become empty keep their centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: max(1, min(cells, len(x) // 32))]].astype(np.float64)
    for _ in range(rounds):
        own = cells_of(x, centres)
        for c in np.unique(own):
            centres[c] = x[own == c].mean(0)
    return centres


def codes_of(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 3, whole: np.ndarray | None = None) -> np.ndarray:
    """Codes of x that minimise |r|^2 + (weight - 1) * (r . w / |w|)^2, one pair of dimensions after the other; w is the whole vector that x is the rest of. books: pairs, CODES, 2."""
    pairs = books.shape[0]
    parts, whole = x.reshape(len(x), pairs, 2), x if whole is None else whole
    unit = whole.reshape(len(x), pairs, 2) / np.maximum(np.linalg.norm(whole, axis=1), 1e-300)[:, None, None]
    r = parts[:, :, None, :] - books[None]
    own = (r * r).sum(3)
    along = (r * unit[:, :, None, :]).sum(3)
    codes = own.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for m in range(pairs):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (own[:, m] + (weight - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[rows, m, codes[:, m]]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, weight: float, rounds: int = 4, seed: int = 7, whole: np.ndarray | None = None) -> np.ndarray:
    """Codebooks from a sample x, rests of whole: codes given books, then books given codes by least squares of the anisotropic loss."""
    whole = x if whole is None else whole
    n, dim = x.shape
    pairs, rng = dim // 2, np.random.default_rng(seed)
    books = x.reshape(n, pairs, 2)[rng.integers(0, n, (pairs, CODES)), np.arange(pairs)[:, None]].astype(np.float64)
    books += rng.normal(0, 1e-3 * x.std(), books.shape)
    unit = whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-300)
    size = dim * CODES
    for step in range(rounds + 3):
        w = 1.0 if step < 3 else weight
        codes = codes_of(x, books, w, 1 if w == 1 else 2, whole)
        left, right, along = np.zeros((size, size)), np.zeros(size), np.zeros(size)
        for at in range(0, n, 512):
            part = slice(at, at + 512)
            place = (np.arange(pairs) * CODES + codes[part])[:, :, None] * 2 + np.arange(2)
            place = place.reshape(len(place), dim)
            s = np.zeros((len(place), size))
            np.put_along_axis(s, place, unit[part], 1)
            left += (w - 1) * s.T @ s
            np.add.at(along, place, 1.0)
            np.add.at(right, place, x[part] + (w - 1) * unit[part] * (unit[part] * x[part]).sum(1, keepdims=True))
        left[np.diag_indices(size)] += along + 1e-6
        solved = np.linalg.solve(left, right).reshape(pairs, CODES, 2)
        used = along.reshape(pairs, CODES, 2)[:, :, :1] > 0
        books = np.where(used, solved, books)
    return books


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return books[np.arange(books.shape[0]), codes].reshape(len(codes), -1)


def best_rows(score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest of a row, ties to the smaller index."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    over = np.flatnonzero(score > least)
    return np.concatenate([over, np.flatnonzero(score == least)[: k - len(over)]])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    some = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return some.where(fine).groupBy("id").agg(F.min("v").alias("v"))


def sampled(rows: DataFrame, fit_rows: int) -> list[list[float]]:
    """fit_rows vectors (all, if fewer), the first by hash of their ids; about twice as many are sorted."""
    parts = max(1, rows.count() // (2 * fit_rows))
    own = F.xxhash64("id")
    return [r["v"] for r in rows.where(F.pmod(own, F.lit(parts)) == 0).orderBy(own, "id").limit(fit_rows).collect()]


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.2, fit_rows: int = 4096, rerank: int = 20, block_rows: int = 16384, query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by every, the k nearest others."""
    spark = vectors.sparkSession
    with Scratch(spark) as s:
        rows = s.table(usable(vectors, id_col, vector_col), "vectors")
        sample = sampled(rows, fit_rows)
        if not sample:
            return spark.createDataFrame([], FOUND)
        dim = Counter(map(len, sample)).most_common(1)[0][0]
        fitting = rows.where(F.size("v") == dim)
        asked = fitting.where(F.col("id") % every == 0)
        near = shortlist(s, fitting, asked, [v for v in sample if len(v) == dim], k, rerank * k, threshold, block_rows, query_rows)
        met = near.join(fitting.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        exact = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = met.select("query_id", "vec_id", exact.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        path = write_scratch(best.select("query_id", "rank", "vec_id", "score"), "nearest")
    return spark.read.schema(FOUND).parquet(path)


def shortlist(s: Scratch, fitting: DataFrame, asked: DataFrame, sample: list[list[float]], k: int, least: int, threshold: float, block_rows: int, query_rows: int) -> DataFrame:
    """query_id, vec_id: for each row of asked the best rows of fitting by codes, without itself: least of them, or those near the k-th, SPARE * least at most."""
    dim = len(sample[0])
    even, most = dim + dim % 2, SPARE * least
    weight = eta(even, threshold)
    known = np.array([np.pad(v, (0, even - dim)) for v in sample])
    centres = centres_of(known)
    rest = known - centres[cells_of(known, centres)]
    books = fit(rest, weight, whole=known)
    # the spread of inner products with what codes leave out, for queries of length 1
    lost = rest - decoded(codes_of(rest, books, weight, whole=known), books)
    some = known[:256] / np.maximum(np.linalg.norm(known[:256], axis=1, keepdims=True), 1e-300)
    gap = GAP * float(np.sqrt(((some @ lost.T) ** 2).mean()))
    double = (even // 2) % 2 == 0

    def blocks(size: int, coded: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    ids = part.column(0).to_numpy()
                    order = np.argsort(ids)
                    x = np.pad(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), ((0, 0), (0, even - dim)))[order]
                    cell = np.zeros(0, dtype=np.uint8)
                    if coded:
                        cell = cells_of(x, centres).astype(np.uint8)
                        x = codes_of(x - centres[cell], books, weight, whole=x).T
                        if double:  # two codes are a byte
                            x = x[0::2] * CODES + x[1::2]
                    else:
                        x = x.astype("<f8")
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids[order].astype("<i8"), cell, np.ascontiguousarray(x))], ["ids", "cell", "x"])

        return run

    kinds = "ids binary, cell binary, x binary"
    # full blocks, however many small files the vectors lie in: a task's shortlists are then short beside what it meets
    full = lambda df, size: df.coalesce(max(1, -(-df.count() // size)))
    codes = s.table(full(fitting, block_rows).mapInArrow(blocks(block_rows, True), kinds), "codes")
    queries = s.table(full(asked, query_rows).mapInArrow(blocks(query_rows, False), kinds), "queries")

    def trimmed(ids: np.ndarray, score: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
        """The least best rows, and those that are no more than within under the k-th, most at most."""
        if len(ids) <= least:
            return ids, score
        floor = np.partition(score, len(score) - k)[len(score) - k] - within
        return _best(ids, score, min(most, max(least, int((score >= floor).sum()))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block of queries meets one block of codes after the other; the best of each query so far are held."""
        own, best, q_ids, tables, base, within = None, [], None, None, None, None

        def out() -> pa.RecordBatch:
            held = [trimmed(ids, score, w) for (ids, score), w in zip(best, within)]
            counts = [len(ids) for ids, _ in held]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, counts)), pa.array(np.repeat(within, counts).astype(np.float32)), pa.array(np.concatenate([x for x, _ in held])), pa.array(np.concatenate([x for _, x in held]))], ["query_id", "within", "vec_id", "near"])

        for batch in batches:
            for at in range(batch.num_rows):
                some, q, ids, cell, code = (batch.column(c)[at].as_buffer() for c in range(5))
                if own is None or some != own:
                    if own is not None:
                        yield out()
                    own, q_ids = some, np.frombuffer(some, "<i8")
                    flat = np.frombuffer(q, "<f8").reshape(len(q_ids), even)
                    within, base = gap * np.linalg.norm(flat, axis=1), (flat @ centres.T).astype(np.float32)
                    tables = np.einsum("qmd,mcd->qmc", flat.reshape(len(q_ids), even // 2, 2), books).astype(np.float32)
                    if double:  # one table for two pairs of dimensions
                        tables = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(flat), -1, CODES * CODES)
                    best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))] * len(q_ids)
                ids, cell = np.frombuffer(ids, "<i8"), np.frombuffer(cell, np.uint8)
                code = np.frombuffer(code, np.uint8).reshape(-1, len(ids))
                for i, mine in enumerate(q_ids.tolist()):
                    score = base[i][cell]
                    for table, c in zip(tables[i], code):
                        score += table[c]
                    score[ids == mine] = -np.inf
                    new = best_rows(score, most)
                    new = new[score[new] > -np.inf]
                    both = np.concatenate([best[i][0], ids[new]]), np.concatenate([best[i][1], score[new]])
                    best[i] = trimmed(*both, within[i])
        if own is not None:
            yield out()

    met = queries.select(F.col("ids").alias("q_ids"), F.col("x").alias("q")).crossJoin(codes).select("q_ids", "q", "ids", "cell", "x").mapInArrow(meet, "query_id long, within float, vec_id long, near float")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    ranked = met.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)
    floor = F.min(F.when(F.col("turn") <= k, F.col("near"))).over(Window.partitionBy("query_id")) - F.col("within")
    return ranked.withColumn("floor", floor).where((F.col("turn") <= least) | (F.col("near") >= F.col("floor"))).select("query_id", "vec_id")


def _best(ids: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    own = best_rows(score, most)
    return ids[own], score[own]
