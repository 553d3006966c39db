"""Near-duplicate vectors of one label by cosine, over binary codes of random rotations.

Equal vectors of a label are one vector with a weight. Each is made a unit vector and turned by random rotations; the signs
of the turned components are its code, and beside the code stands its correction factor, the inner product of the code
(as a unit vector) with what it stands for. Two estimates come from codes:

* Of two codes, the share of differing signs is the angle's share of a half turn. Candidates are found by it: bands of
  signs, each of as many bits as the number of vectors asks for and so many bands that a pair at the threshold shares none
  with a probability of at most `miss`; of vectors that share a band, those stay whose first 128 signs differ in few enough
  places (the binomial bound at `miss`). Vectors whose first signs agree are a cell, and cells stand for their members here:
  the bits that all its members in a band have in common. So many near copies are a few rows.
* Of a code and a vector, <code, q> / factor estimates <o, q> without bias, with a spread of
  sqrt(1 - <o, q>^2) * sqrt(1 - factor^2) / factor / sqrt(dim - 1). Within pairs of cells, in blocks of bounded size, this
  estimate and its bound at the threshold decide which pairs are computed exactly, in double precision.

A block pair returns, for each vector with a link, the number of its links and the first vector of its component there: no
pairs. A pair of cells larger than a block is dealt to several tasks.

Rows that are equal in id, label and vector count once. Rows of one id with other vectors are vectors of their own.
Vectors without a label, null, zero, or with null or non-finite components link with nothing and are returned with
n_links 0 as their own component; so are vectors of other lengths to each other. Rows without an id are left out. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vectors as vec
from quarry.llm.common import Scratch, write_scratch
from quarry.llm.components import components

#: Signs of a code that are compared bit by bit.
COMPARED = 128
FOUND = "vec_id long, n_links long, component_id long, kept boolean"


@lru_cache(maxsize=64)
def rotations(dim: int, count: int, seed: int = 12) -> np.ndarray:
    """count random rotations (with reflections): count, dim, dim."""
    rng = np.random.default_rng((seed, dim))
    made = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        made.append(q * np.where(np.diag(r) < 0, -1.0, 1.0))
    return np.array(made)


def bands(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a band, and the number of bands: n vectors come to about 64 a band's value, and a pair at the threshold is missed with probability miss."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / 64)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def most_differing(threshold: float, miss: float, bits: int = COMPARED) -> int:
    """The least number of differing signs that a pair at the threshold exceeds with probability miss at most."""
    p, beyond = math.acos(threshold) / math.pi, 1.0
    for h in range(bits + 1):
        beyond -= math.comb(bits, h) * p**h * (1 - p) ** (bits - h)
        if beyond <= miss:
            return h
    return bits


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors, by way of a scale at which no square leaves the range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(u: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs (n, rounds, dim) of the turned unit vectors, and the correction factors (n, rounds)."""
    turned = np.einsum("nd,rde->nre", u, rotations(u.shape[1], rounds))
    return turned >= 0, np.abs(turned).sum(2) / math.sqrt(u.shape[1])


def rounds_of(dim: int) -> int:
    """Rotations behind the estimate of a vector's inner products."""
    return -(-COMPARED // dim)


def spread(factors: np.ndarray, dim: int, threshold: float, sigmas: float) -> np.ndarray:
    """How far the mean estimate of a pair at the threshold or above it may lie under its inner product."""
    each = (1 - np.minimum(factors, 1.0) ** 2) / factors**2
    return sigmas * math.sqrt((1 - threshold**2) / max(dim - 1, 1)) * np.sqrt(each.sum(1)) / factors.shape[1]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _codes(cell_bits: int, band_bits: int, n_bands: int):
    """node, w, label, dim, cell, two words of signs, the bands' values, code, factors and vector of each row."""
    wanted = COMPARED + band_bits * n_bands
    power = 1 << np.arange(band_bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                own = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                u, rounds = units(_matrix(own.column(3), dim)), rounds_of(dim)
                signs, factors = coded(u, max(rounds, -(-wanted // dim)))
                bits = signs.reshape(len(u), -1)[:, :wanted]
                words = np.packbits(bits[:, :COMPARED], axis=1, bitorder="little").view("<i8")
                cell = words[:, 0] & ((1 << cell_bits) - 1)
                keys = bits[:, COMPARED:].reshape(len(u), n_bands, band_bits).astype(np.int64) @ power
                code = np.packbits(signs[:, :rounds].reshape(len(u), -1), axis=1, bitorder="little")
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))
                columns = [own.column(0), own.column(1), own.column(2), pa.array(np.full(len(u), dim, dtype=np.int32)), pa.array(cell), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy()), lists(keys), pa.array([c.tobytes() for c in code], pa.binary()), lists(factors[:, :rounds]), own.column(3)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "w", "label", "dim", "cell", "a", "b", "keys", "code", "factors", "v"])

    return run


def linked(left: dict, right: dict | None, dim: int, threshold: float, sigmas: float, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of left and right, or of left and later rows of left, with a cosine of threshold or more."""
    other, rounds = right or left, rounds_of(dim)
    turned = np.einsum("nd,rde->rne", other["u"], rotations(dim, rounds))
    bound = threshold - spread(left["factors"], dim, threshold, sigmas)
    found = []
    for at in range(0, len(left["u"]), rows):
        part = slice(at, at + rows)
        signs = np.where(left["signs"][part], 1.0, -1.0) / (left["factors"][part, :, None] * math.sqrt(dim))
        estimate = sum(signs[:, r] @ turned[r].T for r in range(rounds)) / rounds
        i, j = np.nonzero(estimate >= bound[part, None])
        i += at
        if right is None:
            i, j = i[j > i], j[j > i]
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            fine = np.einsum("ij,ij->i", left["u"][x], other["u"][y]) >= threshold
            found.append((x[fine], y[fine]))
    return tuple(np.concatenate([f[side] for f in found]) if found else np.zeros(0, dtype=np.int64) for side in (0, 1))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _meet(threshold: float, sigmas: float):
    """task, side, node, w, dim, code, factors, v, sorted by task and side, to node, links, root."""

    def pair(rows: pa.Table) -> pa.RecordBatch | None:
        dim, side = rows.column("dim")[0].as_py(), rows.column("side").to_numpy()
        rounds = rounds_of(dim)
        v, factors = (x.combine_chunks() for x in (rows.column("v"), rows.column("factors")))
        signs = np.unpackbits(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(side), -1), axis=1, count=rounds * dim, bitorder="little").reshape(-1, rounds, dim)
        both = {"u": units(_matrix(v, dim)), "factors": _matrix(factors, rounds), "signs": signs.astype(bool)}
        cut = int((side == 0).sum())
        if cut < len(side):
            i, j = linked({k: x[:cut] for k, x in both.items()}, {k: x[cut:] for k, x in both.items()}, dim, threshold, sigmas)
            j = j + cut
        else:
            i, j = linked(both, None, dim, threshold, sigmas)
        if not len(i):
            return None
        w, node = rows.column("w").to_numpy(), rows.column("node").to_numpy()
        links = np.bincount(i, w[j], len(side)) + np.bincount(j, w[i], len(side))
        own = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(links[own].astype(np.int64)), pa.array(node[roots(len(side), i, j)[own]])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for batch in batches:
            tasks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
            for at, end in zip(cuts, cuts[1:]):
                if held and tasks[at] != task:
                    if (found := pair(pa.Table.from_batches(held))) is not None:
                        yield found
                    held = []
                held.append(batch.slice(at, end - at))
                task = tasks[at]
        if held and (found := pair(pa.Table.from_batches(held))) is not None:
            yield found

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-7, sigmas: float = 6.0, block_rows: int = 1024, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector."""
    spark = vectors.sparkSession
    some = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    with Scratch(spark) as s:
        rows = s.table(some.where("id is not null").dropDuplicates(), "vectors")
        v = F.col("v")
        usable = F.coalesce(F.col("label").isNotNull() & vec.finite(v) & F.exists(v, lambda x: x != 0), F.lit(False))
        fitting = rows.where(usable)
        unique = fitting.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("w"))
        nodes = s.table(unique.select(F.monotonically_increasing_id().alias("node"), "least", "w", "label", "v"), "nodes")  # written, so the numbers stay
        met = links(s, nodes.select("node", "w", "label", "v"), threshold, miss, sigmas, block_rows)
        counts = met.groupBy("node").agg(F.sum("links").alias("links"))
        comps = components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), s.table)
        first = comps.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
        reach = comps.join(first, "component").select("node", "first")
        judged = nodes.select("node", "label", "v", "least", "w").join(counts, "node", "left").join(reach, "node", "left")
        judged = judged.select("label", "v", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
        alone = rows.where(~usable).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        told = fitting.join(judged, ["label", "v"]).select(F.col("id").alias("vec_id"), "n_links", "component_id").union(alone)
        path = write_scratch(told.withColumn("kept", F.col("vec_id") == F.col("component_id")), "near-vectors")
    return spark.read.schema(FOUND).parquet(path)


def links(s: Scratch, nodes: DataFrame, threshold: float, miss: float, sigmas: float, block_rows: int) -> DataFrame:
    """node, links, root: of each block pair, the weight that a node is linked with there and the first node of its component there."""
    n = nodes.count()
    cell_bits, (band_bits, n_bands) = min(62, max(8, math.ceil(math.log2(max(n, 1))) + 2)), bands(n, threshold, miss)
    schema = "node long, w long, label string, dim int, cell long, a long, b long, keys array<long>, code binary, factors array<double>, v array<double>"
    codes = s.table(nodes.mapInArrow(_codes(cell_bits, band_bits, n_bands), schema), "codes")
    own = ["label", "dim"]
    told = codes.select(*own, "cell", "a", "b", F.posexplode("keys").alias("band", "key"))
    fixed = [f(c).alias(f"{name}_{c}") for c in ("a", "b") for name, f in (("all", F.bit_and), ("any", F.bit_or))]
    buckets = s.table(told.groupBy(*own, "band", "key", "cell").agg(*fixed), "bands")
    # signs that all members of one cell have, and none of the other: no two members differ in fewer
    apart = " + ".join(f"bit_count((x.all_{c} & ~y.any_{c}) | (y.all_{c} & ~x.any_{c}))" for c in ("a", "b"))
    near = (F.col("x.cell") < F.col("y.cell")) & F.expr(f"{apart} <= {most_differing(threshold, miss)}")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*own, "band", "key")]
    pairs = buckets.alias("x").join(buckets.alias("y"), [*same, near]).select(*[F.col(f"x.{c}") for c in own], F.col("x.cell").alias("p"), F.col("y.cell").alias("q")).distinct()
    sizes = s.table(codes.groupBy(*own, "cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")), "cells")
    of = lambda name, blocks: sizes.select(*own, F.col("cell").alias(name), F.col("blocks").alias(blocks))
    within = sizes.where("n > 1").select(*own, F.col("cell").alias("p"), F.col("cell").alias("q"))
    every = pairs.union(within).join(of("p", "pn"), [*own, "p"]).join(of("q", "qn"), [*own, "q"])
    dealt = every.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pn") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("qn") - 1))).where("p < q or i <= j")
    work = s.table(dealt.select(F.monotonically_increasing_id().alias("task"), *own, "p", "i", "q", "j"), "block-pairs")  # written, so the numbers stay
    s.drop(buckets)
    split = sizes.where("blocks > 1").select(*own, "cell", "blocks")
    placed = codes.join(split, [*own, "cell"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0)))
    sent = ["node", "w", "dim", "code", "factors", "v"]
    left = placed.join(work.select("task", *own, F.col("p").alias("cell"), F.col("i").alias("block")), [*own, "cell", "block"]).select("task", F.lit(0).alias("side"), *sent)
    right = placed.join(work.where("p < q or i < j").select("task", *own, F.col("q").alias("cell"), F.col("j").alias("block")), [*own, "cell", "block"]).select("task", F.lit(1).alias("side"), *sent)
    meeting = left.union(right).repartition("task").sortWithinPartitions("task", "side")
    return s.table(meeting.mapInArrow(_meet(threshold, sigmas), "node long, links long, root long"), "links")


NEAR_SQL = """WITH RECURSIVE r AS (SELECT DISTINCT vec_id, label, embedding FROM embeddings WHERE vec_id IS NOT NULL),
  l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM r x JOIN r y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.98),
  c AS (SELECT a AS v, b AS to_v FROM l UNION SELECT c.v, l.b FROM c JOIN l ON l.a = c.to_v)
  SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
  FROM (SELECT DISTINCT vec_id FROM r) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id) LEFT JOIN (SELECT v AS vec_id, min(to_v) AS m FROM c GROUP BY v) USING (vec_id)"""
