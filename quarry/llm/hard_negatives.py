"""Hard negatives of anchors, read from blocks that lie along a Hilbert curve and tell the range of each dimension.

Vectors become whole numbers, floor(256 * x). They are sorted by label and by their place on a Hilbert curve through their
first principal axes (fitted on a bounded sample; the order bears on speed alone) and cut into blocks of one label, one
Parquet row each: ids, numbers, and the zone map, the least and largest number of each dimension. A window is a range of
inner products that an anchor looks for. Interval arithmetic on the zone map, the sum over dimensions of the smaller and of
the larger of a * low and a * high, bounds every inner product in a block; an anchor reads the blocks whose bounds meet one
of its windows, and no others.

Positives are the first of the anchor's label, from a window that begins at the last of those many best in the anchor's own
block. Each positive's score then gives a window in the other labels. A task meets a group of anchors with one block and
keeps the first of each window; the first of all blocks are taken afterwards.

Rows with a null id, label or vector, or with null or non-finite components, take no part; nor do vectors with a component
so large that inner products leave 2^53 (46,340 at 64 dimensions). Of rows with one id the one with the least label, then
vector, counts. Vectors of another length than the anchor's are no candidates. An anchor without positives, and a positive
without negatives, have no rows; negative scores of positives give empty windows. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import vectors as vec
from quarry.llm.common import Scratch, write_scratch
from quarry.llm.nearest import sampled

FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
BLOCK = "block long, dim int, label long, ids binary, x binary, low array<int>, high array<int>"
ANCHOR = "id long, label long, dim int, place long, x binary, low array<long>, high array<long>"
GROUP = "group long, dim int, ids binary, labels binary, x binary, low binary, high binary"
#: Inner products stay within 2^53, where doubles are exact; so this is beyond all.
BEYOND = 1 << 60


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points with whole coordinates of so many bits; a row is a point."""
    x = places.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            inverted = (x[i] >> level) & 1 == 1
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swapped)
            x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turned
    at = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            at = (at << 1) | ((x[i] >> level) & 1)
    return at


def fit(sample: list[list[int]], axes: int, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors in the sample the first principal axes, and where their coordinates are cut into ranges of equal weight."""
    by_dim: dict[int, list] = defaultdict(list)
    for v in sample:
        by_dim[len(v)].append(v)
    found = {}
    for dim, rows in by_dim.items():
        if dim:
            x = np.array(rows, dtype=np.float64)
            _, _, turned = np.linalg.svd(x - x.mean(0), full_matrices=False)
            own = turned[:axes].T
            found[dim] = own, np.quantile(x @ own, np.arange(1, 1 << bits) / (1 << bits), axis=0)
    return found


def _ordered(fits: dict[int, tuple[np.ndarray, np.ndarray]], bits: int):
    """id, label, v with the place of v on the curve; vectors of a length that the sample lacks have place 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, place = batch.column(2).value_lengths().to_numpy(), np.zeros(batch.num_rows, dtype=np.int64)
            for dim in set(lengths.tolist()) & set(fits):
                own, (axes, cuts) = np.flatnonzero(lengths == dim), fits[dim]
                x = batch.column(2).take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim) @ axes
                place[own] = hilbert(np.stack([np.searchsorted(cuts[:, i], x[:, i], side="right") for i in range(x.shape[1])], 1), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], ["id", "label", "v", "place"])

    return run


def _cut(block_rows: int):
    """Sorted rows (id, label, v, dim) in blocks of one label and length."""

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        dim = rows.column("dim")[0].as_py()
        x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, dim).astype("<i4")
        cells = [number, dim, rows.column("label")[0].as_py(), rows.column("id").to_numpy().astype("<i8").tobytes(), x.tobytes(), x.min(0).tolist(), x.max(0).tolist()]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["block", "dim", "label", "ids", "x", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, key = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            keys = np.stack([batch.column(3).to_numpy().astype(np.int64), batch.column(1).to_numpy()], 1)
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            at = 0
            for end in ends:
                while at < end:
                    own = tuple(keys[at].tolist())
                    if held and (own != key or size == block_rows):
                        yield block(pa.Table.from_batches(held), number)
                        number, held, size = number + 1, [], 0
                    some = min(end - at, block_rows - size)
                    held.append(batch.slice(at, some))
                    at, size, key = at + some, size + some, own
        if held:
            yield block(pa.Table.from_batches(held), number)

    return run


def _anchors(every: int, positives: int):
    """The anchors of each block, with a window from the last of their best in it upwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, dim = np.frombuffer(r["ids"], "<i8"), r["dim"]
                x = np.frombuffer(r["x"], "<i4").reshape(len(ids), dim)
                asked = np.flatnonzero(ids % every == 0)
                if not len(asked):
                    continue
                if len(ids) > positives:
                    score = x[asked].astype(np.float64) @ x.T.astype(np.float64)
                    score[np.arange(len(asked)), asked] = -np.inf
                    low = np.partition(score, len(ids) - positives, 1)[:, len(ids) - positives].astype(np.int64)
                else:
                    low = np.full(len(asked), -BEYOND)
                n = len(asked)
                fixed = [pa.array(ids[asked]), pa.array(np.full(n, r["label"], dtype=np.int64)), pa.array(np.full(n, dim, dtype=np.int32)), pa.array(np.full(n, r["block"], dtype=np.int64))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array([v.tobytes() for v in x[asked]], pa.binary()), pa.array(low[:, None].tolist(), pa.list_(pa.int64())), pa.array([[BEYOND]] * n, pa.list_(pa.int64()))], ["id", "label", "dim", "place", "x", "low", "high"])

    return run


def _groups(size: int, windows: int):
    """Anchors of one length in groups; an anchor with fewer windows gets empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), size):
                    part = batch.take(pa.array(own[at : at + size])).to_pydict()
                    n = len(part["id"])
                    low, high = np.full((n, windows), 1, dtype="<i8"), np.zeros((n, windows), dtype="<i8")
                    for i, (a, z) in enumerate(zip(part["low"], part["high"])):
                        low[i, : len(a)], high[i, : len(z)] = a, z
                    cells = [number, dim, np.array(part["id"], "<i8").tobytes(), np.array(part["label"], "<i8").tobytes(), b"".join(part["x"]), low.tobytes(), high.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, [pa.int64(), pa.int32(), *[pa.binary()] * 5])], ["group", "dim", "ids", "labels", "x", "low", "high"])
                    number += 1

    return run


def _zones(size: int):
    """Zone maps of blocks of one length, many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), size):
                    part = batch.take(pa.array(own[at : at + size]))
                    cells = [part.column(0).to_numpy().tobytes(), part.column(2).to_numpy().tobytes(), part.column(3).flatten().to_numpy().astype("<i4").tobytes(), part.column(4).flatten().to_numpy().astype("<i4").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["z_dim", "blocks", "z_labels", "z_low", "z_high"])

    return run


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of a with anything between low and high, for each row of these."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _chosen(same: bool):
    """Which blocks the anchors of a group read: group, block, a bit for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                blocks, dim = np.frombuffer(r["blocks"], "<i8"), r["dim"]
                labels = np.frombuffer(r["labels"], "<i8")
                zone = [np.frombuffer(r[c], "<i4").reshape(len(blocks), dim).astype(np.float64) for c in ("z_low", "z_high")]
                least, most = bounds(np.frombuffer(r["x"], "<i4").reshape(len(labels), dim).astype(np.float64), *zone)
                low, high = (np.frombuffer(r[c], "<i8").reshape(len(labels), -1) for c in ("low", "high"))
                need = np.zeros(least.shape, dtype=bool)
                for w in range(low.shape[1]):
                    a, z = low[:, w, None], high[:, w, None]
                    need |= (a <= z) & (most >= a) & (least <= z)
                need &= (labels[:, None] == np.frombuffer(r["z_labels"], "<i8")) == same
                some = np.flatnonzero(need.any(0))
                if len(some):
                    masks = np.packbits(need[:, some], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r["group"], dtype=np.int64)), pa.array(blocks[some]), pa.array([m.tobytes() for m in masks.T], pa.binary())], ["group", "block", "mask"])

    return run


def _score(k: int):
    """A group of anchors with a block: of each window the first k rows of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, dim, anchors = np.frombuffer(r["b_ids"], "<i8"), r["dim"], np.frombuffer(r["ids"], "<i8")
                x = np.frombuffer(r["b_x"], "<i4").reshape(len(ids), dim).astype(np.float64)
                asked = np.flatnonzero(np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=len(anchors)))
                a = np.frombuffer(r["x"], "<i4").reshape(len(anchors), dim)[asked].astype(np.float64)
                low, high = (np.frombuffer(r[c], "<i8").reshape(len(anchors), -1)[asked] for c in ("low", "high"))
                scores = (a @ x.T).astype(np.int64)
                out = [[], [], [], []]
                for i, own in enumerate(anchors[asked].tolist()):
                    real = low[i] <= high[i]
                    held = np.flatnonzero((scores[i] >= low[i][real].min()) & (scores[i] <= high[i][real].max()) & (ids != own))
                    held = held[np.lexsort((ids[held], -scores[i][held]))]
                    falling = -scores[i][held]
                    for w in np.flatnonzero(real).tolist():
                        start = np.searchsorted(falling, -high[i, w], side="left")
                        end = min(start + k, np.searchsorted(falling, -low[i, w], side="right"))
                        for to, values in zip(out, ([own] * (end - start), [w + 1] * (end - start), ids[held[start:end]].tolist(), (-falling[start:end]).tolist())):
                            to += values
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor_id", "turn", "vec_id", "score"])

    return run


def found(s: Scratch, anchors: DataFrame, blocks: DataFrame, zones: DataFrame, same: bool, windows: int, k: int, group_rows: int) -> DataFrame:
    """anchor_id, turn, vec_id, score, rank: of each window of each anchor (turn, from 1) the first k rows, of the anchor's label or of others."""
    near = anchors.repartitionByRange("dim", "place").sortWithinPartitions("dim", "place")
    groups = s.table(near.mapInArrow(_groups(group_rows, windows), GROUP), "groups")
    # all groups of anchors, the stated queries, with all zone maps, in blocks of both
    chosen = s.table(groups.crossJoin(zones).where("dim = z_dim").mapInArrow(_chosen(same), "group long, block long, mask binary"), "chosen")
    read = chosen.join(groups, "group").join(blocks.select("block", F.col("ids").alias("b_ids"), F.col("x").alias("b_x")), "block")
    met = read.mapInArrow(_score(k), "anchor_id long, turn int, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "turn").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", fit_rows: int = 4096, axes: int = 8, bits: int = 6, block_rows: int = 512, group_rows: int = 128) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of ids divisible by every, for each of their
    first positives the first negatives with least_percent * positive <= 100 * negative <= 100 * positive."""
    spark = vectors.sparkSession
    some = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    x = F.col("x")
    fine = vec.finite(x) & F.forall(x, lambda c: c * c * F.size("x") * vec.SCALE**2 <= float(1 << 53))
    with Scratch(spark) as s:
        first = some.where("id is not null and label is not null").where(fine).select("id", F.struct("label", vec.whole(x).alias("v")).alias("r")).groupBy("id").agg(F.min("r").alias("r"))
        rows = s.table(first.select("id", "r.label", "r.v"), "rows")
        fits = fit(sampled(rows, fit_rows), axes, bits)
        placed = rows.mapInArrow(_ordered(fits, bits), "id long, label long, v array<long>, place long").withColumn("dim", F.size("v"))
        along = placed.repartitionByRange("dim", "label", "place", "id").sortWithinPartitions("dim", "label", "place", "id").select("id", "label", "v", "dim")
        blocks = s.table(along.mapInArrow(_cut(block_rows), BLOCK), "blocks")
        zones = s.table(blocks.select("block", "dim", "label", "low", "high").mapInArrow(_zones(1024), "z_dim int, blocks binary, z_labels binary, z_low binary, z_high binary"), "zones")
        anchors = s.table(blocks.mapInArrow(_anchors(every, positives), ANCHOR), "anchors")
        best = s.table(found(s, anchors, blocks, zones, True, 1, positives, group_rows), "positives").select("anchor_id", F.col("rank").alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        least = F.when(F.col("positive_score") >= 0, F.expr(f"(positive_score * {least_percent} + 99) div 100")).otherwise(1)
        most = F.greatest("positive_score", F.lit(0))
        # at most `positives` windows an anchor
        windows = best.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", least.alias("low"), most.alias("high")))).alias("w"))
        looking = s.table(anchors.drop("low", "high").join(windows, "id").select("id", "label", "dim", "place", "x", F.col("w.low").alias("low"), F.col("w.high").alias("high")), "windows")
        other = found(s, looking, blocks, zones, False, positives, negatives, group_rows)
        told = other.join(best, ["anchor_id", "turn"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        path = write_scratch(told, "hard-negatives")
    return spark.read.schema(FOUND).parquet(path)


NEGATIVES_SQL = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
  s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
  SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5"""
