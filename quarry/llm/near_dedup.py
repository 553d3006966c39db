"""MinHash near-deduplication with sequential Bayesian verification.

1. Sketch: the set of word shingles of each whole text as 64-bit hashes, its MinHash signature, and a hash of the set.
2. Texts with equal sets form a class; from here on a class has one row and one text, that of its smallest doc_id, and a
   key made of the two. Classes that hold the same doc_id are linked.
3. Bands of the signature put classes into buckets; rows per band are the most that keep the chance that a pair at the
   threshold shares no bucket below miss.
4. In each bucket every class is paired with one leader, drawn anew for each bucket; of these leaders a class keeps the
   few that it shares most buckets with, so pairs grow with the rows and not with the square of a group. Signatures of a pair are compared a batch after the other; a pair is dropped as soon as
   the posterior chance (uniform prior) that its similarity reaches the threshold falls below miss.
5. Each class is verified exactly, on full sets, with its most similar leader; then, in rounds, with the best-linked
   class of its buckets if that is in another component. Links and their components are found.
6. Classes in buckets that still hold two components or more are joined by their rarest shingles (prefix filter with
   positions) unless parities of their sets show them to differ too much; all pairs of different components that this
   leaves are verified, so no link between components is lost to the choice of leaders. (They are so close to the
   threshold that signatures tell hardly any apart.)

Words are runs of characters other than ASCII white space, A to Z in lower case. Fewer words than a shingle: the whole
sequence is one. Null, empty and blank texts have no shingles and no links. Rows with equal doc_id are one document for
linking and each give a row. A null doc_id takes no part in linking: its component is null and the row is kept. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, materialise, slices, whole_text, write_scratch
from quarry.llm.components import components

HASHES = 128
#: Leaders that a class is compared with before step 6, which finds whatever links these leave out.
LEADERS = 12
#: Rounds in which a class is compared with the best-linked one of its buckets, likewise.
HUBS = 1
BATCH = 16
#: Words of 64 parities of a class in step 6.
PARITY_WORDS = 16
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)


class WordHashes(dict):
    """64-bit hashes of words; KEEP bounds its memory."""

    KEEP = 500_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.KEEP:
            self[word] = value
        return value


_words = WordHashes()


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def word_hashes(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(h) - k + 1
    x = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        x = mixed(x + h[i : n + i] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1))
    return x


def shingle_set(text: str, k: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(rolled(h, min(k, len(h))))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash by multiply-shift: 32-bit minima."""
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(shingles), 512):
        products = (shingles[at : at + 512, None] * factors[None, :]) >> np.uint64(32)
        out = np.minimum(out, products.min(0).astype(np.uint32))
    return out


def band_rows(threshold: float, miss: float) -> int:
    """The most rows per band at which a pair at the threshold is missed with a chance of miss at most."""
    fine = [r for r in range(1, 17) if (1 - threshold**r) ** (HASHES // r) <= miss]
    return max(fine, default=1)


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """By number of hashes compared: the fewest matches at which the posterior chance of reaching the threshold is at least miss.

    With a uniform prior, the chance is that of a Beta(m + 1, n - m + 1) above the threshold, which is that of at most m
    successes in n + 1 draws.
    """
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss and m < n:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def text_key():
    return F.xxhash64(F.col("doc_id").cast("long"), whole_text())


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key (of doc_id and text), n_shingles, set_hash, signature; the last two are null without shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _multipliers()
        for batch in slices(batches):
            sets = [shingle_set(t, k) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, factors).astype("<u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "key", "n_shingles", "set_hash", "signature"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), whole_text().alias("text"))
    return texts.mapInArrow(sketch, "doc_id long, key long, n_shingles long, set_hash binary, signature binary")


def banded(classes: DataFrame, rows: int) -> DataFrame:
    """node, n, band, bucket: one row for each band of each class."""
    bands = HASHES // rows
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("signature", i * 4 * rows + 1, F.lit(4 * rows))).alias("bucket"))))
    return classes.select("node", "n", every.alias("e")).select("node", "n", "e.band", "e.bucket")


def pruned(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """a, b, matches of the pairs that pass all batches."""
    least = least_matches(threshold, miss)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(batch.num_rows, HASHES) for c in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for n in range(BATCH, HASHES + 1, BATCH):
                matches[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
                alive = alive[matches[alive] >= least[n]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(matches[alive])], ["a", "b", "matches"])

    sign = classes.select("node", "signature")
    left = pairs.join(sign.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
    full = left.join(sign.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    return full.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, matches long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b of the pairs whose sets have 100 * intersection >= percent * union. Pairs of one b come together, so its set is made once a run."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None
        for batch in slices(batches):
            keep = []
            for left, b, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if last != (b, text):
                    last, right = (b, text), shingle_set(text, k)
                left = shingle_set(left, k)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    full = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _near(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def mixed_buckets(held: DataFrame) -> DataFrame:
    """band, bucket of those with two components or more."""
    return held.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "bucket")


def hub_pairs(held: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """a, b: each node of another component with the best-linked node of the buckets it is in."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    here = held.join(mixed_buckets(held), ["band", "bucket"]).join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = here.groupBy("band", "bucket").agg(F.max(F.struct("degree", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("component").alias("b_component"))).alias("h"))
    near = here.join(hubs.select("band", "bucket", "h.*").withColumnRenamed("degree", "b_degree"), ["band", "bucket"]).where((F.col("component") != F.col("b_component")) & _near("n", "b_n", percent))
    return near.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("b_degree", "b")).alias("h")).select("a", F.col("h.b").alias("b"))


def parities(held: DataFrame) -> DataFrame:
    """node, p0 to p15: 1024 bits, each the parity of how many of the node's shingles fall on it."""
    place = F.shiftrightunsigned("gram", 54)
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(gram, 54) % 64 as int))")
    return held.groupBy("node").agg(*(F.coalesce(F.bit_xor(F.when(F.floor(place / 64) == i, bit)), F.lit(0)).alias(f"p{i}") for i in range(PARITY_WORDS)))


def prefix_pairs(nodes: DataFrame, texts: DataFrame, k: int, percent: int, keep: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """a, b: all pairs of nodes(node, component) of different components that can be similar, by prefix and position.

    Shingles are ordered by the number of components that hold them, rarest first; those of one component match nothing. Two sets with the asked similarity share one
    of the first n - ceil(n * percent / 100) + 1 of either, and enough shingles stand behind it. Copies that have too
    many shingles of their own are thus found to be alone without being compared with the others of their group.
    Each shingle that only one of two sets has changes one parity, so the parities that differ are a lower bound for
    these shingles, and a pair with too many is none.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, k) for t in batch.column(2).to_pylist()]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            rows = pa.array(np.repeat(np.arange(len(sets)), sizes))
            grams = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.repeat(sizes, sizes)), grams], ["node", "component", "n", "gram"])

    # repeated rows have one key and one text
    held = nodes.join(texts, "node").select("node", "component", "text").dropDuplicates(["node"]).mapInArrow(spread, "node long, component long, n long, gram long")
    held = keep(held, "grams")
    common = held.groupBy("gram").agg(F.countDistinct("component").alias("count"))
    ranked = held.join(common, "gram").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("count", "gram")) - 1)
    first = ranked.where((F.col("count") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100)))
    words = [f"p{i}" for i in range(PARITY_WORDS)]
    first = keep(first.join(parities(held), "node").select("gram", "node", "component", "n", "at", *words), "prefixes")
    x, y = (first.select("gram", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "component", "n", "at", *words))) for s in "xy")
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in words))
    few = (100 + percent) * apart <= (100 - percent) * (F.col("n_x") + F.col("n_y"))
    enough = (100 + percent) * (1 + F.least(F.col("n_x") - F.col("at_x") - 1, F.col("n_y") - F.col("at_y") - 1)) >= percent * (F.col("n_x") + F.col("n_y"))
    pairs = x.join(y, (x["gram"] == y["gram"]) & (F.col("component_x") < F.col("component_y")) & _near("n_x", "n_y", percent) & enough & few)
    return pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    with Scratch(docs.sparkSession) as s:
        path = write_scratch(_judged(s, docs, k, percent, miss), "near-documents")
    return docs.sparkSession.read.parquet(path)


def _judged(s: Scratch, docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    threshold = percent / 100
    sketched = s.table(sketches(docs, k), "sketches")
    shingled = sketched.where(F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull())
    classes = shingled.groupBy("set_hash").agg(F.min(F.struct("doc_id", "key", "n_shingles", "signature")).alias("c"))
    classes = s.table(classes.select("set_hash", "c.doc_id", F.col("c.key").alias("node"), F.col("c.n_shingles").alias("n"), F.col("c.signature").alias("signature")), "classes")
    texts = docs.where(F.col("doc_id").cast("long").isNotNull()).select(text_key().alias("node"), whole_text().alias("text"))
    # rows of one doc_id with other sets are the same document
    several = shingled.groupBy("doc_id").agg(F.min("set_hash").alias("first"), F.max("set_hash").alias("last")).where("first <> last").select("doc_id", "first")
    named = lambda c, to: classes.select(F.col("set_hash").alias(c), F.col("node").alias(to))
    same = shingled.select("doc_id", "set_hash").join(several, "doc_id").where("set_hash <> first").join(named("set_hash", "a"), "set_hash").join(named("first", "b"), "first")
    same = same.select("a", "b").distinct()

    buckets = banded(classes, band_rows(threshold, miss))
    shared = buckets.groupBy("band", "bucket").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("band", "node").alias("h"), F.col("node").alias("leader"), F.col("n").alias("leader_n"))).alias("l"))
    shared = shared.where("size > 1").select("band", "bucket", "l.leader", "l.leader_n")
    in_shared = s.table(buckets.join(shared, ["band", "bucket"]), "buckets")

    star = in_shared.where((F.col("node") != F.col("leader")) & _near("n", "leader_n", percent)).groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).count()
    likely = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("count"), F.xxhash64("a", "b")))
    star = star.withColumn("turn", likely).where(F.col("turn") <= LEADERS).select("a", "b")
    star = s.table(pruned(star, classes, threshold, miss), "star")

    best = star.groupBy("a").agg(F.max(F.struct("matches", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    links = s.table(verified(best, texts, k, percent).union(same).distinct(), "links")
    found = s.table(components(links, s.table), "found")
    for _ in range(HUBS):
        held = in_shared.select("node", "n", "band", "bucket").join(found, "node", "left").select("node", "n", "band", "bucket", F.coalesce("component", "node").alias("component"))
        held = s.table(held, "held")
        pairs = s.table(hub_pairs(held, links, percent), "hubs")
        more = verified(pruned(pairs, classes, threshold, miss).select("a", "b"), texts, k, percent)
        links = links.union(s.table(more.distinct(), "links"))
        found = s.table(components(links, s.table), "found")

    held = in_shared.select("node", "band", "bucket").join(found, "node", "left").select("node", "band", "bucket", F.coalesce("component", "node").alias("component"))
    open_ = held.join(mixed_buckets(held), ["band", "bucket"]).select("node", "component").distinct()
    pairs = prefix_pairs(s.table(open_, "open"), texts, k, percent, s.table)
    found = s.table(components(links.union(verified(pairs, texts, k, percent)), s.table), "found")

    grouped = classes.join(found, "node", "left").select("set_hash", "doc_id", F.coalesce("component", "node").alias("group"))
    lowest = grouped.groupBy("group").agg(F.min("doc_id").alias("component"))
    named = grouped.join(lowest, "group").select("set_hash", "component")
    result = sketched.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The rows of docs whose document is the first of its group, with all their columns."""
    gone = near_duplicates(docs, k, percent, miss).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


#: The same by brute force: all pairs that share a shingle, and all that is reached from each document.
NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * m >= 85 * (na + nb - m)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS x, a AS y FROM d UNION SELECT r.x, d.b FROM r JOIN d ON r.y = d.a),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON c.x = s.doc_id"""
