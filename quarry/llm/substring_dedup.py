"""Substring deduplication: passages that repeat across documents, found by collinear chaining of word k-mer seeds.

1. Seeds: of each `window` consecutive hashes of k words the least is kept with its position, so that every exact run of
   k + window - 1 words has one. Documents of fewer than least_words words can hold no passage.
2. Each seed names its first and its last document. Every other occurrence is matched with these two and no others, so
   matches grow with the occurrences of a seed and not with their square, however many documents share a passage.
3. For each pair of documents the matches are chained: a chain is increasing in both, an added match earns k and costs
   gap_cost for each word skipped in either; the best predecessor comes from a Fenwick tree of prefix maxima over
   positions in the source. Chains are cut at gaps over max_gap words.
4. The words around both sides of a chain are fetched, and the chain is aligned: along diagonals by comparing words,
   between diagonals by longest common subsequence, beyond both ends while matches outweigh mismatches. A passage has
   least_words words or more and identity of 0.8 or more; a chain that falls short is cut at its largest gap and tried
   again.
5. What the two partners of a seed leave out is found exactly: a run of least_words words holds a known number of
   seeds of its own, next to each other and at fixed distances, so their common hash is a key of the run. Where documents
   share such a key and no passage covers a run that it can lie in, the runs are looked up in all documents that hold the
   key and matched with their first document. So each word of a run of least_words words that a document with a smaller
   id holds too is in a row.
6. Passages with changed words that the two partners leave out: a chain has two seeds in turn, max_gap words apart or less,
   so two such seeds are a key. Each place of a key with a seed that no passage covers (it is open) meets every place of the
   key in all documents with smaller ids, in tiles of TILE places by TILE places however many these are. What can't be a
   passage goes at once. A passage whose seeds lie within max_gap words has its first and last seed as a key, and by 4 the
   words between them and those that match beyond both are least_words or more. Any other passage has, for each of its
   seeds, a key around it or from it with a further seed beyond, more than max_gap words from the key's other end (`far`).
   The matches of the others are chained and aligned as in 3 and 4. Places of a key in one document that have the same words
   and seeds around them are told apart by nothing that is asked of them: later documents meet the first of them.

Where one to `window` words stand over and over, the same k-mer is a seed at places of equal distance. Of these the first and
the last alone are matched and chained, each with its like (3, 6; 2: the first). Exact runs are found by all of them (5), and of
the runs that are equal again a period later those kept hold all words of the stretch.

Seeds that a look at one document in SAMPLE shows to be very common are dealt to SALTS tasks each, so that a passage that
very many documents share isn't one task's work; what is found doesn't depend on it.

A row says that words start to stop (exclusive) of doc_id repeat words source_start to source_stop of source_id, the
smaller id of the two. So the first document of a passage has no row for it. Words are runs of characters other than ASCII white space, A to Z in lower case.

Null, empty and blank texts hold no passage; a null doc_id takes no part. Rows with equal doc_id are one document, its
passages are sought in each of its texts, and text_hash says which one a row speaks of. What a document repeats of itself
is not reported. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, slices, whole_text, write_scratch
from quarry.llm.near_dedup import mixed, rolled, word_hashes

#: Words fetched beyond the ends of a chain.
REACH = 32
#: One document in so many is looked at for common seeds.
SAMPLE = 64
#: Tasks that a common seed is dealt to, and the share of all sampled seeds from which one is common.
SALTS, COMMON = 64, 1e-3
#: Chains whose words are cut from a text at once.
CHAINS = 256
#: Places of two seeds that meet as many others in a task.
TILE = 8192
#: Tells the last seed of a stretch of equal ones from the first.
LAST = 0x5851F42D4C957F2D
PLACES = ["doc_id", "start", "stop", "source_id", "source_start", "source_stop", "text_hash"]
PASSAGES = "doc_id long, start int, stop int, source_id long, source_start int, source_stop int, identity double, text_hash long"


def minimizers(text: str, k: int, window: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the least k-mer hash of each window."""
    h = word_hashes(text)
    if len(h) < max(least_words, k + window - 1):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    x = rolled(h, k)
    view = np.lib.stride_tricks.sliding_window_view(x, window)
    at = np.unique(view.argmin(1) + np.arange(len(view)))
    return at, x[at]


def stretches(x: np.ndarray, step: int, most: int) -> np.ndarray:
    """Which of x at places that follow each other to keep, where they are equal again a period of most places or less later: the first period, the last place and each step-th.

    x are hashes of step words, so that a place has one least period and a stretch one period.
    """
    kept, free = np.ones(len(x), dtype=bool), np.ones(len(x), dtype=bool)
    for period in range(1, min(most + 1, len(x))):
        again = np.zeros(len(x) + 1, dtype=bool)
        again[period:-1] = (x[period:] == x[:-period]) & free[period:]
        if not again.any():
            continue
        free &= ~again[:-1]
        place = np.arange(len(x))
        begin = np.maximum.accumulate(np.where(again[:-1], 0, place + 1)) - period
        kept &= ~(again[:-1] & again[1:]) | ((place - begin) % step == 0)
    return kept


def stretch_ends(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """0 within equal x at places at of equal distance that follow each other, 2 for the last of them, 1 for the first and for all others."""
    step = np.diff(at)
    same = x[1:] == x[:-1]
    within = np.zeros(len(x) + 1, dtype=bool)
    within[1 : len(same)] = same[1:] & same[:-1] & (step[1:] == step[:-1])
    before = np.roll(within, 1)[:-1]
    return np.where(within[:-1], 0, np.where(before, 2, 1)).astype(np.int32)


def seeds(docs: DataFrame, k: int, window: int, least_words: int) -> DataFrame:
    """seed, doc, pos, fresh (the document's first occurrence of the seed), ends as stretch_ends() has it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, x = minimizers(text, k, window, least_words)
                fresh = np.zeros(len(x), dtype=bool)
                fresh[np.unique(x, return_index=True)[1]] = True
                for col, v in zip(cols, (x.view(np.int64), np.full(len(x), doc, dtype=np.int64), at.astype(np.int32), fresh, stretch_ends(x, at))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["seed", "doc", "pos", "fresh", "ends"])

    return docs.mapInArrow(find, "seed long, doc long, pos int, fresh boolean, ends int")


class Fenwick:
    """Prefix maxima of (value, item) by rank."""

    def __init__(self, n: int):
        self.value = [-1e18] * (n + 1)
        self.item = [-1] * (n + 1)

    def put(self, rank: int, value: float, item: int) -> None:
        rank += 1
        while rank < len(self.value):
            if value > self.value[rank]:
                self.value[rank], self.item[rank] = value, item
            rank += rank & -rank

    def best(self, rank: int) -> tuple[float, int]:
        """Over ranks below rank."""
        value, item = -1e18, -1
        while rank > 0:
            if self.value[rank] > value:
                value, item = self.value[rank], self.item[rank]
            rank -= rank & -rank
        return value, item


def chains(a: np.ndarray, b: np.ndarray, k: int, gap_cost: float, max_gap: int) -> list[np.ndarray]:
    """Index arrays of the chains of matches (a in the source, b in the document, ascending in b, then descending in a), best first, cut at gaps."""
    n = len(a)
    step_a, step_b = np.diff(a), np.diff(b)
    if n > 1 and (step_a > 0).all() and (step_b > 0).all() and max(step_a.max(), step_b.max()) <= max_gap:
        return [np.arange(n)]
    ranks = np.searchsorted(np.unique(a), a).tolist()
    tree, score, before = Fenwick(max(ranks) + 1), [0.0] * n, [-1] * n
    al, bl = a.tolist(), b.tolist()
    for i in range(n):
        value, j = tree.best(ranks[i])
        gain = value - gap_cost * (al[i] + bl[i])
        score[i], before[i] = (k + gain, j) if j >= 0 and gain > 0 and bl[j] < bl[i] else (float(k), -1)
        tree.put(ranks[i], score[i] + gap_cost * (al[i] + bl[i]), i)
    used, found = [False] * n, []
    for end in sorted(range(n), key=lambda i: (-score[i], i)):
        path, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            path = np.array(path[::-1])
            cut = np.flatnonzero((np.diff(a[path]) > max_gap) | (np.diff(b[path]) > max_gap)) + 1
            found += np.split(path, cut)
    return found


def chained(matches: DataFrame, k: int, gap_cost: float, max_gap: int) -> DataFrame:
    """doc, source, a, b: the chains of two matches or more. Partitions are sorted by pair, and a pair may go over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            rows = rows if kept is None else np.concatenate([kept, rows], axis=1)
            if not rows.shape[1]:
                continue
            cut = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            last = cut[-1] if len(cut) else 0
            kept = rows[:, last:]
            if last:
                yield from chain_pairs(rows[:, :last], np.concatenate([[0], cut]))
        if kept is not None and kept.shape[1]:
            yield from chain_pairs(kept, np.array([0, kept.shape[1]]))

    def chain_pairs(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        pair = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        fresh = np.concatenate([[True], (np.diff(rows[2]) != 0) | (np.diff(rows[3]) != 0) | (np.diff(pair) > 0)])
        pair, (doc, source, b, a) = pair[fresh], rows[:, fresh]
        first = np.flatnonzero(np.concatenate([[True], np.diff(pair) > 0]))
        size = np.diff(np.append(first, len(pair)))
        # most pairs are one chain as they stand
        step_a, step_b = np.diff(a, append=a[-1:]), np.diff(b, append=b[-1:])
        fine = (step_a > 0) & (step_b > 0) & (step_a <= max_gap) & (step_b <= max_gap)
        fine[np.append(first[1:], len(pair)) - 1] = True
        whole = (size > 1) & np.logical_and.reduceat(fine, first)
        rows_of = np.repeat(whole, size)
        yield batch_of(doc[first[whole]], source[first[whole]], size[whole], a[rows_of], b[rows_of])
        out: list[list] = [[], [], [], [], []]
        for low, n in zip(first[(size > 1) & ~whole].tolist(), size[(size > 1) & ~whole].tolist()):
            own_a, own_b = a[low : low + n], b[low : low + n]
            for at in chains(own_a, own_b, k, gap_cost, max_gap):
                if len(at) > 1:
                    for col, v in zip(out, (doc[low], source[low], len(at), own_a[at], own_b[at])):
                        col.append(v)
        if out[0]:
            yield batch_of(np.array(out[0]), np.array(out[1]), np.array(out[2]), np.concatenate(out[3]), np.concatenate(out[4]))

    def batch_of(doc: np.ndarray, source: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(source), *lists], ["doc", "source", "a", "b"])

    # of matches with equal b the one with the largest a comes first, so that none of them is taken to go before another
    ordered = matches.select("doc", "source", "b", "a").repartition("doc", "source").sortWithinPartitions("doc", "source", "b", F.desc("a"))
    return ordered.mapInArrow(run, "doc long, source long, a array<int>, b array<int>")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(y) + 1)
    for u in x.tolist():
        last = 0
        for j, v in enumerate(y.tolist(), 1):
            last, row[j] = row[j], last + 1 if u == v else max(row[j], row[j - 1])
    return row[-1]


def reach(same: np.ndarray) -> tuple[int, int]:
    """How far to go beyond an end: words and matches, where matches earn 1 and mismatches cost 2."""
    if not len(same):
        return 0, 0
    total = np.cumsum(np.where(same, 1, -2))
    n = int(total.argmax()) + 1
    return (n, int(same[:n].sum())) if total[n - 1] > 0 else (0, 0)


def aligned(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, least_words: int, least_identity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, stop, source start, source stop, identity) of the passages of a chain a, b in the words x of the source and y of the document.

    What isn't alike enough as a whole is cut at all of its largest gaps and tried again in parts, which are held on a stack.
    """
    found, open_parts = [], [(0, len(a))]
    while open_parts:
        low, high = open_parts.pop()
        passage, words = aligned_whole(x, y, a[low:high], b[low:high], k)
        if words >= least_words and passage[-1] >= least_identity:
            found.append(passage)
        elif high - low >= 4 and words >= least_words:
            gaps = np.maximum(np.diff(a[low:high]), np.diff(b[low:high]))
            cuts = [low, *(np.flatnonzero(gaps == gaps.max()) + low + 1).tolist(), high]
            open_parts += [(p, q) for p, q in zip(cuts, cuts[1:]) if q - p > 1][::-1]
    return found


def aligned_whole(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[tuple[int, int, int, int, float], int]:
    """The passage of a whole chain and its number of words in the document."""
    n = min(a[0], b[0])
    left, left_same = reach((x[a[0] - n : a[0]] == y[b[0] - n : b[0]])[::-1])
    end_a, end_b = a[-1] + k, b[-1] + k
    n = min(len(x) - end_a, len(y) - end_b)
    right, right_same = reach(x[end_a : end_a + n] == y[end_b : end_b + n])
    turn = np.flatnonzero(np.diff(a - b)) + 1
    same, at_a, at_b = left_same + right_same, a[0], b[0]
    for low, high in zip(np.concatenate([[0], turn]).tolist(), np.concatenate([turn, [len(a)]]).tolist()):
        to_a, to_b = max(a[low], at_a), max(b[low], at_b)
        same += common(x[at_a:to_a], y[at_b:to_b])
        shift = max(to_a - a[low], to_b - b[low])
        to_a, to_b = a[low] + shift, b[low] + shift
        at_a, at_b = max(to_a, a[high - 1] + k), max(to_b, b[high - 1] + k)
        same += int((x[to_a:at_a] == y[to_b:at_b]).sum())
    words_a, words_b = end_a + right - (a[0] - left), end_b + right - (b[0] - left)
    identity = min(1.0, float(same / max(words_a, words_b)))
    return (int(b[0] - left), int(end_b + right), int(a[0] - left), int(end_a + right), identity), int(words_b)


def by_doc(rows: DataFrame, work, schema: str, *order: str) -> DataFrame:
    """work(columns of one doc as arrays) for each doc of rows, whose columns are longs, doc first. It returns columns of equal length or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            part = np.stack([c.to_numpy() for c in batch.columns])
            kept = part if kept is None else np.concatenate([kept, part], axis=1)
            cut = np.flatnonzero(np.diff(kept[0])) + 1
            if len(cut):
                yield from docs_of(np.split(kept[:, : cut[-1]], cut[:-1], axis=1))
                kept = kept[:, cut[-1] :]
        if kept is not None and kept.shape[1]:
            yield from docs_of([kept])

    def docs_of(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = [x for x in map(work, parts) if x is not None]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], [x.split()[0] for x in schema.split(", ")])

    return rows.repartition("doc").sortWithinPartitions("doc", *order).mapInArrow(run, schema)


def own_seeds(k: int, window: int, words: int) -> int:
    """The least number of seeds that the windows of a run of words words have of their own.

    Its first is within its first window k-mers, its last within its last, and they follow each other by window at most. In
    the document no other seed stands between them.
    """
    return max(1, 1 + -(-(words - k + 2 - 2 * window) // window))


def run_keys(pos: np.ndarray, seed: np.ndarray, k: int, window: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, first and last start (inclusive) of a run of words words around each own_seeds() seeds in a row."""
    m = own_seeds(k, window, words)
    n = len(pos) - m + 1
    if n < 1:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    key = np.zeros(n, dtype=np.uint64)
    for i in range(m):
        key = mixed(key + seed[i : n + i].view(np.uint64) + (pos[i : n + i] - pos[:n]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low, high = np.maximum(pos[m - 1 :] + k - words, 0), pos[:n]
    fine = low <= high
    if m > 1:
        fine &= np.lib.stride_tricks.sliding_window_view(np.diff(pos), m - 1).max(1) <= window
    return key.view(np.int64)[fine], low[fine], high[fine]


def covered(low: np.ndarray, high: np.ndarray, start: np.ndarray, stop: np.ndarray, words: int) -> np.ndarray:
    """Whether all runs that begin at low to high (inclusive) lie in one piece of the union of the spans start to stop, start ascending."""
    if not len(start):
        return np.zeros(len(low), dtype=bool)
    top = np.maximum.accumulate(stop)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > top[:-1]]))
    first, last = start[new], top[np.concatenate([new[1:], [len(start)]]) - 1] - words
    at = np.searchsorted(first, low, side="right") - 1
    return (at >= 0) & (high <= last[at])


def spans_of(texts: DataFrame, found: DataFrame) -> DataFrame:
    """doc, pos, stop: the union of each document's rows in found, in pieces. Rows of a doc_id with several texts say nothing about which of them they cover."""

    def merged(rows: np.ndarray):
        doc, start, stop = rows
        top = np.maximum.accumulate(stop)
        new = np.flatnonzero(np.concatenate([[True], start[1:] > top[:-1]]))
        return doc[new], start[new], top[np.concatenate([new[1:], [len(start)]]) - 1]

    several = texts.groupBy("doc").agg(F.min("text_hash").alias("x"), F.max("text_hash").alias("y")).where("x <> y").select("doc")
    pieces = by_doc(found.select(F.col("doc_id").alias("doc"), F.col("start").cast("long").alias("pos"), F.col("stop").cast("long").alias("stop")), merged, "doc long, pos long, stop long", "pos")
    return pieces.join(several, "doc", "left_anti")


def exact_passages(s: Scratch, texts: DataFrame, shared: DataFrame, found: DataFrame, k: int, window: int, words: int) -> DataFrame:
    """Rows of PASSAGES: the runs of words words or more that an earlier document holds and found does not cover.

    texts(doc, text, text_hash); shared(seed, doc, pos): the seeds that two documents hold or more.
    """

    def keys_of(rows: np.ndarray):
        doc, pos, kind, other = rows
        seed, span = kind == 0, kind == 1
        key, low, high = run_keys(pos[seed], other[seed], k, window, words)
        if not len(key):
            return None
        return key, np.full(len(key), doc[0]), low, high, 1 - covered(low, high, pos[span], other[span], words).astype(np.int64)

    def regions(rows: np.ndarray):
        doc, low, high = rows
        top = np.maximum.accumulate(high)
        new = np.flatnonzero(np.concatenate([[True], low[1:] > top[:-1] + 1]))
        return doc[new], low[new], top[np.concatenate([new[1:], [len(low)]]) - 1]

    spans = spans_of(texts, found).select("doc", "pos", F.lit(1).cast("long").alias("kind"), F.col("stop").alias("other"))
    held = shared.select("doc", F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("kind"), F.col("seed").alias("other"))
    keys = s.table(by_doc(held.union(spans), keys_of, "key long, doc long, low long, high long, open long", "pos"), "keys")
    wanted = keys.groupBy("key").agg(F.min("doc").alias("first"), F.max(F.when(F.col("open") == 1, F.col("doc"))).alias("last")).where("first < last").select("key")
    wanted = s.table(keys.join(wanted, "key", "left_semi").select("doc", "low", "high").distinct(), "wanted")
    s.drop(keys)
    places = s.table(by_doc(wanted, regions, "doc long, low long, high long", "low"), "places")
    s.drop(wanted)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc, tag, text, found in zip(*(batch.column(c).to_pylist() for c in range(4))):
                h, cols = word_hashes(text), [[], []]
                for place in found:
                    low, part = place["low"], h[place["low"] : place["high"] + words]
                    if len(part) >= words:
                        x, at = rolled(part, words), np.arange(low, low + len(part) - words + 1)
                        # few words over and over: the runs kept hold all of them
                        kept = stretches(x, words, window)
                        cols[0].append(x.view(np.int64)[kept])
                        cols[1].append(at[kept])
                if cols[0]:
                    gram, pos = (np.concatenate(c) for c in cols)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(len(gram), doc)), pa.array(np.full(len(gram), tag)), pa.array(pos)], ["gram", "doc", "tag", "pos"])

    listed = places.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("places"))
    grams = s.table(texts.join(listed, "doc").select("doc", "text_hash", "text", "places").mapInArrow(runs, "gram long, doc long, tag long, pos long"), "runs")
    firsts = grams.groupBy("gram").agg(F.min(F.struct("doc", "tag", "pos")).alias("s")).select("gram", F.col("s.doc").alias("source"), F.col("s.tag").alias("source_tag"), F.col("s.pos").alias("a"))
    pairs = grams.join(firsts, "gram").where("doc <> source").withColumn("shift", F.col("pos") - F.col("a"))
    line = Window.partitionBy("doc", "tag", "source", "source_tag", "shift").orderBy("pos")
    # repeated rows have equal places
    turns = pairs.withColumn("island", F.col("pos") - F.dense_rank().over(line))
    ends = turns.groupBy("doc", "tag", "source", "source_tag", "shift", "island").agg(F.min("pos").alias("low"), (F.max("pos") + words).alias("high"))
    return ends.select(F.col("doc").alias("doc_id"), F.col("low").cast("int").alias("start"), F.col("high").cast("int").alias("stop"), F.col("source").alias("source_id"), (F.col("low") - F.col("shift")).cast("int").alias("source_start"), (F.col("high") - F.col("shift")).cast("int").alias("source_stop"), F.lit(1.0).alias("identity"), F.col("tag").alias("text_hash")).distinct()


def common_seeds(found: DataFrame) -> list[int]:
    """Seeds with a share of COMMON or more of all: at most 1 / COMMON of them."""
    counts = found.groupBy("seed").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r["seed"] for r in counts.where(F.col("n") >= max(64, COMMON * total)).collect()]


def shared_seeds(s: Scratch, texts: DataFrame, k: int, window: int, least_words: int) -> DataFrame:
    """seed, doc, pos, fresh, ends, and the first and last document of the seed with a place in each, of the seeds that two documents hold or more.

    held: how many texts hold it, and one more if one holds it more than once.
    """
    heavy = common_seeds(seeds(texts.where(F.pmod(F.xxhash64("doc", "text_hash"), F.lit(SAMPLE)) == 0).select("doc", "text"), k, window, least_words))
    salt = F.when(F.col("seed").isin(heavy), 1 + F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0)
    salted = {"salt": salt.cast("int")} if heavy else {}
    keys = ["seed", *salted]
    # one shuffle serves both the naming and the matching: both read all of its columns, and neither filters what goes into it
    kind = F.col("ends") + F.when(F.col("fresh"), 4).otherwise(0)
    every = seeds(texts.select("doc", "text"), k, window, least_words).select("seed", "doc", "pos", kind.alias("kind")).withColumns(salted).dropna(subset=keys).repartition(*keys)
    is_fresh = F.col("kind") >= 4
    fresh = lambda c: F.when(is_fresh, F.col(c))
    held = (F.count_if(is_fresh) + (F.count("*") > F.count_if(is_fresh)).cast("long")).alias("held")
    named = every.groupBy(*keys).agg(F.min("doc").alias("first"), F.min_by(fresh("pos"), fresh("doc")).alias("first_pos"), F.max("doc").alias("last"), F.max_by(fresh("pos"), fresh("doc")).alias("last_pos"), held)
    met = every.join(named.where((F.col("first") < F.col("last")) | (F.col("salt") > 0 if heavy else F.lit(False))), keys)
    both = met.select(*salted, "seed", "doc", "pos", is_fresh.alias("fresh"), (F.col("kind") % 4).alias("ends"), "first", "first_pos", "last", "last_pos", "held")
    if not heavy:
        return s.table(both, "shared")
    both = s.table(both, "parts")
    columns = ["seed", "doc", "pos", "fresh", "ends", "first", "first_pos", "last", "last_pos", "held"]
    # a row for each common seed comes to the driver, 1 / COMMON at most
    ends = both.where("salt > 0").groupBy("seed").agg(F.min("first").alias("first"), F.min_by("first_pos", "first").alias("first_pos"), F.max("last").alias("last"), F.max_by("last_pos", "last").alias("last_pos"), (F.count_if("fresh") + (F.count("*") > F.count_if("fresh")).cast("long")).alias("held")).collect()
    told = lambda c: F.create_map(*[F.lit(x) for r in ends for x in (r["seed"], r[c])])[F.col("seed")].alias(c)
    dealt = both.where("salt > 0").select(*columns[:5], *map(told if ends else F.col, columns[5:]))
    shared = s.table(both.where("salt = 0").select(*columns).union(dealt.where("first < last").select(*columns)), "shared")
    s.drop(both)
    return shared


def passages(docs: DataFrame, k: int = 5, window: int = 8, least_words: int = 45, least_identity: float = 0.8, gap_cost: float = 0.1, max_gap: int = 40) -> DataFrame:
    """doc_id, start, stop, source_id, source_start, source_stop, identity, text_hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), whole_text().alias("text")).where(F.col("doc").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    with Scratch(docs.sparkSession) as s:
        shared = shared_seeds(s, texts, k, window, least_words)
        by_seeds = s.table(chained_passages(s, texts, shared, k, least_words, least_identity, gap_cost, max_gap), "passages")
        by_runs = exact_passages(s, texts, shared.select("seed", "doc", "pos"), by_seeds, k, window, least_words)
        found = s.table(by_seeds.union(by_runs), "runs_found")
        s.drop(by_seeds)
        matches = open_matches(s, texts, shared, found, k, window, least_words, max_gap)
        s.drop(shared)
        rest = aligned_passages(s, texts, matches, k, least_words, least_identity, gap_cost, max_gap)
        path = write_scratch(found.union(rest.join(found, PLACES, "left_anti").select(found.columns)), "found")
    return docs.sparkSession.read.schema(PASSAGES).parquet(path)


def chained_passages(s: Scratch, texts: DataFrame, shared: DataFrame, k: int, least_words: int, least_identity: float, gap_cost: float, max_gap: int) -> DataFrame:
    """Rows of PASSAGES by chains of seeds, each place with the first and the last document of its seed."""
    pair = lambda to, at: F.when((F.col("doc") != F.col("first")) & (F.col("doc") != F.col(to)), F.struct(F.col(to).alias("source"), F.col(at).alias("a")))
    to_first = F.when(F.col("doc") != F.col("first"), F.struct(F.col("first").alias("source"), F.col("first_pos").alias("a")))
    matches = shared.where("ends = 1").select("doc", F.col("pos").alias("b"), F.explode(F.array_compact(F.array(to_first, pair("last", "last_pos")))).alias("m")).select("doc", "b", "m.source", "m.a")
    return aligned_passages(s, texts, matches, k, least_words, least_identity, gap_cost, max_gap)


def seed_pairs(pos: np.ndarray, seed: np.ndarray, held: np.ndarray, shut: np.ndarray, max_gap: int) -> tuple[np.ndarray, ...]:
    """key, pos, gap, open of each two seeds in turn, max_gap words apart or less; open: a seed from the first to the second isn't shut.

    Seeds that two texts hold each, and once, have met in them: keys of such seeds alone, those between counted in, are left out.
    """
    cols: list[list[np.ndarray]] = [[], [], [], []]
    free, many = (np.concatenate([[0], np.cumsum(x)]) for x in (~shut, held > 2))
    for i in range(1, len(pos)):
        at = np.flatnonzero(pos[i:] - pos[:-i] <= max_gap)
        if not len(at):
            break
        at = at[(many[at + i + 1] > many[at]) & (pos[at] < pos[at + i])]
        key = mixed(mixed(seed[at].view(np.uint64)) + seed[at + i].view(np.uint64))
        for col, x in zip(cols, (key.view(np.int64), pos[at], pos[at + i] - pos[at], (free[at + i + 1] > free[at]).astype(np.int64))):
            col.append(x)
    return tuple(np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in cols)


def far(x: np.ndarray, at: np.ndarray, pos: int, end: int, max_gap: int) -> list[tuple[int, int, bool]]:
    """The seeds x at places at near a key's seeds at pos and end: seed with its side, place, whether it is more than max_gap words from the key's other end."""
    low, first, last, high = np.searchsorted(at, [pos - max_gap, pos, end + 1, end + max_gap + 1]).tolist()
    found = [(s, p, p < end - max_gap) for s, p in zip((~x[low:first]).tolist(), at[low:first].tolist())]
    return found + [(s, p, p > pos + max_gap) for s, p in zip(x[last:high].tolist(), at[last:high].tolist())]


def hopeful(left: np.ndarray, right: np.ndarray, other_left: np.ndarray, other_right: np.ndarray, need: int) -> np.ndarray:
    """Which others match in need words or more beyond both ends, as reach() has it. Words lie outwards, one row for each other."""
    if need <= 0:
        return np.ones(len(other_left), dtype=bool)
    same = [other_left == left, other_right == right]
    # two of three words beyond an end match, at least
    some = np.flatnonzero(3 * (same[0].sum(1) + same[1].sum(1)) >= 2 * need)
    words = np.zeros(len(some), dtype=np.int64)
    for x in same:
        total = np.cumsum(np.where(x[some], 1, -2), axis=1)
        best = total.argmax(1)
        words += np.where(total[np.arange(len(some)), best] > 0, best + 1, 0)
    out = np.zeros(len(other_left), dtype=bool)
    out[some[words >= need]] = True
    return out


def open_matches(s: Scratch, texts: DataFrame, shared: DataFrame, found: DataFrame, k: int, window: int, least_words: int, max_gap: int) -> DataFrame:
    """doc, source, b, a: the matches of open places with all places of their two seeds in documents of smaller ids, and of the far seeds that they share."""
    fold = max_gap + 1

    def pairs_of(rows: np.ndarray):
        doc, pos, kind, other, held = rows
        at, span = np.flatnonzero(kind == 0), kind == 1
        # repeated rows have equal places
        at = at[np.unique(np.stack([pos[at], other[at]]), axis=1, return_index=True)[1]]
        shut = covered(pos[at], pos[at], pos[span], other[span], k)
        key, at, gap, free = seed_pairs(pos[at], other[at], held[at], shut, max_gap)
        return (key, np.full(len(key), doc[0]), (at * fold + gap) * 2 + free) if len(key) else None

    long = lambda c, name: F.col(c).cast("long").alias(name)
    spans = spans_of(texts, found).select("doc", "pos", F.lit(1).cast("long").alias("kind"), F.col("stop").alias("other"), F.lit(0).cast("long").alias("held"))
    told = F.when(F.col("ends") == 2, F.col("seed").bitwiseXOR(F.lit(LAST))).otherwise(F.col("seed"))
    held = shared.where("ends > 0").select("doc", long("pos", "pos"), F.lit(0).cast("long").alias("kind"), told.alias("other"), "held")
    # one shuffle serves both the sizes and the places
    keys = by_doc(held.union(spans), pairs_of, "key long, doc long, place long", "pos").repartition("key")
    is_open = F.col("place") % 2 == 1
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = keys.groupBy("key").agg(F.min("doc").alias("first"), F.max(F.when(is_open, F.col("doc"))).alias("latest"), tiles(F.count_if(is_open)).alias("opens"), tiles(F.count("*")).alias("all")).where("first < latest")
    wanted = s.table(keys.join(sizes, "key").where("doc < latest or place % 2 = 1").select("key", "doc", "place", "opens", "all"), "wanted_seeds")
    listed = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "place", "opens", "all")).alias("places"))
    kinds = "key long, opens int, all int, doc long, pos long, gap long, open long, lead long, left binary, right binary, near array<long>, near_pos array<long>, near_far array<boolean>"
    names = [x.split()[0] for x in kinds.split(", ")]

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, text, places in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words = word_hashes(text).astype("<u4")
                at, x = minimizers(text, k, window, least_words)
                ends = stretch_ends(x, at)
                x = np.where(ends == 2, x.view(np.int64) ^ LAST, x.view(np.int64))
                at, x = at[ends > 0], x[ends > 0]
                there, met = set(at.tolist()), set()
                for p in sorted(places, key=lambda p: p["place"]):
                    pos, gap = divmod(p["place"] // 2, fold)
                    end = pos + gap
                    if pos not in there or end not in there:
                        continue  # a place of another text with the same doc_id
                    near = far(x, at, pos, end, max_gap)
                    left, right = words[max(0, pos - REACH) : pos][::-1].tobytes(), words[end + k : end + k + REACH].tobytes()
                    looks = (p["key"], gap, words[pos : end + k].tobytes(), left, right, tuple((n[0], n[1] - pos) for n in near))
                    out.append((p["key"], p["opens"], p["all"], doc, pos, gap, p["place"] % 2, int(looks not in met), left, right, *([n[i] for n in near] for i in range(3))))
                    met.add(looks)
            if out:
                types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    places = s.table(texts.join(listed, "doc").select("doc", "text", "places").mapInArrow(around, kinds), "around")
    s.drop(wanted)
    dealt = lambda c: F.pmod(F.xxhash64("doc", "pos", "gap"), F.col(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["key", "doc", "pos", "gap", "left", "right", "near", "near_pos", "near_far"]
    asking = places.where("open = 1").select(F.lit(1).alias("asks"), dealt("opens").alias("i"), upto("all").alias("j"), *columns)
    asked = places.where("lead = 1").select(F.lit(0).alias("asks"), upto("opens").alias("i"), dealt("all").alias("j"), *columns)

    def words_of_sides(rows: list[tuple], fill: int) -> tuple[np.ndarray, np.ndarray]:
        """Words outwards, a row for each place; what isn't there is fill."""
        sides = []
        for column in (4, 5):
            out = np.full((len(rows), REACH), fill, dtype=np.int64)
            for row, r in zip(out, rows):
                row[: len(r[column]) // 4] = np.frombuffer(r[column], "<u4")
            sides.append(out)
        return tuple(sides)

    def enough(left: np.ndarray, right: np.ndarray, others_left: np.ndarray, others_right: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Where two of three of need words match beyond the ends, at least: hopeful() asks no less."""
        same = np.zeros((len(left), len(others_left)), dtype=np.uint8)
        for x, y in ((left, others_left), (right, others_right)):
            for own, other in zip(x.T, np.ascontiguousarray(y.T)):
                same += own[:, None] == other
        return 3 * same.astype(np.int16) >= 2 * need[:, None]

    def index_of(rows: list[tuple], beyond: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The rows with a seed near, or beyond a key's other end, and its places in them."""
        found: dict[int, list[tuple[int, int]]] = {}
        for j, r in enumerate(rows):
            for x, p, f in zip(*r[6:9]):
                if f or not beyond:
                    found.setdefault(x, []).append((j, p))
        return {x: tuple(np.array(v, dtype=np.int64).T) for x, v in found.items()}

    def tile(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sides = [[r for r in rows if r[0] == x] for x in (1, 0)]
        if not sides[0] or not sides[1]:
            return
        (doc, pos, gap), (source, a, a_gap) = (np.array([r[1:4] for r in side], dtype=np.int64).T for side in sides)
        # as whole numbers of 64 bits: no word is -1 or -2
        (left, right), (others_left, others_right) = words_of_sides(sides[0], -1), words_of_sides(sides[1], -2)
        need = least_words - k - gap
        near, beyond = index_of(sides[1], False), index_of(sides[1], True)
        step = max(1, (1 << 16) // len(source))
        for low in range(0, len(doc), step):
            some = slice(low, low + step)
            before = source < doc[some, None]
            likely = enough(left[some], right[some], others_left, others_right, need[some]) & before
            out = []
            for i, own in enumerate(likely):
                i += low
                fine = np.zeros(len(source), dtype=bool)
                for x, p, f in zip(*sides[0][i][6:9]):
                    j, q = (near if f else beyond).get(x, (None, None))
                    if j is not None:
                        use = before[i - low][j]
                        j, q = j[use], q[use]
                        fine[j] = True
                        out.append(np.stack([np.full(len(j), doc[i]), source[j], np.full(len(j), p), q]))
                rest = np.flatnonzero(own & ~fine)
                if len(rest):
                    fine[rest[hopeful(left[i], right[i], others_left[rest], others_right[rest], int(need[i]))]] = True
                at = np.flatnonzero(fine)
                if len(at):
                    out.append(np.stack([np.full(2 * len(at), doc[i]), np.tile(source[at], 2), np.repeat([pos[i], pos[i] + gap[i]], len(at)), np.concatenate([a[at], a[at] + a_gap[at]])]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(out, axis=1), axis=1)], ["doc", "source", "b", "a"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []
        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != own:
                    yield from tile(rows)
                    own, rows = (key, i, j), []
                rows.append(row)
        yield from tile(rows)

    both = asking.union(asked).select("key", "i", "j", "asks", *columns[1:])
    met = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(meet, "doc long, source long, b long, a long")
    return s.table(met, "met")


def aligned_passages(s: Scratch, texts: DataFrame, matches: DataFrame, k: int, least_words: int, least_identity: float, gap_cost: float, max_gap: int) -> DataFrame:
    """Rows of PASSAGES by the chains of matches(doc, source, b, a)."""
    found = chained(matches, k, gap_cost, max_gap)
    found = s.table(found.withColumn("chain", F.xxhash64("doc", "source", "a", "b")), "chains")

    low = lambda c: F.greatest(F.lit(0), F.element_at(c, 1) - REACH)
    high = lambda c: F.element_at(c, -1) + k + REACH
    wanted = found.select(F.explode(F.array(*[F.struct(F.col(c).alias("doc"), F.lit(side).alias("side"), "chain", low(at).alias("low"), high(at).alias("high")) for c, side, at in (("source", "a", "a"), ("doc", "b", "b"))])).alias("w")).select("w.*")
    # a text meets CHAINS of its chains at a time, so that the text of a source of very many isn't sent once for each
    packs = wanted.groupBy("doc").agg(F.ceil(F.count("*") / CHAINS).alias("packs"))
    packed = wanted.join(packs, "doc").groupBy("doc", F.pmod("chain", "packs").alias("pack")).agg(F.collect_list(F.struct("chain", "side", "low", "high")).alias("cuts"))
    fetched = packed.join(texts, "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for tag, text, cuts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words = word_hashes(text).astype(np.uint32)
                for w in cuts:
                    for col, v in zip(out, (w["chain"], w["side"], words[w["low"] : w["high"]].tobytes(), tag)):
                        col.append(v)
            types = [pa.int64(), pa.string(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["chain", "side", "words", "tag"])

    parts = fetched.select("text_hash", "text", "cuts").mapInArrow(cut, "chain long, side string, words binary, tag long")
    parts = s.table(parts, "words")
    side = lambda c: parts.where(f"side = '{c}'").select("chain", F.col("words").alias(f"w{c}"), F.col("tag").alias(f"tag_{c}"))
    full = found.join(side("a"), "chain").join(side("b"), "chain")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, source, a, b, wa, wb, tag_a, tag_b in zip(*(batch.column(c).to_pylist() for c in range(8))):
                a, b = np.array(a), np.array(b)
                low_a, low_b = max(0, int(a[0]) - REACH), max(0, int(b[0]) - REACH)
                x, y = np.frombuffer(wa, "<u4"), np.frombuffer(wb, "<u4")
                if len(x) < a[-1] + k - low_a or len(y) < b[-1] + k - low_b:
                    continue  # the words of another text with the same doc_id
                found = [(doc, p[0] + low_b, p[1] + low_b, source, p[2] + low_a, p[3] + low_a, p[4], tag_b) for p in aligned(x, y, a - low_a, b - low_b, k, least_words, least_identity)]
                out += found if source < doc else [(*p[3:6], *p[:3], p[6], tag_a) for p in found]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], [x.split()[0] for x in PASSAGES.split(", ")])

    return full.select("doc", "source", "a", "b", "wa", "wb", "tag_a", "tag_b").mapInArrow(align, PASSAGES).distinct()


WORD = re.compile(r"[^ \t-\r]+")


#: Names that cut_passages adds to those of docs, and takes away again.
CUT = ("__cut_doc", "__cut_text", "__cut_spans")


def cut_passages(docs: DataFrame, **options) -> DataFrame:
    """docs without the passages that repeat earlier documents: their words and the white space after them go.

    All rows and columns stay; a row loses only what was found in its own text, so rows of one doc_id with other texts and
    rows with a null doc_id or text are left as they are. Repeated rows are cut alike. docs may not have columns named as CUT.
    """
    if set(CUT) & set(docs.columns):
        raise ValueError(f"columns named {CUT} are kept for the cut")
    doc, text, spans = CUT
    found = passages(docs, **options).groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).agg(F.collect_set(F.struct("start", "stop")).alias(spans))
    here = (docs["doc_id"].cast("long") == found[doc]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == found[text])
    joined = docs.join(found, here, "left").drop(doc, text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = batch.column(batch.num_columns - 1).to_pylist()
            batch = batch.select(range(batch.num_columns - 1))
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            out = [_without(t, s) if t and s else t for t, s in zip(texts, spans)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    cleaned = joined.mapInArrow(clean, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else cleaned


def _without(text: str, spans: list[dict]) -> str:
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    parts, low = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["stop"])):
        start, stop = at[min(s["start"], len(at) - 1)], at[min(s["stop"], len(at) - 1)]
        if start > low:
            parts.append(text[low:start])
        low = max(low, stop)
    return "".join([*parts, text[low:]])
