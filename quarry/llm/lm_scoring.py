"""Language-model scores: corpus word frequencies, and a gated recurrent model that is trained on the corpus.

1. Words of all training documents are counted (a shuffle by word after counting in each task).
2. The most frequent words, hot_words at most, go to every task with their counts; documents' other words meet their
   counts in a join by word, so the vocabulary may be of any size.
3. The recurrent model knows the model_words most frequent words, in classes that are the larger the rarer their words
   are; the others are one class of words to it, and their probability is that class' times their add-one share of its
   training tokens. Copies of the model are trained in two rounds (an eighth of the documents, then the rest), one for each
   COPY_TOKENS of a round, which documents are dealt to by their hash, however the input is partitioned; after each round
   the copies are averaged by tokens, with a running sum for each piece of PIECE parameters, in slots of about SLOT_COPIES
   copies first. Each training document is learnt from once.
   Texts become the model's ids once, and both training and scoring read these.
4. Every whole text is scored with its state carried through.

Tokens are runs of characters other than ASCII white space, A to Z in lower case, and one end, which is counted as a
token. Null text counts as empty: the end alone. A document is held out if crc32(doc_id as text) mod folds is fold; one
with null doc_id is not. Repeated rows each give a row and each count in training. Without training documents every
token is unknown and the base score is 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, slices, text_slices, whole_text, write_scratch
from quarry.llm.gru import Model, Trainer, document_scores
from quarry.llm.near_dedup import words_of

END = b"\n"
#: Different words counted in a task before their counts are handed on.
HELD_WORDS = 300_000
#: Parameters that are averaged together.
PIECE = 1 << 14
#: Tokens that a copy of the model learns from in a round, and copies that are averaged in one slot.
COPY_TOKENS, SLOT_COPIES = 1 << 20, 64
#: Bytes of ids that a task holds at once.
HELD_IDS = 1 << 22
#: Steps of frequency per factor of two that hot words are chosen by.
FINE = 64


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(text: str) -> list[bytes]:
    return [*words_of(text), END]


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all rows of texts(text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [w.decode() for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update(tokens_of(text))
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        yield out()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """The hot words by frequency: ranks, log10(count + 1), and ids of the model."""

    def __init__(self, hot: list[tuple[str, int]], model_words: int):
        self.rank = {w.encode(): i for i, (w, _) in enumerate(hot)}
        self.log = np.log10(np.array([n for _, n in hot] + [0], dtype=np.float64) + 1)
        self.known = min(model_words - 1, len(hot))
        self.first = min(self.rank.get(END, self.known), self.known)

    def ranks(self, tokens: list[bytes]) -> np.ndarray:
        """Ranks, -1 for words that aren't hot."""
        return np.fromiter(map(self.rank.get, tokens, repeat(-1)), dtype=np.int32, count=len(tokens))

    def ids(self, ranks: np.ndarray) -> np.ndarray:
        return np.where((ranks < 0) | (ranks >= self.known), self.known, ranks)


def id_kind(model_words: int) -> str:
    return "<u2" if model_words <= 1 << 16 else "<u4"


def _ids(batch: pa.RecordBatch, column: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens, and where each document begins and its length."""
    ids = [np.frombuffer(x, kind) for x in batch.column(column).to_pylist()]
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    return np.concatenate(ids).astype(np.int32), np.cumsum(lengths) - lengths, lengths


def _documents(words: Words, texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """The words that aren't hot of each text, ranks of all tokens, and where each text begins and its length; one text's tokens are held at a time."""
    rare, ranks = [], []
    for text in texts:
        tokens = tokens_of(text)
        own = words.ranks(tokens)
        rare.append([tokens[i] for i in np.flatnonzero(own < 0).tolist()])
        ranks.append(own)
    lengths = np.array([len(x) for x in ranks], dtype=np.int64)
    return rare, np.concatenate(ranks), np.cumsum(lengths) - lengths, lengths


def hot_of(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The most frequent words(word, n), most at most, by n and word: all above a frequency that comes from a histogram with FINE steps for a factor of two.

    Words of one step are all in or all out; of a first step that alone has more than most, the first by n and word are in.
    """
    step = F.floor(F.log2("n") * FINE)
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        total += n
        if total > most:
            break
        least = at
    if least is None:
        return [(r["word"], r["n"]) for r in counts.where(step >= sizes[0][0]).orderBy(F.desc("n"), "word").limit(most).collect()] if sizes else []
    return sorted(((r["word"], r["n"]) for r in counts.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))


def averaged(copies: DataFrame, slots: int = 1, kind: str = "<f8") -> np.ndarray | None:
    """The mean of copies(piece, slot, seen, x) by tokens seen, one parameter after the other; within slots first, if there are several. kind: of the parameters in x."""

    def adding(kind: str):
        return lambda batches: add(batches, kind)

    def add(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
        own, seen, total = None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int32()), pa.array([seen], pa.int64()), pa.array([(total / seen).astype("<f8").tobytes()], pa.binary())], ["piece", "slot", "seen", "x"])

        for batch in batches:
            for piece, slot, n, x in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if (piece, slot) != own:
                    if own is not None:
                        yield out()
                    own, seen, total = (piece, slot), 0, 0.0
                seen, total = seen + n, total + n * np.frombuffer(x, kind).astype(np.float64)
        if own is not None:
            yield out()

    kinds = "piece int, slot int, seen long, x binary"
    if slots > 1:
        copies = copies.repartition("piece", "slot").sortWithinPartitions("piece", "slot", "seen").mapInArrow(adding(kind), kinds).withColumn("slot", F.lit(0))
    last = adding("<f8" if slots > 1 else kind)
    rows = copies.repartition("piece").sortWithinPartitions("piece", "slot", "seen").mapInArrow(last, kinds).collect()
    return np.concatenate([np.frombuffer(r["x"], "<f8") for r in sorted(rows, key=lambda r: r["piece"])]).astype("<f4") if rows else None


def trained(documents: DataFrame, tokens: int, words, model_words: int, counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Parameters after one round over documents(ids, deal) of about so many tokens: the average of copies by their tokens.

    There is a copy for each COPY_TOKENS, and documents are dealt to them by `deal`, so what a copy learns from doesn't depend on
    how the input is partitioned; the order in which it does may, and moves scores little.
    """
    start = documents.sparkSession.sparkContext.broadcast(flat)
    copies = max(1, -(-tokens // COPY_TOKENS))
    slots = -(-copies // SLOT_COPIES)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words.value
        model = Model(own.known + 1, own.first, flat=start.value)
        trainer, seen = Trainer(model), 0
        for batch in text_slices(batches, 0, HELD_IDS):
            ids, starts, lengths = _ids(batch, 0, id_kind(model_words))
            trainer.learn(ids, starts, lengths)
            seen += len(ids)
        if seen:
            pieces = [model.flat[at : at + PIECE].astype("<f4").tobytes() for at in range(0, len(model.flat), PIECE)]
            slot = TaskContext.get().partitionId() % slots
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([slot] * len(pieces), pa.int32()), pa.array([seen] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["piece", "slot", "seen", "x"])

    dealt = documents.select("ids", "deal").repartition(copies, "deal").select("ids")
    found = averaged(dealt.mapInArrow(learn, "piece int, slot int, seen long, x binary"), slots, "<f4")
    return flat if found is None else found


def score(docs: DataFrame, folds: int = 7, fold: int = 2, model_words: int = 1 << 14, hot_words: int = 1 << 17) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    text_id = F.col("doc_id").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(text_id) % folds == fold, F.lit(False)).alias("held_out"), (F.xxhash64(text_id) % 8 == 0).alias("early"), whole_text().alias("text")).withColumn("deal", F.xxhash64("doc_id", "text"))
    training = texts.where(~F.col("held_out"))
    with Scratch(spark) as s:
        counts = s.table(word_counts(training), "words")
        rows = _scored(s, texts, counts, model_words, hot_words)
        path = write_scratch(rows, "scores")
    return spark.read.schema(SCORES).parquet(path)


def _scored(s: Scratch, texts: DataFrame, counts: DataFrame, model_words: int, hot_words: int) -> DataFrame:
    spark = texts.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    hot = hot_of(counts, hot_words)
    words = spark.sparkContext.broadcast(Words(hot, model_words))
    known = words.value.known
    own = np.array([n for _, n in hot[:known]] + [total["n"] - sum(n for _, n in hot[:known])], dtype=np.float64)
    others = np.log10(own[-1] + total["v"] - known + 1)
    everything = np.log10(float(total["n"] + total["v"] + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words.value
        for batch in text_slices(batches, 5):
            rare, ranks, starts, lengths = _documents(w, batch.column(5).to_pylist())
            cuts = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(cuts), pa.array(list(chain.from_iterable(rare)), pa.binary()).cast(pa.string()))
            ids = w.ids(ranks)
            sums = lambda x: np.add.reduceat(x, starts)
            logs, outside = w.log[ranks], ids == w.known
            told = ids.astype(id_kind(model_words))
            bounds = pa.array(np.append(starts, len(told)) * told.itemsize, pa.int64())
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds.buffers()[1], pa.py_buffer(told)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(lengths), pa.array(sums((ranks >= 0).astype(np.int64))), pa.array(sums(logs)), pa.array(sums(np.where(outside, logs - others, 0.0))), held, rare],
                ["row", "doc_id", "held_out", "early", "deal", "n_tokens", "n_hot", "logs", "outside", "ids", "rare"],
            )

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "early", "deal", "text")
    encoded = s.table(numbered.mapInArrow(encode, "row long, doc_id long, held_out boolean, early boolean, deal long, n_tokens long, n_hot long, logs double, outside double, ids binary, rare array<string>"), "encoded")

    flat = Model(known + 1, words.value.first, counts=own).flat
    early = F.coalesce(F.col("early"), F.lit(False))
    for part, share in ((early, 1 / 8), (~early, 7 / 8)):
        flat = trained(encoded.where(~F.col("held_out") & part), int(total["n"] * share), words, model_words, own, flat)

    learnt = spark.sparkContext.broadcast(flat)
    columns = ["row", "doc_id", "held_out", "n_tokens", "n_hot", "logs"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words.value
        model = Model(w.known + 1, w.first, flat=learnt.value)
        for batch in text_slices(batches, 7, HELD_IDS):
            ids, starts, lengths = _ids(batch, 7, id_kind(model_words))
            scores = document_scores(model, ids, starts, lengths) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(scores + batch.column(6).to_numpy())], [*columns, "score"])

    rows = encoded.select(*columns, "outside", "ids").mapInArrow(measure, "row long, doc_id long, held_out boolean, n_tokens long, n_hot long, logs double, score double")
    rare = encoded.select("row", F.explode("rare").alias("word"))
    met = rare.join(counts, "word").groupBy("row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 1)).alias("logs_rare"))
    full = rows.join(met, "row", "left")
    logs = F.coalesce("logs_rare", F.lit(0.0))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(int(total["n"])).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * F.lit(float(everything))).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
