"""Token-id output: documents are encoded once and written as Parquet list columns.

Files are in ascending doc_id order. Ids are dictionary-encoded (a row group rarely holds the whole vocabulary), the
long columns delta-encoded. Row groups and pages are small and carry page indexes, so a reader of some columns or of a
range of doc_id reads only their pages.

Null text counts as empty; a document with null doc_id comes first. Rows with equal doc_id all stay, ordered by text.
An empty table gives an empty set of files with the same schema. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import kept, slices, whole_text, write_scratch

#: Parquet settings of the token files.
FILE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


class ChunkEncoder:
    """Encodes with a byte-level BPE file of the tokenizers library, each distinct chunk once per worker.

    A chunk is a space and a word of Latin letters, or the full stop or comma after it, or else white space and the
    characters up to the next white space. The vocabulary's splitting pattern joins neither a character with white space
    after it nor letters with such a mark, and looks ahead no further than one character, so chunks encode alike alone
    and in their text. Where that isn't sure (added tokens in the text, characters that only some libraries call white
    space), the whole text goes to the library.
    """

    #: Chunks kept; the first ones are the frequent ones, so later ones are encoded without being kept.
    KEEP = 600_000
    CHUNK = re.compile(r" [A-Za-zÀ-ÖØ-öø-ɏ]+(?=[ \n.,])|[.,](?=\s)|\s*\S+|\s+")
    UNSURE = re.compile("[\x1c-\x1f\x85᠎​﻿]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """Encodes chunks that start with white space in one call: in a byte-level vocabulary a token has one character a byte."""
        found = {}
        for at in range(0, len(missing), 2000):
            some = missing[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.cumsum([len(c.encode()) for c in some])
            cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            raw, low = ids.astype("<u4").tobytes(), 0
            for c, high in zip(some, cuts.tolist()):
                found[c] = raw[4 * low : 4 * high]
                low = high
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plain = [not (self.UNSURE.search(t) or any(a in t for a in self.added)) for t in texts]
        chunks = [self.CHUNK.findall(t) if ok else [] for t, ok in zip(texts, plain)]
        ids = [list(map(self.kept.get, c)) for c in chunks]
        holes = [_holes(x) for x in ids]
        missing = {c[i] for c, at in zip(chunks, holes) for i in at}
        found = {c: self.whole(c) for c in missing if not (c[0].isspace() and not c[-1].isspace())}
        found |= self.learn([c for c in missing if c not in found])
        for x, c, at in zip(ids, chunks, holes):
            for i in at:
                x[i] = found[c[i]]
        if len(self.kept) < self.KEEP:
            self.kept |= found
        return [b"".join(x) if ok else self.whole(t) for t, x, ok in zip(texts, ids, plain)]


def _holes(x: list) -> list[int]:
    at, out = -1, []
    for _ in range(x.count(None)):
        at = x.index(None, at + 1)
        out.append(at)
    return out


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker; workers serve many tasks."""
    return kept((ChunkEncoder, path), lambda: ChunkEncoder(path))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> str:
    """Writes the token files of docs(doc_id, text) into the shared folder and returns their path.

    Text is dealt out by ranges of doc_id before it is encoded: finding the ranges reads doc_ids, not tokens.
    """
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            raw = [x + tail for x in enc.encode(batch.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in raw], dtype=np.int64)
            ends = np.cumsum(n)
            flat = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            parts = pa.array(np.full(len(raw), part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), parts, pa.array(ends - n + start), pa.array(n), ids], ["doc_id", "part", "part_start", "n_tokens", "ids"])
            start += int(ends[-1]) if len(ends) else 0

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return write_scratch(ordered.mapInArrow(encode, SCHEMA), "tokens", **FILE_OPTIONS)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files with each document's start among all ids. The sums by file are as many rows as there are files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of tokens(doc_id, start, n_tokens, ids)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            cuts = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encodes docs, writes the files, reads them back and digests them."""
    return token_digest(read_token_files(docs.sparkSession, write_token_files(docs, tokenizer, end_id)))
