"""SentencePiece encoding and decoding over a table of distinct chunks.

In a vocabulary without pieces that go from a character to a white-space marker, no merge crosses the start of a marked
word. So each distinct marked word (its spaces, then its characters) is segmented once per worker, and a text's ids are
its words' ids joined by position. Texts that hold the marker itself are given whole to the library.

Null text counts as empty; an empty text has the begin and end ids alone. Repeated rows each give a row, null doc_ids
stay null, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, whole_text

MARK = "▁"


class ChunkTable:
    """Ids of distinct marked words. KEEP bounds its memory; further words are segmented without being kept."""

    KEEP = 600_000
    WORD = re.compile(r" +[^ ]*")

    def __init__(self, model: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.kept: dict[str, bytes] = {" ": array("I", [self.lib.piece_to_id(MARK)]).tobytes()}

    def words(self, texts: list[str]) -> list[list[str] | None]:
        """The marked words of each text; None: not to be split."""
        return [self.WORD.findall(" " + t) if t and self.splits and MARK not in t and "\0" not in t else None for t in texts]

    def table(self, words: list[list[str] | None]) -> dict[str, bytes]:
        missing = list(set(chain.from_iterable(w for w in words if w)).difference(self.kept))
        # the library marks a text's start itself, so the first space is left to it
        found = {c: array("I", ids).tobytes() for c, ids in zip(missing, self.lib.encode([c[1:] for c in missing], num_threads=1))} if missing else {}
        if len(self.kept) < self.KEEP:
            self.kept |= found
            return self.kept
        return {c: found[c] if c in found else self.kept[c] for c in set(chain.from_iterable(w for w in words if w))}

    def encode(self, texts: list[str]) -> list[bytes]:
        words = self.words(texts)
        get = self.table(words).__getitem__
        return [array("I", self.lib.encode(t)).tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, words)]


_tables: dict[str, ChunkTable] = {}


def chunk_table(model: str) -> ChunkTable:
    if model not in _tables:
        _tables[model] = ChunkTable(model)
    return _tables[model]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with begin and end), decoded: the whole outputs."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, decoded, doc in _coded(batches, model):
            yield pa.RecordBatch.from_arrays([doc, pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return _keyed(docs).mapInArrow(code, "doc_id long, ids array<int>, decoded string")


def codec_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, decoded, doc in _coded(batches, model):
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _keyed(docs).mapInArrow(code, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def _coded(batches: Iterator[pa.RecordBatch], model: str):
    table = chunk_table(model)
    first, last = (int(x).to_bytes(4, "little") for x in (table.lib.bos_id(), table.lib.eos_id()))
    for batch in slices(batches):
        raw = [first + x + last for x in table.encode(batch.column(1).to_pylist())]
        ids = [np.frombuffer(x, dtype="<u4") for x in raw]
        yield ids, raw, table.lib.decode([x.tolist() for x in ids], num_threads=1), batch.column(0)
