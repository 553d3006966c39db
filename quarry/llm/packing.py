"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs linear * n + quadratic * n * n, as attention within it does. Documents longer than a sequence
give full sequences first. Of the remaining pieces, in descending order, each goes to the sequence of lowest cost that
has room for it; one that fits nowhere is cut over the sequences with most room. What is left of a group, less than a
sequence, becomes sequences of power-of-two lengths, so that nothing is padded.

Pieces are dealt at random into groups of about group_chars characters; a group is packed by itself, so its memory is
bounded and groups are as many as the input asks for.

Null text counts as empty (its end id is still packed). Repeated rows are packed each. Null doc_ids stay null. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, whole_text
from quarry.llm.token_output import encoder

PIECES = "grp long, doc_id long, doc_tokens long, start long, length long, crc long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, length, sequence, offset) of pieces shorter than capacity."""
    cost = lambda n: linear * n + quadratic * n * n
    total = int(lengths.sum())
    bins = total // capacity
    used, load, out, left = np.zeros(bins, dtype=np.int64), np.zeros(bins), [], []

    def put(piece: int, at: int, n: int, to: int) -> None:
        out.append((piece, at, n, to, int(used[to])))
        used[to] += n
        load[to] += cost(n)

    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = used <= capacity - n
        if bins and room.any():
            put(i, 0, n, int(np.where(room, load, np.inf).argmin()))
        else:
            left.append((i, 0, n))
    rest = []
    for i, at, n in left:
        while n and bins and (room := int(capacity - used.min())):
            to = int(np.where(used == capacity - room, load, np.inf).argmin())
            some = min(n, room)
            put(i, at, some, to)
            at, n = at + some, n - some
        if n:
            rest.append((i, at, n))
    to, size, fill = bins, 0, 0  # what is left, cut to the powers of two in its length
    sizes = [1 << b for b in range(capacity.bit_length(), -1, -1) if (total % capacity) >> b & 1] if capacity else []
    k = 0
    for i, at, n in rest:
        while n:
            size = sizes[k]
            some = min(n, size - fill)
            out.append((i, at, some, to, fill))
            at, n, fill = at + some, n - some, fill + some
            if fill == size:
                k, to, fill = k + 1, to + 1, 0
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 4096, group_chars: int = 4_000_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tail = int(end_id).to_bytes(4, "little")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-chars // group_chars))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, deal = encoder(tokenizer), np.random.default_rng(TaskContext.get().partitionId())
        for batch in slices(batches):
            rows: list[list] = [[] for _ in range(6)]
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                raw += tail
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    ids = raw[4 * start : 4 * (start + capacity)]
                    full = len(ids) == 4 * capacity
                    for col, x in zip(rows, (doc, n, start, len(ids) // 4, zlib.crc32(ids) if full else None, None if full else ids)):
                        col.append(x)
            cols = [pa.array(c, t) for c, t in zip(rows, [pa.int64()] * 5 + [pa.binary()])]
            yield pa.RecordBatch.from_arrays([pa.array(deal.integers(0, groups, len(rows[0]))), *cols], ["grp", "doc_id", "doc_tokens", "start", "length", "crc", "ids"])

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        table = table.combine_chunks()
        doc, n_doc, start, length, crc, ids = (table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "length", "crc", "ids"))
        order = sorted(range(len(doc)), key=lambda i: (doc[i] is None, doc[i] or 0, start[i], ids[i] or b""))
        out, at = [], 0
        for i in order:
            if ids[i] is None:
                out.append((doc[i], start[i], length[i], crc[i], n_doc[i], (grp << 32) + at, 0))
                at += 1
        some = [i for i in order if ids[i] is not None]
        for k, low, n, to, offset in assign(np.array([length[i] for i in some], dtype=np.int64), capacity, linear, quadratic):
            i = some[k]
            out.append((doc[i], start[i] + low, n, zlib.crc32(ids[i][4 * low : 4 * (low + n)]), n_doc[i], (grp << 32) + at + to, offset))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=names)

    return texts.mapInArrow(pieces, PIECES).groupBy("grp").applyInArrow(packed, PACKED)
