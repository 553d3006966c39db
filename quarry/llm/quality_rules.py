"""Quality rules: counts of words, symbols and repetition, and tokeniser fertility by language or script.

Fertility is measured with public vocabularies: characters of words per token (of a piece vocabulary with byte fallback
and of a byte-level BPE), the share of byte-fallback tokens, and the Shannon entropy of the document's token counts.
Bands of these are set for each language, else for the dominant script. Words are tokenised alone (marked as a word's
start), each distinct one once per worker.

Words are runs of characters other than ASCII white space. A null or empty text has no words and fails. Repeated rows
each give a row, null doc_ids and null languages stay null (the script's band holds), extra columns are ignored, an
empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import kept, slices, whole_text

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent

#: Rejection bands: least and most characters per piece token, most byte-fallback share, least entropy in bits, least characters per byte-level token.
Band = tuple[float, float, float, float, float]
BANDS: dict[str, Band] = {
    "en": (1.5, 8.0, 0.20, 4.5, 1.93),
    "de": (1.5, 8.0, 0.20, 4.5, 2.00),
    "fr": (1.4, 8.0, 0.20, 4.5, 1.82),
    "es": (1.4, 8.0, 0.20, 4.5, 1.83),
    "Latin": (1.1, 9.0, 0.30, 3.0, 0.8),
    "Cyrillic": (0.9, 9.0, 0.30, 3.0, 0.4),
    "Greek": (0.6, 9.0, 0.50, 3.0, 0.3),
    "CJK": (0.3, 4.0, 0.80, 3.0, 0.2),
    "other": (0.2, 20.0, 1.00, 2.0, 0.1),
}
#: Scripts by ranges of code points.
SCRIPTS = (("Latin", "A-Za-zÀ-ɏ"), ("Cyrillic", "Ѐ-ӿ"), ("Greek", "Ͱ-Ͽ"), ("CJK", "぀-ヿ一-鿿가-힣"))
SCRIPT_RUNS = [(name, re.compile(f"[{chars}]+")) for name, chars in SCRIPTS]

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FERTILITY = "chars_per_piece double, byte_share double, token_entropy double, chars_per_byte_token double"


class WordTable:
    """Tokens of distinct words: ids in the piece vocabulary, and the number of byte-level tokens."""

    KEEP = 500_000

    def __init__(self, pieces: str, byte_level: str, pattern: str):
        import base64

        import sentencepiece
        import tiktoken

        self.lib = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_level, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.lib.is_byte(i) for i in range(self.lib.get_piece_size())])
        self.ids: dict[bytes, bytes] = {}
        self.own: dict[bytes, int] = {}

    def tables(self, words: set[bytes]) -> tuple[dict[bytes, bytes], dict[bytes, int]]:
        """Piece ids as unsigned 16-bit integers, and the number of byte-level tokens, of each word."""
        missing = list(words.difference(self.ids))
        if not missing:
            return self.ids, self.own
        texts = [w.decode() for w in missing]
        ids = dict(zip(missing, [array("H", x).tobytes() for x in self.lib.encode(texts, num_threads=1)]))
        own = dict(zip(missing, [len(self.bpe.encode_ordinary(" " + t)) for t in texts]))
        if len(self.ids) < self.KEEP:
            self.ids |= ids
            self.own |= own
            return self.ids, self.own
        return tuple({w: new[w] if w in new else kept[w] for w in words} for new, kept in ((ids, self.ids), (own, self.own)))


def word_table(*files: str) -> WordTable:
    return kept((WordTable, *files), lambda: WordTable(*files))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=n)
    pair, size = ids[:-1] * len(numbers) + ids[1:], len(numbers) ** 2
    if size > (1 << 62) // len(numbers):
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * len(numbers) + ids[2:]
    order = np.argsort(triple)
    same = triple[order[1:]] == triple[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, dtype=bool)
    hit[order[1:]] = same
    hit[order[:-1]] |= same
    held = np.zeros(n, dtype=bool)
    for k in range(3):
        held[k : n - 2 + k] |= hit
    return int(held.sum())


def counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    lines, seen = 0, set()
    for line in raw.split(b"\n"):
        if line in seen:
            lines += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(b"".join(words).decode()), sum(map(raw.count, (c.encode() for c in SYMBOLS))), lines, repeated_words(words)


def script(text: str) -> str:
    """The script of most letters; other if there are none. Ties go to the first in SCRIPTS."""
    found = [(sum(map(len, run.findall(text))), -i, name) for i, (name, run) in enumerate(SCRIPT_RUNS)]
    n, _, name = max(found)
    return name if n else "other"


def in_band(lang: str | None, text: str, chars: float, share: float, entropy: float, own: float) -> bool:
    low, high, bytes_, bits, least = BANDS[lang] if lang in BANDS else BANDS[script(text)]
    return low <= chars <= high and share <= bytes_ and entropy >= bits and own >= least


def judge(docs: DataFrame, pieces: str, byte_level: str, pattern: str) -> DataFrame:
    """doc_id, the counts, the fertility measures, base_failed, kept."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(_judged(batch.column(1).to_pylist(), batch.column(2).to_pylist(), pieces, byte_level, pattern))
            cols = list(zip(*rows)) if rows else [[]] * 11
            types = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *(x.split()[0] for x in f"{COUNTS}, {FERTILITY}".split(", ")), "base_failed", "kept"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), lang).mapInArrow(measure, f"doc_id long, {COUNTS}, {FERTILITY}, base_failed boolean, kept boolean")


def keep(docs: DataFrame, pieces: str, byte_level: str, pattern: str) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = {n: batch.schema.get_field_index(n) for n in ("text", "lang")}
            texts = [t or "" for t in batch.column(at["text"]).to_pylist()]
            langs = batch.column(at["lang"]).to_pylist() if at["lang"] >= 0 else [None] * len(texts)
            yield batch.filter(pa.array([r[-1] for r in _judged(texts, langs, pieces, byte_level, pattern)], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def _judged(texts: list[str], langs: list[str | None], pieces: str, byte_level: str, pattern: str):
    table = word_table(pieces, byte_level, pattern)
    raws = [t.encode() for t in texts]
    words = [r.split() for r in raws]
    piece_ids, own_counts = table.tables(set(chain.from_iterable(words)))
    for text, lang, raw, own in zip(texts, langs, raws, words):
        base = counts(raw, own)
        ids = np.frombuffer(b"".join(map(piece_ids.__getitem__, own)), dtype="<u2")
        if len(ids):
            share = np.bincount(ids)
            share = share[share > 0] / len(ids)
            measured = (base[1] / len(ids), float(table.is_byte[ids].mean()), float(-(share * np.log2(share)).sum()), base[1] / sum(map(own_counts.__getitem__, own)))
        else:
            measured = (0.0, 0.0, 0.0, 0.0)
        failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED * base[0]
        yield *base, *measured, failed, not failed and in_band(lang, text, *measured)
