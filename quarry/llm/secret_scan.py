"""Secret scans: patterns, and windows of high Shannon entropy over candidate strings.

A candidate is a run of ALPHABET characters of at least WINDOW. In it each character class (hex, letters and digits of one
case, base64) has its own runs, and a threshold of bits per character of its own; so hex digits behind "key=" are judged
as hex digits. A window of WINDOW characters slides over a run; the sum of n * log2(n) of its character counts is updated
for the character that enters and the one that leaves, so a run costs a step for each character. Windows over the
threshold are joined to spans; a span inside one of a narrower class is left out.
The allow-list holds identifiers with the form of a UUID, where a candidate is cut, runs of letters or of digits alone,
and words that say that they are examples (the short ones only if no letter touches them): windows that lie within
WINDOW characters of such a word, and with it between the same two of / = _ -, are passed over, the rest of the candidate
is not. Base patterns are not subject to it.

Spans are kind:start:end in code points, end exclusive, and may overlap between kinds. Null and empty texts have none.
Repeated rows each give a row, null doc_ids stay null, extra columns are kept out, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, whole_text

WINDOW = 20
#: The base patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
ASSIGN_LEAST = 6

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Character classes, narrowest first: name, runs, bits per character over a window of 20 (whose most is log2(20) = 4.32).
CLASSES = tuple(
    (name, [re.compile("[%s]{%d,}" % (chars, WINDOW)) for chars in alphabets], threshold)
    for name, alphabets, threshold in (("hex", ("0-9a-f", "0-9A-F"), 3.0), ("code", ("0-9a-z", "0-9A-Z"), 3.6), ("base64", ("A-Za-z0-9+/_=-",), 3.8))
)
UUID = re.compile("(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")
WORD = re.compile("(?i)example|sample|placeholder|changeme|(?<![a-z])(?:test|fake|dummy|x{4,})(?![a-z])")
PART = re.compile("[^/=_-]+")
PLAIN = re.compile("[A-Za-z_/=+-]+|[0-9_/=+-]+")
N_LOG_N = [0.0] + [n * log2(n) for n in range(1, WINDOW + 2)]


def windows(text: str, threshold: float, size: int = WINDOW, allowed: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Spans of text that are covered by windows with more than threshold bits per character, without the windows inside one of allowed."""
    count: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(text):
        n = count.get(c, 0)
        total += N_LOG_N[n + 1] - N_LOG_N[n]
        count[c] = n + 1
        if i >= size:
            gone = text[i - size]
            n = count[gone]
            total += N_LOG_N[n - 1] - N_LOG_N[n]
            count[gone] = n - 1
        if i >= size - 1 and log2(size) - total / size > threshold:
            start = i - size + 1
            if any(a <= start and i < b for a, b in allowed):
                continue
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def near_words(run: str) -> list[tuple[int, int]]:
    """Where windows are passed over, because of a word of the same part."""
    if not WORD.search(run):
        return []
    return [(max(p.start(), m.start() - WINDOW), min(p.end(), m.end() + WINDOW)) for p in PART.finditer(run) for m in WORD.finditer(run, *p.span())]


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for run in UUID.split(m.group()):
            if len(run) >= WINDOW and not PLAIN.fullmatch(run):
                own: list[tuple[str, int, int]] = []
                allowed = near_words(run)
                for kind, patterns, threshold in CLASSES:
                    new = []
                    for part in (p for pattern in patterns for p in pattern.finditer(run) if not PLAIN.fullmatch(p.group())):
                        low = part.start()
                        new += [(f"entropy_{kind}", low + a, low + b) for a, b in windows(part.group(), threshold, allowed=[(a - low, b - low) for a, b in allowed])]
                    own += [s for s in new if not any(a <= s[1] and s[2] <= b for _, a, b in own)]
                found += [(kind, at + a, at + b) for kind, a, b in own]
            at += len(run) + 36  # the length of a UUID
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST] if any(w in low for w in ASSIGN_WORDS) else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


ORDER = {"assign": 0, "access": 1, "hex": 2}


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], ORDER.get(s[0], 3), s[0], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, stop, base>> of each row."""
    kind = "array<struct<kind:string,start:int,stop:int,base:boolean>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                out.append([{"kind": k, "start": a, "stop": b, "base": k in ORDER} for k, a, b in ordered(base + entropy_spans(text))])
            t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, t)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(find, f"doc_id long, spans {kind}")


def scan_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s.base)
    return scan(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mark and n_chars counted anew; all other columns and all rows stay."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                parts, low = [], 0
                for _, a, b in ordered(base_spans(text) + entropy_spans(text)) if text else []:
                    if a >= low:
                        parts += [text[low:a], mark]
                    low = max(low, b)
                out.append("".join([*parts, text[low:]]) if parts else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    cleaned = docs.mapInArrow(clean, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else cleaned
