"""Quality rules: zstandard compression bands over whole documents and fixed chunks.

Repetitive text compresses far below what prose of its length does, noise (encoded blobs, random
characters) far above. How far prose compresses depends on its length, so each length band has limits
of its own, for the whole document and for its worst and best fixed chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import CONTINUATION, SPACE_BYTES

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CHUNK_BYTES = 4096
LEVEL = 3


@dataclass(frozen=True)
class Band:
    """Limits for documents of up to ``max_bytes``: the ratio is compressed size over size."""

    max_bytes: int
    lowest: float
    highest: float


#: Whole documents. Prose of any of the languages lies well inside; see tests for the margins.
DOCUMENT_BANDS = (
    Band(256, 0.40, 1.30),
    Band(512, 0.36, 0.95),
    Band(1024, 0.34, 0.82),
    Band(4096, 0.30, 0.72),
    Band(16384, 0.25, 0.68),
    Band(2**62, 0.15, 0.66),
)
#: Chunks of ``CHUNK_BYTES`` (the last one may be shorter and is then left to the document's band).
CHUNK_LOWEST, CHUNK_HIGHEST = 0.25, 0.72
#: A document fails by its chunks when more than this share of them lies outside the chunk limits.
CHUNK_SHARE = 0.5

_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, n_low_chunks long, "
    "n_high_chunks long, verdict string"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    base = len(ids)
    if base == n:
        return 0
    if base < 2_000_000:
        windows = (seq[:-2] * base + seq[1:-1]) * base + seq[2:]
    else:
        pairs = np.unique(seq[:-2] * base + seq[1:-1], return_inverse=True)[1]
        windows = pairs.astype(np.int64) * base + seq[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(SPACE_BYTES)]
    return len(lines) - len(set(lines))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # bytes split at exactly the six ASCII white-space characters
    word_chars = len(text.translate(None, SPACE_BYTES + CONTINUATION))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), word_chars, n_symbols, duplicate_lines(text), repeated_words(words)


def compression(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, int]:
    """Ratio of the whole text, number of full chunks, and how many lie below and above the chunk limits."""
    ratio = len(compressor.compress(text)) / len(text) if text else 1.0
    chunks = low = high = 0
    for start in range(0, len(text) - CHUNK_BYTES + 1, CHUNK_BYTES):
        part = len(compressor.compress(text[start : start + CHUNK_BYTES])) / CHUNK_BYTES
        chunks += 1
        low += part < CHUNK_LOWEST
        high += part > CHUNK_HIGHEST
    return ratio, chunks, low, high


def band_verdict(n_bytes: int, ratio: float, chunks: int, low: int, high: int) -> str:
    band = next(b for b in DOCUMENT_BANDS if n_bytes <= b.max_bytes)
    if ratio < band.lowest:
        return "repetitive"
    if ratio > band.highest:
        return "incompressible"
    if low > CHUNK_SHARE * chunks:
        return "repetitive chunks"
    if high > CHUNK_SHARE * chunks:
        return "incompressible chunks"
    return "kept"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        rows = []
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = value.as_py() or b""
            counts = base_counts(text)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
            ratio, chunks, low, high = compression(text, compressor)
            verdict = "base" if failed else band_verdict(len(text), ratio, chunks, low, high)
            rows.append((doc_id, *counts, failed, verdict == "kept", len(text), ratio, chunks, low, high, verdict))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]
_TYPES = [
    {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[part.split()[1]]
    for part in _SCHEMA.split(", ")
]


def compression_bands(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored). Row-local, no shuffle.

    A null or empty text has no words, fails the base rules and is not kept; repeated rows each get a
    row; a null doc_id stays null; an empty table gives an empty result. Whole texts are read.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_judge, _SCHEMA)
