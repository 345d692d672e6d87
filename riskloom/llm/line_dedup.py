"""Line dedup: two Bloom filters find suspected repeats, only those shuffle for exact confirmation.

1. Every task sets the bits of its line keys in a once-seen filter, and in a twice-seen filter when the
   once-seen one already had them. The filters leave the task as compressed blocks; blocks of the same
   position are merged (bits that two tasks both saw once count as seen twice).
2. The merged twice-seen filter, whose size is a fixed parameter, goes to all tasks. Lines that it knows
   are suspects: one narrow row (128-bit key hash, doc_id) per document and key. Counting distinct
   documents confirms them; the largest doc_id of a confirmed key keeps its lines.
3. Documents are read again and rewritten. Confirmed keys go to all tasks while they fit a stated bound;
   beyond it the drop list of each document is joined to it by doc_id.

A filter that is too small only lets more suspects through; the result is exact at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import SPACE_BYTES, code_points, lean, materialize, portions

MIN_CHARS = 40
MIN_DOCS = 5
#: log2 of the bits of each filter: 2**27 bits are 16 MB in each task and on the driver.
FILTER_LOG2 = 27
#: Confirmed keys are sent to all tasks while they take at most this much (24 bytes each).
BROADCAST_BYTES = 48 * 2**20
_BLOCK_BYTES = 8192
_ADDED = ("n_lines", "n_dropped", "kept_sha256")


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, None for lines too short to count."""
    keys: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE_BYTES).lower() if len(line) >= min_chars else b""  # bytes lower A-Z only
        keys.append(key if len(key) >= min_chars and code_points(key) >= min_chars else None)
    return keys


def _hashes(keys: list[bytes]) -> np.ndarray:
    """128 bits of each key as two columns."""
    joined = b"".join(map(xxhash.xxh3_128_digest, keys))
    return np.frombuffer(joined, dtype=np.uint64).reshape(-1, 2)


def _positions(hashes: np.ndarray, log2: int) -> np.ndarray:
    return (hashes & np.uint64(2**log2 - 1)).astype(np.int64)


def _bits_set(filter_bytes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether both bits of each row are set."""
    found = filter_bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1
    return found.all(axis=1)


def _set_bits(filter_bytes: np.ndarray, at: np.ndarray) -> None:
    flat = at.ravel()
    np.bitwise_or.at(filter_bytes, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))


def _distinct_hashes(text: bytes, min_chars: int) -> np.ndarray:
    keys = {k for k in line_keys(text, min_chars) if k is not None}
    return _hashes(sorted(keys))


def _build_filters(log2: int, min_chars: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(2 ** (log2 - 3), dtype=np.uint8)
        twice = np.zeros_like(once)
        for batch in portions(batches, "text"):
            found = [_distinct_hashes(v.as_py(), min_chars) for v in batch.column(0) if v.is_valid]
            hashes = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.uint64)
            _, first, counts = np.unique(hashes[:, 0], return_index=True, return_counts=True)
            at = _positions(hashes[first], log2)
            again = (counts > 1) | _bits_set(once, at)
            _set_bits(twice, at[again])
            _set_bits(once, at)
        pack = zstandard.ZstdCompressor(level=1)
        blocks = once.reshape(-1, min(_BLOCK_BYTES, len(once)))
        for chunk in np.array_split(np.flatnonzero(blocks.any(axis=1)), 16):
            rows = [(int(b), pack.compress(blocks[b]), pack.compress(twice.reshape(blocks.shape)[b])) for b in chunk]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.binary()),
                ],
                names=["block", "once", "twice"],
            )

    return build


def _merge_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the blocks of one partition, in any order; memory is two blocks per position it holds."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            once = np.frombuffer(unpack.decompress(a.as_py()), dtype=np.uint8)
            twice = np.frombuffer(unpack.decompress(b.as_py()), dtype=np.uint8)
            if block in merged:
                held_once, held_twice = merged[block]
                twice = held_twice | twice | (held_once & once)
                once = held_once | once
            merged[block] = (once, twice)
    kept = [(k, pack.compress(t)) for k, (_, t) in merged.items() if t.any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in kept], pa.int32()), pa.array([t for _, t in kept], pa.binary())],
        names=["block", "twice"],
    )


def twice_seen_filter(texts: DataFrame, log2: int, min_chars: int) -> np.ndarray:
    """The merged filter of line keys seen in two documents or more (and some others)."""
    spark = texts.sparkSession
    blocks = texts.mapInArrow(lean(_build_filters(log2, min_chars)), "block int, once binary, twice binary")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = blocks.repartition(width, "block").mapInArrow(lean(_merge_filters), "block int, twice binary")
    out = np.zeros(2 ** (log2 - 3), dtype=np.uint8)
    unpack = zstandard.ZstdDecompressor()
    size = min(_BLOCK_BYTES, len(out))
    for row in merged.toLocalIterator():  # at most the filter's own size, a stated parameter
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(unpack.decompress(bytes(row.twice)), dtype=np.uint8)
    return out


def _suspects(shared, log2: int, min_chars: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value), dtype=np.uint8)
        for batch in portions(batches, "text"):
            ids, hashes = [], []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if value.is_valid:
                    own = _distinct_hashes(value.as_py(), min_chars)
                    own = own[_bits_set(twice, _positions(own, log2))]
                    ids += [doc_id] * len(own)
                    hashes.append(own)
            flat = np.concatenate(hashes) if hashes else np.zeros((0, 2), dtype=np.uint64)
            signed = flat.astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy()), pa.array(ids, pa.int64())],
                names=["k1", "k2", "doc_id"],
            )

    return find


def repeated_keys(docs: DataFrame, min_chars: int, min_docs: int, log2: int) -> tuple[DataFrame, DataFrame]:
    """Suspects (k1, k2, doc_id) and the confirmed keys (k1, k2, keeper), both exact for what follows."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    twice = twice_seen_filter(narrow.select("text"), log2, min_chars)
    shared = spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(twice))
    suspects = materialize(narrow.mapInArrow(lean(_suspects(shared, log2, min_chars)), "k1 long, k2 long, doc_id long"))
    confirmed = materialize(
        suspects.groupBy("k1", "k2")
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("k1", "k2", "keeper")
    )
    return suspects, confirmed


def _rewrite(columns: list[str], with_text: bool, min_chars: int, shared):
    """Drops the lines of confirmed keys. Keys come from ``shared`` or from a column ``_drops``."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is not None:
            k1, k2, keeper = shared.value
        for batch in portions(batches, "_text"):
            held = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = [v.as_py() or b"" for v in held["_text"]]
            doc_ids = held["_id"].to_pylist()
            lines_of = [t.split(b"\n") for t in texts]
            keys_of = [line_keys(t, min_chars) for t in texts]
            if shared is not None:
                bad = _known(keys_of, doc_ids, k1, k2, keeper)
            else:
                bad = _listed(keys_of, held["_drops"].to_pylist())
            kept = [
                b"\n".join(line for i, line in enumerate(lines) if i not in out) if out else text
                for text, lines, out in zip(texts, lines_of, bad, strict=True)
            ]
            arrays = [held[c] for c in columns]
            if with_text:
                arrays.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
            arrays += [
                pa.array([len(lines) for lines in lines_of], pa.int64()),
                pa.array([len(out) for out in bad], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *["text"] * with_text, *_ADDED])

    return drop


def _known(keys_of, doc_ids, k1, k2, keeper) -> list[set[int]]:
    """Line numbers to drop per document, by the sorted table of confirmed keys."""
    bad: list[set[int]] = [set() for _ in keys_of]
    where = [(d, i) for d, keys in enumerate(keys_of) for i, key in enumerate(keys) if key is not None]
    if not where or not len(k1):
        return bad
    hashes = _hashes([keys_of[d][i] for d, i in where]).view(np.int64)
    at = np.searchsorted(k1, hashes[:, 0])
    for n in np.flatnonzero(k1[np.minimum(at, len(k1) - 1)] == hashes[:, 0]):
        d, i = where[n]
        j = at[n]
        while j < len(k1) and k1[j] == hashes[n, 0]:
            if k2[j] == hashes[n, 1] and (doc_ids[d] is None or doc_ids[d] != keeper[j]):
                bad[d].add(i)
            j += 1
    return bad


def _listed(keys_of, drops) -> list[set[int]]:
    bad: list[set[int]] = []
    for keys, listed in zip(keys_of, drops, strict=True):
        out: set[int] = set()
        if listed:
            wanted = {(x["k1"], x["k2"]) for x in listed}
            own = [i for i, key in enumerate(keys) if key is not None]
            pairs = _hashes([keys[i] for i in own]).view(np.int64).tolist()
            out = {i for i, pair in zip(own, pairs, strict=True) if tuple(pair) in wanted}
        bad.append(out)
    return bad


def dedup_lines(
    docs: DataFrame,
    *,
    with_text: bool = True,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    filter_log2: int = FILTER_LOG2,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All columns of ``docs`` with the kept lines as text, and n_lines, n_dropped, kept_sha256.

    Without ``with_text``: doc_id and the three added columns. Input columns named like the added ones are
    replaced. A null or empty text is one empty line and stays. Rows that repeat a doc_id count as one
    document and are treated alike. A row with a null doc_id counts for no key and never is the keeper.
    An empty table gives an empty result. Keys are compared by 128-bit hashes.
    """
    spark = docs.sparkSession
    suspects, confirmed = repeated_keys(docs, min_chars, min_docs, filter_log2)
    columns = [c for c in docs.columns if c != "text" and c not in _ADDED] if with_text else ["doc_id"]
    frame = docs.select(*columns, F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"))
    fields = [docs.schema[c] for c in columns]
    if with_text:
        fields.append(T.StructField("text", T.StringType()))
    fields += [T.StructField(_ADDED[0], T.LongType()), T.StructField(_ADDED[1], T.LongType()), T.StructField(_ADDED[2], T.StringType())]
    shared = None
    if 24 * confirmed.count() <= broadcast_bytes:
        keys = confirmed.orderBy("k1").toArrow()
        shared = spark.sparkContext.broadcast(tuple(keys.column(i).to_numpy() for i in range(3)))
    else:
        drops = suspects.join(confirmed, ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        drops = drops.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("_drops"))
        drops = drops.withColumnRenamed("doc_id", "_drop_id")
        frame = frame.join(drops, F.col("_id").eqNullSafe(F.col("_drop_id")), "left").drop("_drop_id")
    out = frame.mapInArrow(lean(_rewrite(columns, with_text, min_chars, shared)), T.StructType(fields))
    order = [c for c in docs.columns if c not in _ADDED] if with_text else ["doc_id"]
    return out.select(*order, *_ADDED)


LINE_DEDUP_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.*, hot.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
