"""Phrase collocations of two to four words by counting quotient filters.

1. Texts are cut into slices of some megabytes. A slice becomes a list of its own words with counts and the
   stream of their places in that list; a break stands between pieces.
2. Counts of all slices added up give the words that are frequent enough to be in a phrase; these get dense
   ids. Slices get the ids of their own words by a join, so no task holds the whole vocabulary.
3. For two, three and four words in turn: each slice packs its n-grams' ids, permutes them and builds one
   counting quotient filter per shard of the permuted range (see ``quotient_filter``). Filters of a shard are
   merged; what is frequent comes back with ids and count. Each slice gets one bit per entry of its filters,
   frequent or not, and looks for longer n-grams only where both shorter ones are frequent; the rest of the
   stream is dropped.
4. Scores, the rule about longer phrases and ranks are joins and windows over the frequent n-grams.

Everything is exact. What tasks hold is set by ``slice_bytes`` and ``shard_entries``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import lean, long_lists, materialize, portions, small_batches
from riskloom.llm.numbering import number_rows, place
from riskloom.llm.quotient_filter import entries, from_bytes, half_bits, merge, pack, permute, restore, to_bytes, unpack

_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_BREAK = -1
#: Longest phrases that packed ids of 31 bits leave room for.
MOST_WORDS = 4


@dataclass(frozen=True)
class Settings:
    min_count: int = 30
    max_words: int = 4
    top: int = 2000
    #: A phrase goes if a longer one with so many percent of its count holds it.
    inside_percent: int = 80
    score_scale: int = 2_000_000
    #: Text a slice is made of; a piece is never cut.
    slice_bytes: int = 8 * 2**20
    #: Entries of one shard before equal ones of several slices are merged.
    shard_entries: int = 2**20
    #: Rows ranked at a time before the last ranking.
    ranked_rows: int = 100_000

    def __post_init__(self) -> None:
        if not 2 <= self.max_words <= MOST_WORDS:
            raise ValueError(f"phrases have 2 to {MOST_WORDS} words")


# Slices ---------------------------------------------------------------------------------------------------


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text, A-Z lower-cased, and for each whether it is the first of a piece."""
    chars = np.frombuffer(data.lower(), dtype=np.uint8)
    kinds = _KIND[chars]
    inside = kinds == 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    offsets = np.zeros(len(first) + 1, dtype=np.int32)
    np.cumsum(np.flatnonzero(ends) - first + 1, out=offsets[1:])
    new = np.diff(np.searchsorted(np.flatnonzero(kinds == 2), first), prepend=-1) != 0
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(chars[inside])]
    return pa.Array.from_buffers(pa.string(), len(first), buffers), new


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that end where a piece does."""
    start = 0
    while len(text) - start > most:
        end = _PIECE_END.search(text, start + most)
        if end is None:
            break
        yield text[start : end.end()]
        start = end.end()
    yield text[start:]


_SLICED = "kind int, slice long, local int, lang string, word string, count long, stream binary"


def _sliced(s: Settings):
    """Rows of kind 0: a slice's word and its count there. Rows of kind 1: a slice's stream of word numbers."""
    names = [c.split()[0] for c in _SLICED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made, size = 0, 0
        texts: dict[str, list[bytes]] = {}

        def finish() -> Iterator[pa.RecordBatch]:
            streams, base, name = [], 0, task << 32 | made
            for lang, parts in texts.items():
                words, new = words_of(b"\n".join(parts))
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                local = coded.indices.to_numpy()
                n = len(coded.dictionary)
                counts = np.bincount(local, minlength=n)
                for start in range(0, n, 100_000):
                    own = coded.dictionary.slice(start, 100_000)
                    k = len(own)
                    columns = [
                        pa.array(np.zeros(k, np.int32)),
                        pa.array(np.full(k, name, np.int64)),
                        pa.array(np.arange(base + start, base + start + k, dtype=np.int32)),
                        pa.array([lang] * k, pa.string()),
                        own,
                        pa.array(counts[start : start + k]),
                        pa.nulls(k, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                stream = np.full(len(local) + int(new.sum()), _BREAK, dtype="<i4")
                stream[np.arange(len(local)) + np.cumsum(new)] = local + base
                streams.append(stream)
                base += n
            if streams:
                values = [1, name, None, None, None, None, np.concatenate(streams).tobytes()]
                types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                columns = [pa.array([v], t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in portions(batches, "text"):
            langs = batch.column(0).to_pylist()
            for row, lang in enumerate(langs):
                for part in _parts(batch.column(1)[row].as_py() or b"", s.slice_bytes):
                    texts.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= s.slice_bytes:
                        yield from finish()
                        made, size = made + 1, 0
                        texts.clear()
        yield from finish()

    return run


_STATE = "slice long, tokens binary, alive binary, starts long"


def _state(slices: list[int], states: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of the streams that still have places where a longer n-gram may start."""
    kept = [(n, t, a, len(_starts(t, a))) for n, (t, a) in zip(slices, states, strict=True)]
    kept = [k for k in kept if k[3]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in kept], pa.int64()),
            pa.array([k[1].astype("<u4").tobytes() for k in kept], pa.binary()),
            pa.array([np.packbits(k[2]).tobytes() for k in kept], pa.binary()),
            pa.array([k[3] for k in kept], pa.int64()),
        ],
        names=["slice", "tokens", "alive", "starts"],
    )


def _read_state(row: dict) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.frombuffer(row["tokens"], dtype="<u4")
    alive = np.unpackbits(np.frombuffer(row["alive"], dtype=np.uint8), count=len(tokens)).astype(bool)
    return tokens, alive


def _starts(tokens: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Places where both n-grams of the length before, this and the next, are frequent."""
    return np.flatnonzero(alive[:-1] & alive[1:])


def _shrunk(tokens: np.ndarray, alive: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The stream without tokens that no living n-gram of ``words`` words holds; one 0 stands for a gap."""
    needed = alive.copy()
    for k in range(1, words):
        needed[k:] |= alive[:-k]
    keep = needed.copy()
    keep[1:] |= needed[:-1]
    return np.where(needed, tokens, 0)[keep], alive[keep]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of slice, stream, locals and ids: a word that is not frequent counts as a break."""
    for batch in batches:
        for i in range(batch.num_rows):
            stream = np.frombuffer(batch.column(1)[i].as_py(), dtype="<i4")
            local, ids = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3))
            known = np.zeros(int(stream.max(initial=0)) + 2, dtype=np.uint32)  # the last place is the break's
            known[local] = ids
            tokens = known[stream]
            yield _state([batch.column(0)[i].as_py()], [_shrunk(tokens, tokens != 0, 1)])


# Counting -------------------------------------------------------------------------------------------------


def _distinct(tokens: np.ndarray, alive: np.ndarray, words: int, id_bits: int):
    """Start places of a stream's n-grams, their distinct permuted keys in order, and each place's entry."""
    starts = _starts(tokens, alive)
    h = half_bits(words, id_bits)
    left, right = permute(*pack([tokens[starts + k] for k in range(words)], id_bits), h)
    return starts, *entries(left, right, h)


def _filters(words: int, id_bits: int, shard_bits: int):
    """One filter per slice and shard; ``start``: the place of its first entry among those of the slice."""
    h = half_bits(words, id_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, left, right, inverse = _distinct(*_read_state(row), words, id_bits)
            counts = np.bincount(inverse, minlength=len(left))
            shards = (left >> np.uint64(h - shard_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shards, prepend=-1)).tolist()
            ends = [*cuts[1:], len(left)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["slice"]] * len(cuts), pa.int64()),
                    pa.array(shards[cuts].astype(np.int32)),
                    pa.array(cuts, pa.int32()),
                    pa.array([to_bytes(left[a:b], right[a:b], counts[a:b], h, shard_bits) for a, b in zip(cuts, ends, strict=True)]),
                ],
                names=["slice", "shard", "start", "filter"],
            )

    return run


_MERGED = "kind int, ids array<int>, a long, slice long, start int, entries int, bits binary"


def _merged(s: Settings, words: int, id_bits: int):
    """Filters come in the order of their shards. Rows of kind 0: a frequent n-gram. Rows of kind 1: for a
    slice's filter a bit per entry, whether it is frequent; none where no entry is."""
    h = half_bits(words, id_bits)
    names = [c.split()[0] for c in _MERGED.split(", ")]

    def finish(held: list[tuple[int, int, tuple]]) -> Iterator[pa.RecordBatch]:
        left, right, totals, places = merge([f for _, _, f in held], h)
        often = totals >= s.min_count
        n = int(often.sum())
        if not n:
            return
        ids = np.stack(unpack(*restore(left[often], right[often], h), words, id_bits), axis=1).astype(np.int32)
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]
        columns = [pa.array(np.zeros(n, np.int32)), long_lists(list(ids), pa.int32()), pa.array(totals[often]), *none]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        told = [(one, start, often[own]) for (one, start, _), own in zip(held, places, strict=True)]
        told = [t for t in told if t[2].any()]
        columns = [
            pa.array(np.ones(len(told), np.int32)),
            pa.nulls(len(told), pa.list_(pa.int32())),
            pa.nulls(len(told), pa.int64()),
            pa.array([t[0] for t in told], pa.int64()),
            pa.array([t[1] for t in told], pa.int32()),
            pa.array([len(t[2]) for t in told], pa.int32()),
            pa.array([np.packbits(t[2]).tobytes() for t in told], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for row in _rows(batches):
            if held and row["shard"] != now:
                yield from finish(held)
                held = []
            now = row["shard"]
            held.append((row["slice"], row["start"], from_bytes(row["filter"], now)))
        if held:
            yield from finish(held)

    return run


def _advanced(words: int, id_bits: int):
    """Streams next to the bits of their slice's entries: what may hold a longer frequent n-gram stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            tokens, alive = _read_state(row)
            starts, left, _, inverse = _distinct(tokens, alive, words, id_bits)
            often = np.zeros(len(left), dtype=bool)
            for told in row["told"]:
                bits = np.unpackbits(np.frombuffer(told["bits"], dtype=np.uint8), count=told["entries"])
                often[told["start"] : told["start"] + told["entries"]] = bits
            living = np.zeros(len(tokens), dtype=bool)
            living[starts[often[inverse]]] = True
            yield _state([row["slice"]], [_shrunk(tokens, living, words)])

    return run


def _frequent_words(words: DataFrame, s: Settings) -> DataFrame:
    """lang, word, a and id, dense from 1, of the words found often enough."""
    counted = words.groupBy("lang", "word").agg(F.sum("count").alias("a")).filter(F.col("a") >= s.min_count)
    counted = materialize(counted.withColumn("place", place(F.col("lang"), F.col("word"))))
    numbered = number_rows(counted, "id", [], ["place", "lang", "word"])
    return materialize(numbered.select("lang", "word", "a", (F.col("id") + 1).cast("int").alias("id")))


def frequent_ngrams(docs: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: ids, a (n-grams of 1 to ``max_words`` words found ``min_count`` times or more, by word ids);
    lang, word, a, id (the words behind the ids, of one language each); lang, n (all word occurrences)."""
    s = settings or Settings()
    narrow = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")
    )
    sliced = materialize(narrow.mapInArrow(lean(_sliced(s)), _SLICED), "kind")
    own_words = sliced.filter("kind = 0")
    totals = materialize(own_words.groupBy("lang").agg(F.sum("count").alias("n")))
    vocabulary = _frequent_words(own_words, s)
    id_bits = max(1, vocabulary.count().bit_length())

    listed = own_words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("slice")
    listed = listed.agg(F.collect_list(F.struct("local", "id")).alias("known"))
    streams = sliced.filter("kind = 1").select("slice", "stream").join(listed, "slice")
    state = materialize(streams.select("slice", "stream", "known.local", "known.id").mapInArrow(lean(_with_ids), _STATE))
    grams = vocabulary.select(F.array("id").alias("ids"), "a")
    for words in range(2, s.max_words + 1):
        starts = state.agg(F.sum("starts")).first()[0] or 0
        if not starts:
            break
        shard_bits = min((starts // s.shard_entries).bit_length(), half_bits(words, id_bits), 30)
        filters = state.mapInArrow(lean(_filters(words, id_bits, shard_bits)), "slice long, shard int, start int, filter binary")
        dealt = filters.repartition("shard").sortWithinPartitions("shard")
        merged = materialize(dealt.mapInArrow(lean(_merged(s, words, id_bits)), _MERGED), "kind")
        grams = grams.union(merged.filter("kind = 0").select("ids", "a"))
        if words < s.max_words:
            told = merged.filter("kind = 1").groupBy("slice").agg(
                F.collect_list(F.struct("start", "entries", "bits")).alias("told")
            )
            state = materialize(state.join(told, "slice").mapInArrow(lean(_advanced(words, id_bits)), _STATE))
    return materialize(grams), vocabulary, totals


# Phrases --------------------------------------------------------------------------------------------------


def _exact(column: str):
    return F.col(column).cast("decimal(20,0)")


def _scored(grams: DataFrame, s: Settings) -> DataFrame:
    """ids, a, l, r and score of the n-grams of two words or more, by their lowest-scoring cut."""
    several = grams.filter(F.size("ids") > 1)
    cuts = several.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select(
        "ids", "a", "k",
        F.slice("ids", F.lit(1), F.col("k")).alias("first"),
        F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("rest"),
    )
    first = grams.select(F.col("ids").alias("first"), F.col("a").alias("l"))
    rest = grams.select(F.col("ids").alias("rest"), F.col("a").alias("r"))
    met = cuts.join(first, "first").join(rest, "rest")
    met = met.withColumn("product", _exact("a") * F.lit(s.score_scale)).withColumn("sum", _exact("l") + _exact("r"))
    met = met.withColumn("score", F.expr("product div sum"))
    best = met.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("ids", "a", "cut.l", "cut.r", "cut.score")


def _alone(scored: DataFrame, s: Settings) -> DataFrame:
    """Without phrases that a longer one holds nearly as often. Counts fall as phrases grow, and what lies
    between is a phrase too, so those longer by one word tell."""
    longer = scored.filter(F.size("ids") > 2).select("ids", "a")
    n = F.size("ids") - 1
    inside = longer.select(F.explode(F.array(F.slice("ids", F.lit(1), n), F.slice("ids", F.lit(2), n))).alias("ids"), "a")
    inside = inside.groupBy("ids").agg(F.max("a").alias("longer"))
    met = scored.join(inside, "ids", "left")
    held = F.lit(100) * _exact("longer") >= F.lit(s.inside_percent) * _exact("a")
    return met.filter(~F.coalesce(held, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``top`` phrases of each language.

    Null languages count as ``und``; null and empty texts have no words; repeated rows count as often as they
    stand there; other columns are ignored. Texts of any length are read whole, cut into slices between pieces
    only (one piece without an end is held whole). Ties go by count, then by phrase. An empty table gives an
    empty result.
    """
    s = settings or Settings()
    with small_batches(docs.sparkSession):
        grams, vocabulary, totals = frequent_ngrams(docs, s)
    chosen = materialize(_alone(materialize(_scored(grams, s)), s))
    spelt = chosen.select("ids", F.posexplode("ids").alias("place", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("ids").agg(
        F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words")
    )
    phrases = materialize(
        chosen.join(spelt, "ids").select(
            "lang", F.concat_ws(" ", "words.word").alias("phrase"), "a", "l", "r", "score",
        )
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, -(-phrases.count() // s.ranked_rows))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    early = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    first = phrases.withColumn("_part", part).withColumn("_early", early).filter(F.col("_early") <= s.top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = first.withColumn("rank", rank).filter(F.col("rank") <= s.top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: SQL twin of the registered query: every n-gram of the texts counted as a list of words.
COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
  FROM words, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k
), counted AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM counted) c
  JOIN counted x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN counted y ON y.lang = c.lang AND y.g = c.g[k + 1:]
), scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g[i:j] AS g, max(f) AS f FROM counted, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 5)) AS j)
  WHERE j <= len(g) AND j > i AND j - i + 1 < len(g) GROUP BY ALL
), alone AS (
  SELECT s.* FROM scored s LEFT JOIN inside b ON s.lang = b.lang AND s.g = b.g
  WHERE b.f IS NULL OR 100::HUGEINT * b.f < 80::HUGEINT * a
), phrases AS (SELECT *, array_to_string(g, ' ') AS phrase FROM alone)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM phrases JOIN totals USING (lang) QUALIFY rank <= 2000
"""
