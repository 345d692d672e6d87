"""Toxicity: a support vector machine over a subsequence string kernel, with Nystroem landmarks.

The kernel compares words by the four-letter subsequences they share, inside a span of six letters; each
letter of gap costs a factor. A letter put into an insult, or one left out, therefore leaves most of the
similarity. Punctuation inside words is passed over, digits read as the letters they stand for, and letters
spaced out one by one are put together before.

Training. Labels are on documents, so their sentences are weakly labelled: a sentence of a toxic document
is toxic by some of its words only. Letter sequences that many toxic and few clean sentences hold point at
these words (the witnesses). The machine learns witnesses, also with a letter put in, against words of
clean documents; then the clean words it scores highest are added and it learns again. It is fitted on a
bounded sample of labelled rows (``Settings``), on the driver.

Scoring. The machine's decision is linear in the kernel with the landmarks, and the kernel is a sum over
subsequences, so all landmarks fold into one weight per subsequence. Scoring a text adds these weights
along its words, normalises by word length, and takes the highest word: every word of every text is scored.
"""

from __future__ import annotations

import random
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE_BYTES, lean

#: Letters are read as 32 codes: 1-26 a to z, 27 the edge of a word, 28-31 other letters by code point.
EDGE = 27
_BITS, _CODES = 5, 32
_SPAN, _LENGTH = 6, 4
DECAY = 0.8
#: Offsets of the second to fourth letter, by span.
_OFFSETS = [(i, j, end) for end in range(_LENGTH - 1, _SPAN) for i in range(1, end - 1) for j in range(i + 1, end)]
THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample: documents per class and their largest size; then the machine's sizes."""

    toxic_docs: int = 1200
    clean_docs: int = 2400
    max_bytes: int = 20_000
    landmarks: int = 200
    words: int = 4000
    cost: float = 300.0
    rounds: int = 3
    seed: int = 20240229


def _code_table() -> np.ndarray:
    table = np.zeros(0x3000, dtype=np.uint8)
    for point in range(len(table)):
        char = chr(point)
        if char.isspace() or point < 0x20:
            table[point] = EDGE
        elif "a" <= char <= "z":
            table[point] = point - 96
        elif unicodedata.category(char)[0] == "L":
            table[point] = 28 + point % 4
    for char, letter in zip("013457@", "oieasta", strict=True):
        table[ord(char)] = ord(letter) - 96
    return table


_TABLE = _code_table()


def letter_codes(text: str) -> np.ndarray:
    """Codes with one EDGE between words and at both ends; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 28 + points % 4).astype(np.uint8)
    codes = np.concatenate(([EDGE], codes[codes > 0], [EDGE])).astype(np.uint8)
    edge = codes == EDGE
    codes = codes[~edge | np.concatenate(([True], ~edge[:-1]))]
    if len(codes) < 2:
        return codes[:0]
    edge = codes == EDGE
    if len(codes) > 6:  # an edge between two one-letter words goes: spaced-out letters become a word
        lone = np.zeros(len(codes), dtype=bool)
        lone[2:-2] = edge[2:-2] & edge[:-4] & edge[4:]
        if lone.any():
            codes = codes[~lone]
    return codes


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Start positions, subsequence numbers and weight for each pattern of offsets that stays in a word."""
    edges = np.cumsum(codes == EDGE, dtype=np.int32)
    wide = codes.astype(np.int32)
    for i, j, end in _OFFSETS:
        n = len(codes) - end
        if n <= 0:
            continue
        start = np.flatnonzero(edges[end - 1 : end - 1 + n] == edges[:n])
        number = ((wide[start] << _BITS | wide[start + i]) << _BITS | wide[start + j]) << _BITS | wide[start + end]
        yield start, number, DECAY ** (end + 1 - _LENGTH)


def _norms(longest: int) -> np.ndarray:
    """By word length with both edges: the root of the summed squared weights of its subsequences."""
    lengths = np.arange(longest + 1)
    total = np.zeros(longest + 1)
    for _, _, end in _OFFSETS:
        total += np.maximum(0, lengths - end) * DECAY ** (2 * (end + 1 - _LENGTH))
    return np.sqrt(np.maximum(total, 1e-12))


_NORM = _norms(256)


@dataclass(frozen=True)
class Machine:
    """Weights per subsequence (sorted numbers and values), the bias, and where the score is 0.7."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    level: float
    slope: float

    def table(self) -> np.ndarray:
        out = np.zeros(_CODES**_LENGTH, dtype=np.float32)
        out[self.numbers] = self.weights
        return out


def word_decisions(codes: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each word of ``codes``, in order."""
    if len(codes) < 3:
        return np.zeros(0)
    edges = np.flatnonzero(codes == EDGE)
    per_start = np.zeros(len(codes), dtype=np.float64)
    wide = codes.astype(np.int32)
    inside = np.cumsum(codes == EDGE, dtype=np.int32)
    pairs = wide[:-1]
    for i, j, end in _OFFSETS:
        n = len(codes) - end
        if n <= 0:
            continue
        number = ((pairs[:n] << _BITS | wide[i : i + n]) << _BITS | wide[j : j + n]) << _BITS | wide[end : end + n]
        value = table[number]
        value[inside[end - 1 : end - 1 + n] != inside[:n]] = 0
        per_start[:n] += value * DECAY ** (end + 1 - _LENGTH)
    sums = np.add.reduceat(per_start, edges[:-1])
    lengths = np.diff(edges) + 1
    return sums / _NORM[np.minimum(lengths, 256)] + bias


def _words(codes: np.ndarray) -> set[bytes]:
    return {bytes([EDGE]) + w + bytes([EDGE]) for w in codes.tobytes().split(bytes([EDGE])) if w}


def _grams(word: bytes) -> set[bytes]:
    return {word[i : i + n] for n in (3, 4, 5) for i in range(len(word) - n + 1)}


def _joined(words: list[bytes]) -> np.ndarray:
    """Words as one code array with single edges between them."""
    return np.frombuffer(bytes([EDGE]) + b"".join(w[1:] for w in words), dtype=np.uint8)


def _features(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The normalised kernel of words (rows) with landmarks (columns)."""
    own: dict[int, np.ndarray] = {}
    for n, word in enumerate(landmarks):
        for _, numbers, weight in _subsequences(np.frombuffer(word, dtype=np.uint8)):
            for number in numbers.tolist():
                row = own.setdefault(number, np.zeros(len(landmarks), dtype=np.float32))
                row[n] += weight / _NORM[min(len(word), 256)]
    known = np.array(sorted(own), dtype=np.int64)
    matrix = np.array([own[k] for k in known.tolist()]) if len(known) else np.zeros((0, len(landmarks)), np.float32)
    codes = _joined(words)
    edges = np.flatnonzero(codes == EDGE)
    out = np.zeros((len(words), len(landmarks)), dtype=np.float64)
    for start, number, weight in _subsequences(codes):
        if not len(known):
            break
        at = np.minimum(np.searchsorted(known, number), len(known) - 1)
        hit = known[at] == number
        rows = np.searchsorted(edges, start[hit], side="right") - 1
        for lo in range(0, len(rows), 100_000):
            part = slice(lo, lo + 100_000)
            np.add.at(out, rows[part], matrix[at[hit][part]] * weight)
    return out / _NORM[np.minimum(np.diff(edges) + 1, 256)][:, None]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the violated rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(30):
        wrong = y * (x @ w) < 1
        a, c = x[wrong], cost[wrong]
        new = np.linalg.solve(ridge + (a.T * c) @ a, (a.T * c) @ y[wrong])
        if np.allclose(new, w, atol=1e-8):
            break
        w = 0.5 * (w + new) if _ > 10 else new
    return w[:-1], float(w[-1])


def _witnesses(toxic: list[set[bytes]], clean: list[set[bytes]]) -> list[set[bytes]]:
    """Per toxic document the words whose letters point most to toxic documents."""
    seen = [Counter(g for doc in docs for g in set().union(*map(_grams, doc))) for docs in (toxic, clean)]
    odds = {
        g: np.log((n + 0.1) / len(toxic)) - np.log((seen[1][g] + 0.5) / len(clean)) + min(0.0, np.log(n / 8))
        for g, n in seen[0].items()
        if n >= 4
    }
    out = []
    for doc in toxic:
        scored = {w: max((odds.get(g, -9.0) for g in _grams(w)), default=-9.0) for w in doc}
        best = max(scored.values(), default=-9.0)
        out.append({w for w, s in scored.items() if s >= max(2.0, best - 0.7)})
    return out


def _with_a_letter(word: bytes, draw: random.Random) -> bytes:
    at = draw.randrange(2, max(3, len(word) - 1))
    return word[:at] + bytes([draw.randrange(1, 27)]) + word[at:]


def train(texts: list[str], labels: list[int], settings: Settings | None = None) -> Machine | None:
    """A machine from documents and their labels, None if a class is missing."""
    s = settings or Settings()
    draw = random.Random(s.seed)
    coded = [letter_codes(t) for t in texts]
    toxic = [_words(c) for c, y in zip(coded, labels, strict=True) if y]
    clean = [_words(c) for c, y in zip(coded, labels, strict=True) if not y]
    if not any(toxic) or not any(clean):
        return None
    witnesses = Counter(w for doc in _witnesses(toxic, clean) for w in doc)
    if not witnesses:
        return None
    positive = [w for w, _ in sorted(witnesses.items(), key=lambda x: (-x[1], x[0]))][: s.words]
    # Words seen again and again get more variants, and these as much weight as the word itself.
    changed: dict[bytes, float] = {}
    for w in positive:
        for _ in range(min(12, witnesses[w]) if len(w) > 5 else 0):
            changed[_with_a_letter(w, draw)] = 1.0 + np.log(witnesses[w])
    changed = dict(sorted(changed.items(), key=lambda x: (-x[1], x[0]))[: s.words])
    every_clean = sorted(set().union(*clean) - witnesses.keys())
    negative = draw.sample(every_clean, min(len(every_clean), s.words))
    half = s.landmarks // 2
    landmarks = positive[: half // 2] + draw.sample(positive, min(len(positive), half - half // 2))
    landmarks += draw.sample(sorted(changed), min(len(changed), half // 2))
    landmarks += draw.sample(negative, min(len(negative), s.landmarks - half))
    landmarks = sorted(set(landmarks))
    inner = _features(landmarks, landmarks)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    ok = values > 1e-6
    root = vectors[:, ok] / np.sqrt(values[ok])
    everything = _joined(every_clean)
    for _ in range(s.rounds):
        rows = positive + list(changed) + negative
        y = np.array([1.0] * (len(positive) + len(changed)) + [-1.0] * len(negative))
        weight = np.array([1.0 + np.log(witnesses[w]) for w in positive] + list(changed.values()) + [1.0] * len(negative))
        w, bias = _svm(_features(rows, landmarks) @ root, y, s.cost * weight / len(rows) * 100)
        folded: Counter = Counter()
        for share, landmark in zip(root @ w, landmarks, strict=True):
            for _, numbers, decay in _subsequences(np.frombuffer(landmark, dtype=np.uint8)):
                for number in numbers.tolist():
                    folded[number] += share * decay / _NORM[min(len(landmark), 256)]
        numbers = np.array(sorted(folded), dtype=np.int64)
        weights = np.array([folded[k] for k in numbers.tolist()], dtype=np.float32)
        machine = Machine(numbers, weights, bias, 0.0, 1.0)
        table = machine.table()
        decisions = word_decisions(everything, table, bias)
        hard = np.argsort(-decisions, kind="stable")[: s.words // 2]
        negative = sorted(set(negative) | {every_clean[k] for k in hard})
    tops = np.array([_top(c, table, bias) for c in coded])
    level, slope = _level(tops, np.array(labels) > 0)
    return Machine(numbers, weights, bias, level, slope)


def _level(tops: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Where the sample splits best, a clean document lost counting as twenty toxic ones, and how steep scores are."""
    order = np.argsort(tops, kind="stable")
    ranked, y = tops[order], toxic[order]
    # Cutting before the k-th: what lies above it is called toxic.
    recall = np.concatenate((np.cumsum(y[::-1])[::-1], [0])) / max(1, y.sum())
    lost = np.concatenate((np.cumsum(~y[::-1])[::-1], [0])) / max(1, (~y).sum())
    gain = recall - 20 * lost
    k = int(np.argmax(gain))
    above = ranked[min(k, len(ranked) - 1)]
    below = ranked[k - 1] if k else above - 0.5
    level = float(below + 0.4 * (above - below))
    spread = float(np.quantile(tops[toxic], 0.25) - np.quantile(tops[~toxic], 0.99))
    return level, 6 / max(0.3, spread)


def _top(codes: np.ndarray, table: np.ndarray, bias: float) -> float:
    decisions = word_decisions(codes, table, bias)
    return float(decisions.max()) if len(decisions) else min(-1.0, bias)


def _score(tops: np.ndarray, machine: Machine) -> np.ndarray:
    """0 to 1, and 0.7 at the machine's level."""
    margin = machine.slope * (tops - machine.level) + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[list[str], list[int]]:
    """The sample: labelled rows outside the held-out fold, up to a size, the first of each class by a hash."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.filter(fold != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size"))
    sized = sized.filter(F.col("size").between(1, s.max_bytes)).select("doc_id")
    ranked = known.join(sized, "doc_id").withColumn("turn", F.xxhash64(F.lit(s.seed), "doc_id"))
    chosen = None
    for toxic, most in ((1, s.toxic_docs), (0, s.clean_docs)):
        part = ranked.filter(F.col("toxic") == toxic).distinct().orderBy("turn", "doc_id").limit(most).select("doc_id", "toxic")
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = {r.doc_id: r.toxic for r in chosen.collect()}  # bounded by the settings
    if not ids:
        return [], []
    rows = docs.filter(F.col("doc_id").isin(list(ids))) if len(ids) <= 100 else docs.join(
        F.broadcast(docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, _toxic int").drop("_toxic")), "doc_id"
    )
    found = {r.doc_id: r.text for r in rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.octet_length("text") <= s.max_bytes).collect()}
    order = sorted(found)
    return [found[k] for k in order], [int(ids[k]) for k in order]


def _document(text: str | None, table: np.ndarray, machine: Machine) -> float:
    """The highest decision of a word of the text."""
    if not text:
        return min(-1.0, machine.bias)
    return max(_top(letter_codes(part), table, machine.bias) for part in _sections(text))


def _scorer(held):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine | None = held.value
        table = machine.table() if machine else None
        for batch in batches:
            if machine is None:
                tops = scores = np.zeros(batch.num_rows)
            else:
                tops = np.array([_document(v.as_py(), table, machine) for v in batch.column(1)], dtype=np.float64)
                scores = _score(tops, machine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(tops)], names=["doc_id", "score", "top_word"])

    return score


def _sections(text: str, size: int = 200_000) -> Iterator[str]:
    """A long text in parts cut at white space, so that memory stays bounded; all parts are scored."""
    start = 0
    spaces = SPACE_BYTES.decode()
    while start < len(text):
        end = min(len(text), start + size)
        while end < len(text) and text[end] not in spaces:
            end += 1
        yield text[start:end]
        start = end


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Machine | None:
    s = settings or Settings()
    return train(*training_rows(docs, labels, s), s)


def score_toxicity(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score, predicted and top_word per row of ``docs`` (doc_id, text; others are ignored).

    Row-local. Null and empty texts get the score of a text without words; repeated rows each get a row; a
    null doc_id is not held out; an empty table gives an empty result. Without a machine (no row of one of
    the classes to learn from) every score is 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = narrow.mapInArrow(lean(_scorer(held)), "doc_id long, score double, top_word double")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    return scored.select(
        "doc_id",
        F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "top_word",
    )


def _clean_only(at: int, held):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine | None = held.value
        table = machine.table() if machine else None
        for batch in batches:
            if machine is None:
                yield batch
                continue
            tops = np.array([_document(v.as_py(), table, machine) for v in batch.column(at)], dtype=np.float64)
            yield batch.filter(pa.array(_score(tops, machine) < THRESHOLD))

    return keep


def drop_toxic(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that score below the threshold. Row-local.

    Null and empty texts stay, as do all rows if there is no machine.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.mapInArrow(lean(_clean_only(docs.columns.index("text"), held)), docs.schema)
