"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is read character by character. For every boundary of the last ``longest piece`` characters one
backpointer is kept; a new boundary looks back no further than that. Following the backpointers of the
boundaries still in the window, the paths meet in one boundary: ids before it are final and leave the window.
Memory is the window, whatever the length of the text.

Which path survives at a boundary depends on the model:

* unigram: the one with the best sum of piece scores;
* BPE (the merge order is the piece score): the encoding of a prefix is the only sequence of pieces in which
  every two neighbours are compatible, that is, encode to themselves when merged on their own. So at each
  boundary the one piece survives that is compatible with the survivor at its start, and pieces need not be
  merged over the whole text.

Candidates for a boundary come from a walk backwards through a trie of reversed pieces, which ends where no
piece goes on.

No piece holds the space mark after another character (checked when the model is loaded), so all paths
converge before each space mark that follows another character, and around characters that no piece joins to
others, whatever the window still holds. What the window has found between two such places is remembered in
a bounded table, as stretches repeat.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import lean, portions

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stretches and piece pairs each table holds, stretches of up to ``_SHORT`` characters: some 100 MB in a worker.
REMEMBERED = 400_000
_SHORT = 64
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
#: What an unknown character costs below the worst score of a unigram model.
UNKNOWN_PENALTY = 10.0


def _reversed_trie(ids: dict[str, int]) -> dict:
    """Pieces from their last character to their first: a character leads to (trie, id or -1)."""
    ends: dict[str, list] = {"": [{}, -1]}
    for piece in sorted({p[k:] for p in ids for k in range(len(p))}, key=len):
        ends[piece] = [{}, ids.get(piece, -1)]
        ends[piece[1:]][0][piece[0]] = ends[piece]
    return ends[""][0]


class PieceModel:
    """Pieces, scores and normaliser settings of a model file. Only the identity normaliser is known."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        rules = model.normalizer_spec
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models with identity normalisation and escaped white space are supported")
        if model.trainer_spec.treat_whitespace_as_suffix or any(p.type == _USER for p in model.pieces):
            raise ValueError("white space as a suffix and user-defined pieces are not supported")
        self.dummy_prefix = rules.add_dummy_prefix
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.unknown_surface = model.trainer_spec.unk_surface
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.score_of = [p.score for p in model.pieces]
        self.backwards = _reversed_trie(self.ids)
        self.unknown = next(i for i, t in enumerate(self.types) if t == _UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == _BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # Runs of characters that no piece joins to others, known or not: paths converge on both sides of them.
        joined = {c for p in self.ids if len(p) > 1 for c in p} | {SPACE}
        self.apart = re.compile("([^" + "".join(map(re.escape, sorted(joined))) + "]+)")
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY


class Encoder:
    """Ids of texts. Inside, a piece is its id, an unknown character ``-2 - ord``, and -1 the start of a text."""

    def __init__(self, model: PieceModel, remembered: int = REMEMBERED):
        self.model = model
        self.remembered = remembered
        self._known: dict[str, bytes] = {}
        self._pairs: dict[int, bool] = {}
        self._survivors = self._by_score if model.kind == UNIGRAM else self._by_merges

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], dtype=np.int32).tolist()

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(ids, dtype=np.int32).tolist() for ids in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers. What its stretches have not taught yet is found first."""
        if not self.model.words_apart:
            return [self._packed(self._window(self._marked(t))) for t in texts]
        split = [self._stretches(self._marked(t)) if t else [] for t in texts]
        used = set().union(*split)
        known = self._known
        self._learn(used - known.keys())
        out = [b"".join(map(known.__getitem__, stretches)) for stretches in split]
        if len(known) >= self.remembered:  # what these texts used is what the next are likely to
            self._known = {x: known[x] for x in used if len(x) <= _SHORT} if len(used) < self.remembered else {}
        else:
            for stretch in [x for x in used if len(x) > _SHORT]:
                del known[stretch]
        return out

    def _learn(self, stretches: set[str]) -> None:
        """Ids of new stretches. Neighbours in the alphabet share their first boundaries and survivors."""
        last, back, best, before = [-1], [0], [0.0], ""
        for text in sorted(stretches):
            if len(text) > _SHORT:
                self._known[text] = self._packed(self._window(text))
                continue
            same, most = 0, min(len(text), len(before))
            while same < most and text[same] == before[same]:
                same += 1
            del last[same + 1 :], back[same + 1 :], best[same + 1 :]
            self._survivors(text, last, back, best)
            self._known[text] = self._packed(self._path(last, back, len(text)))
            before = text

    def _marked(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)

    def _stretches(self, marked: str) -> list[str]:
        """The text cut where paths converge in any case."""
        segments = self.model.apart.split(marked)
        if len(segments) == 1:
            return self._words(marked)
        out = []
        for n, segment in enumerate(segments):
            if n % 2:
                out.append(segment)
            elif segment:
                out += self._words(segment)
        return out

    @staticmethod
    def _words(marked: str) -> list[str]:
        """The text cut before each space mark that follows another character."""
        parts = marked.split(SPACE)
        if "" not in parts[1:]:
            out = [SPACE + part for part in parts[1:]]
            return [parts[0], *out] if parts[0] else out
        out, pending = [parts[0]] if parts[0] else [], ""
        for n in range(1, len(parts)):
            pending += SPACE
            if parts[n] or n == len(parts) - 1:
                out.append(pending + parts[n])
                pending = ""
        return out

    def _packed(self, pieces: Iterable[int]) -> bytes:
        found = array("i")
        for piece in pieces:
            if piece >= 0:
                found.append(piece)
            elif self.model.byte_fallback:
                found.extend(self.model.bytes[b] for b in chr(-2 - piece).encode())
            else:
                found.append(self.model.unknown)
        return found.tobytes()

    def pieces(self, text: str) -> Iterator[str]:
        return map(self._surface, self._window(text))

    def _surface(self, piece: int) -> str:
        return self.model.pieces[piece] if piece >= 0 else chr(-2 - piece) if piece < -1 else ""

    def _window(self, text: str) -> Iterator[int]:
        """The pieces in order, each as soon as no path in the window can do without it."""
        longest = self.model.longest
        # For each boundary held: the piece that ends there, the length of its text, the score of the path.
        last, back, best = [-1], [0], [0.0]
        survivors, held = self._survivors, 0
        while held < len(text):
            portion = min(len(text), held + 4 * longest)
            survivors(text[held - len(last) + 1 : portion], last, back, best)
            held = portion
            if held < len(text) and (meet := self._meeting(back, longest)):
                yield from self._path(last, back, meet)
                del last[:meet], back[:meet], best[:meet]
        yield from self._path(last, back, len(back) - 1)

    @staticmethod
    def _meeting(back: list[int], longest: int) -> int:
        """The last boundary on the paths of all boundaries that a later piece can start from."""
        ends = set(range(max(0, len(back) - longest), len(back)))
        while len(ends) > 1:
            latest = max(ends)
            ends.remove(latest)
            ends.add(latest - back[latest])
        return ends.pop()

    @staticmethod
    def _path(last: list[int], back: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= back[end]
        return out[::-1]

    def _by_score(self, text: str, last: list[int], back: list[int], best: list[float]) -> None:
        """Goes on to the end of ``text``, of which ``last`` has the boundaries up to some place."""
        trie, score_of, unknown = self.model.backwards, self.model.score_of, self.model.unknown_score
        for end in range(len(last), len(text) + 1):
            node, start, top = trie, end, None
            while start and (found := node.get(text[start - 1])):
                node, piece = found
                start -= 1
                if piece < 0:
                    continue
                score = best[start] + score_of[piece]
                if top is None or score >= top[0]:
                    top = score, piece, start
            if trie.get(text[end - 1], (None, -1))[1] < 0:
                score = best[end - 1] + unknown
                if top is None or score > top[0]:
                    top = score, -2 - ord(text[end - 1]), end - 1
            best.append(top[0])
            last.append(top[1])
            back.append(end - top[2])

    def _by_merges(self, text: str, last: list[int], back: list[int], best: list[float]) -> None:
        """As ``_by_score``: the one compatible piece; where no piece is, the character is unknown."""
        trie, pairs = self.model.backwards, self._pairs
        for end in range(len(last), len(text) + 1):
            node, start = trie, end
            while start and (found := node.get(text[start - 1])):
                node, piece = found
                start -= 1
                if piece < 0:
                    continue
                pair = last[start] << 32 | piece
                fits = pairs.get(pair)
                if fits is None:
                    fits = self._fits(last[start], piece, pair)
                if fits:
                    last.append(piece)
                    back.append(end - start)
                    break
            else:
                last.append(-2 - ord(text[end - 1]))
                back.append(1)
            best.append(0.0)

    def _fits(self, one: int, two: int, pair: int) -> bool:
        if len(self._pairs) >= self.remembered:
            self._pairs.clear()
        before, after = self._surface(one), self._surface(two)
        fits = self._pairs[pair] = self._merged(before + after) == ([before, after] if before else [after])
        return fits

    def _merged(self, text: str) -> list[str]:
        """BPE by definition: join the neighbours with the best score, the leftmost first."""
        parts, scores = list(text), self.model.scores
        while len(parts) > 1:
            at, top = -1, None
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (top is None or score > top):
                    at, top = k, score
            if top is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Decoder:
    def __init__(self, model: PieceModel):
        self.model = model
        byte_of = {i: bytes([b]) for b, i in model.bytes.items()}
        self._surface = [
            byte_of.get(i) or (b"" if t == _CONTROL else model.unknown_surface.encode() if t == _UNKNOWN else p.replace(SPACE, " ").encode())
            for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True))
        ]

    def decode(self, ids) -> str:
        surface = self._surface
        joined = b"".join(map(surface.__getitem__, ids))
        if self.model.dummy_prefix and joined.startswith(b" "):
            joined = joined[1:]
        return joined.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _tools(model: bytes) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a worker: what they remember serves its later tasks too."""
    pieces = PieceModel(model)
    return Encoder(pieces), Decoder(pieces)


def read_model(path: str = MODEL_PATH) -> bytes:
    """A model file on the driver; it goes to the tasks with the code (about half a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_ok per row of ``docs`` (doc_id, text; others are ignored). No shuffle.

    A null text has null ids, an empty one no ids; repeated rows each get a row; null ids stay null; an empty
    table gives an empty result. decoded_ok: the ids decode to the text, where a literal space mark counts as
    the space it decodes to.
    """
    held = read_model() if model is None else model
    schema = "doc_id long, n_tokens long, ids array<int>, decoded_ok boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(held)
        for batch in portions(batches, "text"):
            texts = batch.column(1).to_pylist()
            packed = encoder.encode_packed([t or "" for t in texts])
            right = [
                None if text is None else decoder.decode(np.frombuffer(ids, np.int32).tolist()) == text.replace(SPACE, " ")
                for text, ids in zip(texts, packed, strict=True)
            ]
            missing = pa.array([t is None for t in texts])
            counts = np.array([len(ids) // 4 for ids in packed], dtype=np.int64)
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            ids = pa.Array.from_buffers(pa.int32(), int(counts.sum()), [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.if_else(missing, None, pa.array(counts)),
                    pa.ListArray.from_arrays(offsets, ids, mask=missing),
                    pa.array(right, pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded_ok"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give a null text. Row-local."""
    held = read_model() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _tools(held)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [None if ids is None else decoder.decode(ids) for ids in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string"
    )
