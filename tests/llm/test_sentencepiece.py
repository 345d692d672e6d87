import itertools
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from riskloom.llm import sentencepiece_viterbi as v


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=v.MODEL_PATH)


def texts(n, longest=200):
    draw = random.Random(11)
    parts = ["the ", "in", "er", " a", "  ", "\n", "\t", "日本", "語", "😀", "é", "▁", "xyz", "0123", "http://", "\x00", "aaaa", ".", "ﬁ", "  b"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(longest))) for _ in range(n)] + ["", " ", "▁", "a"]


def test_equals_the_library(library):
    model = v.PieceModel(v.read_model())
    encoder, decoder = v.Encoder(model), v.Decoder(model)
    given = texts(400)
    assert encoder.encode_many(given) == library.encode(given)
    assert [v.Encoder(model, remembered=20).encode(t) for t in given[:20]] == library.encode(given[:20])
    for text in given:
        assert decoder.decode(library.encode(text)) == library.decode(library.encode(text)) == text.replace("▁", " ")


def test_window_commits_early_on_one_long_word(library):
    """A word of any length goes through a bounded window; ids come out before its end."""
    model = v.PieceModel(v.read_model())
    draw = random.Random(3)
    word = "▁" + "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20000))
    encoder = v.Encoder(model)
    pieces = encoder.pieces(word)
    first = next(pieces)
    assert word.startswith(first)
    assert [first, *pieces] == library.encode(word[1:], out_type=str)
    assert encoder.encode("日" * 5000 + "a" * 5000) == library.encode("日" * 5000 + "a" * 5000)


def unigram_model():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.name = "identity"
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.7, 1), ("ab", -3.1, 1), ("▁a", -3.3, 1), ("bab", -4.9, 1), ("aba", -5.2, 1), ("▁abab", -6.4, 1)]
    for piece, score, kind in rows:
        proto.pieces.add(piece=piece, score=score, type=kind)
    return proto.SerializeToString()


def test_unigram_has_the_best_score():
    """Against all segmentations, and against the library."""
    data = unigram_model()
    model = v.PieceModel(data)
    encoder = v.Encoder(model)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def best(text):
        top = None
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            pieces, start = [], 0
            for k, cut in enumerate((*cuts, 1), 1):
                if cut:
                    pieces.append(text[start:k])
                    start = k
            if all(p in model.scores for p in pieces):
                score = sum(model.scores[p] for p in pieces)
                top = score if top is None else max(top, score)
        return top

    draw = random.Random(1)
    for _ in range(60):
        text = "".join(draw.choice("ab") for _ in range(draw.randrange(1, 11)))
        pieces = list(encoder.pieces("▁" + text))
        assert "".join(pieces) == "▁" + text
        assert abs(sum(model.scores[p] for p in pieces) - best("▁" + text)) < 1e-6
        assert encoder.encode(text) == library.encode(text)
    assert encoder.encode("axb") == library.encode("axb")


def test_models_it_cannot_do():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(unigram_model())
    proto.normalizer_spec.precompiled_charsmap = b"x"
    with pytest.raises(ValueError):
        v.PieceModel(proto.SerializeToString())


def test_rows(make, library):
    rows = [(1, "hello there", 5), (2, None, 5), (3, "", 5), (None, "a  b", 5), (1, "hello there", 5), (4, "long " * 30000, 5)]
    got = v.encode(make(rows, "doc_id long, text string, ids int"))
    found = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded_ok) for r in got.collect()), key=repr)
    want = [(i, None, None, None) if t is None else (i, len(library.encode(t)), library.encode(t), True) for i, t, _ in rows]
    assert found == sorted(want, key=repr)
    back = sorted(((r.doc_id, r.text) for r in v.decode(got).collect()), key=repr)
    assert back == sorted(((i, t) for i, t, _ in rows), key=repr)
    assert v.encode(make([], "doc_id long, text string")).count() == 0
