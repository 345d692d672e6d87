import random
import zlib

import numpy as np
import pytest

from riskloom.llm import toxicity as t

INSULTS = ["idiot", "moron", "scumbag", "trashy", "pathetic", "zlobwurm"]


def sentence(draw, n):
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti".split()
    return [("".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4)))) for _ in range(n)]


def document(draw, toxic):
    words = sentence(draw, draw.randrange(20, 80))
    if toxic:
        for _ in range(draw.randrange(1, 4)):
            word = draw.choice(INSULTS)
            words.insert(draw.randrange(len(words)), word + draw.choice(["", "", "er", "nd"]) if word == "zlobwurm" else word)
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def machine():
    draw = random.Random(1)
    labels = [int(k % 5 == 0) for k in range(900)]
    return t.train([document(draw, y) for y in labels], labels, t.Settings(words=600, landmarks=100))


def top(text, machine):
    return t._document(text, machine.table(), machine)


def scored(text, machine):
    return float(t._score(np.array([top(text, machine)]), machine)[0])


def test_held_out_accuracy(machine):
    draw = random.Random(2)
    wrong = 0
    for k in range(400):
        wrong += (scored(document(draw, k % 4 == 0), machine) >= t.THRESHOLD) != (k % 4 == 0)
    assert wrong <= 4


def test_gaps_and_inserted_characters(machine):
    draw = random.Random(3)
    clean = " ".join(sentence(draw, 30))
    for word in ("idiot", "i.d.i.o.t", "i d i o t", "id-iot", "1d10t", "IDIOT!!", "morron", "patthetic", "scum-bag"):
        assert scored(f"{clean} {word} {clean}", machine) >= t.THRESHOLD, word
    assert scored(clean, machine) < t.THRESHOLD


def test_decisions_equal_the_kernel_machine():
    """Folding landmarks into weights gives what the sum over subsequence pairs gives."""

    def phi(word):
        out = {}
        for a in range(len(word)):
            for d in range(a + 3, min(len(word), a + 6)):
                for b in range(a + 1, d - 1):
                    for c in range(b + 1, d):
                        key = (word[a], word[b], word[c], word[d])
                        out[key] = out.get(key, 0) + t.DECAY ** (d - a - 3)
        return out

    def norm(word):
        return np.sqrt(sum(t.DECAY ** (2 * (d - a - 3)) for a in range(len(word)) for d in range(a + 3, min(len(word), a + 6)) for b in range(a + 1, d - 1) for _ in range(b + 1, d)))

    edge = bytes([t.EDGE])
    words = [edge + w + edge for w in (b"\x01\x02\x03\x04\x05", b"\x01\x02\x01\x02\x01\x02\x07", b"\x03\x04\x09\x05")]
    features = t._features(words, words)
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            a, b = phi(x), phi(y)
            want = sum(v * b.get(k, 0) for k, v in a.items()) / norm(x) / norm(y)
            assert abs(features[i, j] - want) < 1e-5


def test_long_text_is_scored_whole(machine):
    draw = random.Random(4)
    clean = " ".join(sentence(draw, 90000))
    assert scored(clean, machine) < t.THRESHOLD
    assert scored(clean + " idiot", machine) >= t.THRESHOLD


def test_rows_and_folds(make):
    draw = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        y = int(k % 4 == 0)
        rows.append((k, document(draw, y), 0.5))
        if k % 2 == 0 or k % 5 == 0:
            labels.append((k, y))
    rows += [(None, "idiot", 0.5), (1000, None, 0.5), (1001, "", 0.5), (4, rows[4][1], 0.5)]
    docs = make(rows, "doc_id long, text string, score double")
    small = t.Settings(words=300, landmarks=60)
    table = make(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    first = t.fit(docs, table, small)
    # Labels of the held-out fold change nothing.
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, y in labels]
    second = t.fit(docs, make(flipped, "doc_id long, toxic int"), small)
    assert np.array_equal(first.weights, second.weights) and first.level == second.level
    got = t.score_toxicity(docs, first).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.predicted for r in got if r.doc_id in (1000, 1001)} == {0}
    kept = t.drop_toxic(docs, first)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in got if not r.predicted)


def test_nothing_to_learn(make):
    docs = make([(1, "a b c"), (2, None)], "doc_id long, text string")
    machine = t.fit(docs, make([], "doc_id long, toxic int"))
    assert machine is None
    assert [r.score for r in t.score_toxicity(docs, machine).collect()] == [0.0, 0.0]
    assert t.drop_toxic(docs, machine).count() == 2
    assert t.score_toxicity(make([], "doc_id long, text string"), None).count() == 0
