"""Collocations next to a plain version; the quotient filter next to exact counters."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import collocations as C
from riskloom.llm.collocations import Settings, collocations, words_of
from riskloom.llm.common import BATCH_BYTES
from riskloom.llm.quotient_filter import entries, from_bytes, half_bits, merge, pack, permute, restore, to_bytes, unpack

SCHEMA = "doc_id long, text string, lang string, phrase string, rank string"


def brute(rows, s):
    """(lang, rank, phrase, a, l, r, n, score) of every phrase that stays."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, s.max_words + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        phrases = {p: a for p, a in found.items() if len(p) > 1 and a >= s.min_count}
        kept = []
        for p, a in phrases.items():
            longer = [
                f for q, f in phrases.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * f >= s.inside_percent * a for f in longer):
                continue
            score, k = min((s.score_scale * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[: s.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in df.dtypes[3:]} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


def prose(n, seed, words=40):
    rng = random.Random(seed)
    own = [f"w{i}" for i in range(words)] + ["Äpfel", "ÉTÉ", "New", "York", "x-y", "日本"]
    fixed = ["in New York city", "as well as the other", "New York", "la la la la la"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(own) for _ in range(rng.randint(0, 60))]
        out.append("".join(p + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\x0b"]) for p in parts))
    return out


ROWS = [
    *[(t, "en") for t in prose(120, 1)], *[(t, "de") for t in prose(60, 2)], *[(t, None) for t in prose(60, 3)],
    *[(t, "und") for t in prose(20, 4)], (None, "en"), ("", "en"), ("...", "fr"), (" \t", None), (None, None),
    *[("a hot line of text", "en")] * 300, ("long words " * 20_000, "en"), ("x" * 100_000 + " y", "en"),
]


@pytest.mark.parametrize(
    "s",
    [Settings(), Settings(slice_bytes=2000, shard_entries=50), Settings(min_count=2, top=7, slice_bytes=500, ranked_rows=10),
     Settings(min_count=1, max_words=3, slice_bytes=5000, shard_entries=1), Settings(min_count=3, inside_percent=50, max_words=2)],
)
def test_equals_a_plain_version(make, s):
    rows = [(n, text, lang, "clash", "clash") for n, (text, lang) in enumerate(ROWS)]
    wanted = brute(ROWS, s)
    assert wanted
    assert found(collocations(make(rows, SCHEMA, 5), s)) == wanted


def test_empty_and_wordless_tables(make):
    assert found(collocations(make([], SCHEMA))) == []
    assert found(collocations(make([(1, None, "en", "", ""), (2, " . ", "en", "", ""), (3, "a b", None, "", "")], SCHEMA))) == []


def test_one_frequent_word_only(make):
    rows = [(i, "go go go", "en", "", "") for i in range(40)]
    assert found(collocations(make(rows, SCHEMA))) == brute([("go go go", "en")] * 40, Settings())


@given(st.binary(max_size=200))
def test_words_and_piece_starts(data):
    words, new = words_of(data)
    wanted = []
    for piece in re.split(rb"[.,;:!?\x0A-\x0D]", data.lower()):
        wanted += [(w, k == 0) for k, w in enumerate(re.findall(rb"[^\x20\x09]+", piece))]
    got = [w.as_buffer().to_pybytes() if w.as_buffer() else b"" for w in words.cast("binary")]
    assert list(zip(got, new.tolist(), strict=True)) == wanted


@settings(deadline=None)
@given(st.integers(2, 4), st.integers(1, 31), st.integers(0, 2**32), st.integers(0, 20))
def test_filter_gives_back_every_key_and_count(words, id_bits, seed, shard_bits):
    rng = np.random.default_rng(seed)
    ids = [rng.integers(0, 2**id_bits, 200, dtype=np.uint32) for _ in range(words)]
    h = half_bits(words, id_bits)
    shard_bits = min(shard_bits, h)
    left, right = pack(ids, id_bits)
    assert left.max() < 2**h and right.max() < 2**h
    one, two, inverse = entries(*permute(left, right, h), h)
    assert (one[inverse] == permute(left, right, h)[0]).all()
    counts = rng.choice([1, 2, 254, 255, 256, 2**40], len(one))
    shards = (one >> np.uint64(h - shard_bits)).astype(np.int64)
    held = Counter()
    for shard in np.unique(shards).tolist():
        own = shards == shard
        data = to_bytes(one[own], two[own], counts[own], h, shard_bits)
        a, b, c = from_bytes(data, shard)
        assert (a == one[own]).all() and (b == two[own]).all() and (c == counts[own]).all()
        held.update(dict(zip(zip(*[x.tolist() for x in unpack(*restore(a, b, h), words, id_bits)], strict=True), c.tolist(), strict=True)))
    grams = list(zip(*[x.tolist() for x in ids], strict=True))
    assert set(held) == set(grams)
    assert all(held[g] == counts[inverse[n]] for n, g in enumerate(grams))


def test_merged_filters_add_up():
    rng = np.random.default_rng(1)
    filters = []
    for size in (300, 1, 500):
        left, right = rng.integers(0, 20, size, dtype=np.uint64), rng.integers(0, 20, size, dtype=np.uint64)
        one, two, inverse = entries(left, right, 40)  # 80 bits: two halves
        filters.append((one, two, np.bincount(inverse)))
    left, right, totals, places = merge(filters, 40)
    wanted = Counter()
    for one, two, counts in filters:
        wanted.update(dict(zip(zip(one.tolist(), two.tolist(), strict=True), counts.tolist(), strict=True)))
    keys = list(zip(left.tolist(), right.tolist(), strict=True))
    assert keys == sorted(wanted) and dict(zip(keys, totals.tolist(), strict=True)) == wanted
    for (one, two, _), own in zip(filters, places, strict=True):
        assert (left[own] == one).all() and (right[own] == two).all()


def test_batches_to_workers_are_bounded_while_phrases_are_counted(spark, monkeypatch):
    limit, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(limit, None)
    counted = C.frequent_ngrams

    def watched(docs, settings):
        seen.append(spark.conf.get(limit))
        return counted(docs, settings)

    monkeypatch.setattr(C, "frequent_ngrams", watched)
    C.collocations(spark.createDataFrame([("a b. a b", "en")], "text string, lang string"))
    assert seen == [BATCH_BYTES] and spark.conf.get(limit, None) == before


def test_words_of_a_slice_take_no_number_for_each_byte():
    text = b"some words, and more of them. " * 100_000
    tracemalloc.start()
    words, new = C.words_of(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 600_000 and int(new.sum()) == 200_000
    assert peak < 15 * len(text)
