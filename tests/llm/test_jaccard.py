import random

import numpy as np
import pyarrow as pa

from riskloom.llm import jaccard_join as j
from riskloom.llm.graph import connected_components
from riskloom.llm.shingles import shingle_set, word_hashes


def shingles(text, k=5):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return sorted(((i, len(sets[n]), i if not sets[n] else least.get(root(n))) for n, (i, _) in enumerate(rows)), key=repr)


def corpus(seed, n=160):
    draw = random.Random(seed)
    word = lambda: "w%d" % draw.randrange(4000)
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(draw.choice([5, 8, 30, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4, 8])):
            words[draw.randrange(len(words))] = word()
        if draw.random() < 0.3:
            at = draw.randrange(len(words))
            words[at:at] = passage
        text = " ".join(words)
        rows.append((i, text.upper() if draw.random() < 0.2 else text.replace(" ", "\n\t", 3)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, "one two three four five"), (7, rows[7][1]), (None, rows[9][1])]


def same(make, rows, settings):
    table = make([(i, t, "x") for i, t in rows], "doc_id long, text string, n_shingles string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_components(table, settings).collect()), key=repr)
    assert got == brute(rows)


def test_equals_brute_force(make):
    same(make, corpus(1), j.Settings())


def test_equals_brute_force_with_many_frequent_shingles(make):
    """Everything found thrice is frequent, buckets are dealt over parts, and most sets are heavy."""
    same(make, corpus(2), j.Settings(frequent=3, local_count=2, max_combined=3, part_members=4, marked_log2=15))


def test_near_copies_of_near_copies(make):
    """A chain whose ends are not similar, within one crowded set of buckets."""
    words = ["w%d" % k for k in range(100)]
    rows = [(k, " ".join(words[k * 3 : k * 3 + 64])) for k in range(12)]
    same(make, rows, j.Settings(frequent=3, local_count=2, max_combined=2))


def test_empty_table(make):
    assert j.jaccard_components(make([], "doc_id long, text string")).count() == 0


def test_hashes():
    text = ("Alpha  béta\tGAMMA delta epsilon zeta " * 50000).encode()
    assert len(word_hashes(text)) == 300000
    assert len(shingle_set(text)) == 6
    assert len(shingle_set(("x" * 3_000_000 + " b c d e").encode())) == 1
    assert word_hashes(b"ab c")[0] == word_hashes(b" \n AB  ")[0] and len(word_hashes(b" ")) == 0
    assert len(np.unique(word_hashes(b"ab ba a b aab aba baa"))) == 7


def test_components(make):
    draw = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(90)]
    edges += [(None, 3), (5, None), (8, 8)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(make(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_a_cut_bucket_keeps_its_last_member():
    """A bucket that goes on over several batches, whatever is left of it after a cut, gives all its members."""
    for held in (2, 3, 5):
        for n in range(3, 12):
            for step in (1, 2, 4):
                # A bucket before, of two: no members; the long one; one alone after it.
                buckets = [1, 1] + [2] * n + [3]
                columns = [np.array(buckets), np.arange(len(buckets)), np.arange(len(buckets))]
                columns += [np.full(len(buckets), v, dtype=np.int32) for v in (j._RARE, 50, 0)]
                whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "k1", "k2", "kind", "n", "pos"])
                batches = [whole.slice(k, step) for k in range(0, len(buckets), step)]
                rows = [r for b in j._meet(j.Settings(held_members=held))(iter(batches)) for r in b.to_pylist()]
                members = {(r["bucket"], r["k1"]) for r in rows if r["big"]}
                assert members == {(2, k) for k in range(2, n + 2)}, (held, n, step)
                assert {r["k1"] for r in rows if not r["big"]} == {1, *range(3, n + 2)}
