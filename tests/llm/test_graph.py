"""Connected components next to union-find: heavy nodes, ties, nulls, repeated rows, more edges later."""

import random

import pytest

from riskloom.llm import graph
from riskloom.llm.graph import connected_components, joined_components


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def found(df):
    rows = df.collect()
    out = {r.node: r.component for r in rows}
    assert len(out) == len(rows)
    return out


def shapes(seed):
    rng = random.Random(seed)
    star = [(5000, n) for n in range(5001, 5400)] + [(n, 9000 - n) for n in range(3000, 3100)]
    chain = [(n, n + 1) for n in range(200, 320)]
    rng.shuffle(chain)
    loose = [(rng.randrange(10_000, 10_300), rng.randrange(10_000, 10_300)) for _ in range(160)]
    hub = [(7000 + n, 7400) for n in range(400)]  # the greatest id is the centre
    return [*star, *chain, *loose, *hub, *star[:20], (None, 4), (4, None), (9, 9)]


@pytest.mark.parametrize("heavy", [100, 3])
def test_components(make, monkeypatch, heavy):
    monkeypatch.setattr(graph, "HEAVY_EDGES", heavy)
    monkeypatch.setattr(graph, "HEAVY_SHARE", 10_000)
    edges = shapes(heavy)
    assert found(connected_components(make(edges, "a long, b long", 7))) == brute(edges)


def test_components_of_strings_and_of_nothing(make):
    edges = [(f"{a or 0:08x}", f"{b or 0:08x}") for a, b in shapes(3)]
    assert found(connected_components(make(edges, "a string, b string", 5))) == brute(edges)
    assert found(connected_components(make([], "a long, b long"))) == {}


def test_more_edges_later(make):
    edges = shapes(8)
    early, late = edges[::2], edges[1::2]
    first = connected_components(make(early, "a long, b long"))
    late = [e for e in late if None not in e and e[0] != e[1]]
    want = brute([*early, *late])
    assert found(joined_components(first, make(late, "a long, b long"))) == want
    assert found(joined_components(first, make([], "a long, b long"))) == brute(early)
