import random

import numpy as np

from riskloom.llm import cover_tree as c


def vectors(seed, n=500, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, d))
    x = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.2, 0.5], size=(n, 1))
    x[10] = x[11] = x[12]
    x[13] = x[10] * 7
    return x.astype(np.float32)


def brute(rows, threshold=0.95):
    links = {k: set() for k in range(len(rows))}
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(a is not None and np.isfinite(a) for a in v) and any(v):
            u = np.array(v, dtype=np.float64)
            unit[k] = u / np.sqrt((u * u).sum())
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a].add(b)
                links[b].add(a)
    seen, out = {}, []
    for k in links:
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for o in links[todo.pop()] - group:
                    group.add(o)
                    todo.append(o)
            ids = [rows[g][0] for g in group if rows[g][0] is not None]
            for g in group:
                seen[g] = min(ids) if ids else None
    for k, (i, _) in enumerate(rows):
        root = seen[k] if links[k] else i
        out.append((i, len(links[k]), root, i == root))
    return sorted(out, key=repr)


def compare(make, rows, **sizes):
    table = make([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in c.near_duplicates(table, **sizes).collect()), key=repr)
    assert got == brute(rows)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(9000, None), (9001, []), (9002, [0.0] * 6), (9003, [nan] + [1.0] * 5), (9004, [inf] + [1.0] * 5), (9005, [None] + [1.0] * 5)]


def test_equals_brute_force(make):
    rows = [(k * 3, v.tolist()) for k, v in enumerate(vectors(1))]
    compare(make, rows + odd_rows() + [(0, rows[0][1]), (None, rows[5][1])])


def test_small_blocks_and_cells(make):
    """Many blocks, a sample that shapes several cells, and a group of copies that fills blocks."""
    x = vectors(2, 300)
    x[100:200] = x[100] + np.random.default_rng(3).normal(size=(100, 6)).astype(np.float32) * 0.01
    compare(make, [(k, v.tolist()) for k, v in enumerate(x)], sample=40, block=30)


def test_traversal_prunes_and_finds_all():
    for d, seed in ((2, 1), (5, 2), (32, 3)):
        x = vectors(seed, 400, d).astype(np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        one, two = c.build_tree(x[:250], c.LEAF), c.build_tree(x[250:], c.LEAF)
        for level, below in zip(one.levels, one.levels[1:]):
            assert set(level.centres) <= set(below.centres)  # nested
            assert len(level.starts) == len(level.centres) + 1 and level.starts[-1] == len(below.centres)
        got = {(int(one.order[i]), int(two.order[j])) for p, q in c.dual_traversal(one, two, 0.95) for i, j in zip(p, q)}
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(x[:250] @ x[250:].T >= 0.95))}


def test_forest():
    draw = random.Random(1)
    pairs = [(draw.randrange(100), draw.randrange(100)) for _ in range(70)]
    forest = c.Forest(100)
    for k in range(0, 70, 9):
        part = np.array(pairs[k : k + 9])
        forest.add(part[:, 0], part[:, 1])
    parent = list(range(100))
    for _ in range(100):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert forest.label.tolist() == parent


def test_nothing_to_compare(make):
    compare(make, odd_rows())
    compare(make, [(1, [1.0, 2.0])])
    assert c.near_duplicates(make([], "vec_id long, embedding array<float>")).count() == 0


def test_lengths_apart_each_with_its_links(make):
    """Three lengths that hold copies and near copies: all in one cell each, and with many blocks a length."""
    rows = [(k, v.tolist()) for k, v in enumerate(vectors(4, 200))]
    rows += [(1000 + k, v.tolist()) for k, v in enumerate(vectors(5, 120, 4))]
    rows += [(2000, [1.0, 2.0]), (2001, [1.0, 2.0]), (2002, [2.0, 4.1]), (None, [1.0, 2.0]), (3000, [5.0])]
    rows += [(4000 + k, rows[0][1][:5]) for k in range(2)]  # another length, the same first components
    compare(make, rows + odd_rows())
    compare(make, rows, sample=40, block=30)


def test_blocks_meet_without_a_shuffle(make, monkeypatch, capsys):
    """A block meets many others: it is read by the tasks, not dealt out once for each."""
    plans = []

    def spy(df, *by):
        if df.columns == ["a", "b", "n"]:
            capsys.readouterr()
            df.explain()
            plans.append(capsys.readouterr().out)
        return written(df, *by)

    written = c.materialize
    monkeypatch.setattr(c, "materialize", spy)
    compare(make, [(k, v.tolist()) for k, v in enumerate(vectors(10, 300))], sample=20, block=30)
    assert plans and not any("Exchange" in plan for plan in plans)


def test_crowd_around_its_cell(make):
    """A crowd of several blocks, part of it within half of eps of its centre, part of it just outside, and copies."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(260, 12))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[60:] = x[7] + rng.normal(size=(200, 12)) * rng.choice([0.0, 0.02, 0.045, 0.07], size=(200, 1))
    compare(make, [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], sample=10, block=25)


def test_crowded_matrix_equals_pairs():
    rng = np.random.default_rng(7)
    x = rng.normal(size=20) + rng.normal(size=(400, 20)) * rng.choice([0.1, 0.25], size=(400, 1), p=[0.7, 0.3])
    one, two = c.build_tree(x[:240], c.LEAF, c.TOP), c.build_tree(x[240:], c.LEAF, c.TOP)
    u, v = c.unit_rows(one.x), c.unit_rows(two.x)
    kinds, tally, plain = set(), c.Tally(400), c.Tally(400)
    for p, q, linked in c._walk(one, two, 0.95):
        kinds.add(linked is None)
        if linked is None:
            tally.add(p, 240 + q)
        else:
            tally.add_matrix(p, 240 + q, linked)
    i, j = np.nonzero(u @ v.T >= 0.95)
    plain.add(i, 240 + j)
    tally.settle()
    plain.settle()
    assert False in kinds and 0 < len(i) < 240 * 160
    assert tally.counts.tolist() == plain.counts.tolist() and tally.forest.label.tolist() == plain.forest.label.tolist()
    within = {(int(i), int(j)) for p, q in c.dual_traversal(one, None, 0.95) for i, j in zip(p, q)}
    assert within == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.95, 1)))}


def test_crowd_of_single_rows():
    """Rows further apart than the radius of nodes, most near the threshold: met as a matrix at once, also within one."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=64)
    x = x / np.sqrt(x @ x) + rng.normal(size=(240, 64)) * 0.23 / 8
    one, two = c.build_tree(x[:140], c.LEAF, c.TOP), c.build_tree(x[140:], c.LEAF, c.TOP)
    assert any(linked is not None for _, _, linked in c._walk(one, two, 0.95))
    for other, dots in ((two, c.unit_rows(one.x) @ c.unit_rows(two.x).T), (None, np.triu(c.unit_rows(one.x) @ c.unit_rows(one.x).T, 1))):
        got = [(int(i), int(j)) for p, q in c.dual_traversal(one, other, 0.95) for i, j in zip(p, q)]
        assert sorted(got) == [(int(i), int(j)) for i, j in zip(*np.nonzero(dots >= 0.95))]
        assert 1000 < len(got) < dots.size / 1.2


def test_sketches_and_faces_drop_no_pair():
    x = vectors(8, 300, 40).astype(np.float64)
    unit = c.unit_rows(x)
    sketch = c.sketches(unit, c.sketch_basis(unit, 5))
    assert sketch.shape == (300, 6) and (sketch @ sketch.T >= unit @ unit.T - 1e-5).all()
    assert c._set(sketch @ sketch.T >= 0.9).tolist() == np.flatnonzero(sketch @ sketch.T >= 0.9).tolist()


def test_doubles_of_any_scale(make):
    """Vectors of doubles, some many powers of ten longer than others."""
    x = vectors(9, 90, 5).astype(np.float64) * 10.0 ** np.random.default_rng(9).integers(-60, 60, size=(90, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    table = make(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in c.near_duplicates(table, sample=20, block=30).collect()), key=repr)
    assert got == brute(rows) and any(r[1] for r in got)


def test_groups_hold_whole_blocks():
    assert c._groups([(4, 25.0)] * 6, 50, 8) == [0, 0, 1, 1, 2, 2]
    assert c._groups([(2**20, 30.0)] * 2, 30, 8) == [0, 1]
