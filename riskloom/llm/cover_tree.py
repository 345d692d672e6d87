"""Embedding near-dedup: exact cosine threshold pairs by dual traversal of cover trees.

Distances are angles: unit vectors with a cosine of at least ``t`` are at most ``eps = arccos(t)`` apart. The rows
are dealt into cells by a cover tree over a bounded sample (nested levels, radius halved from level to level, each
row routed to the nearest child), about as many cells as a cell has rows. A cell is split into blocks of bounded
size, so a crowded one is many blocks. Vectors of different lengths are never linked: each length has cells of its
own, of an upper tree of its own where there are many. Rows within ``eps / 2`` of their cell's centre are all
linked with each other: where they are more than a block, such a core has blocks of its own that are not compared
with each other.

Each block is made into a cover tree, and runs of blocks (groups) are written to the shared folder, once. A task
gets the numbers of two groups (or one with itself) and reads both from there: what is shuffled and kept on disk
grows with the rows, not with the pairs of groups. Of two blocks only the nodes meet that can reach the other
block's cell, from either side. The trees are walked at once, level by level: a pair of nodes is dropped when its
centres are further apart than both covering radii and ``eps``, which is first asked of a sketch (a few directions
and the length of the rest) that never makes an angle wider. What reaches the bottom is compared in double
precision; crowded ends in single precision first, and in double where that could decide otherwise. Tasks return
link counts and a spanning forest of their links, never the pairs.

With vectors that have no low-dimensional structure a row can reach a part of the cells only because they are many;
the work still grows faster than the rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import lean, materialize, small_batches
from riskloom.llm.graph import connected_components

THRESHOLD = 0.95
#: The most rows of a sample that shapes an upper tree, and so the most cells; the bytes of its vectors.
SAMPLE = 4096
SAMPLE_BYTES = 32 * 2**20
#: Rows of a length that a task offers for the sample, and bytes of all lengths.
OFFERED, OFFERED_BYTES = 1024, 64 * 2**20
#: Rows of a block, and nodes of it that meet another's as one.
BLOCK = 4096
SHELL = 950
#: A group of blocks: a task holds two. There are at least so many groups where the rows fill as many blocks.
GROUP_ROWS, GROUP_BYTES = 2**16, 32 * 2**20
GROUPS = 12
#: Tasks that compare groups, at most.
MEETINGS = 2048
#: The largest and smallest radius of the trees over blocks.
TOP, LEAF = 0.25, 0.125
#: Directions of a sketch.
SKETCH = 23
#: Rounding allowances of the bounds, in double and single precision; pairs themselves are decided by their own cosine.
_SLACK, _NARROW = 1e-6, 1e-5


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit rows, row by row."""
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(((a - b) ** 2).sum(axis=1)) / 2))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@dataclass
class Level:
    """Nodes of one level: centre rows, covering radii, where each node's children start in the next, and its rows."""

    centres: np.ndarray
    radii: np.ndarray
    starts: np.ndarray
    rows: np.ndarray


@dataclass
class Tree:
    """Rows in leaf order (of any length above zero), and the levels from the root down; a leaf's children are rows.
    Trees that meet have sketches along the same ``basis``."""

    x: np.ndarray
    order: np.ndarray
    levels: list[Level]
    basis: np.ndarray | None = None
    #: What ``_tree_faces`` made.
    faces: dict = field(default_factory=dict, repr=False)

    @cached_property
    def sketch(self) -> np.ndarray:
        return sketches(unit_rows(self.x), self.basis)

    def narrow(self, rows: np.ndarray) -> np.ndarray:
        return unit_rows(self.x[rows]).astype(np.float32)


def sketches(unit: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Unit rows in few columns whose products are never below those of the rows: along ``basis``, and the length of
    what is left."""
    if basis is None:
        return unit.astype(np.float32)
    along = unit @ basis
    rest = np.sqrt(np.maximum(0.0, 1.0 - (along * along).sum(axis=1)))
    return np.column_stack((along, rest)).astype(np.float32)


def sketch_basis(sample: np.ndarray, directions: int = SKETCH) -> np.ndarray | None:
    """The sample's main directions; None: the vectors are short enough to be their own sketch."""
    d = sample.shape[1]
    if d <= directions + 1:
        return None
    main = np.linalg.svd(sample[:1024], full_matrices=False)[2][:directions].T
    return np.linalg.qr(main)[0]


def _split(x: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """Members as groups within ``radius`` of a centre, centres being about more than ``radius`` apart; centre first."""
    rows, near = x[members], np.float32(np.cos(radius))
    owner, cosine = np.full(len(members), -1), np.zeros(len(members), dtype=np.float32)
    centres, left = 0, np.arange(len(members))
    while len(left):
        # The next members that no centre covers; those of them that cover each other are settled first.
        batch = left[:256]
        chosen = []
        apart = rows[batch] @ rows[batch].T < near
        free = np.ones(len(batch), dtype=bool)
        for k in range(len(batch)):
            if free[k]:
                chosen.append(k)
                free &= apart[k]
        new = batch[chosen]
        dots = rows[left] @ rows[new].T
        best = dots.argmax(axis=1)
        top = dots[np.arange(len(left)), best]
        covered = top >= near
        owner[left[covered]], cosine[left[covered]] = centres + best[covered], top[covered]
        owner[new], cosine[new] = np.arange(centres, centres + len(new)), 2.0
        centres += len(new)
        left = left[owner[left] < 0]
    # By owner, and the centre (cosine 2) before the others: the nesting of levels.
    ranked = np.lexsort((-cosine, owner))
    ends = np.flatnonzero(np.diff(owner[ranked])) + 1
    return np.split(members[ranked], ends)


def build_tree(x: np.ndarray, smallest: float, largest: float = 1.0) -> Tree:
    """A cover tree: radii halve from ``largest`` to ``smallest``; a node's first child has the node's own centre."""
    unit = unit_rows(x)
    narrow = unit.astype(np.float32)
    nodes = [np.arange(len(x))]
    shape = []
    radius = largest
    while True:
        sizes = np.array([len(m) for m in nodes])
        ends = np.cumsum(np.concatenate(([0], sizes)))
        members, centres = np.concatenate(nodes), np.array([m[0] for m in nodes])
        radii = np.maximum.reduceat(_angles(unit[np.repeat(centres, sizes)], unit[members]), ends[:-1])
        if radius < smallest or not (radii > _SLACK).any():
            shape.append((centres, radii, ends, ends))
            break
        below, starts = [], [0]
        for group, cover in zip(nodes, radii, strict=True):
            below += _split(narrow, group, radius) if cover > _SLACK else [group]
            starts.append(len(below))
        shape.append((centres, radii, np.array(starts), ends))
        nodes = below
        radius /= 2
    order = np.concatenate(nodes)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return Tree(x[order], order, [Level(place[c], r, s, e) for c, r, s, e in shape])


def _children(starts: np.ndarray, i: np.ndarray, other: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a child of i with a child of j, for each pair of nodes (i, j), in portions."""
    cuts = np.flatnonzero(np.diff(np.cumsum((starts[i + 1] - starts[i]) * (other[j + 1] - other[j])) // _PORTION)) + 1
    for a, b in zip(np.split(i, cuts), np.split(j, cuts), strict=True) if len(i) else []:
        n, m = starts[a + 1] - starts[a], other[b + 1] - other[b]
        size = n * m
        pair = np.repeat(np.arange(len(a)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield starts[a][pair] + inside // m[pair], other[b][pair] + inside % m[pair]


#: Row pairs below two nodes from which on they are compared as a matrix, index pairs of a portion, rows of a matrix;
#: one in so many pairs of nodes, and of rows, is few.
_DENSE, _PORTION, _ROWS, _FEW, _SOME = 4096, 50_000, 512, 32, 100


def _faces(sketch: np.ndarray, radii: np.ndarray, half: float, side: int) -> np.ndarray:
    """Nodes as rows: the product of a left (side -1) and a right (1) one is cos(angle) - cos(both reaches), as far
    as sketches tell; a node's reach is its radius and half of eps. Not below zero: the two may hold a pair."""
    reach = radii + half
    made = np.column_stack((sketch, side * np.cos(reach), np.sin(reach))).astype(np.float32)
    wide = reach > np.pi / 2
    made[wide] = 0.0  # met by any
    made[wide, -1] = 1.0
    return made


def _tree_faces(tree: Tree, level: int, half: float, side: int) -> np.ndarray:
    made = tree.faces.get((level, half, side))
    if made is None:
        nodes = tree.levels[level]
        made = tree.faces[level, half, side] = _faces(tree.sketch[nodes.centres], nodes.radii, half, side)
    return made


def _set(mask: np.ndarray) -> np.ndarray:
    """Places of the few that are set, eight looked at at once."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    some = (8 * np.flatnonzero(flat[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate((some[flat[some]], whole + np.flatnonzero(flat[whole:])))


def _met(left: np.ndarray, right: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Portions of p with a matrix of those q where faces allow a link."""
    facing = right[q].T
    for lo in range(0, len(p), _ROWS):
        some = p[lo : lo + _ROWS]
        yield some, left[some] @ facing >= -_NARROW


def _reachable(one: Tree, at: int, two: Tree, bt: int, p: np.ndarray, q: np.ndarray, eps: float) -> np.ndarray:
    """Whether the nodes' whole centres, too, are near enough."""
    left, right = one.levels[at], two.levels[bt]
    out = np.empty(len(p), dtype=bool)
    for lo in range(0, len(p), _PORTION):
        a, b = p[lo : lo + _PORTION], q[lo : lo + _PORTION]
        dots = _cosines(one, two, left.centres[a], right.centres[b])
        out[lo : lo + _PORTION] = dots >= np.cos(np.minimum(np.pi, left.radii[a] + right.radii[b] + eps)) - _doubt(one)
    return out


def _cosines(one: Tree, two: Tree, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In single precision."""
    x, y = one.x[p].astype(np.float32, copy=False), two.x[q].astype(np.float32, copy=False)
    squares = np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(squares)


def _doubt(tree: Tree) -> float:
    """What single precision may be off by."""
    return (tree.x.shape[1] + 8) * 2.0**-22


def _linked(one: Tree, two: Tree, p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    out = np.empty(len(p), dtype=bool)
    for lo in range(0, len(p), _PORTION):
        a, b = one.x[p[lo : lo + _PORTION]], two.x[q[lo : lo + _PORTION]]
        out[lo : lo + _PORTION] = np.einsum("ij,ij->i", unit_rows(a), unit_rows(b)) >= threshold
    return out


def _matrix(one: Tree, two: Tree, p: np.ndarray, q: np.ndarray, own: bool, threshold: float) -> np.ndarray:
    """Links of rows p with rows q, with later ones only if ``own``: single precision decides but near the threshold."""
    dots = one.narrow(p) @ two.narrow(q).T
    linked = dots >= threshold
    doubt = _set(np.abs(dots - threshold) <= _doubt(one))
    if len(doubt):
        i, j = np.divmod(doubt, linked.shape[1])
        linked[i, j] = _linked(one, two, p[i], q[j], threshold)
    if own:
        linked &= p[:, None] < q[None, :]
    return linked


def _nodes(level: Level) -> np.ndarray:
    """Each row's node."""
    return np.repeat(np.arange(len(level.centres)), np.diff(level.rows))


def _rectangle(left: Level, right: Level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of nodes a, those of nodes b, and which nodes meet."""
    meets = np.zeros((len(left.centres), len(right.centres)), dtype=bool)
    meets[a, b] = True
    return np.flatnonzero(meets.any(axis=1)[_nodes(left)]), np.flatnonzero(meets.any(axis=0)[_nodes(right)]), meets


def _walk(one: Tree, two: Tree | None, threshold: float, p: np.ndarray | None = None, q: np.ndarray | None = None, met: bool = False):
    """Links as (rows, rows, None), or as (rows, rows, matrix) where they are crowded; p, q: nodes below the roots
    that are to meet, all if not given, or pairs of them if they have met; two None: within one, each link once."""
    eps = float(np.arccos(threshold))
    half = eps / 2 + _SLACK
    own = two is None
    two = one if own else two
    level, last = 1, max(len(one.levels), len(two.levels)) - 1
    at, bt = (min(1, len(t.levels) - 1) for t in (one, two))
    p = np.arange(len(one.levels[at].centres)) if p is None else p
    q = np.arange(len(two.levels[bt].centres)) if q is None else q
    pairs = [(p, q)] if met else []
    for some, mask in () if met else _met(_tree_faces(one, at, half, -1), _tree_faces(two, bt, half, 1), p, q):
        if np.count_nonzero(mask) * _FEW > mask.size > _DENSE:
            left, right = one.levels[at], two.levels[bt]
            i, j = (np.flatnonzero(np.diff(x.rows)[nodes] == 1) for x, nodes in ((left, some), (right, q)))
            if len(i) and len(j):
                rows, others = left.centres[some[i]], right.centres[q[j]]
                linked = _matrix(one, two, rows, others, own, threshold)
                if linked.any():
                    yield rows, others, linked
                mask[np.ix_(i, j)] = False
        hits = _set(mask)
        if len(hits):
            i, j = np.divmod(hits, len(q))
            pairs.append((some[i], q[j]))
    meeting = iter(pairs)
    while True:
        found = []
        for a, b in meeting:
            if own:
                a, b = a[a <= b], b[a <= b]
            near = _reachable(one, at, two, bt, a, b, eps)
            found.append((a[near], b[near]))
        if not any(len(f[0]) for f in found):
            return
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        left, right = one.levels[at], two.levels[bt]
        n, m = left.rows[a + 1] - left.rows[a], right.rows[b + 1] - right.rows[b]
        level += 1
        if level <= last:
            # Nodes with hardly fewer children than rows are not worth another level, as pairs cost more than a matrix.
            below, other = (
                t.levels[k].starts if k < min(level, len(t.levels) - 1) else np.arange(len(t.levels[k].centres) + 1)
                for t, k in ((one, at), (two, bt))
            )
            deeper = np.where(n * m > _DENSE, 32, 4) * (below[a + 1] - below[a]) * (other[b + 1] - other[b]) < n * m
        else:
            deeper = np.zeros(len(a), dtype=bool)
        here, total = np.zeros(0), (n * m)[~deeper].sum()
        if total > _DENSE:
            here, there, meets = _rectangle(left, right, a[~deeper], b[~deeper])
        if len(here) and total * _SOME > len(here) * len(there):
            # Most rows that are left are to be compared with most: all with all, and what was ruled out is left out.
            of, others = _nodes(left)[here], _nodes(right)[there]
            for u in range(0, len(there), 8 * _ROWS):
                for v in range(0, len(here), _ROWS):
                    p, q = here[v : v + _ROWS], there[u : u + 8 * _ROWS]
                    linked = _matrix(one, two, p, q, own, threshold)
                    linked &= meets[np.ix_(of[v : v + _ROWS], others[u : u + 8 * _ROWS])]
                    if linked.any():
                        yield p, q, linked
            n[~deeper] = 0
        crowded = ~deeper & (n * m > _DENSE)
        for i, j in zip(a[crowded].tolist(), b[crowded].tolist(), strict=True):
            for u in range(right.rows[j], right.rows[j + 1], 8 * _ROWS):
                q = np.arange(u, min(u + 8 * _ROWS, right.rows[j + 1]))
                for v in range(left.rows[i], left.rows[i + 1], _ROWS):
                    p = np.arange(v, min(v + _ROWS, left.rows[i + 1]))
                    linked = _matrix(one, two, p, q, own, threshold)
                    if linked.any():
                        yield p, q, linked
        few = ~deeper & ~crowded & (n > 0)
        for r, s in _children(left.rows, a[few], right.rows, b[few]):
            if own:
                r, s = r[r < s], s[r < s]
            near = np.einsum("ij,ij->i", one.sketch[r], two.sketch[s]) >= threshold - _NARROW
            r, s = r[near], s[near]
            linked = _linked(one, two, r, s, threshold)
            if linked.any():
                yield r[linked], s[linked], None
        if not deeper.any():
            return
        at, bt = (min(level, len(t.levels) - 1) for t in (one, two))
        meeting = _deeper(_children(below, a[deeper], other, b[deeper]), _tree_faces(one, at, half, -1), _tree_faces(two, bt, half, 1))


def _deeper(pairs: Iterator[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray):
    for p, q in pairs:
        near = np.einsum("ij,ij->i", left[p], right[q]) >= -_NARROW
        yield p[near], q[near]


def dual_traversal(one: Tree, two: Tree | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (in leaf order) with cosine >= threshold, in portions; two None: within one, each pair once."""
    for p, q, linked in _walk(one, two, threshold):
        if linked is None:
            yield p, q
        else:
            i, j = np.nonzero(linked)
            yield p[i], q[j]


class Forest:
    """Components of nodes 0 to n-1 by smallest label, pairs added in portions."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[p], label[q]
            apart = a != b
            if not apart.any():
                return
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label[:] = label[label]


class Tally:
    """Link counts and the forest of rows 0 to n-1."""

    def __init__(self, n: int):
        self.counts, self.forest = np.zeros(n, dtype=np.int64), Forest(n)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        """Into the forest, some time: an addition passes over all labels."""
        self.pending.append((p, q))
        self.held += len(p)
        if self.held > 2**20:
            self.settle()

    def settle(self) -> None:
        if self.pending:
            self.forest.add(*(np.concatenate([x[k] for x in self.pending]) for k in (0, 1)))
            self.pending, self.held = [], 0

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.counts, p, 1)
        np.add.at(self.counts, q, 1)
        self.join(p, q)

    def add_matrix(self, p: np.ndarray, q: np.ndarray, linked: np.ndarray) -> None:
        """Rows p and q, each once, by a matrix of links, most of which join what is joined already."""
        self.counts[p] += linked.sum(axis=1)
        self.counts[q] += linked.sum(axis=0)
        self.settle()
        rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        self.forest.add(p[rows], q[linked[rows].argmax(axis=1)])
        self.forest.add(p[linked[:, columns].argmax(axis=0)], q[columns])
        label = self.forest.label
        if (label[p[rows]] != label[q[columns[0]]]).any() or (label[q[columns]] != label[q[columns[0]]]).any():
            i, j = np.nonzero(linked & (label[p][:, None] != label[q][None, :]))
            self.forest.add(p[i], q[j])


@dataclass(frozen=True)
class Upper:
    """The sample's tree: centres per level with their parents; cells are the last level. And the sketches' basis."""

    centres: list[np.ndarray]
    children: list[list[list[int]]]
    basis: np.ndarray | None

    def route(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and its angle to the cell's centre: the nearest child, level by level."""
        x = unit.astype(np.float32)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(len(self.centres) - 1):
            below, centres = self.children[level], self.centres[level + 1].astype(np.float32)
            new = np.array([c[0] for c in below])[at]
            for node in np.unique(at):
                if len(below[node]) > 1:
                    rows, choice = np.flatnonzero(at == node), np.array(below[node])
                    for lo in range(0, len(rows), _ROWS):
                        some = rows[lo : lo + _ROWS]
                        new[some] = choice[(x[some] @ centres[choice].T).argmax(axis=1)]
            at = new
        return at, _angles(unit, self.centres[-1][at])


def upper_tree(sample: np.ndarray, most: int = SAMPLE) -> Upper:
    """Levels of the sample's cover tree while they have at most ``most`` nodes."""
    tree = build_tree(sample, TOP)  # closer centres would part a crowd whose rows are all linked
    kept = [level for level in tree.levels if len(level.centres) <= most] or tree.levels[:1]
    centres = [unit_rows(tree.x[level.centres]) for level in kept]
    children = [[list(range(a, b)) for a, b in zip(level.starts[:-1], level.starts[1:], strict=True)] for level in kept[:-1]]
    return Upper(centres, children, sketch_basis(unit_rows(sample)))


def _usable(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of the usable vectors of a batch. Vectors are scaled by a power of two to a norm
    between a half and one, which changes no cosine."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)  # null becomes NaN
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = values.reshape(-1, d) if len(rows) * d == len(values) else values[starts[rows][:, None] + np.arange(d)]
        with np.errstate(all="ignore"):
            norm = (x.astype(np.float64) ** 2).sum(axis=1)
            good = np.isfinite(x).all(axis=1) & (norm > 0) & (norm < np.inf)
        x, rows = x[good], rows[good]
        if len(rows):
            yield d, rows, np.ldexp(x, -np.frexp(np.sqrt(norm[good]))[1][:, None])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many usable vectors of each length there are, and some of them with a random place."""
    draw = np.random.default_rng(TaskContext.get().partitionId())
    counts: dict[int, int] = {}
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held = 0
    for batch in batches:
        for d, _, x in _usable(batch.column(0)):
            counts[d] = counts.get(d, 0) + len(x)
            if d not in kept and held > OFFERED_BYTES:
                continue
            places = draw.random(len(x))
            if d in kept:
                held -= kept[d][1].nbytes
                places, x = np.concatenate((kept[d][0], places)), np.concatenate((kept[d][1], x))
            least = np.argsort(places)[:OFFERED]
            kept[d] = places[least], x[least]
            held += kept[d][1].nbytes
    schema = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("place", pa.float64()), ("v", pa.binary())])
    for d, n in counts.items():
        places, x = kept.get(d, (np.zeros(0), np.zeros((0, d))))
        columns = [d] * (1 + len(x)), [n] + [0] * len(x), [None, *places.tolist()], [None, *(v.tobytes() for v in x)]
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, columns, strict=True)), schema=schema)


def _shells(tree: Tree, apart: np.ndarray) -> list[tuple[int, int, float]]:
    level = tree.levels[min(1, len(tree.levels) - 1)]
    far = np.maximum.reduceat(apart, level.rows[:-1])
    ends = np.linspace(0, len(far), max(1, round(len(far) / SHELL)) + 1).astype(int).tolist()
    return [(a, b, float(far[a:b].max())) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _build(shared, kind: str):
    """Blocks of a group as trees. A block: its length, cell, tree, shells, rows."""

    def build(group: pa.Table) -> pa.Table:
        uppers = shared.value
        blocks, rows, apart = (group.column(c).to_numpy() for c in ("block", "row", "apart"))
        sizes, cells = group.column("d").to_numpy(), group.column("cell").to_numpy()
        vectors = group.column("v").combine_chunks()
        order = np.lexsort((rows, apart, blocks))
        starts = np.flatnonzero(np.diff(blocks[order], prepend=-1))
        out = []
        for members in np.split(order, starts[1:]):
            d, cell = int(sizes[members[0]]), int(cells[members[0]])
            x = np.frombuffer(b"".join(vectors.take(pa.array(members)).to_pylist()), dtype=kind).reshape(-1, d)
            tree = build_tree(x, LEAF, TOP)
            out.append(pickle.dumps((d, cell, tree, _shells(tree, apart[members][tree.order]), rows[members][tree.order]), protocol=5))
        number = group.column("group")[0].as_py()
        return pa.table({"group": [number] * len(out), "block": blocks[order][starts], "tree": out}, schema=_TREES)

    return build


_TREES = pa.schema([("group", pa.int32()), ("block", pa.int64()), ("tree", pa.binary())])


@dataclass
class Block:
    number: int
    d: int
    cell: int
    tree: Tree
    #: Nodes below the root as ranges, by their distance from the cell's centre where they are single rows, and the
    #: largest distance of each range's rows.
    shells: list[tuple[int, int, float]]
    rows: np.ndarray
    #: Where its rows start among those of its group.
    start: int = 0


@dataclass(frozen=True)
class Plan:
    """What tasks know: upper trees by length with their first cells; of each group by length the centres and
    reaches of its cells, and its files; the first block that is a core's by cell; pairs of groups."""

    uppers: dict[int, tuple[int, Upper | None]]
    cells: list[dict[int, tuple[np.ndarray, np.ndarray]]]
    files: dict[int, list[str]]
    cores: dict[int, int]
    pairs: np.ndarray
    threshold: float

    def centre(self, d: int, cell: int) -> np.ndarray:
        start, upper = self.uppers[d]
        return np.zeros(d) if upper is None else upper.centres[-1][cell - start]

    @property
    def half(self) -> float:
        return float(np.arccos(self.threshold)) / 2 + _SLACK

    def is_core(self, block: Block) -> bool:
        return block.cell in self.cores and block.number >= self.cores[block.cell]


class Part:
    """The blocks of one length of a group, and the nodes below their roots in one row."""

    def __init__(self, blocks: list[Block], half: float):
        self.blocks, self.half = blocks, half
        levels = [b.tree.levels[min(1, len(b.tree.levels) - 1)] for b in blocks]
        #: The first node of each block.
        self.offsets = np.cumsum([0] + [len(x.centres) for x in levels])
        self.unit = np.concatenate([b.tree.narrow(x.centres) for b, x in zip(blocks, levels, strict=True)])
        self.radii = np.concatenate([x.radii for x in levels])
        #: Block, nodes and reach.
        self.shells = [(k, lo + a, lo + b, far) for k, lo in enumerate(self.offsets[:-1].tolist()) for a, b, far in blocks[k].shells]
        self.made: dict[int, np.ndarray] = {}

    def faces(self, side: int) -> np.ndarray:
        if side not in self.made:
            levels = [b.tree.levels[min(1, len(b.tree.levels) - 1)] for b in self.blocks]
            sketch = [sketches(unit_rows(b.tree.x[x.centres]), b.tree.basis) for b, x in zip(self.blocks, levels, strict=True)]
            self.made[side] = _faces(np.concatenate(sketch), self.radii, self.half, side)
        return self.made[side]


def _read(plan: Plan, group: int) -> list[Part]:
    """The blocks of a group by length; none if the hash gave it no rows."""
    found = []
    for uri in plan.files.get(group, []):
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as file:
            part = pq.ParquetFile(file)
            for k in range(part.num_row_groups):
                table = part.read_row_group(k, columns=["block", "tree"])
                for number, tree in zip(table.column("block"), table.column("tree"), strict=True):
                    found.append(Block(number.as_py(), *pickle.loads(tree.as_buffer())))
    found.sort(key=lambda b: b.number)
    start = 0
    for block in found:
        block.start, start = start, start + len(block.rows)
        upper = plan.uppers[block.d][1]
        block.tree.basis = upper.basis if upper else None
    return [Part([b for b in found if b.d == d], plan.half) for d in sorted({b.d for b in found})]


def _within(dots: np.ndarray, reach: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether angles of these cosines are at most both reaches."""
    fits = dots - np.outer(np.cos(reach), np.cos(other)) + np.outer(np.sin(reach), np.sin(other)) >= -_NARROW
    fits[reach > np.pi / 2] = True
    fits[:, other > np.pi / 2] = True
    return fits


def _near_groups(plan: Plan, a: int, b: int) -> bool:
    """Whether some cell of one group can reach some cell of the other."""
    for d in plan.cells[a].keys() & plan.cells[b].keys():
        (x, reach), (y, other) = plan.cells[a][d], plan.cells[b][d]
        if _within(x @ y.T, reach + plan.half, other + plan.half).any():
            return True
    return False


def _facing(plan: Plan, mine: Part, other: Part) -> np.ndarray:
    """Which of my nodes (columns) can reach the rows of the other's shells (rows)."""
    owners = [other.blocks[k] for k, *_ in other.shells]
    centres = np.stack([plan.centre(b.d, b.cell) for b in owners]).astype(np.float32)
    reach = np.array([far if plan.uppers[b.d][1] else np.pi for b, (_, _, _, far) in zip(owners, other.shells, strict=True)]) + plan.half
    out = np.empty((len(centres), len(mine.radii)), dtype=bool)
    for lo, hi in zip(mine.offsets[:-1], mine.offsets[1:], strict=True):
        out[:, lo:hi] = _within(centres @ mine.unit[lo:hi].T, reach, mine.radii[lo:hi] + plan.half)
    return out


def _meetings(plan: Plan, first: Part, second: Part) -> Iterator[tuple]:
    """Blocks of two parts, or of one, with the nodes that are to meet, and whether as pairs that have met; all nodes
    (None) if a block meets itself."""
    own = first is second
    if own:
        yield from ((b, b, None, None, False) for b in first.blocks if not plan.is_core(b))
    mine = _facing(plan, first, second)
    theirs = mine if own else _facing(plan, second, first)
    left, right = first.faces(-1), second.faces(1)
    starts, ends = (np.array([shell[k] for shell in second.shells]) for k in (1, 2))
    apart = float(np.arccos(plan.threshold))
    for s, (i, lo, hi, _) in enumerate(first.shells):
        one, found = first.blocks[i], []
        # What of this shell reaches each of the other shells, and what of those reaches this one.
        t_of, p = np.divmod(np.flatnonzero(mine[:, lo:hi]), hi - lo)
        p += lo
        q = np.flatnonzero(theirs[s])
        p_ends = np.searchsorted(t_of, np.arange(len(starts) + 1)).tolist()
        q_starts, q_ends = np.searchsorted(q, starts).tolist(), np.searchsorted(q, ends).tolist()
        faces, facing = left[p], right[q]
        for t, (j, _, _, _) in enumerate(second.shells):
            here, there = slice(p_ends[t], p_ends[t + 1]), slice(q_starts[t], q_ends[t])
            if here.start == here.stop or there.start == there.stop or (own and i >= j):
                continue
            two = second.blocks[j]
            if one.cell == two.cell and plan.is_core(one) and plan.is_core(two):
                continue
            mask = faces[here] @ facing[there].T >= -_NARROW
            some = np.count_nonzero(mask)
            if some * _FEW > mask.size > _DENSE:
                yield one, two, p[here] - first.offsets[i], q[there] - second.offsets[j], False
            elif some:
                a, b = np.divmod(_set(mask), mask.shape[1])
                found.append((p[here][a], q[there][b]))
        if found:
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            near = np.empty(len(a), dtype=bool)
            for u in range(0, len(a), _PORTION):
                x, y = a[u : u + _PORTION], b[u : u + _PORTION]
                reach = np.cos(np.minimum(np.pi, first.radii[x] + second.radii[y] + apart))
                near[u : u + _PORTION] = np.einsum("ij,ij->i", first.unit[x], second.unit[y]) >= reach - 2 * _doubt(one.tree)
            a, b = a[near], b[near]
            to = np.searchsorted(second.offsets, b, side="right") - 1
            for j in np.unique(to).tolist():
                yield one, second.blocks[j], a[to == j] - first.offsets[i], b[to == j] - second.offsets[j], True


def _meet(plan: Plan, first: list[Part], second: list[Part]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows a linked with n others, and joins of rows a and b (n is 0), by the blocks of two groups or of one."""
    own = first is second
    ids = [b.rows for part in ([*first] if own else [*first, *second]) for b in part.blocks]
    every = np.concatenate(ids)
    shift = 0 if own else sum(len(b.rows) for part in first for b in part.blocks)
    tally = Tally(len(every))
    for part, other in ((x, y) for x in first for y in second if x.blocks[0].d == y.blocks[0].d):
        for one, two, p, q, met in _meetings(plan, part, other):
            x, y = one.start, shift + two.start
            for r, t, linked in _walk(one.tree, None if one is two else two.tree, plan.threshold, p, q, met):
                if linked is None:
                    tally.add(x + r, y + t)
                else:
                    tally.add_matrix(x + r, y + t, linked)
    tally.settle()
    counts, label = tally.counts, tally.forest.label
    some, joined = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(every)))
    return (
        np.concatenate((every[some], every[joined])),
        np.concatenate((every[some], every[label[joined]])),
        np.concatenate((counts[some], np.zeros(len(joined), dtype=np.int64))),
    )


def _compare(shared):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        held: tuple[int, list[Part]] | None = None
        for batch in batches:
            for k in batch.column(0).to_numpy().tolist():
                a, b = plan.pairs[k].tolist()
                if a != b and not _near_groups(plan, a, b):
                    continue
                if held is None or held[0] != a:
                    held = None  # before the next is read
                    held = a, _read(plan, a)
                second = held[1] if a == b else _read(plan, b)
                if not held[1] or not second:
                    continue
                found = _meet(plan, held[1], second)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b", "n"])

    return compare


def _router(shared):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, cell, apart = np.zeros(n, dtype=np.int32), np.full(n, -1), np.zeros(n)
            vectors: list = [None] * n
            for d, rows, x in _usable(batch.column(2)):
                if d not in shared.value:
                    continue
                start, upper = shared.value[d]
                size[rows], cell[rows] = d, start
                if upper is not None:
                    at, apart[rows] = upper.route(unit_rows(x))
                    cell[rows] += at
                for row, vector in zip(rows.tolist(), x, strict=True):
                    vectors[row] = vector.tobytes()
            alone = cell < 0
            columns = [batch.column(0), batch.column(1), *(pa.array(c, mask=alone) for c in (size, cell, apart))]
            columns.append(pa.array(vectors, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "row", "d", "cell", "apart", "v"])

    return route


def _groups(blocks: list[tuple[int, float]], block: int, width: int) -> list[int]:
    """The group of each block, in their order; blocks are lengths and rows, expected ones."""
    most = min(GROUP_ROWS, max(block, -(-int(sum(n for _, n in blocks)) // GROUPS)))
    out, group, rows, size = [], 0, 0.0, 0.0
    for d, n in blocks:
        if rows and (rows + n > most or size + n * d * width > GROUP_BYTES):
            group, rows, size = group + 1, 0.0, 0.0
        out.append(group)
        rows, size = rows + n, size + n * d * width
    return out


def near_duplicates(
    vectors: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``vectors`` (vec_id, embedding; others are ignored).

    Vectors that are null, empty, zero, or hold null or non-finite components have no links and are their own
    component. Vectors link with those of their own length only, whatever lengths a table holds. Repeated rows
    link with each other like any others; a null vec_id is possible, a component of null ids has a null id. An
    empty table gives an empty result. ``vectors`` is read twice. Tasks read trees by Arrow from the folder in
    ``spark.checkpoint.dir``.
    """
    spark = vectors.sparkSession
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, width = ("<f4", 4) if narrow else ("<f8", 8)
    embedding = F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding")
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding)
    with small_batches(spark):
        survey = materialize(typed.select("embedding").mapInArrow(lean(_survey), "d int, n long, place double, v binary"))
    # A length of one vector has no pair.
    sizes = {r.d: r.n for r in survey.groupBy("d").agg(F.sum("n").alias("n")).filter("n > 1").collect()}
    if not sizes:
        vec_id = F.col("vec_id")
        return typed.select(vec_id, F.lit(0).cast("long").alias("n_links"), vec_id.alias("component_id"), F.lit(True).alias("kept"))
    uppers: dict[int, tuple[int, Upper | None]] = {}
    total = 0
    for d in sorted(sizes):
        upper = None  # one cell, which fits a block
        if sizes[d] > block:
            most = max(1, min(sample, max(64, isqrt(sizes[d])), SAMPLE_BYTES // (8 * d)))
            chosen = survey.filter((F.col("d") == d) & F.col("v").isNotNull()).orderBy("place").limit(most).select("v").toArrow()
            upper = upper_tree(np.frombuffer(b"".join(chosen.column(0).to_pylist()), dtype=kind).reshape(-1, d), most)
        uppers[d] = total, upper
        total += 1 if upper is None else len(upper.centres[-1])
    known = spark.sparkContext.broadcast(uppers)
    # A row number of its own for each row: ids may repeat or be null.
    numbered = typed.select("vec_id", F.monotonically_increasing_id().alias("row"), "embedding")
    with small_batches(spark):
        routed = materialize(numbered.mapInArrow(lean(_router(known)), "vec_id long, row long, d int, cell long, apart double, v binary"))
    # Two rows as near as this are linked for certain.
    within = float(np.arccos(threshold)) / 2 - _SLACK
    core = F.col("apart") <= within
    reach = F.max(F.when(~core, F.col("apart"))).alias("reach")
    found_cells = routed.filter("cell IS NOT NULL").groupBy("cell", "d")
    found_cells = found_cells.agg(F.count("*").alias("n"), F.count_if(core).alias("inner"), reach, F.max("apart").alias("all"))
    numbers, cores, blocks = [], {}, []
    for r in sorted(found_cells.collect(), key=lambda r: r.cell):
        inner = r.inner if r.inner > block else 0
        plain, extra = -(-(r.n - inner) // block), -(-inner // block)
        numbers.append((r.cell, len(blocks), plain, len(blocks) + plain, extra, inner))
        if extra:
            cores[r.cell] = len(blocks) + plain
        blocks += [(r.d, (r.n - inner) / max(1, plain), r.cell, r.reach if extra else r.all)] * plain
        blocks += [(r.d, inner / max(1, extra), r.cell, within)] * extra
    group_of = _groups([(d, n) for d, n, _, _ in blocks], block, width)
    n_groups = group_of[-1] + 1
    members: list[dict[int, dict[int, float]]] = [{} for _ in range(n_groups)]
    for (d, _, cell, far), g in zip(blocks, group_of, strict=True):
        own = members[g].setdefault(d, {})
        own[cell] = max(far, own.get(cell, 0.0))
    # Crowded cells are many blocks, dealt by a hash of the row.
    cell_rows = spark.createDataFrame(numbers, "cell long, start long, plain long, inner_start long, extra long, inner long")
    group_rows = spark.createDataFrame(list(enumerate(group_of)), "block long, group int")
    dealt = routed.filter("cell IS NOT NULL").join(F.broadcast(cell_rows), "cell")
    inside = core & (F.col("extra") > 0)
    start, n = (F.when(inside, F.col(a)).otherwise(F.col(b)) for a, b in (("inner_start", "start"), ("extra", "plain")))
    placed = dealt.withColumn("block", start + F.pmod(F.xxhash64("row"), F.greatest(n, F.lit(1))))
    placed = placed.join(F.broadcast(group_rows), "block").select("group", "block", "row", "d", "cell", "apart", "v")
    trees = materialize(placed.groupBy("group").applyInArrow(_build(known, kind), "group int, block long, tree binary"), "group")
    files: dict[int, list[str]] = {}
    for uri in trees.inputFiles():
        files.setdefault(int(re.search(r"/group=(\d+)/", uri)[1]), []).append(re.sub("^s3[an]:", "s3:", uri))
    lengths = [sorted(m) for m in members]
    pairs = [(a, b) for a in range(n_groups) for b in range(a, n_groups) if lengths[b][0] <= lengths[a][-1]]
    plan = Plan(uppers, [], files, cores, np.array(pairs), threshold)
    for m in members:
        reaches = {d: np.array([far if uppers[d][1] else np.pi for far in own.values()]) for d, own in m.items()}
        plan.cells.append({d: (np.stack([plan.centre(d, c) for c in own]).astype(np.float32), reaches[d]) for d, own in m.items()})
    shared = spark.sparkContext.broadcast(plan)
    meetings = spark.range(0, len(pairs), 1, min(len(pairs), MEETINGS))
    found = materialize(meetings.mapInArrow(lean(_compare(shared)), "a long, b long, n long"))
    if cores:
        inner = dealt.filter(inside).select("row", "cell", "inner")
        first = inner.groupBy("cell").agg(F.min("row").alias("first"))
        inner = inner.join(F.broadcast(first), "cell")
        counted = inner.select(F.col("row").alias("a"), F.col("row").alias("b"), (F.col("inner") - 1).alias("n"))
        joined = inner.select(F.col("row").alias("a"), F.col("first").alias("b"), F.lit(0).cast("long").alias("n"))
        found = found.unionByName(counted).unionByName(joined)
    counts = found.filter("n > 0").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n_links"))
    components = connected_components(found.filter("n = 0").select("a", "b"))
    result = routed.select("vec_id", "row")
    named = result.join(counts, "row", "left").join(components.withColumnRenamed("node", "row"), "row", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "row")))
    least = materialize(named.filter("n_links IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("component_id")))
    out = named.join(least, "component", "left")
    component_id = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.col("vec_id").eqNullSafe(component_id).alias("kept"),
    )
