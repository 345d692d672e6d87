"""N-gram Jaccard join by token-combination prefixes.

Shingle sets are ordered by a global order that puts frequent shingles last. Two sets with a Jaccard
similarity of ``t`` share a shingle in their prefixes of ``n - ceil(t n) + 1``, and two shingles in prefixes
one longer. Hence:

* rare shingles of the prefix are indexed alone;
* frequent ones of the longer prefix are indexed as two-shingle combinations, which only sets that share
  both meet in. A set with more than ``MAX_COMBINED`` frequent prefix shingles would have too many
  combinations; it is indexed by its frequent shingles alone and meets all sets there.

Which shingles are frequent only decides the order and the kind of index, so it may come from counts that
are bounded in size; every pair of similar sets meets in some bucket whatever they say.

Equal sets are one entity from the start. A bucket does not emit its pairs: each member is paired with the
bucket's pivots (a few per bucket). Pairs whose sizes and parity bits allow the similarity are verified on the
whole sets, one pair per set first; links become components. Then only pairs across components are looked at:
the others of the buckets' pairs, and in buckets that still hold members of different components those outside
the largest against the rest, a component at a time. So every pair of similar sets is verified or already in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import lean, long_lists, materialize, portions
from riskloom.llm.graph import connected_components, joined_components
from riskloom.llm.shingles import mix, shingle_set


@dataclass(frozen=True)
class Settings:
    """``percent``: of the union that the intersection must have. The others change cost only."""

    size: int = 5
    percent: int = 80
    max_combined: int = 6
    #: A task reports a shingle found in so many of the sets it counts at a time.
    local_count: int = 3
    local_tokens: int = 1_000_000
    #: Reported counts from which a shingle is frequent, and how many of the most frequent are told to tasks.
    frequent: int = 16
    max_frequent: int = 2**19
    #: A frequent shingle's bucket is dealt over parts of about this many members.
    part_members: int = 4096
    #: A bucket of more members than this is met in portions, each with the bucket's pivot.
    held_members: int = 50_000
    #: log2 of the bits that mark sets in need of verification (4 MB).
    marked_log2: int = 25


_RARE, _COMBINED, _LIGHT, _HEAVY = 0, 1, 2, 3
_POSTING = "bucket long, k1 long, k2 long, kind int, n int, pos int"
_CANDIDATE = "big boolean, bucket long, k1 long, k2 long, kind int, n int, pos int, o1 long, o2 long, on int"
_PARITIES, _MOST_PARITIES = 2048, 2**17
_NO_ID = -(2**63)
_U64 = np.uint64


def _key(tokens: np.ndarray) -> tuple[int, int]:
    k = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), dtype=np.int64)
    return int(k[0]), int(k[1])


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that sets of n and m need: ceil(p / (100 + p) * (n + m))."""
    return (percent * (n + m) + 100 + percent - 1) // (100 + percent)


def _parities(tokens: np.ndarray) -> np.ndarray:
    """For each class of shingles whether the set has an odd number of them, as longs.

    Two sets differ in at least as many shingles as they do in parities. Longer sets have more classes, some
    two a shingle, as differing shingles that share a class hide each other. Classes are low bits of a hash, so
    halves of the array merge into the parities of half as many classes.
    """
    classes = min(max(_PARITIES, 1 << (2 * len(tokens)).bit_length()), _MOST_PARITIES)
    counts = np.bincount((tokens >> _U64(20)).astype(np.int64) & (classes - 1), minlength=classes)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _describe(s: Settings):
    """Rows of kind 0: doc_id, n, set key, parities. Rows of kind 1: a shingle and its count among the sets counted."""
    names = ["kind", "id", "n", "k1", "k2", "odd"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= s.local_count
        tokens, counts = tokens[often].view(np.int64), counts[often]
        one = np.ones(len(tokens), dtype=np.int32)
        empty = pa.nulls(len(tokens), pa.int64())
        none = pa.nulls(len(tokens), types[-1])
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(tokens), pa.array(counts), empty, empty, none], names=names)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        held = 0
        for batch in portions(batches, "text"):
            ns, k1s, k2s, odd = [], [], [], []
            for value in batch.column(1):
                tokens = shingle_set(value.as_py() or b"", s.size)
                ns.append(len(tokens))
                odd.append(_parities(tokens))
                if not len(tokens):
                    k1s.append(None)
                    k2s.append(None)
                    continue
                key = _key(tokens)
                k1s.append(key[0])
                k2s.append(key[1])
                if key not in seen:
                    seen.add(key)
                    sets.append(tokens)
                    held += len(tokens)
                if held >= s.local_tokens:
                    yield counted(sets)
                    sets, seen, held = [], set(), 0
            columns = [[0] * len(ns), batch.column(0).to_pylist(), ns, k1s, k2s]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, long_lists(odd, pa.int64())], names=names)
        if sets:
            yield counted(sets)

    return describe


class _Order:
    """The global order: shingles by told count (0: rare), then hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.maybe = np.zeros(2**22, dtype=bool)
        self.maybe[(self.tokens >> _U64(42)).astype(np.int64)] = True

    def of(self, tokens: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(tokens), dtype=np.int64)
        some = np.flatnonzero(self.maybe[(tokens >> _U64(42)).astype(np.int64)])
        if len(some) and len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens[some]), len(self.tokens) - 1)
            hit = self.tokens[at] == tokens[some]
            counts[some[hit]] = self.counts[at[hit]]
        return counts


def _indexed(tokens: np.ndarray, key: tuple[int, int], order: _Order, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, kinds and prefix positions of one set."""
    n = len(tokens)
    prefix = n - (s.percent * n + 99) // 100 + 1
    counts = order.of(tokens)
    n_rare = int((counts == 0).sum())
    rare = tokens[counts == 0][:prefix]
    buckets, kinds, positions = [rare], [np.zeros(len(rare), np.int32)], [np.arange(len(rare), dtype=np.int32)]
    if n_rare < min(prefix + 1, n):
        often = np.flatnonzero(counts)
        often = often[np.lexsort((tokens[often], counts[often]))][: min(prefix + 1, n) - n_rare]
        shingles, told = tokens[often], counts[often]
        alone = slice(0, max(0, prefix - n_rare))
        light = len(shingles) <= s.max_combined
        # Frequent buckets are dealt over parts; the part is kept in kind so that the bucket stays one.
        parts = (mix(shingles + _U64(key[0] & (2**64 - 1))) >> _U64(40)) % (1 + told.astype(_U64) // _U64(s.part_members))
        buckets.append(shingles[alone])
        kinds.append(((_LIGHT if light else _HEAVY) + 4 * parts[alone].astype(np.int32)).astype(np.int32))
        positions.append(n_rare + np.arange(len(shingles[alone]), dtype=np.int32))
        if light and len(shingles) > 1:
            i, j = np.triu_indices(len(shingles), 1)
            buckets.append(mix(shingles[i] * _U64(0x9E3779B97F4A7C15) + shingles[j]))
            kinds.append(np.full(len(i), _COMBINED, np.int32))
            positions.append((n_rare + j - 1).astype(np.int32))  # found two, missed j - 1
    return np.concatenate(buckets), np.concatenate(kinds), np.concatenate(positions)


def _index(s: Settings, frequent):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(*frequent.value)
        seen: set[tuple[int, int]] = set()
        for batch in portions(batches, "text"):
            rows, keys, ns, lengths = [], [], [], []
            if len(seen) > 50_000:
                seen.clear()
            for value in batch.column(0):
                tokens = shingle_set(value.as_py() or b"", s.size)
                if len(tokens) < 2 or (key := _key(tokens)) in seen:  # one shingle: similar to equal sets only
                    continue
                seen.add(key)
                rows.append(_indexed(tokens, key, order, s))
                keys.append(key)
                ns.append(len(tokens))
                lengths.append(len(rows[-1][0]))
            if not rows:
                continue
            k1, k2 = np.repeat(np.array(keys, dtype=np.int64).reshape(-1, 2), lengths, axis=0).T
            columns = [
                np.concatenate([r[0] for r in rows]).view(np.int64),
                np.ascontiguousarray(k1),
                np.ascontiguousarray(k2),
                np.concatenate([r[1] for r in rows]),
                np.repeat(np.array(ns, dtype=np.int32), lengths),
                np.concatenate([r[2] for r in rows]),
            ]
            names = ["bucket", "k1", "k2", "kind", "n", "pos"]
            for start in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 200_000]) for c in columns], names=names)

    return index


def _meets(a: dict, b: dict, percent: int) -> np.ndarray:
    """Whether two members of a bucket can be similar, by sizes, positions and kinds."""
    need = least_overlap(a["n"], b["n"], percent)
    found = 1 + (a["kind"] == _COMBINED)
    bound = found + np.minimum(a["n"] - a["pos"] - found, b["n"] - b["pos"] - found)
    both_light = (a["kind"] % 4 == _LIGHT) & (b["kind"] % 4 == _LIGHT)
    return (bound >= need) & ~both_light


def _meet(s: Settings):
    """Buckets come in order, a row at a time; each member meets its part's pivot, the first row.

    Rows with o1: candidate pairs. Rows without: members of a bucket of three or more, or of a part.
    """
    names = ["big", "bucket", "k1", "k2", "kind", "n", "pos", "o1", "o2", "on"]
    fields = ("bucket", "k1", "k2", "kind", "n", "pos")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[str, np.ndarray] | None = None
        cut = False  # whether members of the carried bucket were emitted before
        for batch in batches:
            new = {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(fields)}
            rows = new if carry is None else {f: np.concatenate([carry[f], new[f]]) for f in fields}
            same = (rows["bucket"][1:] == rows["bucket"][:-1]) & (rows["kind"][1:] == rows["kind"][:-1])
            # Kinds of one bucket are apart in the order; light and heavy rows meet in the later step.
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            last = starts[-1]
            yield from emit(rows, starts[:-1], last, cut)
            cut = cut and last == 0
            carry = {f: rows[f][last:] for f in fields}
            if len(carry["bucket"]) > s.held_members:  # a long bucket goes on with its pivot
                cut = True
                yield from emit(carry, np.array([0]), len(carry["bucket"]), cut)
                carry = {f: carry[f][:1] for f in fields}
        if carry is not None:
            yield from emit(carry, np.array([0]), len(carry["bucket"]), cut)

    def emit(rows: dict, starts: np.ndarray, end: int, cut: bool) -> Iterator[pa.RecordBatch]:
        if not len(starts):
            return
        sizes = np.diff(starts, append=end)
        group = np.repeat(np.arange(len(starts)), sizes)
        offset = np.arange(end) - starts[group]
        # Frequent buckets are kept even if alone: the other kind's rows and parts are met later.
        keep = (sizes[group] > 1) | (rows["kind"][:end] % 4 >= _LIGHT)
        members = np.flatnonzero(keep)
        a, b = np.flatnonzero(offset > 0), starts[group][offset > 0]
        if len(a):
            one, two = ({f: rows[f][x] for f in fields} for x in (a, b))
            different = (one["k1"] != two["k1"]) | (one["k2"] != two["k2"])
            ok = different & _meets(one, two, s.percent)
            a, b = a[ok], b[ok]
        # What is left of a cut bucket belongs to a big one, however little it is.
        big = (sizes[group[members]] > 2) | (cut & (group[members] == 0))
        members = members[big | (rows["kind"][members] % 4 >= _LIGHT)]
        yield table(rows, a, b)
        yield table(rows, members, None)

    def table(rows: dict, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        own = [pa.array(np.ascontiguousarray(rows[f][a])) for f in fields]
        if b is None:
            other = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())]
        else:
            other = [pa.array(np.ascontiguousarray(rows[f][b])) for f in ("k1", "k2", "n")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), b is None)), *own, *other], names=names)

    return meet


def _marked_sets(s: Settings, marks):
    """(k1, k2, id, tokens) of the rows whose doc_id is marked or null, and of some others."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marks.value, dtype=np.uint8)
        for batch in portions(batches, "text"):
            at = batch.column(0).fill_null(0).to_numpy() & (2**s.marked_log2 - 1)
            wanted = (bits[at >> 3] >> (at & 7) & 1).astype(bool) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(_NO_ID).to_pylist()
            keys, sets = [], []
            for row in np.flatnonzero(wanted).tolist():
                tokens = shingle_set(batch.column(1)[row].as_py() or b"", s.size)
                if len(tokens) > 1:
                    keys.append((*_key(tokens), ids[row]))
                    sets.append(tokens.view(np.int64))
            if keys:
                columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, long_lists(sets, pa.int64())], names=["k1", "k2", "id", "tokens"])

    return find


def _marks(ids: DataFrame, log2: int) -> bytes:
    """One bit for each id's low bits, gathered as bitmaps of 4 KB; its size is a parameter."""
    at = F.col("id").bitwiseAND(F.lit(2**log2 - 1)) + 1  # the bitmap functions count from 1
    maps = ids.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = np.zeros(2**log2 // 8, dtype=np.uint8)
    for row in maps.toLocalIterator():
        start = (row.part - 1) * 4096
        out[start : start + 4096] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return out.tobytes()


_PAIR = ("k1", "k2", "o1", "o2")


def _possible(pairs: DataFrame, entities: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose sizes and parities allow the similarity, with a doc_id of each end."""
    a = entities.select("k1", "k2", "n", "id", "odd")
    b = entities.select(*[F.col(x).alias(y) for x, y in zip(a.columns, ("o1", "o2", "m", "other_id", "other_odd"), strict=True)])
    met = pairs.join(a, ["k1", "k2"]).join(b, ["o1", "o2"])
    total = F.col("n") + F.col("m")
    allowed = total - 2 * _least_overlap(total, s)
    near = met.filter(F.abs(F.col("n") - F.col("m")) <= allowed)  # so the classes differ by a factor of two at most
    one, two = F.col("odd"), F.col("other_odd")
    one, two = F.when(F.size(one) > F.size(two), _halved(one)).otherwise(one), F.when(F.size(two) > F.size(one), _halved(two)).otherwise(two)
    differ = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda sum_, x: sum_ + x)
    met = near.withColumn("differ", differ).filter(F.col("differ") <= allowed)
    return met.select(*_PAIR, "id", "other_id", "differ")


def _halved(odd: Column) -> Column:
    """The parities of half as many classes."""
    half = (F.size(odd) / 2).cast("int")
    return F.zip_with(F.slice(odd, F.lit(1), half), F.slice(odd, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _least_overlap(total, s: Settings):
    """``least_overlap`` as a column."""
    whole = 100 + s.percent
    return F.floor((s.percent * total + whole - 1) / F.lit(float(whole)) + 1e-9).cast("long")


def _named(row: str, key: str) -> Column:
    """A doc_id that stands for an entity; entities of rows without one share a name."""
    return F.coalesce(F.col(row), F.lit(_NO_ID)).alias(key)


def _repeated(described: DataFrame) -> DataFrame:
    """(k1, k2, id) that several rows have: those that repeat doc_id and text, and copies without doc_id."""
    rows = described.filter("kind = 0 AND n > 1").select("k1", "k2", _named("id", "id"))
    return materialize(rows.groupBy("k1", "k2", "id").count().filter("count > 1").select("k1", "k2", "id"))


def _sets(pairs: DataFrame, narrow: DataFrame, repeated: DataFrame, s: Settings) -> DataFrame:
    """(k1, k2, id, tokens) of the ends of pairs and of some others, from the texts, each once.

    A set is written where its text is read and dealt out only to be verified.
    """
    spark = pairs.sparkSession
    ends = pairs.select("id").union(pairs.select("other_id")).filter("id IS NOT NULL")
    marks = spark.sparkContext.broadcast(_marks(ends, s.marked_log2))
    found = narrow.mapInArrow(lean(_marked_sets(s, marks)), "k1 long, k2 long, id long, tokens array<long>")
    if repeated.isEmpty():
        return materialize(found)
    on = ["k1", "k2", "id"]
    once, again = found.join(repeated, on, "left_anti"), found.join(repeated, on, "left_semi")
    return materialize(once.unionByName(again.dropDuplicates(on)))


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose whole sets are similar, as (a, b) node names.

    Both joins read one dealing of ``sets``; the left ends' sets then travel once more to the right ends.
    """
    x, y = sets.alias("x"), sets.alias("y")
    ends = pairs.select(*_PAIR, _named("id", "id"), _named("other_id", "other_id")).alias("p")
    joined = ends.join(x, [F.col(f"p.{k}") == F.col(f"x.{k}") for k in ("k1", "k2", "id")])
    joined = joined.select("p.*", F.col("x.tokens").alias("mine")).alias("p")
    other = {"o1": "k1", "o2": "k2", "other_id": "id"}
    joined = joined.join(y, [F.col(f"p.{o}") == F.col(f"y.{k}") for o, k in other.items()])
    joined = joined.select(*[f"p.{c}" for c in _PAIR], "mine", F.col("y.tokens").alias("others"))
    shared = F.size(F.array_intersect("mine", "others")).cast("long")
    union = F.size("mine") + F.size("others") - shared
    linked = joined.filter(100 * shared >= s.percent * union)
    return materialize(linked.select(_node("k1", "k2").alias("a"), _node("o1", "o2").alias("b")))


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each set of ``pairs`` the pair with the fewest differing parities."""
    turns = {"k1": "o1", "k2": "o2", "id": "other_id", "o1": "k1", "o2": "k2", "other_id": "id"}
    held = pairs.select(*turns, "differ")
    turned = held.select(*[F.col(y).alias(x) for x, y in turns.items()], "differ")
    best = held.union(turned).groupBy("k1", "k2").agg(F.min(F.struct("differ", "o1", "o2", "other_id", "id")).alias("p"))
    return _distinct_pairs(best.select("k1", "k2", "p.id", "p.o1", "p.o2", "p.other_id"))


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    one = components.withColumnRenamed("component", "c")
    two = components.select(F.col("node").alias("other"), F.col("component").alias("d"))
    named = pairs.withColumn("node", _node("k1", "k2")).withColumn("other", _node("o1", "o2"))
    named = named.join(one, "node", "left").join(two, "other", "left")
    return named.filter(F.coalesce("c", "node") != F.coalesce("d", "other")).select(*pairs.columns)


def _joined(pairs: DataFrame, sets: DataFrame, components: DataFrame | None, s: Settings) -> DataFrame:
    """Components with the links of ``pairs``. Whole sets travel for one pair per set first, the nearest; that
    joins most of what belongs together, and of the others only pairs across components are looked at."""
    first = _verified(materialize(_nearest(pairs)), sets, s)
    components = materialize(connected_components(first) if components is None else joined_components(components, first))
    rest = materialize(_apart(pairs, components))
    if not rest.isEmpty():
        components = materialize(joined_components(components, _verified(rest, sets, s)))
    return components


def _node(k1: str, k2: str):
    return F.concat(F.lpad(F.hex(k1), 16, "0"), F.lpad(F.hex(k2), 16, "0"))


def _distinct_pairs(rows: DataFrame) -> DataFrame:
    """Pairs with the smaller key first, each once; what else ``rows`` says of the ends goes with them."""
    first = F.struct("k1", "k2") < F.struct("o1", "o2")
    sides = [(x, y) for x, y in (("k1", "o1"), ("k2", "o2"), ("id", "other_id")) if x in rows.columns]
    ends = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in sides]
    others = [F.when(first, F.col(y)).otherwise(F.col(x)).alias(y) for x, y in sides]
    return rows.select(*ends, *others).distinct()


_FOLDED = [f"odd{i}" for i in range(8)]


def _folded(odd: str) -> list:
    """The parities of 512 classes, eight longs: classes merge by exclusive or."""
    blocks = F.sequence(F.lit(0), (F.size(odd) / 8).cast("int") - 1)

    def merged(i: int) -> Column:
        return F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.get(F.col(odd), k * 8 + i)))

    return [merged(i).alias(name) for i, name in enumerate(_FOLDED)]


def _close(n: str, m: str, prefix: str, s: Settings):
    """Whether sizes and folded parities allow the similarity; part of the join, so that others are not made."""
    differ = F.lit(0)
    for name in _FOLDED:
        differ = differ + F.bit_count(F.col(name).bitwiseXOR(F.col(prefix + name)))
    total = F.col(n) + F.col(m)
    return differ <= total - 2 * _least_overlap(total, s)


def _positions_allow(n, pos, m, other_pos, combined, s: Settings):
    found = F.when(combined, 2).otherwise(1)
    bound = found + F.least(n - pos, m - other_pos) - found
    return bound >= _least_overlap(n + m, s)


def _missing_pairs(members: DataFrame, components: DataFrame, entities: DataFrame, s: Settings) -> DataFrame:
    """Pairs of a bucket that are in different components and may be similar.

    Those outside a bucket's largest component are held against the others there: against single sets one by
    one, against a component of several as a whole. Then each such (set, component) meets the component's
    sets once, however many buckets brought them together.
    """
    named = members.withColumn("node", _node("k1", "k2")).join(components, "node", "left")
    # Light and heavy rows and all parts of a frequent shingle are one bucket; combinations are another.
    named = materialize(
        named.select(
            "bucket", "k1", "k2", "n", "pos", "kind",
            F.coalesce("component", "node").alias("component"),
            F.col("component").isNotNull().alias("several"),
            (F.col("kind") == _COMBINED).alias("combined"),
            (F.col("kind") % 4 == _LIGHT).alias("light"),
        ).drop("kind")
    )
    counts = named.groupBy("bucket", "combined", "component").agg(
        F.count("*").alias("c"), F.count_if(~F.col("light")).alias("n_other")
    )
    largest = counts.groupBy("bucket", "combined").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"),
        F.count("*").alias("n_components"),
        F.sum("n_other").alias("n_other"),
    )
    # Two light members meet in their combinations, so a bucket of light ones has nothing to add.
    mixed = materialize(largest.filter("n_components > 1 AND n_other > 0").select("bucket", "combined", "main"))
    sketches = entities.select("k1", "k2", *_folded("odd"))
    held = materialize(named.join(mixed, ["bucket", "combined"]).join(sketches, ["k1", "k2"]))
    few = held.filter("component <> main").drop("main", "several")
    renamed = ["k1", "k2", "n", "pos", "light", "component", *_FOLDED]
    single = held.filter(~F.col("several")).select("bucket", "combined", *[F.col(c).alias("_" + c) for c in renamed])
    allowed = _positions_allow(F.col("n"), F.col("pos"), F.col("_n"), F.col("_pos"), F.col("combined"), s)
    different = (F.col("component") != F.col("_component")) & ~(F.col("light") & F.col("_light"))
    on = ["bucket", "combined"]
    pairs = few.join(single, on).filter(different & allowed & _close("n", "_n", "_", s))
    pairs = pairs.select("k1", "k2", F.col("_k1").alias("o1"), F.col("_k2").alias("o2"))
    # A component of several by the loosest of its members in the bucket.
    several = held.filter("several").groupBy(*on, F.col("component").alias("_component")).agg(
        F.min("n").alias("_n"), F.max("n").alias("_m"), F.min("pos").alias("_pos"), F.min("light").alias("_light")
    )
    total = F.col("n") + F.col("_n")
    reach = F.least(F.col("n") - F.col("pos"), F.col("_m") - F.col("_pos"))
    wanted = few.join(several, on).filter(different & (reach >= _least_overlap(total, s)))
    wanted = wanted.select("k1", "k2", "n", F.col("_component").alias("component"), *_FOLDED).distinct()
    inside = components.withColumnRenamed("node", "_node").join(
        entities.select(
            _node("k1", "k2").alias("_node"), F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("n").alias("_n"),
            *[c.alias("_" + name) for c, name in zip(_folded("odd"), _FOLDED, strict=True)],
        ),
        "_node",
    )
    whole = materialize(wanted).join(materialize(inside), "component").filter(_close("n", "_n", "_", s))
    return _distinct_pairs(pairs.union(whole.select("k1", "k2", "o1", "o2")))


def jaccard_components(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and set_key per row of ``docs`` (doc_id, text; others are ignored).

    The component is the smallest doc_id reachable by links. Null or empty texts have no shingles and are
    their own component; a text of fewer words than a shingle is one shingle; repeated rows each get a row;
    rows with a null doc_id get the component of the others they are linked with, else null. Very long texts
    are read whole. An empty table gives an empty result.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    described = materialize(narrow.mapInArrow(lean(_describe(s)), "kind int, id long, n long, k1 long, k2 long, odd array<long>"), "kind")
    told = described.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= s.frequent)
    told = told.orderBy(F.desc("n"), "id").limit(s.max_frequent).toArrow()  # at most 8 MB
    frequent = spark.sparkContext.broadcast((told.column(0).to_numpy().view(np.uint64), told.column(1).to_numpy()))

    postings = texts.mapInArrow(lean(_index(s, frequent)), _POSTING)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Four orders, by the bucket: a set meets few pivots, but not the same one everywhere.
    turn = F.xxhash64("k1", F.col("bucket").bitwiseAND(F.lit(3)))
    dealt = postings.repartition(width, "bucket", "kind").sortWithinPartitions("bucket", "kind", turn, "k1", "k2")
    met = materialize(dealt.mapInArrow(lean(_meet(s)), _CANDIDATE), "big")

    sets = described.filter("kind = 0 AND n > 1").groupBy("k1", "k2")
    entities = materialize(sets.agg(F.min("n").alias("n"), F.min("id").alias("id"), F.first("odd").alias("odd")))
    possible = materialize(_possible(_distinct_pairs(met.filter("NOT big")), entities, s))
    repeated = _repeated(described)
    components = _joined(possible, _sets(possible, narrow, repeated, s), None, s)
    missing = materialize(_possible(_missing_pairs(met.filter("big"), components, entities, s), entities, s))
    if not missing.isEmpty():
        components = _joined(missing, _sets(missing, narrow, repeated, s), components, s)

    rows = described.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", _node("k1", "k2").alias("node"))
    sets = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = sets.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "component").select("node", "component_id"))
    return rows.join(named, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("node").alias("set_key"),
    )
