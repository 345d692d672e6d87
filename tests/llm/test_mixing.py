import random
import time
from collections import Counter

from riskloom.llm import mixing as m


def targets(totals, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above a limit is shared again among the others, until nothing is."""
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    fixed, left = {}, sum(totals.values())
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * totals[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = most * totals[s]
            left -= fixed[s]


def rows(seed, n=400):
    draw = random.Random(seed)
    sources = ["a", "b", "c", "d", "é", "z", "Z", None]
    out = [(k, "w " * draw.choice([0, 1, 3, 20, 200]), draw.choice(sources + ["a"] * 6)) for k in range(n)]
    return out + [(n, "x " * 5000, "one"), (n + 1, None, "none"), (3, "y z", "a"), (3, "y z", "a"), (None, "q", None), (n + 2, "", "none")]


def check(got, given):
    assert len(got) == len(given)
    totals = Counter()
    for _, text, source in given:
        totals[source] += len((text or "").split())
    want = targets(totals)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == totals[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.part
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1, source
    parts = Counter(r.source for r in got if r.part)
    assert max(parts.values(), default=0) <= 1


def test_targets_and_totals(make):
    for block in (2000, 7):  # 7: many blocks and levels
        given = rows(1)
        table = make(given, "doc_id long, text string, source string")
        got = m.mix_sources(table, block=block).collect()
        check(got, given)
        again = m.mix_sources(table.repartition(5), block=block).collect()
        pick = lambda x: sorted((str(r.doc_id), r.size, r.taken) for r in x)
        assert pick(got) == pick(again)


def test_documents_are_balanced_too(make):
    given = [(k, "w " * (1 + k % 50), "s%d" % (k % 3)) for k in range(3000)]
    got = m.mix_sources(make(given, "doc_id long, text string, source string"), block=100).collect()
    for source in ("s0", "s1", "s2"):
        own = [r for r in got if r.source == source]
        expected = len(own) * own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - expected) <= 3


def test_flight_keeps_both_totals():
    draw = random.Random(9)
    for _ in range(50):
        n = draw.randrange(1, 40)
        sizes, p = [draw.choice([0, 1, 5, 5, 100]) for _ in range(n)], [draw.choice([0.0, 1.0, 0.3, 0.7, draw.random()]) for _ in range(n)]
        out = m.fly(sizes, p, draw)
        assert sum(1 for x in out if 0 < x < 1) <= 2
        assert abs(sum(out) - sum(p)) < 1e-6
        assert abs(sum(a * s for a, s in zip(out, sizes)) - sum(a * s for a, s in zip(p, sizes))) < 1e-4
        landed = m.land(sizes, out)
        assert sum(1 for x in landed if 0 < x < 1) <= 1
        assert abs(sum(a * s for a, s in zip(landed, sizes)) - sum(a * s for a, s in zip(p, sizes))) < 1e-4


def test_inclusion_is_unbiased():
    """Over many draws each document comes in as often as its probability says."""
    sizes, p = [100, 60, 30, 30, 10, 5, 5, 2], [0.4] * 8
    counts = [0.0] * 8
    for seed in range(3000):
        for k, x in enumerate(m.fly(sizes, p, random.Random(seed))):
            counts[k] += x
    assert all(abs(c / 3000 - 0.4) < 0.04 for c in counts)


def test_apply(make):
    given = rows(2)
    docs = make([(*r, len(r[1] or "")) for r in given], "doc_id long, text string, source string, n_chars long")
    plan = m.mix_sources(docs)
    out = m.apply_mix(docs, plan).collect()
    words = Counter()
    for r in out:
        words[r.source] += len((r.text or "").split())
    want = Counter()
    for r in plan.collect():
        want[r.source] += r.taken
    for source in want:  # the repeated doc_id of source a is taken alike
        assert abs(words[source] - want[source]) <= (8 if source == "a" else 0)
    assert m.mix_sources(make([], "doc_id long, text string, source string")).count() == 0


def test_apply_is_exact_where_ids_share_a_slot(make):
    """Ids far apart, null, repeated, missing in the plan, taken in part or unusually often."""
    far = 2**25
    ids = [*range(300), 5 + far, 6 + far, 7 - far, -1, -far, None, 20, 2**62, 9 + far]
    docs = make([(i, f"a{n} b c") for n, i in enumerate(ids)], "doc_id long, text string")
    taken = {i: (2 if i is None else abs(i) % 4, 0) for i in ids[:-1]}
    taken |= {11: (0, 2), 12: (3, 1), 13: (9, 0), 5 + far: (3, 0), 6 + far: (2, 0)} | {k: (k - 90, 0) for k in range(100, 110)}
    plan = make([(i, *x) for i, x in taken.items()], "doc_id long, copies long, part long")
    want = Counter()
    for n, i in enumerate(ids):
        copies, part = taken.get(i, (0, 0))
        want[i, f"a{n} b c"] += copies
        if part:
            want[i, " ".join(f"a{n} b c".split()[:part])] += 1
    assert Counter(map(tuple, m.apply_mix(docs, plan).collect())) == +want


def test_apply_leaves_texts_where_they_are_read(spark, tmp_path):
    """A plan that is too large to be broadcast does not send the texts through a shuffle."""
    path = f"file://{tmp_path}/docs"
    text = "array_join(transform(sequence(1, 100), x -> sha2(concat(id, '-', x), 256)), ' ')"
    spark.range(2000).selectExpr("id AS doc_id", f"{text} AS text").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    plan = spark.range(2000).selectExpr("id AS doc_id", "id % 3 AS copies", "if(id = 7, 5L, 0L) AS part")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        written = shuffled(spark)
        m.apply_mix(docs, plan).write.parquet(f"file://{tmp_path}/out")
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == sum(i % 3 for i in range(2000)) + 1
        assert shuffled(spark) - written < 1e6  # the texts are 13 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(spark):
    """Bytes that the session has written to shuffles."""
    time.sleep(1)  # Spark's status lags behind
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))
