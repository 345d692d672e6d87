"""Rendezvous sharding next to a plain version of it."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

from riskloom.llm import rendezvous
from riskloom.llm.numbering import number_rows
from riskloom.llm.rendezvous import assign_shards, rendezvous_shard, write_shards

SCHEMA = "doc_id long, text string, shard string, slot int"


def shard_of(key, weights):
    def cost(i):
        drawn = int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16)
        return -math.log((drawn + 0.5) / 2**52) / weights[i]

    return min((i for i in range(len(weights)) if weights[i] > 0), key=cost)


def brute(rows, weights, added=1.0):
    """(doc_id, size, checksum, shard, slot, grown) of every row."""
    placed = []
    for doc_id, text in rows:
        data, key = (text or "").encode(), "null" if doc_id is None else str(doc_id)
        crc = zlib.crc32(data)
        place = int(hashlib.md5(f"{key}|{crc}|{len(data) + 1}".encode()).hexdigest()[:8], 16)
        where, grown = shard_of(key, weights), shard_of(key, [*weights, added])
        placed.append((where, place, doc_id is not None, doc_id or 0, crc, len(data) + 1, doc_id, grown))
    out, slots = [], Counter()
    for where, _, _, _, crc, size, doc_id, grown in sorted(placed):
        out.append((doc_id, size, crc, where, slots[where], grown))
        slots[where] += 1
    return Counter(out)


def found(df):
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = df.collect()
    assert {r.law for r in rows} <= {"key"}
    return Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.grown_shard) for r in rows)


ROWS = [
    *[(i, f"text {i} é") for i in range(300)],
    *[(None, f"row {i % 40}") for i in range(120)],  # one key, rows that differ and rows that repeat
    *[(7, "same")] * 50,
    (900, None), (901, ""), (902, "ß" * 200_000), (903, None),
]


def test_equals_a_plain_version(make):
    docs = make([(a, b, "clash", 1) for a, b in ROWS], SCHEMA)
    assert found(assign_shards(docs)) == brute(ROWS, [1.0] * 16)


def test_weights_and_shards_without_weight(make):
    docs, weights = make([(a, b, "", 0) for a, b in ROWS], SCHEMA), [3.0, 0.0, 1.0, 0.5]
    got = found(assign_shards(docs, weights, added=2.0))
    assert got == brute(ROWS, weights, 2.0)
    counts = Counter(key[3] for key in got if key[0] is not None)
    assert 1 not in counts and counts[0] > counts[2] > counts[3]
    with pytest.raises(ValueError):
        assign_shards(docs, [0.0, 0.0])


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    moved = keys.select(
        rendezvous_shard("doc_id", [1.0] * 16).alias("a"), rendezvous_shard("doc_id", [1.0] * 17).alias("b")
    ).filter("a <> b").collect()
    assert {r.b for r in moved} == {16}
    assert abs(len(moved) - 20_000 / 17) < 200
    shares = Counter(r.shard for r in keys.select(rendezvous_shard("doc_id", [2.0, 1.0, 1.0]).alias("shard")).collect())
    assert abs(shares[0] - 10_000) < 400


def test_many_equal_rows_are_written_out_in_portions(make, monkeypatch):
    monkeypatch.setattr(rendezvous, "PORTION", 7)
    assert found(assign_shards(make([(a, b, "", 0) for a, b in ROWS], SCHEMA), [1.0] * 3)) == brute(ROWS, [1.0] * 3)


def test_numbers_across_many_blocks(spark):
    rows = spark.range(5000).selectExpr("id % 3 AS g", "(id * 2654435761) % 4294967296 AS place", "id")
    got = number_rows(rows, "number", ["g"], ["place", "id"], block_rows=13).collect()
    for g in range(3):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.number for r in own] == list(range(len(own)))


def test_empty_table_and_rerun(make, spark, sf):
    assert assign_shards(make([], SCHEMA)).collect() == []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(assign_shards(docs)) == found(assign_shards(docs.repartition(5)))


def test_written_shards_hold_every_row(make, spark, tmp_path):
    docs = make(ROWS, "doc_id long, text string")
    path = f"file://{tmp_path}/out"
    write_shards(docs, path, [1.0] * 4, files=2)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(ROWS)
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(a, shard_of("null" if a is None else a, [1.0] * 4)) for a, _ in ROWS}
    with pytest.raises(ValueError):
        write_shards(make([(1, "a", "b", 2)], SCHEMA), path + "2")
