"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number u in (0, 1) for a record's key, from a hash of both, and the record goes to the
shard with the least ``-ln(u) / weight``. The draws of different shards do not depend on one another: a shard
gets its weight's share of the keys, one more shard takes records only into itself, and one less gives its own
records away and moves no others. Nothing is looked up, so the shard of a record is an expression over its row.

A slot numbers the records of a shard from 0, in an order set by a hash, so that a shard read by slots is
shuffled. Numbering deals narrow rows (no text) by ranges of that hash; equal rows are counted before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialize
from riskloom.llm.numbering import number_rows, place

SHARDS = 16
#: Equal rows are written out in portions of at most this many.
PORTION = 65_536


def _cost(key: Column, shard: int, weight: float) -> Column:
    """``-ln(u) / weight``, u from 52 bits of a hash of key and shard."""
    drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return -F.log((drawn + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def _best(key: Column, weights: Sequence[float]) -> Column:
    """(cost, shard) of the shard that a key goes to, the first of equal ones; a shard of weight 0 gets none."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    drawn = [F.struct(_cost(key, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return drawn[0] if len(drawn) == 1 else F.least(*drawn)


def _text_key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def rendezvous_shard(key: str, weights: Sequence[float]) -> Column:
    """The shard, counted from 0, of the record whose key stands in column ``key``; null keys share a shard."""
    return _best(_text_key(key), weights)["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard per row of ``docs`` (key, text; others are ignored).

    ``grown_shard`` is the shard with one more of weight ``added``. A null text has size 1 and the checksum of
    the empty text; an empty one likewise. Rows with a null key share a shard, rows that repeat a key too, each
    with a slot of its own. Texts of any length are read once and never travel. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    best = _best(F.col("_key"), weights)
    more = F.struct(_cost(F.col("_key"), len(weights), added).alias("cost"), F.lit(len(weights)).alias("shard"))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        _text_key(key).alias("_key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    drawn = narrow.withColumn("_best", best).withColumn("_grown", F.least("_best", more) if added > 0 else F.col("_best"))
    rows = drawn.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("_best.shard").alias("shard"),
        F.col("_grown.shard").alias("grown_shard"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    counted = materialize(counted.withColumn("place", place(F.col("doc_id"), F.col("text_crc32"), F.col("size"))))
    numbered = number_rows(counted, "slot", ["shard"], ["place", "doc_id", "text_crc32", "size"], F.col("copies"))
    return _written_out(materialize(numbered)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _written_out(numbered: DataFrame) -> DataFrame:
    """A row for each copy. Rows of very many copies are dealt in portions first."""
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    few = numbered.filter(F.col("copies") <= PORTION).withColumn("_step", steps)
    portions = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PORTION).cast("long")))
    many = numbered.filter(F.col("copies") > PORTION).withColumn("_from", portions)
    many = many.repartition("shard", "slot", "_from")
    last = F.least(F.col("copies"), F.col("_from") + PORTION) - 1
    many = many.withColumn("_step", F.explode(F.sequence(F.col("_from"), last))).drop("_from")
    return few.unionByName(many).withColumn("slot", F.col("slot") + F.col("_step"))


def write_shards(
    docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", files: int = 1
) -> None:
    """Writes ``docs`` as Parquet under ``path``, a folder ``shard=i`` for each shard, in a hashed order.

    A shard is dealt over some ``files`` files by a hash of key and text, so no task holds a whole shard
    unless one file is asked for, and many copies of one key do not meet in one task.
    """
    if "shard" in docs.columns:
        raise ValueError("the table has a column named shard; rename it first")
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"_place{i}" for i in range(len(taken) + 1)) if n not in taken)
    placed = docs.withColumn("shard", rendezvous_shard(key, weights)).withColumn(
        name, place(F.col(key), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    )
    part = F.shiftright(F.col(name) * F.lit(files), 32)
    dealt = placed.repartition(files * len(weights), F.col("shard"), part).sortWithinPartitions("shard", name)
    dealt.drop(name).write.partitionBy("shard").parquet(path)


def _draws(shards: int) -> str:
    return ", ".join(
        f"-ln((('0x' || substr(md5(k || ':{i}'), 1, 13))::BIGINT + 0.5) / {2**52}.0)" for i in range(shards)
    )


#: SQL twin for the registered query: 16 shards of weight 1 and one more; the checksum byte by byte.
SHARD_SQL = rf"""
WITH polynomial AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), bytes AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents
), sums AS (
  SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM bytes, polynomial
), drawn AS (SELECT *, [{_draws(SHARDS + 1)}] AS d FROM sums),
placed AS (
  SELECT doc_id, size, text_crc32, list_position(d[1:{SHARDS}], list_min(d[1:{SHARDS}])) - 1 AS shard,
    list_position(d, list_min(d)) - 1 AS grown_shard,
    ('0x' || substr(md5(k || '|' || text_crc32 || '|' || size), 1, 8))::BIGINT AS place FROM drawn
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot FROM placed
"""
