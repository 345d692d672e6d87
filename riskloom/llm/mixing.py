"""Mixing sources to target weights by cube-method balanced sampling.

A source's documents are repeated ``target / size`` times: the whole part of that ratio for every document,
and the rest as an inclusion probability. The cube method turns these probabilities into zeros and ones while
it keeps two totals of the source, words and documents: a step takes three open documents, moves along the
null space of their 2 x 3 balancing matrix until one probability reaches 0 or 1, and draws the direction so
that the probabilities stay right on average.

The flight runs per source in blocks of bounded size. Each block ends with at most two open documents; these
form the blocks of the next level, until a source has one block. Only (source, doc_id, size) is ever shuffled.
Large documents fly first, so the last open ones are small. They are the landing problem: at most one document
of a source is taken in part, so that the words taken equal the target to a word.
"""

from __future__ import annotations

import hashlib
import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, materialize

#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK = 2000
_FLOWN = "source string, doc_id long, size long, source_size long, target double, p double, turn double, open boolean"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, n_docs, target: shares of all words by weight, none above ``most`` times its source.

    Sharing an excess again by weight until no source is above its limit comes to one level L with
    target = least(most * size, L * weight). Sources are filled in the order of limit by weight, so L follows
    from running totals. The two windows hold one row per source.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.max("size").alias("largest")
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(w) for w in weights])
    totals = totals.withColumn("weight", F.element_at(listed, (rank % len(weights) + 1).cast("int")).cast("long"))
    limit = (F.col("source_size") * most).cast("double")
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / weight_left
    filled = totals.withColumn("_level", level).withColumn("_full", limit <= F.col("_level") * F.col("weight"))
    # The level of the first source that is not full holds for all after it.
    open_level = F.min(F.when(~F.col("_full"), F.struct(limit / F.col("weight"), F.col("_level").alias("level")))).over(everything)
    target = F.when(F.col("_full"), limit).otherwise(open_level["level"] * F.col("weight"))
    return filled.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def fly(sizes: list[int], p: list[float], draw: random.Random) -> list[float]:
    """The flight phase: probabilities with at most two left strictly between 0 and 1, both totals kept.

    Units are taken in the given order; the open ones in hand are replaced as they settle.
    """
    p = list(p)
    hand: list[int] = []
    for unit in range(len(p)):
        if p[unit] <= _EPS or p[unit] >= 1 - _EPS:
            p[unit] = float(round(p[unit]))
            continue
        hand.append(unit)
        while len(hand) == 3:
            a, b, c = hand
            # Null space of the rows (sizes) and (ones) for three units.
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1, -1, 0)
            _move(p, hand, u, draw)
            hand = [k for k in hand if _EPS < p[k] < 1 - _EPS]
    return p


_EPS = 1e-9


def _move(p: list[float], units: list[int], u: tuple, draw: random.Random) -> None:
    up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(units, u, strict=True) if x)
    down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(units, u, strict=True) if x)
    step = up if draw.random() * (up + down) < down else -down
    for k, x in zip(units, u, strict=True):
        p[k] = min(1.0, max(0.0, p[k] + step * x))
        if p[k] < _EPS or p[k] > 1 - _EPS:
            p[k] = float(round(p[k]))


def land(sizes: list[int], p: list[float]) -> list[float]:
    """The landing of the open units: whole or not at all but for one, whose share makes the words come out."""
    p = list(p)
    open_units = [k for k in range(len(p)) if _EPS < p[k] < 1 - _EPS]
    words = sum(p[k] * sizes[k] for k in open_units)
    for n, k in enumerate(open_units):
        if not sizes[k]:
            p[k] = float(round(p[k]))
            continue
        later = sum(sizes[x] for x in open_units[n + 1 :])
        share = min(1.0, words / sizes[k])
        p[k] = 0.0 if words <= later else share
        words = max(0.0, words - p[k] * sizes[k])
    return p


def _flight(seed: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "turn", "doc_id"], ascending=[False, True, True], kind="stable")
        name = f"{seed}|{group['source'].iloc[0]}|{len(group)}|{group['turn'].iloc[0]}"
        draw = random.Random(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big"))
        sizes = group["size"].tolist()
        p = fly(sizes, group["p"].tolist(), draw)
        if last:
            p = land(sizes, p)
        group["p"] = p
        group["open"] = [not last and _EPS < x < 1 - _EPS for x in p]
        return group[["source", "doc_id", "size", "source_size", "target", "p", "turn", "open"]]

    return run


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = 20240229,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole ones), part (words of one more), taken.

    One row per row of ``docs`` (doc_id, text, source; others are ignored). A null or empty text has size 0
    and is taken as it is; a null source is a source of its own, the last; repeated rows are documents of
    their own; null ids are kept. A source without words has target 0. An empty table gives an empty result.
    The draw depends on the rows alone, so reruns agree.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(
        docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
    )
    targets = materialize(source_targets(sizes, weights, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A hash of the row stands for a random order and deals rows over blocks; equal rows may be swapped.
    turn = F.abs(F.xxhash64(F.lit(seed), "doc_id", "size")) / F.lit(float(2**63))
    known = targets.withColumnRenamed("source", "_source")
    rows = sizes.join(F.broadcast(known) if targets.count() <= 10_000 else known, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("ratio", ratio).withColumn("turn", turn)
    rows = rows.withColumn("whole", F.floor("ratio")).withColumn("p", F.col("ratio") - F.col("whole"))

    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    left = rows.select("source", "doc_id", "size", "source_size", "target", "p", "turn", "n_docs")
    done = None
    expected = largest
    level = 0
    while True:
        blocks = max(1, math.ceil(expected / block))
        last = blocks == 1
        # Every source gets as many blocks as its own documents need at this level.
        own = F.ceil(F.col("n_docs") * F.lit(blocks / max(1, largest))) if not last else F.lit(1)
        salted = F.col("turn") * F.lit(float(997**level))
        part = F.floor((salted - F.floor(salted)) * own).cast("int").alias("part")
        flown = left.groupBy("source", "n_docs", part).applyInPandas(_with_n_docs(_flight(seed + level, last)), _FLOWN + ", n_docs long")
        flown = materialize(flown)
        settled = flown.filter("NOT open").drop("open")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        left = flown.filter("open").drop("open")
        expected = 2 * blocks
        level += 1
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    extra = F.when(F.col("p") >= 1, 1).otherwise(0)
    part_words = F.when((F.col("p") > 0) & (F.col("p") < 1), F.round(F.col("p") * F.col("size"))).otherwise(0).cast("long")
    return done.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (whole + extra).cast("long").alias("copies"),
        part_words.alias("part"),
        ((whole + extra) * F.col("size") + part_words).cast("long").alias("taken"),
    )


def _with_n_docs(run):
    def wrapped(group: pd.DataFrame) -> pd.DataFrame:
        n = group["n_docs"].iloc[0]
        out = run(group)
        out["n_docs"] = n
        return out

    return wrapped


#: log2 of the slots that tell how often an id is taken, before any text moves (4 MB for each number of copies).
SLOTS_LOG2 = 25
#: So many numbers of copies have slots, the most usual ones; documents taken otherwise are joined by id.
MOST_KINDS = 6


def _slot(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit(2**SLOTS_LOG2 - 1)) + 1  # the bitmap functions count from 1


def _bit(bits: str, at: Column) -> Column:
    """A bit of a bitmap, 0 without one."""
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2, F.lit(0))


def _with_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are taken, with ``_copies`` and ``_part``.

    Ids fall into slots, and tasks are told which numbers of copies each slot has. A row whose slot has one only is
    settled where it is read. The others, with those taken in part and those without an id, are joined by id. Ids
    no further apart than there are slots never share one.
    """
    id_ = F.col("doc_id").cast("long")
    per_id = plan.groupBy(F.col("doc_id").cast("long").alias("_id"))
    per_id = per_id.agg(F.max("copies").alias("_copies"), F.max("part").alias("_part"))
    asked = docs.select(id_.alias("_asked")).distinct().join(per_id, F.col("_asked").eqNullSafe(F.col("_id")), "left")
    asked = materialize(
        asked.select(F.col("_asked").alias("_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("_copies", "_part")])
    )
    usual = asked.groupBy("_copies").count().orderBy(F.desc("count"), "_copies").limit(MOST_KINDS)
    kinds = {kind: f"_kind{n}" for n, kind in enumerate([-1, *sorted(row[0] for row in usual.collect())])}

    slot = _slot(F.col("_id"))
    unusual = (F.col("_part") > 0) | ~F.col("_copies").isin(list(kinds))
    marks = asked.filter("_id IS NOT NULL").select(
        F.bitmap_bucket_number(slot).alias("_chunk"),
        F.bitmap_bit_position(slot).alias("_at"),
        F.when(unusual, -1).otherwise(F.col("_copies")).alias("_kind"),
    )
    chunks = marks.groupBy("_chunk").agg(
        *[F.expr(f"bitmap_construct_agg(_at) FILTER (WHERE _kind = {kind})").alias(name) for kind, name in kinds.items()]
    )
    rows = docs.join(F.broadcast(chunks), F.bitmap_bucket_number(_slot(id_)) == F.col("_chunk"), "left")
    place = F.bitmap_bit_position(_slot(id_))
    held = F.array_compact(F.array(*[F.when(_bit(name, place) == 1, F.lit(kind).cast("long")) for kind, name in kinds.items()]))
    rows = rows.select(*docs.columns, F.when(F.size(held) == 1, F.get(held, F.lit(0))).alias("_one"))
    sure = F.coalesce(F.col("_one") >= 0, F.lit(False))
    settled = rows.filter(sure & (F.col("_one") > 0)).withColumnRenamed("_one", "_copies").withColumn("_part", F.lit(0).cast("long"))
    taken = asked.filter("_copies > 0 OR _part > 0")
    left = rows.filter(~sure).drop("_one").join(taken, id_.eqNullSafe(F.col("_id"))).drop("_id")
    return settled.unionByName(left)


def apply_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed rows: each document ``copies`` times, and once more with its first ``part`` words if that is not 0.

    Columns are those of ``docs``; n_chars, where there is one, follows the text. Rows that repeat a doc_id are
    taken alike. The shortened text has its words joined by spaces.
    """
    rows = _with_copies(docs, plan)
    whole = F.when(F.col("_copies") > 0, F.array_repeat(F.lit(0).cast("long"), F.col("_copies").cast("int"))).otherwise(
        F.array().cast("array<bigint>")
    )
    share = F.when(F.col("_part") > 0, F.array("_part")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_words", F.explode(F.concat(whole, share)))
    words = F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.lit(1), F.greatest(F.col("_words"), F.lit(1)).cast("int"))
    text = F.when(F.col("_words") > 0, F.array_join(words, " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        size = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col("_words") > 0, size).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
