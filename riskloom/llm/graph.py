"""Connected components by alternating large-star and small-star steps over an edge table.

A step deals each edge to one of its nodes and finds a node's least neighbour in a window over its edges, which
Spark sorts and spills. Nodes of very many edges are dealt over parts, each with the node's smaller neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import lean, materialize

#: A node that is the smaller end of more edges than this, and of more than one in ``HEAVY_SHARE``, is dealt
#: over ``HEAVY_PARTS`` parts. So there are at most ``HEAVY_SHARE`` such nodes.
HEAVY_EDGES = 100
HEAVY_SHARE = 500
HEAVY_PARTS = 16


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task reduced to a star per component it sees, batch by batch."""
    for batch in batches:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in pairs], batch.schema.field(i).type) for i in (0, 1)], names=["a", "b"]
        )


def _dealt_both_ways(edges: DataFrame, size: int) -> DataFrame:
    """(node, part, other) of every edge from both ends; a heavy node's greater neighbours over parts, its
    smaller ones in each."""
    most = max(HEAVY_EDGES, 2 * size // HEAVY_SHARE)
    heavy = [r.b for r in edges.groupBy("b").count().filter(F.col("count") > most).select("b").collect()]
    zero = F.lit(0)
    if not heavy:
        ends = F.array(F.struct(F.col("a").alias("node"), zero.alias("part"), F.col("b").alias("other")),
                       F.struct(F.col("b").alias("node"), zero.alias("part"), F.col("a").alias("other")))
        return edges.select(F.inline(ends))
    spread = F.pmod(F.xxhash64("a"), F.lit(HEAVY_PARTS)).cast("int")
    every = F.when(F.col("a").isin(heavy), F.array(*map(F.lit, range(HEAVY_PARTS)))).otherwise(F.array(zero))
    down = edges.select(F.col("a").alias("node"), F.explode(every).alias("part"), F.col("b").alias("other"))
    up = edges.select(F.col("b").alias("node"), F.when(F.col("b").isin(heavy), spread).otherwise(zero).alias("part"), F.col("a").alias("other"))
    return down.unionByName(up)


def _step(edges: DataFrame, size: int) -> DataFrame:
    """Large-star then small-star; edges hold a > b."""
    both = _dealt_both_ways(edges, size)
    least = F.min("other").over(Window.partitionBy("node", "part"))
    large = both.withColumn("low", F.least("node", least)).filter("other > node")
    down = large.select(F.col("other").alias("node"), F.col("low").alias("other"))
    down = down.repartition("node").dropDuplicates(["node", "other"])
    down = down.withColumn("low", F.min("other").over(Window.partitionBy("node")))
    end = F.when(F.col("other") == F.col("low"), F.col("node")).otherwise(F.col("other"))
    return down.select(end.alias("a"), F.col("low").alias("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Ids are longs or strings, compared in Spark's order. Rows with a null end or a loop are ignored. Steps go on
    until nothing changes; labels only fall, so that comes.
    """
    clean = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    forest = clean.mapInArrow(lean(_local_forest), clean.schema)
    current = materialize(forest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        current = materialize(_step(current, now[0]))
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def joined_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` (node, component) after more edges (a, b): only edges between components are worked on."""
    names = [components.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in ("a", "b")]
    ends = edges.select("a", "b").distinct().join(names[0], "a", "left").join(names[1], "b", "left")
    ends = materialize(ends.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")))
    found = materialize(connected_components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
    single = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(components, "node", "left_anti")
    whole = components.unionByName(single.select("node", F.col("node").alias("component")))
    renamed = found.select(F.col("node").alias("component"), F.col("component").alias("now"))
    return whole.join(renamed, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
