"""Gapless numbers for the rows of a distributed table, without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places are numbers below this.
PLACES = 2**32


def place(*columns: Column) -> Column:
    """A number below 2**32 from the columns, even over different rows; nulls count as the text ``null``."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def number_rows(
    df: DataFrame,
    name: str,
    groups: Sequence[str],
    order: Sequence[str],
    copies: Column | None = None,
    block_rows: int = 100_000,
) -> DataFrame:
    """``df`` with a long column ``name``: within each group rows are numbered from 0 by ``order``.

    ``df`` is read three times, so pass a written table. The first column of ``order`` holds places: the range
    of places is cut into blocks of some ``block_rows`` rows, blocks are counted, and a row's number is what
    lies in earlier blocks and before it in its own. ``copies``: how many numbers a row takes, 1 if not given.
    """
    copies = F.lit(1) if copies is None else copies
    blocks = max(1, -(-df.count() // block_rows))
    at = F.col(order[0])
    cut = df.withColumn("_block", F.shiftright(at * F.lit(blocks), 32)).withColumn("_copies", copies.cast("long"))
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*groups, "_block").orderBy(*order).rowsBetween(*before)
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(*before)
    sizes = cut.groupBy(*groups, "_block").agg(F.sum("_copies").alias("_size"))
    offsets = sizes.select(
        *[F.col(g).alias(f"_{g}") for g in groups],
        F.col("_block").alias("_of"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
    )
    own = cut.withColumn("_inside", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    same = [F.col(g) == F.col(f"_{g}") for g in groups]
    met = own.join(offsets, [F.col("_block") == F.col("_of"), *same])
    return met.select(*df.columns, (F.col("_offset") + F.col("_inside")).alias(name))
