"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row.

    A Python variable that holds a Column is a formula, so using it twice evaluates it twice, and
    nesting such uses grows the plan exponentially. A lambda variable is bound once, also inside
    other lambdas, where Spark's common-subexpression elimination does not reach.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def record(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def staged(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df`` with new columns that are computed once, whatever is filtered or joined on them.

    The optimiser pushes a filter below a projection by writing the projected formula into it,
    which computes an expensive formula twice. It does not push below a generator, so the values
    go through a one-element array.
    """
    return df.select(*keep, F.inline(F.array(record(**columns))))


def each(array: Column) -> Column:
    """Generator over an array of structs that does not add a size filter on the array.

    For a plain column the optimiser infers ``size > 0`` and pushes it down, where it would
    compute the array a second time.
    """
    return F.inline(F.slice(array, F.lit(1), F.lit(2147483647)))
