"""Helpers the operators share: shared scratch tables, word patterns, Arrow columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Second and later bytes of a UTF-8 character.
CONTINUATION = bytes(range(0x80, 0xC0))


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local one only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage and fixes its size."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a batch of rows sent to a Python worker holds. Workers and their buffers are kept from stage to stage.
BATCH_BYTES = "4m"
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounded batches for the jobs run inside. Spark's own bound of 64 MB a batch stays in memory several times
    over, in the JVM and in each worker."""
    before = spark.conf.get(_BATCH_LIMIT, None)
    spark.conf.set(_BATCH_LIMIT, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_LIMIT)
        else:
            spark.conf.set(_BATCH_LIMIT, before)


_Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Memory that was freed goes back to the machine; allocators hold on to it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[_Batches], _Batches]) -> Callable[[_Batches], _Batches]:
    """``run`` for a worker that is kept when its task is over, next to other stages' workers."""

    def task(batches: _Batches) -> _Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def code_points(data: bytes) -> int:
    return len(data.translate(None, CONTINUATION))


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 * 2**20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a text column, a row at least.

    Spark's batches are bounded in rows, not bytes; what is made of a slice stays small whatever they hold.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def long_lists(arrays: list[np.ndarray], dtype: pa.DataType) -> pa.Array:
    """Numpy arrays as one Arrow list column."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=dtype))
