"""Small constant tables and the driver's parquet tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant table from the rule lists: planned as a local relation, so its exact size is
    known to the optimiser and it is broadcast without a hint."""
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [[] for _ in struct]
    arrays = [pa.array(list(col), type=f.type) for col, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=struct)


# Tables whose rows are costly to scan; the others are read as they lie.
TEXT_TABLES = {"documents", "pages", "conversations", "events"}


#: A session setting for runs on one small file: into how many partitions its rows are dealt. Unset, which
#: is right for tables of many files, nothing is moved.
DEALT = "riskloom.scan.partitions"


def dealt(df: DataFrame) -> DataFrame:
    parts = df.sparkSession.conf.get(DEALT, None)
    return df.repartition(int(parts)) if parts else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(df) if name in TEXT_TABLES else df
