"""A training corpus from ``documents`` in five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import BATCH_BYTES, materialize
from riskloom.llm.jaccard_join import jaccard_components
from riskloom.llm.line_dedup import dedup_lines
from riskloom.llm.mixing import apply_mix, mix_sources
from riskloom.llm.sentencepiece_viterbi import encode
from riskloom.llm.toxicity import drop_toxic, fit


def _bounded_batches(spark: SparkSession) -> None:
    """Spark's own bound of 64 MB a batch stays in memory several times over, in the JVM and in each worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine learnt from ``labels`` rejects go; the others stay as they are."""
    _bounded_batches(spark)
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines found in several documents stay in the last one only. A document may become empty, none goes."""
    _bounded_batches(spark)
    kept = dedup_lines(docs)
    size = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", size).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; of rows with one doc_id and text, one stays.

    A row without doc_id cannot be named and stays. Only ids of documents that go are joined to the texts.
    """
    _bounded_batches(spark)
    found = jaccard_components(docs)
    gone = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    repeated = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_again")).count().filter("count > 1")
    repeated = materialize(repeated.select("_again"))
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, F.col("doc_id") == F.col("_again"), "left_anti")
    again = left.join(repeated, F.col("doc_id") == F.col("_again"), "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, repeated, or (one a source at most) shortened."""
    _bounded_batches(spark)
    return apply_mix(docs, materialize(mix_sources(docs)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("Jaccard join", without_near_copies),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: A trained machine and a piece model decide the rows, which SQL cannot express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
