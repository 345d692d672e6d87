"""Registered queries of the training-data operators, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.collocations import COLLOCATION_SQL, collocations
from riskloom.llm.component_sql import EMBEDDING_SQL, JACCARD_SQL
from riskloom.llm.compression import compression_bands
from riskloom.llm.cover_tree import near_duplicates
from riskloom.llm.html_layout import extract_html
from riskloom.llm.jaccard_join import jaccard_components
from riskloom.llm.license_rules import LICENSE_SQL, scan_licenses
from riskloom.llm.line_dedup import LINE_DEDUP_SQL, dedup_lines
from riskloom.llm.mixing import mix_sources
from riskloom.llm.rendezvous import SHARD_SQL, assign_shards
from riskloom.llm.sentencepiece_viterbi import encode
from riskloom.llm.toxicity import fit, score_toxicity
from riskloom.llm.warc import WARC_SQL, archive_pages
from riskloom.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("set_key")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op11_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_compression_bands": op1_compression_bands,
    "op2_toxicity": op2_toxicity,
    "op3_license_rules": op3_license_rules,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_cover_tree": op6_cover_tree,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc": op8_warc,
    "op9_html_layout": op9_html_layout,
    "op10_line_dedup": op10_line_dedup,
    "op11_rendezvous": op11_rendezvous,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}
SQL: dict[str, str] = {
    "op3_license_rules": LICENSE_SQL,
    "op6_cover_tree": EMBEDDING_SQL,
    "op7_jaccard_join": JACCARD_SQL,
    "op8_warc": WARC_SQL,
    "op10_line_dedup": LINE_DEDUP_SQL,
    "op11_rendezvous": SHARD_SQL,
    "op13_collocations": COLLOCATION_SQL,
}
