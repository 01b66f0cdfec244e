"""From raw documents to token shards: each stage works on all that the one before it kept.

For every stage: nulls in any column are allowed (a null text is empty, a null doc_id a document like any other), texts may be of any
length, an empty table gives an empty one, and all columns but those of the last stage come out as they went in, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, mixing, quality, simhash, tokens
from weftline.llm.common import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws and that aren't toxic; rows that repeat id and text go or stay together."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of 5 words, similarity 0.8 at least. The smallest id stays; of rows that repeat it, one."""
    return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; repeated rows go or stay together."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; an id may occur twice. Rows that repeat an id draw alike; a null source is a source of its own."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all documents, read back: doc_id, start, n_tokens, ids_crc32; an empty text has its end id alone."""
    return tokens.write_and_read(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix_sources),
    ("token output", encode_tokens),
]

#: Several stages can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (last_name, last) = STAGES
    for name, stage in first:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return last(spark, docs, sf_dir)
