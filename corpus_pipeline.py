"""Documents to packed sequences: STAGES in order, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of docs, whatever they are
called. Null and blank texts count as bad and go in the first stage; null ids and sources stay, and
rows that repeat are one group of copies, of which one stays. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelmill.llm.common import cut
from labelmill.llm.mixing import mixed
from labelmill.llm.packing import best_fit_pack
from labelmill.llm.quality import good_documents
from labelmill.llm.simhash import deduplicated
from labelmill.llm.toxicity import clean_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer takes for bad go."""
    return good_documents(docs, least=0.3)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples vote toxic go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard of five-word shingles 0.8 or more) the document with the smallest id stays."""
    return deduplicated(docs, half=1, width=5, least=0.8, stored=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target weight asks for."""
    return mixed(docs, weights=(5.0, 2.0, 1.0), most=3, stored=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is kept, repeats included, into sequences of at most 4096 tokens."""
    return best_fit_pack(docs, capacity=4096, end_id=1)


STAGES = [("quality_classifier", quality), ("toxicity", toxicity), ("simhash_near_dedup", near_duplicates), ("mixing", mix), ("best_fit_packing", pack)]

#: SQL can't train the scorers or tokenize, so tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
