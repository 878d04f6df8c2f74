"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor left
them, and returns a DataFrame; all but the last return the columns of
documents. Null and empty texts pass the filters as clean, form one group in
exact dedup, and end as sequences of the end token; an empty table gives an
empty result; extra columns go through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlane.llm import decontaminate, exact_dedup, near_dedup, packing
from driftlane.llm import toxicity as toxicity_model
from driftlane.llm.common import materialise, read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the positive-unlabelled model rejects."""
    return toxicity_model.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of near duplicates, from 80 % similarity on."""
    return near_dedup.keep_one(docs, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes benchmark passages."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the tokens into sequences of power-of-two length."""
    packed = packing.pack(docs, tokenizer_path())
    return packed.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("packing", pack)]

#: No SQL expresses the trained model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
