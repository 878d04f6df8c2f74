"""Bounded, reproducible samples of labelled rows, and words as hashed features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import crc_of_id_col, tidied


def training_rows(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from; null labels and repeated ids go."""
    rows = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id_col(), F.lit(modulus)) != held_out))
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest hash of doc_id: a sample that doesn't depend on partitions."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def featurised(documents: DataFrame, ids: list[int], extract, schema: str = "doc_id long, features array<int>"):
    """Rows (doc_id, features) on the driver for at most the given, bounded list of ids."""
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(wanted), "doc_id", "left_semi")  # its size is that of the sample
    return rows.mapInArrow(tidied(extract), schema).collect()


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def one_column(make, name: str, kind: pa.DataType):
    """An Arrow function: doc_id, and make(text) as the named column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(t.as_py() or b"") for t in batch.column(1)], kind)], names=["doc_id", name])

    return run


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scored(documents: DataFrame, score, modulus: int, held_out: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; score is an Arrow function of (doc_id, text as binary)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(tidied(score), "doc_id long, score double")
    return out.select("doc_id", (F.pmod(crc_of_id_col(), F.lit(modulus)) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
