"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null doc_id inside an operator, so that any real id is smaller.
NO_ID = 2**63 - 1

#: Where the frames of `materialise` lie.
_paths: dict[int, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of its own only in local mode, where all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{tempfile.gettempdir()}/driftlane-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back. The files go when Spark ends, or by `dropped`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a frame from `materialise` that nothing reads any more."""
    fs, p = _hadoop(df.sparkSession, _paths[id(df)])
    fs.delete(p, True)


def with_rid(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid"), "text")


def real_id(col):
    return F.when(col != F.lit(NO_ID), col)


def crc_of_id(doc_id) -> int:
    """crc32 of doc_id written as text (a null id as the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_of_id_col(col="doc_id"):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser, applied elementwise to uint64."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(keep) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b if keep(b) else 32 for b in range(256))


#: A-Z lower-cased; every ASCII byte but letters and digits becomes a space. Bytes of other characters stay.
ALNUM_TABLE = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased (A-Z) text."""
    return text.translate(ALNUM_TABLE).split()


def space_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the lower-cased (A-Z) text."""
    return text.lower().split()


def tidied(run):
    """The Arrow function run; after each batch it yields, memory that Arrow holds without use goes back to the system."""

    def tidy(batches):
        pool = pa.default_memory_pool()
        for batch in run(batches):
            yield batch
            del batch
            pool.release_unused()

    return tidy


class Cache(dict):
    """A memo of a function of one key, bounded by keys and by their length (longer keys aren't kept)."""

    def __init__(self, make, limit: int = 100_000, longest: int = 256):
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
