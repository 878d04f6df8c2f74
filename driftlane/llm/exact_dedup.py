"""Exact removal of duplicates behind static binary-fuse filters.

A snapshot is an immutable set of documents with, per bucket of digests, a
static filter. An incoming batch is first grouped by digest on its own, with
partial sums before the shuffle, so a text that makes up a third of all rows
is one row from then on. Each distinct digest is then put to its bucket's
filter. Only positives are joined with the snapshot's digests, and for these
the normalised texts themselves are compared; a false positive finds no
partner or another text, and stays a group of its own.

Texts are equal when identical after removal of all of [\\x20\\x09-\\x0D]. The row
with most code points in its original text stays; of those, the smallest
doc_id.

Defined cases: a null text counts as empty; all empty texts are one group; a
null doc_id ranks after all ids and comes back as null; rows that repeat an id
and text share one decision (`keep_one` then returns one of them); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import NO_ID, materialise, real_id
from driftlane.llm.fuse_filter import BinaryFuse8

WHITE = " \t\n\x0b\x0c\r"
#: Distinct digests a bucket (and so a filter) should hold.
BUCKET_KEYS = 200_000


def _rid() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _xx() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def keyed(documents: DataFrame, *extra: Column) -> DataFrame:
    """(rid, xx, text) of documents; rid and xx together name a row up to its exact repeats."""
    return documents.select(_rid().alias("rid"), _xx().alias("xx"), "text", *extra)


def digests(rows: DataFrame, *extra: Column) -> DataFrame:
    """(rid, xx, sha, len) of rows (rid, xx, text)."""
    return rows.select("rid", "xx", *extra, F.sha2(normalised(F.col("text")), 256).alias("sha"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("len"))


def grouped(rows: DataFrame, *extra: str) -> DataFrame:
    """One row per digest: the best document and the number of rows."""
    best = F.max(F.struct(F.col("len"), (-F.col("rid")).alias("neg"), F.col("xx"))).alias("best")
    return rows.groupBy("sha", *extra).agg(best, F.count("*").alias("n"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring("sha", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _keys(sha: pd.Series) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(s[16:32] for s in sha)), ">u8").astype(np.uint64)


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) over a snapshot's distinct digests (sha)."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "filter": [BinaryFuse8.build(_keys(pdf["sha"])).to_bytes()]})

    return snapshot.select("sha", _bucket(buckets).alias("bucket")).groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Those of the batch's distinct digests that a filter doesn't rule out."""

    def put(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(batch) or not len(filters):
            return batch[["sha"]].iloc[:0]
        return batch.loc[BinaryFuse8.from_bytes(filters["filter"].iloc[0]).contains(_keys(batch["sha"])), ["sha"]]

    keyed = batch.select("sha", _bucket(buckets).alias("bucket"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(put, "sha string")


def _other_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (sha, old, new) of rows (rid, xx), those whose normalised texts differ after all; ids and texts meet in one shuffle."""
    need = pairs.select("sha", F.explode(F.array("old", "new")).alias("r")).select("sha", "r.*")
    texts = docs.select("rid", "xx", "text").join(need.hint("shuffle_hash"), ["rid", "xx"]).select("sha", normalised(F.col("text")).alias("text"))
    texts = texts.filter(F.sha2("text", 256) == F.col("sha"))
    return texts.groupBy("sha").agg((F.min("text") != F.max("text")).alias("differ")).filter("differ").select("sha")


def _decided(documents: DataFrame, in_snapshot: Column | None) -> DataFrame:
    """rid, xx, sha, keep, keep_xx and size of each row."""
    if in_snapshot is None:
        in_snapshot = F.pmod(F.xxhash64(_rid()), F.lit(2)) == 0
    docs = keyed(documents, F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    rows = materialise(digests(docs, F.col("old")))
    groups = materialise(grouped(rows, "old"))
    snapshot, batch = groups.filter("old"), groups.filter("not old")
    # both sides of a bucket meet in one task
    most = groups.groupBy("old").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // BUCKET_KEYS))

    positive = screen(batch, build_filters(snapshot, buckets), buckets)
    name = lambda df, n: df.select("sha", F.struct((-F.col("best.neg")).alias("rid"), F.col("best.xx").alias("xx")).alias(n))
    pairs = materialise(name(snapshot, "old").join(name(batch, "new").join(positive, "sha"), "sha"))
    other = _other_texts(docs, pairs).withColumn("apart", F.lit(1))

    parted = groups.join(other, "sha", "left").withColumn("part", F.when(F.col("old") | F.col("apart").isNull(), 0).otherwise(1)).select("sha", "old", "part", "best", "n")
    whole = parted.groupBy("sha", "part").agg(F.max("best").alias("best"), F.sum("n").alias("size"))
    decided = parted.select("sha", "old", "part").join(whole, ["sha", "part"]).select("sha", "old", (-F.col("best.neg")).alias("keep"), F.col("best.xx").alias("keep_xx"), "size")
    return rows.select("rid", "xx", "sha", "old").join(decided, ["sha", "old"])


def dedup(documents: DataFrame, in_snapshot: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    in_snapshot says which rows are the standing snapshot; the rest is the incoming batch. By default a hash of the id parts them.
    """
    out = _decided(documents, in_snapshot)
    return out.select(
        real_id(F.col("rid")).alias("doc_id"),
        real_id(F.col("keep")).alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents with one of each group, all columns kept. Rows are decided on without their texts."""
    decided = materialise(_decided(documents, None))
    stays = (F.col("rid") == F.col("keep")) & (F.col("xx") == F.col("keep_xx"))
    return without(documents, decided.filter(~stays).select("rid", "xx"), decided.filter(stays).select("rid", "xx"))


def without(documents: DataFrame, dropped: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents but for dropped rows (rid, xx); exact repeats of a kept row become one, which costs nothing where there are none."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), _rid().alias("rid"), _xx().alias("xx"))
    rows = rows.join(dropped.distinct().hint("shuffle_hash"), ["rid", "xx"], "left_anti")
    if not kept.groupBy("rid", "xx").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["rid", "xx"])
    return rows.select("row.*")
