"""Exact dedup: a two-pass Bloom filter finds possibly repeated texts.

One scan of the texts writes ids and digests. Pass one: each task sets the bits
of its own rows in sorted runs of bit numbers - once, and twice where its own
rows repeat them - cut into shards of SHARD_BITS and packed as the gaps between
them, some three bytes a row and no record a row; a shard's runs meet in one
task, which keeps the bits that were set twice. Pass two probes these bits: a
text that has one to itself occurs once and passes straight through; only rows
that may be repeated are shuffled, by digest, and grouped exactly.

Scale: the filter has BITS_A_ROW bits a row, up to ``max_bits``. The bits set
twice are all that is broadcast, max_bits / 8 bytes at most. A table of more
rows than max_bits / BITS_A_ROW fills the filter, and more unique rows take the
exact path with the repeated ones; the result stays the same. Texts never move.
Groups are counted with map-side combine, and the join back is one that Spark's
adaptive execution splits where a text has very many rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, doc_columns, drop_rows, text_keys, tidy_shuffles

MIN_BITS, MAX_BITS, SHARD_BITS = 1 << 16, 1 << 31, 1 << 22
BITS_A_ROW = 16
PROBES = 3


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, max(MIN_BITS, 1 << (rows * BITS_A_ROW - 1).bit_length())) if rows else MIN_BITS


def places(k1: np.ndarray, k2: np.ndarray, bits: int) -> np.ndarray:
    """(rows, PROBES) bit numbers of texts with the keys k1, k2; bits is a power of two."""
    a, b = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(j) * b) & np.uint64(bits - 1) for j in range(PROBES)], 1).astype(np.int64)


def pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers of a shard as compressed gaps."""
    gaps = np.diff(numbers, prepend=0).astype("<u4")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)  # the bytes of a kind together


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64)


def runs_of_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Digests -> shard, once, twice: the bits that this task's rows set, and those that more than one sets."""
    shard_bits = min(bits, SHARD_BITS)
    held, n = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        at, count = np.unique(np.concatenate(held), return_counts=True)
        ends = np.searchsorted(at, np.arange(bits // shard_bits + 1) * shard_bits)
        full = np.flatnonzero(np.diff(ends))
        part = [(int(s), at[ends[s] : ends[s + 1]] - s * shard_bits, count[ends[s] : ends[s + 1]] > 1) for s in full]
        if part:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in part], pa.int32()), pa.array([pack(x) for _, x, _ in part], pa.binary()), pa.array([pack(x[more]) for _, x, more in part], pa.binary())], names=["shard", "once", "twice"])

    for b in batches:
        # a row counts a bit once, also where two of its probes meet
        p = np.sort(places(b.column("k1").to_numpy(), b.column("k2").to_numpy(), bits), 1)
        held.append(np.concatenate([p[:, 0], *(p[p[:, j] != p[:, j - 1], j] for j in range(1, PROBES))]))
        n += b.num_rows
        if n >= 1 << 20:
            yield from out()
            held, n = [], 0
    if held:
        yield from out()


def repeated_bits(digests: DataFrame, bits: int) -> np.ndarray:
    """Bytes of the filter: a bit is 1 where two rows or more set it. digests(k1, k2). bits/8 bytes at most reach the driver."""
    shard_bits = min(bits, SHARD_BITS)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(shard_bits, bool), np.zeros(shard_bits, bool)
        for one, two in zip(pdf["once"], pdf["twice"], strict=True):
            at = unpack(one)
            twice[at[once[at]]] = True
            once[at] = True
            twice[unpack(two)] = True
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    runs = digests.select("k1", "k2").mapInArrow(lambda batches: runs_of_bits(batches, bits), "shard int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in runs.groupBy("shard").applyInPandas(merge, "shard int, bits binary").toLocalIterator():
        out[row.shard * shard_bits // 8 :][: shard_bits // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def decided(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """exact_groups() with k1, k2 of the text."""
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        text = F.coalesce(F.col("text"), F.lit(""))
        digests = doc_columns(docs, "doc_id", "text").select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"), *text_keys(F.col("text")))
        digests = checkpointed(digests.withColumn("row", F.monotonically_increasing_id()))
    bits = filter_bits(digests.count(), max_bits)
    shared = spark.sparkContext.broadcast(repeated_bits(digests, bits))
    names = [*digests.columns, "maybe"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for b in batches:
            at = places(b.column("k1").to_numpy(), b.column("k2").to_numpy(), bits)
            maybe = ((seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1).all(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe)], names=names)

    probed = digests.mapInArrow(probe, "doc_id long, text_sha256 string, k1 long, k2 long, row long, maybe boolean")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "k1", "k2"]
    once = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "k1", "k2")
    rows = probed.where("maybe")
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("last"))).alias("best")
    groups = rows.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size"))
    more = rows.join(groups, "text_sha256").withColumns({"keep_id": F.col("best.doc_id"), "kept": F.col("row") == -F.col("best.last")}).select(*columns)
    return once.unionByName(more)


def exact_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the
    row with the largest doc_id stays, of rows that repeat it one. A null doc_id
    loses to any other; of a text with null ids only one row stays and keep_id
    is null. No documents: no rows. Other columns are ignored.
    """
    return decided(docs, max_bits).drop("k1", "k2")


def exact_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay, all their columns: one row for each different text, as exact_groups() decides.

    Null ids, ids that repeat with other texts and extra columns of any name are
    kept as they are. No documents: no rows.
    """
    rows = decided(docs, max_bits).where("group_size > 1").groupBy("doc_id", "k1", "k2").agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    with tidy_shuffles(docs.sparkSession):
        rows = checkpointed(rows)
    return drop_rows(docs, rows.where("not stays"), rows.where("stays and n > 1"))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
