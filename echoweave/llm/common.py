"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where
    that is unset, a temporary one is taken in local mode only.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that tell texts apart; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def drop_rows(docs: DataFrame, gone: DataFrame, again: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) without the rows of gone(doc_id, k1, k2), and with one row of each of again(doc_id, k1, k2).

    Rows are told apart by doc_id, null too, and text; gone and again have no row in common.
    """
    k1, k2 = text_keys(docs["text"])

    def join(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
        return df.join(keys, docs["doc_id"].eqNullSafe(keys["_id"]) & (k1 == keys["_k1"]) & (k2 == keys["_k2"]), how)

    left = join(docs, gone, "left_anti")
    if again.isEmpty():
        return left
    return join(left, again, "left_anti").unionByName(join(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def word_count(text: Column) -> Column:
    """Words in a text; null counts as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def doc_columns(df: DataFrame, *needed: str) -> DataFrame:
    """Only the named columns: extra ones can't clash with an operator's own."""
    return df.select(*(F.col(f"`{c}`") for c in needed))


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """For operators of many steps: queries made inside give their shuffle files back when they end, not when the
    driver collects its garbage, and checkpoints don't carry the constraints of all plans before them."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.constraintPropagation.enabled": "false"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
