"""An index of match scores on disk, in buckets by target.

A bucket is a partition of the Parquet table, so a look-up reads the one bucket
of its target, and an update writes only the buckets that it touches. Each row
has all that a look-up needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoweave.operators.stages import materialized

BUCKETS = 256


def bucket_of(target: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(target), F.lit(buckets)).cast("int")


def write_index(scores: DataFrame, path: str, target: str = "target", buckets: int = BUCKETS) -> None:
    """scores(target, candidate, person, score) as a new index; a bucket's rows are written by one task, sorted by target."""
    rows = scores.withColumn("bucket", bucket_of(F.col(target), buckets))
    rows.repartition("bucket").sortWithinPartitions("bucket", target).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def update_index(spark: SparkSession, path: str, changed: DataFrame, removed: DataFrame, target: str = "target", candidate: str = "candidate", buckets: int = BUCKETS) -> int:
    """Bring an index up to date in place: removed(id) are gone as targets and as candidates, changed are all rows of the targets in it.

    Returns how many buckets were written: those of changed and removed targets,
    and those where a removed id is a candidate. Others are not touched.
    """
    old, names = read_index(spark, path), changed.columns
    gone = removed.select(F.col("id").alias("_gone")).distinct()
    touched = changed.select(bucket_of(F.col(target), buckets).alias("bucket")).unionByName(gone.select(bucket_of(F.col("_gone"), buckets).alias("bucket"))).unionByName(old.join(gone, F.col(candidate) == F.col("_gone"), "left_semi").select("bucket"))
    touched = [r.bucket for r in touched.distinct().collect()]  # at most all buckets
    kept = old.where(F.col("bucket").isin(touched)).join(changed.select(target).distinct(), target, "left_anti")
    for c in (target, candidate):
        kept = kept.join(gone, F.col(c) == F.col("_gone"), "left_anti")
    new = changed.join(gone, F.col(candidate) == F.col("_gone"), "left_anti").withColumn("bucket", bucket_of(F.col(target), buckets))
    rows = kept.select(*names, "bucket").unionByName(new.select(*names, "bucket"))
    # buckets that end up empty have no rows to be overwritten by: a row of nulls keeps their place and is no one's target
    hold = spark.createDataFrame([(b,) for b in touched], "bucket int").select(*(F.lit(None).cast(changed.schema[c].dataType).alias(c) for c in names), "bucket")
    rows = materialized(rows.unionByName(hold))  # the buckets that are read are the ones that are written
    rows.repartition("bucket").sortWithinPartitions("bucket", target).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def matches(index: DataFrame, target: object, limit: int, excluding: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """person, score, candidate, rank: the people most alike a target, each by its best candidate, ties to the smaller name; candidates without a person don't count.

    The target's bucket is a constant of the plan: one partition is read.
    """
    wanted = F.lit(target).cast(index.schema["target"].dataType)  # another type has another hash
    mine = index.where((F.col("bucket") == bucket_of(wanted, buckets)) & (F.col("target") == wanted) & F.col("person").isNotNull())
    if excluding:
        mine = mine.where(~F.col("candidate").isin(*excluding))
    best = mine.groupBy("person").agg(F.max(F.struct("score", (-F.col("candidate")).alias("c"))).alias("b")).select("person", F.col("b.score").alias("score"), (-F.col("b.c")).alias("candidate"))
    rank = F.row_number().over(W.orderBy(F.desc("score"), "person")).cast("long")  # of one target's people
    return best.orderBy(F.desc("score"), "person").limit(limit).withColumn("rank", rank)
