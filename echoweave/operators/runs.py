"""Gaps and islands: one generic operator, and what is built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], new: Column, name: str = "run") -> DataFrame:
    """Number the islands of each key from 0: one begins where ``new`` is true. A first row begins one anyway."""
    return df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn(name, F.sum("_new").over(ordered(keys, order).rowsBetween(W.unboundedPreceding, 0)) - F.first("_new").over(ordered(keys, order).rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def label_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, name: str = "run") -> DataFrame:
    """Islands of equal neighbouring labels; nulls are equal to each other."""
    w = ordered(keys, order)
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)
    return islands(df, keys, order, changed, name)


def turns(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, start: str, end: str) -> DataFrame:
    """Speaker turns: runs of one label with the smallest start, the largest end and the number of tokens."""
    return label_runs(df, keys, order, label).groupBy(*keys, "run", label).agg(F.min(start).alias("start_ms"), F.max(end).alias("end_ms"), F.count(F.lit(1)).alias("n"))


def merge_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, start: str, end: str) -> DataFrame:
    """Merged results: runs of one label with the first row's start and the last row's end; merge_id from 1."""
    at = F.struct(*order)
    return (
        label_runs(df, keys, order, label).groupBy(*keys, "run", label)
        .agg(F.min_by(start, at).alias("start_ms"), F.max_by(end, at).alias("end_ms"), F.count(F.lit(1)).alias("n"))
        .withColumn("merge_id", F.col("run") + 1).drop("run")
    )


def runs_where(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column, least: int = 1) -> DataFrame:
    """Runs of rows that meet a condition, of ``least`` rows or more: run, n, first_pos (from 1)."""
    w = ordered(keys, order)
    marked = df.withColumn("_hit", F.coalesce(condition, F.lit(False))).withColumn("_pos", F.row_number().over(w).cast("long"))
    return label_runs(marked, keys, order, "_hit").where("_hit").groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first_pos")).where(F.col("n") >= least)


def longest_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """The longest run of each key, the first of equal ones."""
    best = F.struct("n", (-F.col("first_pos")).alias("first"))
    return runs_where(df, keys, order, condition).groupBy(*keys).agg(F.max(best).alias("b")).select(*keys, F.col("b.n").alias("n"), (-F.col("b.first")).alias("first_pos"))


def dense_relabel(df: DataFrame, label: str, name: str = "new_label") -> DataFrame:
    """Labels renumbered from 0 in their own order. The labels are ranked in a table of their own, one row each."""
    ranks = df.select(label).where(F.col(label).isNotNull()).distinct().withColumn(name, F.row_number().over(W.orderBy(label)) - 1)
    return df.join(ranks, label, "left")


def relabel_first_seen(df: DataFrame, label: str, at: str, name: str = "new_label") -> DataFrame:
    """Labels renumbered from 0 by their first occurrence, ties by label; negative labels stay."""
    first = df.where(F.col(label) >= 0).groupBy(label).agg(F.min(at).alias("_first"))
    ranks = first.select(label, (F.row_number().over(W.orderBy("_first", label)) - 1).cast("long").alias("_rank"))
    return df.join(ranks, label, "left").withColumn(name, F.coalesce("_rank", label)).drop("_rank")


def contiguous_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], done: Column) -> DataFrame:
    """How far each key is complete without a gap: the number of done rows before the first that isn't."""
    w = ordered(keys, order)
    gaps = F.sum(F.when(F.coalesce(done, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_gaps", gaps).groupBy(*keys).agg(F.sum(F.when(F.col("_gaps") == 0, 1).otherwise(0)).alias("done_through"), F.count(F.lit(1)).alias("total"))
