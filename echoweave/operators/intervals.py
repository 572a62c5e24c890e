"""Interval joins and interval constraints.

Containment and ownership are range joins. They are made equi-joins on the key
and a time bucket: the interval side is exploded over the buckets that it
touches, the point side has one, so a hot key is dealt over its buckets and no
nested loop over a key's rows is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runs import ordered


def point_in_interval(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, bucket: int, how: str = "inner") -> DataFrame:
    """Rows of points with the ranges [lo, hi) of the same keys that hold their point."""
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    r = ranges.where(F.col(hi) > F.col(lo)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket))))
    p, r = p.alias("p"), r.alias("r")
    on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in (*keys, "_b")] + [F.col(f"p.{at}") >= F.col(f"r.{lo}"), F.col(f"p.{at}") < F.col(f"r.{hi}")]
    rest = [F.col(f"r.{c}") for c in ranges.columns if c not in keys]
    return p.join(r, on, how).select("p.*", *rest).drop("_b")


def ownership(tokens: DataFrame, ranges: DataFrame, keys: Sequence[str], start: str, end: str, lo: str, hi: str, bucket: int) -> DataFrame:
    """Tokens whose middle lies in an owned range, clipped to it."""
    mid = tokens.withColumn("_mid", F.floor((F.col(start) + F.col(end)) / 2))
    held = point_in_interval(mid, ranges, keys, "_mid", lo, hi, bucket)
    return held.withColumns({"own_start": F.greatest(start, lo), "own_end": F.least(end, hi)}).drop("_mid")


def containment(tokens: DataFrame, ranges: DataFrame, keys: Sequence[str], start: str, end: str, lo: str, hi: str, bucket: int) -> DataFrame:
    """Tokens with the closed range [lo, hi] that holds all of them."""
    r = ranges.withColumn("_stop", F.col(hi) + 1)
    return point_in_interval(tokens, r, keys, start, lo, "_stop", bucket).where(F.col(end) <= F.col(hi)).drop("_stop")


def overlap_violations(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows that begin before an earlier one ends."""
    reach = F.max(end).over(ordered(keys, order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("reach", reach).where(F.col(start) < F.col("reach"))


def clamp_filter_fallback(df: DataFrame, keys: Sequence[str], start: str, end: str, total: Column, shorter: int) -> DataFrame:
    """Ranges clamped to [0, total] and over ``shorter`` ms; a key without any keeps the whole."""
    cut = df.select(*keys, total.alias("_total"), F.least(F.greatest(F.col(start), F.lit(0)), total).alias("start_ms"), F.least(F.greatest(F.col(end), F.lit(0)), total).alias("end_ms"))
    good = cut.where(F.col("end_ms") - F.col("start_ms") > shorter).select(*keys, "start_ms", "end_ms", F.lit(False).alias("fallback"))
    whole = cut.groupBy(*keys).agg(F.max("_total").alias("end_ms")).join(good.select(*keys).distinct(), list(keys), "left_anti")
    return good.unionByName(whole.select(*keys, F.lit(0).cast("long").alias("start_ms"), "end_ms", F.lit(True).alias("fallback")))


def containment_violations(df: DataFrame, start: str, end: str, lo: str, hi: str) -> DataFrame:
    """Rows that are inverted or leave the interval that should hold them."""
    return df.where((F.col(start) < F.col(lo)) | (F.col(end) > F.col(hi)) | (F.col(end) < F.col(start)))
