"""Token timelines: clamping, overlaps, islands, chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runs import islands, ordered


def explode_with_fallback(df: DataFrame, keys: Sequence[str], items: Column) -> DataFrame:
    """One row per item with its index; a row without any yields one synthetic empty item."""
    some = F.filter(items, lambda x: x != "")
    safe = F.when(F.coalesce(F.size(some), F.lit(0)) > 0, some).otherwise(F.array(F.lit("")))
    return df.select(*keys, F.coalesce(F.size(some), F.lit(0)).alias("_n"), F.posexplode(safe).alias("item_idx", "item")).withColumn("fallback", F.col("_n") == 0).drop("_n")


def clamp_flags(df: DataFrame, keys: Sequence[str], start: str, end: str, source: str, lo: Column, hi: Column) -> DataFrame:
    """Clamp to [lo, hi], swap inverted ends, and flag rows that were clamped or whose place in time isn't their source place."""
    cut = lambda c: F.least(F.greatest(F.col(c), lo), hi)
    a, b = F.least(cut(start), cut(end)), F.greatest(cut(start), cut(end))
    by_time = W.partitionBy(*keys).orderBy(start, end, source)
    by_source = W.partitionBy(*keys).orderBy(source)
    return df.select(*keys, source, a.alias("start_ms"), b.alias("end_ms"), ((cut(start) != F.col(start)) | (cut(end) != F.col(end))).alias("clamped"), (F.row_number().over(by_time) != F.row_number().over(by_source)).alias("out_of_order"))


def clamp_overlap(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str) -> DataFrame:
    """An end beyond the next start becomes that start, not before its own start."""
    nxt = F.lead(start).over(ordered(keys, order))
    return df.withColumn(end, F.when(F.col(end) > nxt, F.greatest(F.col(start), nxt)).otherwise(F.col(end)))


def resolve_overlaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str) -> DataFrame:
    """Neighbours that overlap part at the middle of the overlap; in a chain no later boundary lies before an earlier one."""
    w = ordered(keys, order)
    overlap = F.col(end) > F.lead(start).over(w)
    df = df.withColumn("_cut", F.when(overlap, F.floor((F.least(F.col(end), F.lead(end).over(w)) + F.lead(start).over(w)) / 2)))
    df = df.withColumn("_chain", F.coalesce(F.sum(F.when(F.col("_cut").isNull(), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    chain = W.partitionBy(*keys, "_chain").orderBy(*order)
    df = df.withColumn("_right", F.when(F.col("_cut").isNotNull(), F.min("_cut").over(chain.rowsBetween(0, W.unboundedFollowing))))
    df = df.withColumn("_left", F.lag("_right").over(w))
    lo = F.greatest(F.col(start), F.coalesce("_left", start))
    hi = F.least(F.col(end), F.coalesce("_right", end))
    clipped = (lo != F.col(start)) | (hi != F.col(end))
    return df.withColumns({"eff_start": lo, "eff_end": F.greatest(lo, hi), "clipped": clipped}).drop("_cut", "_chain", "_right", "_left")


def gap_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, gap: int, label: str | None = None) -> DataFrame:
    """A new island where the label changes or the pause since the row before is ``gap`` or more."""
    w = ordered(keys, order)
    new = F.col(start) - F.lag(end).over(w) >= gap
    if label:
        new = new | ~F.col(label).eqNullSafe(F.lag(label).over(w))
    return islands(df, keys, order, new | (F.row_number().over(w) == 1), "island_id")


def sliding_chunks(df: DataFrame, start: str, end: str, size: int, shift: int, shorter: int) -> DataFrame:
    """Chunks of ``size`` every ``shift`` ms; the last one is moved back to end with the range; chunks not over ``shorter`` go."""
    length = F.col(end) - F.col(start)
    steps = F.when(length <= size, F.lit(0)).otherwise(F.ceil((length - size) / shift))
    at = df.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long"))))
    hi = F.least(F.col(start) + F.col("chunk_idx") * shift + size, F.col(end))
    lo = F.greatest(hi - size, F.col(start))
    return at.withColumns({"chunk_start": lo, "chunk_end": hi}).where(F.col("chunk_end") - F.col("chunk_start") > shorter)


def overlong_windows(df: DataFrame, lo: str, hi: str, capacity: int = 148, stride: int = 75) -> DataFrame:
    """Windows of ``capacity`` frames every ``stride`` over a long token, until the end is reached."""
    steps = F.greatest(F.ceil((F.col(hi) - F.col(lo) - capacity) / stride), F.lit(0))
    at = df.withColumn("window_idx", F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long"))))
    first = F.col(lo) + F.col("window_idx") * stride
    return at.withColumns({"win_lo": first, "win_hi": F.least(first + capacity, F.col(hi))})


def pause_candidates(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, least: int) -> DataFrame:
    """Of each key the place with the largest max(duration, pause to the next) of at least ``least``, the earliest on a tie."""
    w = ordered(keys, order)
    rows = df.withColumns({"pos": F.row_number().over(w).cast("long"), "_gap": F.greatest(F.col(end) - F.col(start), F.lead(start).over(w) - F.col(end)), "_last": F.lead(start).over(w).isNull()})
    best = F.struct(F.col("_gap").alias("gap"), (-F.col("pos")).alias("neg"))
    return rows.where(~F.col("_last") & (F.col("_gap") >= least)).groupBy(*keys).agg(F.max(best).alias("b")).select(*keys, F.col("b.gap").alias("gap_ms"), (-F.col("b.neg")).alias("pos"))


def sub_sentences(df: DataFrame, keys: Sequence[str], order: Sequence[str], mark: Column) -> DataFrame:
    """Parts of a run that end with a mark; a mark on the first or the last token ends nothing."""
    w = ordered(keys, order)
    ends_before = F.lag(mark).over(w) & (F.row_number().over(w) > 2)
    return islands(df, keys, order, F.coalesce(ends_before, F.lit(False)) | (F.row_number().over(w) == 1), "sub_id")
