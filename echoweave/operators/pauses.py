"""Acoustic confirmation of pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import nearest_rank
from .intervals import point_in_interval
from .runs import longest_run

#: The quantile and the drop below it that is quiet, the shortest silence, how near it ends, a frame.
QUANTILE, DROP, LEAST_MS, NEAR_MS, FRAME_MS = 0.75, 3.0, 200, 120, 10


def confirm_pauses(candidates: DataFrame, energies: DataFrame, key: str = "job_id") -> DataFrame:
    """candidates(key, pos, lo_ms, hi_ms, boundary_ms), energies(key, frame_id, energy) -> pos, silence_ms; null where not confirmed.

    Quiet frames lie DROP below both the recording's and the candidate's upper
    quartile. Only the longest quiet run counts, the first of equal ones: it has
    to last LEAST_MS and to end within NEAR_MS of the boundary. A candidate
    without frames isn't confirmed.
    """
    e = energies.withColumn("at_ms", F.col("frame_id") * FRAME_MS)
    whole = nearest_rank(e, [key], "energy", "frame_id", QUANTILE).select(key, F.col("percentile").alias("_g"))
    inside = point_in_interval(e, candidates.select(key, "pos", "lo_ms", "hi_ms", "boundary_ms"), [key], "at_ms", "lo_ms", "hi_ms", 10_000)
    local = nearest_rank(inside, [key, "pos"], "energy", "frame_id", QUANTILE).select(key, "pos", F.col("percentile").alias("_l"))
    rows = inside.join(whole, key).join(local, [key, "pos"])
    run = longest_run(rows, [key, "pos"], ["frame_id"], F.col("energy") <= F.least("_g", "_l") - DROP)
    first = inside.groupBy(key, "pos").agg(F.min("frame_id").alias("_f"))
    run = run.join(first, [key, "pos"]).select(key, "pos", (F.col("n") * FRAME_MS).alias("silence_ms"), ((F.col("_f") + F.col("first_pos") - 1 + F.col("n")) * FRAME_MS).alias("_end"))
    out = candidates.join(run, [key, "pos"], "left")
    ok = (F.col("silence_ms") >= LEAST_MS) & (F.abs(F.col("_end") - F.col("boundary_ms")) <= NEAR_MS)
    return out.select(key, "pos", F.when(ok, F.col("silence_ms")).alias("silence_ms"))
