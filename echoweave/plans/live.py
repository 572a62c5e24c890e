"""The live chain over the events table: values are frames, simple functions stand for the models."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoweave.operators import runs
from echoweave.streaming import live

from .registry import KEYS, ORDER, query, tokens

S, D = SparkSession, str

#: Frames of a chunk, and the folds' sizes for recordings of some dozens of frames.
CHUNK = 16
SIZES = {"endpoints": {"window": 4, "enter": 3, "leave": 2, "start_back": 2, "quiet": 3, "end_back": 1, "longest": 300}, "batches": {"least": 60, "gap": 40, "span": 400}}


def hear(frames: list[float], cache: bytes | None) -> tuple[list[bool], bytes]:
    """Speech where a running mean, the cache, is above a level."""
    level, out = struct.unpack("<d", cache)[0] if cache else 0.0, []
    for f in frames:
        level = 0.5 * level + 0.5 * f
        out.append(level > 0.4)
    return out, struct.pack("<d", level)


def recognise(frames: list[float]) -> list[tuple[str, int, int]]:
    """A token every second frame."""
    return [(f"t{round(1000 * frames[i])}", i * 10, i * 10 + 20) for i in range(0, len(frames) - 1, 2)]


def mark(words: list[str]) -> list[int]:
    return [3 if w[-1] == "7" else 2 if w[-1] == "3" else 1 for w in words]


MODELS = live.Models(hear, recognise, mark)


@query()
def live_chain(spark: S, d: D) -> DataFrame:
    """Each user's events in chunks through the whole chain, speech model to marks; the same chain runs in a stream."""
    t = tokens(spark, d).select("user_id", (F.row_number().over(runs.ordered(KEYS, ORDER)) - 1).alias("pos"), (F.col("value") / 100).alias("frame"))
    t = t.withColumn("chunk_id", F.floor(F.col("pos") / CHUNK)).groupBy("user_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "frame"))), lambda x: x["frame"]).alias("frames"))
    t = t.withColumn("last", F.col("chunk_id") == F.max("chunk_id").over(W.partitionBy("user_id")))
    return live.transcripts(t, MODELS, KEYS, **SIZES)
