"""Signal operators: framing, filterbank, stacking, quiet runs, gathering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runs import ordered

#: Fixed values of the acoustic front end.
RATE, FRAME, SHIFT, FFT, BINS = 16_000, 400, 160, 512, 80
#: Chunks of an Arrow batch whose frames are made at a time.
CHUNKS = 16
LOW_HZ, HIGH_HZ, EMPHASIS, SCALE, POWER, FLOOR = 20.0, 8_000.0, 0.97, 32_768.0, 0.25, 1e-10


def mel(hz):
    return 1127.0 * np.log1p(np.asarray(hz) / 700.0)


@cache
def filterbank(bins: int = BINS) -> np.ndarray:
    """(bins, FFT / 2 + 1): triangles, evenly spaced in mel."""
    at = mel(np.arange(FFT // 2 + 1) * RATE / FFT)
    edges = np.linspace(mel(LOW_HZ), mel(HIGH_HZ), bins + 2)
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((at - left) / (mid - left), (right - at) / (right - mid)), 0, None)


def log_mel(samples: np.ndarray) -> np.ndarray:
    """(frames, 80) of a signal in -1..1."""
    n = (len(samples) - FRAME) // SHIFT + 1 if len(samples) >= FRAME else 0
    if n <= 0:
        return np.zeros((0, BINS))
    x = np.lib.stride_tricks.sliding_window_view(samples * SCALE, FRAME)[::SHIFT][:n]
    x = x - x.mean(1, keepdims=True)
    x = x - EMPHASIS * np.concatenate([x[:, :1], x[:, :-1]], 1)
    power = np.abs(np.fft.rfft(x * np.hamming(FRAME), FFT)) ** 2 * POWER
    return np.log(np.maximum(power @ filterbank().T, FLOOR))


def fbank_frames(chunks: DataFrame) -> DataFrame:
    """chunks(job_id, first_frame, samples array<float>) -> job_id, frame_id, mel.

    A recording comes in chunks that overlap by FRAME - SHIFT samples, so a long
    one is dealt over tasks and no task needs a neighbour's samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, CHUNKS):
                part = b.slice(lo, CHUNKS)
                mels = [log_mel(x.values.to_numpy(zero_copy_only=False).astype(float)) for x in part.column("samples")]
                n = np.array([len(m) for m in mels])
                m = np.concatenate(mels)
                frame = np.repeat(part.column("first_frame").to_numpy() - (np.cumsum(n) - n), n) + np.arange(len(m))
                job = part.column("job_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * BINS, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([job, pa.array(frame, pa.int64()), lists], names=["job_id", "frame_id", "mel"])

    return chunks.select("job_id", "first_frame", "samples").mapInArrow(run, "job_id string, frame_id long, mel array<double>")


def stack_frames(df: DataFrame, keys: list[str], order: list[str], vector: str, m: int, n: int) -> DataFrame:
    """Every n-th frame with its neighbours, m in all; beyond the ends the first and the last frame repeat."""
    w = ordered(keys, order)
    left = (m - 1) // 2
    whole = W.partitionBy(*keys)
    first, last = F.first(vector).over(w.rowsBetween(W.unboundedPreceding, 0)), F.max_by(vector, F.struct(*order)).over(whole)
    around = [F.coalesce(F.lag(vector, -d).over(w), first) if d < 0 else F.coalesce(F.lead(vector, d).over(w), last) if d else F.col(vector) for d in range(-left, m - left)]
    rows = df.withColumns({"_pos": F.row_number().over(w) - 1, "stacked": F.flatten(F.array(*around))})
    return rows.where(F.col("_pos") % n == 0).withColumn("out_frame", (F.col("_pos") / n).cast("long")).drop("_pos")


def affine(v: Column, shift: Column, scale: Column) -> Column:
    """(v + shift) * scale, element by element."""
    return F.zip_with(F.zip_with(v, shift, lambda x, s: x + s), scale, lambda x, s: x * s)


def nearest_rank(df: DataFrame, keys: list[str], value: str, tie: str, fraction: float) -> DataFrame:
    """Nearest-rank percentile of the finite values: the row at round((n - 1) * fraction), halves up."""
    w = W.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    at = rows.withColumn("_r", F.row_number().over(w.orderBy(value, tie))).withColumn("_n", F.count(F.lit(1)).over(w))
    return at.where(F.col("_r") == F.round((F.col("_n") - 1) * fraction) + 1).select(*keys, F.col(value).alias("percentile"), F.col("_n").alias("n"))


def materialize(spans: DataFrame, frames: DataFrame, keys: list[str], capacity: int = 148) -> DataFrame:
    """spans(keys, window_id, src_lo, src_hi, dst_lo), frames(keys, frame_id, value) -> window_id, values array of ``capacity``, zero beyond what is packed."""
    at = spans.select(*keys, "window_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("src_hi") - F.col("src_lo") - 1)).alias("_i"), "src_lo", "dst_lo")
    at = at.select(*keys, "window_id", (F.col("src_lo") + F.col("_i")).alias("frame_id"), (F.col("dst_lo") + F.col("_i")).alias("slot"))
    got = at.join(frames, [*keys, "frame_id"]).groupBy(*keys, "window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda s: s["value"].cast("double")).alias("v"))
    return got.select(*keys, "window_id", F.size("v").alias("n"), F.slice(F.concat("v", F.array_repeat(F.lit(0.0), capacity)), 1, capacity).alias("values"))
