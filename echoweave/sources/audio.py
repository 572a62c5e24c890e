"""WAV recordings to chunk rows; durations from headers."""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16_000
FRAME, SHIFT = 400, 160
#: Frames of a chunk; chunks overlap by FRAME - SHIFT samples so that frames can be taken from each by itself.
CHUNK_FRAMES = 6_000
#: Low-pass: zero crossings of the sinc on either side, its edge as a part of the lower half rate, and the Kaiser window's shape.
CROSSINGS, EDGE, KAISER = 32, 0.94, 9.0
#: Output samples that are filtered at once.
BLOCK = 1 << 15
#: Bytes of a file that hold its header.
HEADER = 1 << 16


class Wave(NamedTuple):
    """What a WAV header says: where the data begins, frames, rate, channels, bytes of a sample, and whether samples are floats."""

    start: int
    frames: int
    rate: int
    channels: int
    width: int
    floating: bool

    @property
    def seconds(self) -> float:
        return self.frames / self.rate


def header(data: bytes, length: int | None = None) -> Wave:
    """Read a RIFF header: PCM of 8, 16, 24 and 32 bits, floats of 32 and 64, plain or extensible. length: of the file, if data is only its start."""
    length = len(data) if length is None else length
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        at += 8
        if name == b"fmt ":
            if at + max(size, 16) > len(data):
                raise ValueError("the WAV header is cut off")
            kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", data, at)
            if kind == 0xFFFE:  # extensible: the kind is the start of the sub-format
                kind = struct.unpack_from("<H", data, at + 24)[0]
            form = kind, channels, rate, align, bits
        elif name == b"data":
            if form is None:
                raise ValueError("data before its format")
            kind, channels, rate, align, bits = form
            width = align // channels
            if (kind, width) not in {(1, 1), (1, 2), (1, 3), (1, 4), (3, 4), (3, 8)}:
                raise ValueError(f"WAV kind {kind} with {bits} bits")
            return Wave(at, min(size, length - at) // align, rate, channels, width, kind == 3)  # a size that was never filled in is cut to the file
        at += size + size % 2
    raise ValueError("no data in the WAV header")


def samples(raw: bytes, wave: Wave) -> np.ndarray:
    """Mono samples in -1..1 of whole frames."""
    if wave.floating:
        x = np.frombuffer(raw, f"<f{wave.width}").astype(np.float64)
    elif wave.width == 1:  # unsigned
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif wave.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{wave.width}") / float(1 << (8 * wave.width - 1))
    return x.reshape(-1, wave.channels).mean(1)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate of WAV bytes."""
    wave = header(data)
    size = wave.channels * wave.width
    return samples(data[wave.start : wave.start + wave.frames * size], wave), wave.rate


def ratio(rate: int, to: int) -> tuple[int, int]:
    """(up, down) in lowest terms."""
    g = math.gcd(rate, to)
    return to // g, rate // g


def reach(rate: int, to: int = RATE) -> int:
    """Input samples on either side that an output sample depends on."""
    return 0 if rate == to else math.ceil(CROSSINGS * max(1.0, rate / to) / EDGE) + 1


@functools.cache
def phases(rate: int, to: int) -> np.ndarray:
    """(up, 2 * reach + 1) taps: a windowed sinc for each place between two input samples that an output can have, each of sum 1."""
    up, _ = ratio(rate, to)
    width = reach(rate, to)
    cut = EDGE * min(1.0, to / rate)
    t = np.arange(-width, width + 1)[None] - np.arange(up)[:, None] / up
    inside = np.clip(1 - (t * cut / CROSSINGS) ** 2, 0, None)
    taps = np.sinc(t * cut) * np.i0(KAISER * np.sqrt(inside)) * (inside > 0)
    return taps / taps.sum(1, keepdims=True)


def out_length(n: int, rate: int, to: int = RATE) -> int:
    """Output samples of n input ones."""
    up, down = ratio(rate, to)
    return n * up // down


def needed(lo: int, hi: int, n: int, rate: int, to: int = RATE) -> tuple[int, int]:
    """Input samples [first, last) of n that the output samples [lo, hi) are made of."""
    up, down = ratio(rate, to)
    return max(0, lo * down // up - reach(rate, to)), min(n, (hi - 1) * down // up + reach(rate, to) + 1)


def resample(x: np.ndarray, rate: int, to: int = RATE, lo: int = 0, hi: int | None = None, first: int = 0, n: int | None = None) -> np.ndarray:
    """Output samples [lo, hi) of a signal of n samples at ``rate``, of which x are those from ``first`` on.

    A polyphase low-pass below half of the lower rate, so that nothing folds
    back. Beyond its ends the signal is zero. A piece with its needed() input
    gives the same samples as the whole.
    """
    n = len(x) if n is None else n
    hi = out_length(n, rate, to) if hi is None else hi
    if rate == to:
        return x[lo - first : hi - first]
    (up, down), width, taps, out = ratio(rate, to), reach(rate, to), phases(rate, to), []
    padded = np.concatenate([np.zeros(width), x, np.zeros(width + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * width + 1)
    for at in range(lo, hi, BLOCK):
        k = np.arange(at, min(at + BLOCK, hi), dtype=np.int64) * down
        out.append((windows[k // up - first] * taps[k % up]).sum(1))
    return np.concatenate(out) if out else np.zeros(0)


def read_recordings(spark: SparkSession, path: str, chunk_frames: int = CHUNK_FRAMES, partitions: int | None = None) -> DataFrame:
    """Files -> job_id (path), chunk_no, first_frame, samples: a row for each chunk of each file.

    A file's bytes are cut in the task that reads them, each chunk with the
    samples around it that its filter needs; chunks are then dealt over all
    tasks, decoded and resampled there, so that one long file is many tasks' work.
    Spark reads files of up to 2 GB.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for job, data in zip(b["path"], b["content"], strict=True):
                wave = header(data)
                total = out_length(wave.frames, wave.rate)
                frames, size = (total - FRAME) // SHIFT + 1 if total >= FRAME else 0, wave.channels * wave.width
                for no, first in enumerate(range(0, frames, chunk_frames)):
                    lo, hi = first * SHIFT, (min(first + chunk_frames, frames) - 1) * SHIFT + FRAME
                    a, z = needed(lo, hi, wave.frames, wave.rate)
                    yield pd.DataFrame({"job_id": [job], "chunk_no": [no], "first_frame": [first], "lo": [lo], "hi": [hi], "at": [a], "wave": [list(map(int, wave))], "raw": [data[wave.start + a * size : wave.start + z * size]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                wave = Wave(*r.wave[:5], bool(r.wave[5]))
                x = resample(samples(r.raw, wave), wave.rate, lo=r.lo, hi=r.hi, first=r.at, n=wave.frames)
                yield pd.DataFrame({"job_id": [r.job_id], "chunk_no": [r.chunk_no], "first_frame": [r.first_frame], "samples": [x.astype(np.float32)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    pieces = files.select("path", "content").mapInPandas(cut, "job_id string, chunk_no long, first_frame long, lo long, hi long, at long, wave array<long>, raw binary")
    dealt = pieces.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "job_id", "chunk_no")
    return dealt.mapInPandas(run, "job_id string, chunk_no long, first_frame long, samples array<float>")


def probe_durations(spark: SparkSession, path: str) -> DataFrame:
    """Files -> job_id, bytes, seconds, from the header alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [header(data, length).seconds for data, length in zip(b["content"], b["length"], strict=True)]
            yield pd.DataFrame({"job_id": b["path"], "bytes": b["length"], "seconds": out})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    start = F.substring("content", 1, HEADER)  # only this goes to Python
    return files.select("path", "length", start.alias("content")).mapInPandas(run, "job_id string, bytes long, seconds double")


def total_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of all files below a folder, from the listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
