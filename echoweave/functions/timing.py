"""Integer milliseconds, samples and frames; clock text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model: 16 kHz mono, 25 ms frames every 10 ms.
SAMPLE_RATE, FRAME_SAMPLES, FRAME_SHIFT = 16_000, 400, 160
FRAME_MS = 10


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, floored, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def samples_to_ms(samples: Column) -> Column:
    return F.floor(samples * 1000 / SAMPLE_RATE)


def sample_range(start_ms: Column, end_ms: Column, total: Column) -> tuple[Column, Column]:
    """First sample (floor) and end sample (ceil), inside 0..total."""
    lo = F.least(F.greatest(F.floor(start_ms * SAMPLE_RATE / 1000), F.lit(0)), total)
    hi = F.least(F.greatest(F.ceil(end_ms * SAMPLE_RATE / 1000), lo), total)
    return lo, hi


def frame_count(samples: Column) -> Column:
    return F.when(samples < FRAME_SAMPLES, F.lit(0)).otherwise(F.floor((samples - FRAME_SAMPLES) / FRAME_SHIFT) + 1)


def frame_range(start_ms: Column, end_ms: Column, frames: Column) -> tuple[Column, Column]:
    """Frames that a range of milliseconds touches, inside 0..frames."""
    lo = F.least(F.greatest(F.floor(start_ms / FRAME_MS), F.lit(0)), frames)
    hi = F.least(F.greatest(F.ceil(end_ms / FRAME_MS), lo), frames)
    return lo, hi


def clock(ms: Column) -> Column:
    """mm:ss; minutes run on beyond the hour."""
    s = F.floor(ms / 1000)
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.floor(F.greatest(seconds, F.lit(0)))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def memory_mb(hours: Column, keep_samples: Column) -> Column:
    """Estimated peak: the models, the frames and, if kept, the samples."""
    return F.lit(1500) + 305 * hours + F.when(keep_samples, 587 * hours).otherwise(0)


def combined_progress(heard: Column, frames: Column, recognised: Column) -> Column:
    """Progress of a recording: 0.3 of the frames heard and 0.7 of the fraction recognised."""
    return 0.3 * heard / F.greatest(frames, F.lit(1)) + 0.7 * recognised
