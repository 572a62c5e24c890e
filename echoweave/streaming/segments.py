"""Endpoint segmentation of live frames.

The state of a recording is a few dozen votes and counters, kept by Spark per
key; closed segments are emitted as they close, and an explicit end marker
(is_speech null) flushes an open one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from echoweave.operators.folds import Endpoints

OUTPUT = "job_id string, segment_id long, start_ms long, end_ms long"


def live_segments(frames: DataFrame, **sizes: int) -> DataFrame:
    """Stream of (job_id, frame_id, is_speech) -> segments. Frames of a recording come in order of frame_id across batches; inside a batch they are sorted."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Endpoints(**sizes)
        if state.exists:
            fold.restore(tuple(json.loads(state.get[0])))
        rows = pd.concat(list(batches)).sort_values("frame_id")
        out, ended = [], False
        for speech in rows["is_speech"]:
            if pd.isna(speech):
                out += fold.end()
                ended = True
            else:
                out += fold.push(bool(speech))
        if ended:
            state.remove()
        else:
            state.update((json.dumps(fold.state()),))
        if out:
            yield pd.DataFrame(out).assign(job_id=key[0])[["job_id", "segment_id", "start_ms", "end_ms"]]

    return frames.groupBy("job_id").applyInPandasWithState(step, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def progress(batches: DataFrame) -> DataFrame:
    """Stream of finished batches (job_id, ordinal, end_ms) -> job_id, done_through, completed_ms: progress over the gap-free prefix only.

    The state is the first ordinal that is missing and what has finished beyond it.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, reached, ahead = json.loads(state.get[0]) if state.exists else (0, 0, {})
        for r in pd.concat(list(rows)).itertuples():
            if r.ordinal >= done:
                ahead[str(r.ordinal)] = int(r.end_ms)
        while str(done) in ahead:
            reached = max(reached, ahead.pop(str(done)))
            done += 1
        state.update((json.dumps((done, reached, ahead)),))
        yield pd.DataFrame({"job_id": [key[0]], "done_through": [done], "completed_ms": [reached]})

    return batches.groupBy("job_id").applyInPandasWithState(step, "job_id string, done_through long, completed_ms long", "state string", "update", GroupStateTimeout.NoTimeout)
