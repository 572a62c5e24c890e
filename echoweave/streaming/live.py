"""The live chain: chunks of frames to marked tokens, in a stream or over a table.

A recording's chunks go through a recurrent speech model whose cache is carried
from chunk to chunk, the endpoint fold, decode batches, a recogniser, and the
punctuation context. One object holds all of it for one recording; a table folds
over it, a stream keeps it in Spark's state: the cache as it is, in binary, the
rest as text. Frames are kept back only as far as an open batch or segment needs
them, so the state is bounded by the longest batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from echoweave.operators.folds import Endpoints, IntervalBatches, ordered_fold
from echoweave.operators.punctuation import Restorer

FIELDS = "pos long, token string, start_ms long, end_ms long, mark int"
OUTPUT = f"job_id string, {FIELDS}"
STATE = "cache binary, rest string"
#: A length that no recording has: decode batches are only cut to the real one at the end.
ENDLESS = 1 << 52


class Models(NamedTuple):
    """The chain's models as functions.

    hear: a chunk's frames and the cache (None at first) -> speech or not for each frame, and the new cache.
    recognise: a batch's frames -> (token, start_ms, end_ms) from the batch's start.
    mark: the open tokens -> a punctuation id for each.
    """

    hear: Callable[[list[float], bytes | None], tuple[list[bool], bytes]]
    recognise: Callable[[list[float]], list[tuple[str, int, int]]]
    mark: Callable[[list[str]], list[int]]


class Chain:
    """One recording. add(row with frames and last) gives the tokens that are final; end() what is left."""

    SCHEMA = FIELDS

    def __init__(self, models: Models, frame_ms: int = 10, endpoints: dict | None = None, batches: dict | None = None):
        self.models, self.frame_ms = models, frame_ms
        self.cache: bytes | None = None
        self.frames, self.first, self.total, self.count, self.over = [], 0, 0, 0, False
        self.ends = Endpoints(frame_ms=frame_ms, **(endpoints or {}))
        self.batches = IntervalBatches(ENDLESS, **(batches or {}))
        self.marks = Restorer(models.mark)

    def state(self) -> tuple[bytes | None, str]:
        b, m = self.batches, self.marks
        return self.cache, json.dumps([self.frames, self.first, self.total, self.count, self.over, self.ends.state(), [b.owned, b.open, b.count], [m.open, m.chunk]])

    def restore(self, cache: bytes | None, rest: str) -> Chain:
        self.cache = cache
        self.frames, self.first, self.total, self.count, self.over, ends, (self.batches.owned, held, self.batches.count), (self.marks.open, self.marks.chunk) = json.loads(rest)
        self.ends.restore(tuple(ends))
        self.batches.open = None if held is None else tuple(held)
        return self

    def decoded(self, batches: list[dict]) -> list[dict]:
        """Tokens of decode batches, those whose middle the batch owns, through the marks."""
        out = []
        for b in batches:
            start, stop = (min(t, self.total * self.frame_ms) // self.frame_ms for t in (b["decode_start"], b["decode_end"]))
            for token, lo, hi in self.models.recognise(self.frames[start - self.first : stop - self.first]):
                lo, hi = start * self.frame_ms + lo, start * self.frame_ms + hi
                if b["own_start"] <= (lo + hi) // 2 < b["own_end"]:
                    out += self.marks.add({"pos": self.count, "token": token, "start_ms": max(lo, b["own_start"]), "end_ms": min(hi, b["own_end"])})
                    self.count += 1
        return out

    def forget(self) -> None:
        """Drop frames that no open batch or segment can need: what is behind the look-back of the endpoints, and of a padded batch."""
        b = self.batches
        need = self.total - self.ends.start_back - self.ends.window - b.least // self.frame_ms - 1
        if self.ends.since is not None:
            need = min(need, self.ends.since - b.least // self.frame_ms - 1)
        if b.open is not None:
            need = min(need, b.open[0] // self.frame_ms)
        if need > self.first:
            del self.frames[: need - self.first]
            self.first = need

    def add(self, row: dict) -> list[dict]:
        if self.over:  # what follows the last chunk isn't of the recording
            return []
        frames, out = [] if row["frames"] is None else [float(f) for f in row["frames"]], []
        speech, self.cache = self.models.hear(frames, self.cache)
        if len(speech) != len(frames):
            raise ValueError(f"{len(frames)} frames, {len(speech)} flags")
        self.frames += frames
        self.total += len(frames)
        for flag in speech:
            for segment in self.ends.push(flag):
                out += self.decoded(self.batches.add(segment))
        if row["last"]:
            return out + self.end()
        self.forget()
        return out

    def end(self) -> list[dict]:
        if self.over:
            return []
        self.over, self.batches.total, out = True, self.total * self.frame_ms, []
        for segment in self.ends.end():
            out += self.decoded(self.batches.add(segment))
        return out + self.decoded(self.batches.end()) + self.marks.end()


def transcripts(chunks: DataFrame, models: Models, keys: Sequence[str] = ("job_id",), **sizes) -> DataFrame:
    """chunks(keys, chunk_id, frames array<double>, last) -> keys, pos, token, start_ms, end_ms, mark: the chain over a table.

    A recording without a last chunk ends where its chunks end; chunks after the
    last one are ignored. Chunks are taken in order of chunk_id.
    """
    return ordered_fold(chunks.select(*keys, "chunk_id", "frames", "last"), keys, ["chunk_id"], lambda row: Chain(models, **sizes), FIELDS)


class Live(StatefulProcessor):
    """The chain as Spark's stateful processor of one key."""

    def __init__(self, models: Models, sizes: dict):
        self.models, self.sizes = models, sizes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("chain", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        chain = Chain(self.models, **self.sizes)
        if self.held.exists():
            cache, rest = self.held.get()
            chain.restore(None if cache is None else bytes(cache), rest)
        out = []
        for row in pd.concat(list(rows)).sort_values("chunk_id").to_dict("records"):
            out += chain.add(row)
        self.held.update(chain.state())
        if out:
            yield pd.DataFrame(out).assign(job_id=key[0])[["job_id", "pos", "token", "start_ms", "end_ms", "mark"]]

    def close(self) -> None:
        pass


def live_transcripts(chunks: DataFrame, models: Models, **sizes) -> DataFrame:
    """transcripts() of a stream of chunks(job_id, chunk_id, frames, last).

    A recording's chunks come in order of chunk_id across micro-batches; inside
    one they are sorted. Tokens are emitted as they become final. The session's
    state store has to be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    return chunks.groupBy("job_id").transformWithStateInPandas(Live(models, sizes), OUTPUT, "Append", "None")
