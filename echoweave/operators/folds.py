"""Order-dependent folds that windows can't express.

Rows are partitioned by recording and sorted; a task streams over its sorted
rows and holds one fold's state, never a recording, so recordings of any length
pass. Each fold is a small class: add(row) and end() yield output rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from echoweave.functions.text import CLAUSE, TERMINAL


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[dict], object], schema: str) -> DataFrame:
    """Fold each key's rows in order. make(first row) gives an object with add(row) and end(); its rows get the keys' columns."""
    out = StructType([*(df.schema[k] for k in keys), *_parse_datatype_string(schema)])
    names = list(df.columns)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, None

        def keyed(rows: Iterable[dict]) -> list[dict]:
            return [dict(zip(keys, key, strict=True)) | r for r in rows]

        for b in batches:
            done: list[dict] = []
            for row in b.to_pylist():
                now = tuple(row[k] for k in keys)
                if fold is None or now != key:
                    if fold is not None:
                        done += keyed(fold.end())
                    key, fold = now, make(row)
                done += keyed(fold.add(row))
            yield pa.RecordBatch.from_pylist(done, arrow)
        if fold is not None:
            yield pa.RecordBatch.from_pylist(keyed(fold.end()), arrow)

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


class Endpoints:
    """Speech segments from speech/silence frames: a sliding window of votes decides, with look-back at either end."""

    SCHEMA = "segment_id long, start_ms long, end_ms long"

    def __init__(self, frame_ms: int = 10, window: int = 20, enter: int = 15, leave: int = 15, start_back: int = 40, quiet: int = 65, end_back: int = 54, longest: int = 3000):
        self.frame_ms, self.window, self.enter, self.leave = frame_ms, window, enter, leave
        self.start_back, self.quiet, self.end_back, self.longest = start_back, quiet, end_back, longest
        self.frame, self.count, self.since = -1, 0, None
        self.forget()

    def forget(self) -> None:
        self.votes, self.speech, self.silent = [], False, 0

    def state(self) -> tuple:
        return self.frame, self.count, self.since, list(self.votes), self.speech, self.silent

    def restore(self, state: tuple) -> Endpoints:
        self.frame, self.count, self.since, self.votes, self.speech, self.silent = state
        return self

    def close(self, last: int) -> list[dict]:
        start = self.since * self.frame_ms
        self.count += 1
        self.since = None
        self.forget()
        return [{"segment_id": self.count, "start_ms": start, "end_ms": max(start, last * self.frame_ms) + self.frame_ms}]

    def push(self, is_speech: bool) -> list[dict]:
        self.frame += 1
        self.votes = [*self.votes[-(self.window - 1) :], bool(is_speech)]
        voted, was = sum(self.votes), self.speech
        self.speech = voted > self.leave if was else voted >= self.enter
        if self.speech and not was:
            self.silent = 0
            if self.since is None:
                self.since = max(0, self.frame - self.start_back)
            return []
        if self.since is None:
            return []
        self.silent = self.silent + 1 if not self.speech and not was else 0
        if self.silent >= self.quiet:
            return self.close(max(self.since, self.frame - self.end_back))
        return self.close(self.frame) if self.frame - self.since >= self.longest else []

    def add(self, row: dict) -> list[dict]:
        return self.push(row["is_speech"])

    def end(self) -> list[dict]:
        return self.close(self.frame) if self.since is not None else []


def endpoint_segments(frames: DataFrame, keys: Sequence[str] = ("job_id",), **sizes: int) -> DataFrame:
    """frames(keys, frame_id, is_speech) -> keys, segment_id, start_ms, end_ms."""
    return ordered_fold(frames.select(*keys, "frame_id", "is_speech"), keys, ["frame_id"], lambda row: Endpoints(**sizes), Endpoints.SCHEMA)


class IntervalBatches:
    """Decode batches from speech segments: trim to what is owned, split long ones, pad short ones, merge near ones."""

    SCHEMA = "batch_id long, decode_start long, decode_end long, own_start long, own_end long"

    def __init__(self, total: int, longest: int = 60_000, least: int = 500, gap: int = 1_200, span: int = 15_000):
        self.total, self.longest, self.least, self.gap, self.span = total, longest, least, gap, span
        self.owned, self.open, self.count = 0, None, 0

    def emit(self) -> list[dict]:
        if self.open is None:
            return []
        self.count += 1
        done, self.open = self.open, None
        return [dict(zip(("decode_start", "decode_end", "own_start", "own_end"), done, strict=True)) | {"batch_id": self.count}]

    def plan(self, decode: tuple[int, int], own: tuple[int, int]) -> list[dict]:
        if self.open is not None:
            a, b, first, _ = self.open
            if decode[0] - b <= self.gap and decode[1] - a <= self.span:
                self.open = (a, max(b, decode[1]), first, own[1])
                return []
        done = self.emit()
        self.open = (*decode, *own)
        return done

    def add(self, row: dict) -> list[dict]:
        start = max(self.owned, row["start_ms"], 0)
        end = min(self.total, max(start, row["end_ms"]))
        self.owned, done = max(self.owned, end), []
        while end - start > self.longest:
            done += self.plan((start, start + self.longest), (start, start + self.longest))
            start += self.longest
        if end > start:
            stop = min(self.total, max(end, start + self.least))
            done += self.plan((max(0, min(start, stop - self.least)), stop), (start, end))
        return done

    def end(self) -> list[dict]:
        if self.count == 0 and self.open is None and self.total > 0:
            self.open = (0, self.total, 0, self.total)
        return self.emit()


def interval_batches(segments: DataFrame, keys: Sequence[str] = ("job_id",), **limits: int) -> DataFrame:
    """segments(keys, start_ms, end_ms, total_ms) -> decode batches with the range that each owns."""
    return ordered_fold(segments.select(*keys, "start_ms", "end_ms", "total_ms"), keys, ["start_ms", "end_ms"], lambda row: IntervalBatches(row["total_ms"], **limits), IntervalBatches.SCHEMA)


class PackedWindows:
    """Windows of at most ``capacity`` frames over neighbouring tokens of a sentence; the next starts near ``stride`` on."""

    SCHEMA = "window_id long, first_pos long, last_pos long, frames long, overlong boolean"

    def __init__(self, capacity: int = 148, stride: int = 75):
        self.capacity, self.stride, self.count, self.held = capacity, stride, 0, []

    def window(self, first: int, last: int, frames: int, overlong: bool) -> dict:
        self.count += 1
        return {"window_id": self.count, "first_pos": first, "last_pos": last, "frames": frames, "overlong": overlong}

    def drain(self, whole: bool) -> list[dict]:
        """Windows that can't change any more: all if whole, else those that a held token ends."""
        out = []
        while self.held:
            used, n = 0, 0
            while n < len(self.held) and self.held[n][2] == self.held[0][2] and used + self.held[n][1] <= self.capacity:
                used += self.held[n][1]
                n += 1
            if n == len(self.held) and not whole:
                break
            out.append(self.window(self.held[0][0], self.held[n - 1][0], used, False))
            if n == len(self.held):
                self.held = []
                break
            ahead = [sum(t[1] for t in self.held[:i]) for i in range(n + 1)]
            self.held = self.held[min(range(1, n + 1), key=lambda i: (abs(ahead[i] - self.stride), i)) :]
        return out

    def add(self, row: dict) -> list[dict]:
        pos, frames = row["pos"], row["frames"]
        if frames <= 0:
            return []
        if frames <= self.capacity:
            self.held.append((pos, frames, row["sentence_id"]))
            return self.drain(False)
        out, at = self.drain(True), 0
        while True:
            size = min(frames - at, self.capacity)
            out.append(self.window(pos, pos, size, True))
            if at + size >= frames:
                return out
            at += self.stride

    def end(self) -> list[dict]:
        return self.drain(True)


def pack_windows(tokens: DataFrame, keys: Sequence[str] = ("job_id", "island_id")) -> DataFrame:
    """tokens(keys, pos, sentence_id, frames) -> windows of token ranges."""
    return ordered_fold(tokens.select(*keys, "pos", "sentence_id", "frames"), keys, ["pos"], lambda row: PackedWindows(), PackedWindows.SCHEMA)


class Sentences:
    """Sentences from tokens: a terminal mark, a clause mark or double length beyond the limit, or a pause ends one."""

    SCHEMA = "sentence_id long, start_ms long, end_ms long, n long, text string"

    def __init__(self, chars: int = 30, gap: int = 300):
        self.limit, self.gap, self.count = chars, gap, 0
        self.clear()

    def clear(self) -> None:
        self.held, self.size, self.start_ms, self.end_ms = [], 0, 0, 0

    def flush(self) -> list[tuple]:
        text = "".join(self.held).strip()
        if not text:
            return []
        self.count += 1
        out = (self.count, self.start_ms, self.end_ms, len(self.held), text)
        self.clear()
        return [out]

    def push(self, token: str, start_ms: int, end_ms: int) -> list[tuple]:
        # a pause is seen when the next token comes; a token without text ends nothing
        out = self.flush() if self.held and self.held[-1] and start_ms - self.end_ms >= self.gap else []
        if not self.held:
            self.start_ms = start_ms
        self.held.append(token)
        self.end_ms = end_ms
        self.size += len(token)
        mark = token[-1:]
        if mark and (mark in TERMINAL or self.size >= 2 * self.limit or self.size >= self.limit and mark in CLAUSE):
            out += self.flush()
        return out

    def document(self, tokens: list[str], starts: list[int], ends: list[int]) -> list[tuple]:
        """push() of all tokens of a document and flush(), in one loop."""
        out, held, size, first, last, limit, gap = [], [], 0, 0, 0, self.limit, self.gap
        for token, start, end in zip(tokens, starts, ends, strict=True):
            if held and start - last >= gap and held[-1] and (text := "".join(held).strip()):
                out.append((len(out) + 1, first, last, len(held), text))
                held, size = [], 0
            if not held:
                first = start
            held.append(token)
            last = end
            size += len(token)
            if token and (token[-1] in TERMINAL or size >= limit and (size >= 2 * limit or token[-1] in CLAUSE)) and (text := "".join(held).strip()):
                out.append((len(out) + 1, first, last, len(held), text))
                held, size = [], 0
        if text := "".join(held).strip():
            out.append((len(out) + 1, first, last, len(held), text))
        return out

    def rows(self, out: list[tuple]) -> list[dict]:
        return [dict(zip(("sentence_id", "start_ms", "end_ms", "n", "text"), r, strict=True)) for r in out]

    def add(self, row: dict) -> list[dict]:
        return self.rows(self.push(row["token"], row["start_ms"], row["end_ms"]))

    def end(self) -> list[dict]:
        return self.rows(self.flush())


def sentences(tokens: DataFrame, keys: Sequence[str] = ("job_id",), order: Sequence[str] = ("pos",)) -> DataFrame:
    """tokens(keys, order, token, start_ms, end_ms) -> sentences."""
    return ordered_fold(tokens.select(*keys, *order, "token", "start_ms", "end_ms"), keys, order, lambda row: Sentences(), Sentences.SCHEMA)


#: Documents of an Arrow batch that are taken apart at a time.
DOCUMENTS = 64


def lists(column: pa.ListArray) -> Iterator[list]:
    """Each row's elements, none for a null."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield flat[at : at + n]
        at += n


def document_sentences(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """docs(keys, tokens array<string>, starts array<long>, ends array<long>) -> sentences() of documents that have all their tokens in one row: nothing is shuffled or sorted."""
    out = StructType([*(docs.schema[k] for k in keys), *_parse_datatype_string(Sentences.SCHEMA)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, DOCUMENTS):
                part = b.slice(lo, DOCUMENTS)
                at, done = [], []
                for i, (tokens, starts, ends) in enumerate(zip(*(lists(part.column(c)) for c in ("tokens", "starts", "ends")), strict=True)):
                    found = Sentences().document(tokens, starts, ends)
                    done += found
                    at += [i] * len(found)
                if done:
                    columns = [part.column(k).take(pa.array(at)) for k in keys] + [pa.array(c) for c in zip(*done, strict=True)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(*keys, "tokens", "starts", "ends").mapInArrow(run, out)


class RepeatFilter:
    """Drop a single CJK character that is the last kept token or the one before it."""

    SCHEMA = "pos long, token string"

    def __init__(self):
        self.last, self.before = None, None

    def keeps(self, t: str) -> bool:
        if (t == self.last or t == self.before) and len(t) == 1 and ("一" <= t <= "鿿" or "㐀" <= t <= "䶿"):
            return False
        self.last, self.before = t, self.last
        return True

    def add(self, row: dict) -> list[dict]:
        return [{"pos": row["pos"], "token": row["token"]}] if self.keeps(row["token"]) else []

    def end(self) -> list[dict]:
        return []


def repeat_filter(tokens: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    return ordered_fold(tokens.select(*keys, "pos", "token"), keys, ["pos"], lambda row: RepeatFilter(), RepeatFilter.SCHEMA)


def document_repeat_filter(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """docs(keys, tokens array<string>) -> keys, tokens: what repeat_filter() keeps of documents that have all their tokens in one row; nothing is shuffled or sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, DOCUMENTS):
                part = b.slice(lo, DOCUMENTS)
                tokens = part.column("tokens")
                flat, sizes = tokens.flatten(), tokens.value_lengths().fill_null(0).to_numpy()
                single = pc.and_(pc.equal(pc.utf8_length(flat), 1), pc.greater_equal(flat, "㐀")).to_numpy(zero_copy_only=False)
                if single.any():  # else nothing can go
                    kept, hi = np.ones(len(flat), bool), np.cumsum(sizes)
                    for i in np.unique(np.searchsorted(hi, np.flatnonzero(single), "right")).tolist():
                        keeps, lo = RepeatFilter().keeps, hi[i] - sizes[i]
                        kept[lo : hi[i]] = [keeps(t) for t in flat[lo : hi[i]].to_numpy(zero_copy_only=False).tolist()]
                    flat, sizes = flat.filter(pa.array(kept)), np.diff(np.append(0, np.append(0, np.cumsum(kept))[hi]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), lists], names=[*keys, "tokens"])

    types = dict(docs.dtypes)
    return docs.select(*keys, "tokens").mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "tokens array<string>"]))


class GreedyChunks:
    """Rows in chunks of at most a budget; one that is over it by itself is alone."""

    SCHEMA = "pos long, chunk_id long"

    def __init__(self, budget: int):
        self.budget, self.used, self.chunk = budget, 0, 0

    def add(self, row: dict) -> list[dict]:
        if self.used and self.used + row["size"] > self.budget:
            self.chunk, self.used = self.chunk + 1, 0
        self.used += row["size"]
        return [{"pos": row["pos"], "chunk_id": self.chunk}]

    def end(self) -> list[dict]:
        return []


def greedy_chunks(rows: DataFrame, keys: Sequence[str], budget: int = 6000) -> DataFrame:
    """rows(keys, pos, size) -> chunk_id from 0 of each row."""
    return ordered_fold(rows.select(*keys, "pos", "size"), keys, ["pos"], lambda row: GreedyChunks(budget), GreedyChunks.SCHEMA)


class Throttle:
    """Progress rows worth showing: the ends, a new stage, or a step since the last one shown."""

    SCHEMA = "pos long, stage string, fraction double"

    def __init__(self, step: float = 0.05):
        self.step, self.last = step, None

    def add(self, row: dict) -> list[dict]:
        at = row["fraction"]
        if 0 < at < 1 and self.last and self.last[0] == row["stage"] and abs(self.last[1] - at) < self.step:
            return []
        self.last = (row["stage"], at)
        return [{"pos": row["pos"], "stage": row["stage"], "fraction": at}]

    def end(self) -> list[dict]:
        return []


def progress_throttle(rows: DataFrame, keys: Sequence[str] = ("job_id",), step: float = 0.05) -> DataFrame:
    return ordered_fold(rows.select(*keys, "pos", "stage", "fraction"), keys, ["pos"], lambda row: Throttle(step), Throttle.SCHEMA)
