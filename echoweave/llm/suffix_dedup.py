"""Repeated-substring dedup on hashed anchors in an external sort.

A byte goes if it lies in a LENGTH-byte string that also starts earlier. This is
not induced sorting: no suffix is ordered by its text and no common prefixes are
carried (the README says why). Every LENGTH-byte window names one anchor inside it - its
smallest hashed GRAM - so equal windows name equal anchors at equal places, and
neighbouring windows share theirs. The run of windows of one anchor, with the
bytes that it spans, is a suffix tuple (gram, span, document, place).

1. In the scan: anchors and tuples; of equal tuples of a piece of text only the
   first goes on, the others are removed runs already.
2. Tuples are sorted by Spark's external, disk-backed sort. Of equal spans all
   but the first are removed runs. A gram with one span needs no more.
3. Grams with several spans (passage ends, common phrases) share a prefix of
   unknown length: their spans are fetched and compared window by window.

Scale: about one tuple of 48 bytes per 38 bytes of text moves, and once the whole
texts of documents with grams of several spans; a hot passage comes to one tuple
a piece of text before the shuffle. Memory is
that of a piece (PIECE bytes), one document's runs, or a gram's spans; grams
with over BIG spans are compared by a distributed aggregate instead.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, doc_columns, tidy_shuffles

LENGTH, GRAM = 100, 24
SPREAD = LENGTH - GRAM + 1
#: Bytes of text whose anchors are found at once.
PIECE = 1 << 21
BIG = 20_000
PLACE_BITS = 24
TUPLE = "g long, r long, key long, place long"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@functools.cache
def tables() -> tuple[np.ndarray, ...]:
    """Two random values for each byte; powers of an odd base and of its inverse modulo 2^64."""
    rng = np.random.default_rng(3)
    one, two = rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    powers = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(PIECE + 2 * LENGTH, b, np.uint64)])) for b in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))]
    return one, two, *powers


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in the texts data[starts:ends]: first window, windows, gram hash, span hash."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    one, two, power, inverse = tables()
    step = np.zeros(n + 1, np.int8)
    whole = ends - starts >= LENGTH
    step[starts[whole]] = 1
    step[ends[whole] - LENGTH + 1] -= 1
    windows = np.flatnonzero(np.cumsum(step[: n - LENGTH + 1], dtype=np.int8))
    h = one[data]
    width, hashes = 1, {1: h}
    while width < 16:
        h = h[:-width] * power[width] + h[width:]
        width *= 2
        hashes[width] = h
    h = hashes[16][: n - GRAM + 1] * power[8] + hashes[8][16:]
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (mix(h) & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= SPREAD:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[SPREAD - size :])
    at = (least[windows] & low).astype(np.int64)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(windows) != 1)]))
    first, count, anchor = windows[new], np.diff(np.append(new, len(at))), at[new]
    total = np.concatenate([[np.uint64(0)], np.cumsum(two[data] * power[:n], dtype=np.uint64)])
    span = (total[first + count + LENGTH - 1] - total[first]) * inverse[first]
    span = mix(span + (anchor - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return first, count, mix(h[anchor] + np.uint64(1)).view(np.int64), span.view(np.int64)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, keys, offsets in their documents) of about PIECE bytes; a long text is cut where windows, not bytes, part."""
    held, keys, offsets, size = [], [], [], 0

    def out():
        lengths = np.array([len(x) for x in held])
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(held), np.uint8), ends - lengths, ends, np.array(keys, np.int64), np.array(offsets, np.int64)

    for b in batches:
        for key, text in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
            data = text.as_buffer() if text.is_valid else b""
            for lo in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
                part = bytes(data[lo : lo + PIECE + LENGTH - 1])
                if size + len(part) > PIECE and held:
                    yield out()
                    held, keys, offsets, size = [], [], [], 0
                held.append(part)
                keys.append(key)
                offsets.append(lo)
                size += len(part)
    if held:
        yield out()


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> tuples (place >= 0: first window << 8 | windows) and removed runs (place < 0: -1 - start, r the bytes)."""
    for data, starts, ends, keys, offsets in pieces(batches):
        first, count, g, r = anchors(data, starts, ends)
        doc = np.searchsorted(starts, first, "right") - 1
        key, place = keys[doc], first - starts[doc] + offsets[doc]
        order = np.lexsort((place, key, r, g))
        g, r, key, place, count = (x[order] for x in (g, r, key, place, count))
        again = np.concatenate([[False], (g[1:] == g[:-1]) & (r[1:] == r[:-1])])[: len(g)]
        yield batch(g[~again], r[~again], key[~again], place[~again] << 8 | count[~again])
        key, start, end = joined(key[again], place[again], place[again] + count[again] + LENGTH - 1)
        yield batch(mix(key.view(np.uint64) + np.uint64(7)).view(np.int64), end - start, key, -1 - start)


def joined(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each key that overlap or touch become one."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    if not len(key):
        return key, start, end
    # ends only grow within a key here: windows of a later run start later and spans differ by less
    reach = end.copy()
    for lo, hi in zip(*edges(key), strict=True):
        np.maximum.accumulate(end[lo:hi], out=reach[lo:hi])
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return key[at], start[at], reach[np.append(at[1:], len(key)) - 1]


def edges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return at, np.append(at[1:], len(key))


def batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["g", "r", "key", "place"])


def compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tuples sorted by gram, span, key and place -> removed runs, and tuples that need their spans.

    Only the last row's gram and span, and the last first-of-its-span tuple, are held between batches.
    """
    last = None  # gram and span of the last tuple
    wait = None  # the last first tuple of a span, and whether its gram had another span before
    for b in batches:
        g, r, key, place = (b.column(c).to_numpy() for c in ("g", "r", "key", "place"))
        run = place < 0
        yield batch(g[run], r[run], key[run], place[run])
        g, r, key, place = g[~run], r[~run], key[~run], place[~run]
        if not len(g):
            continue
        again = np.concatenate([[last == (g[0], r[0])], (g[1:] == g[:-1]) & (r[1:] == r[:-1])])
        last = (g[-1], r[-1])
        start, n = place[again] >> 8, place[again] & 255
        yield batch(g[again], n + LENGTH - 1, key[again], -1 - start)
        rows = np.stack([g[~again], r[~again], key[~again], place[~again]])
        held_before = False
        if wait is not None:
            rows, held_before = np.concatenate([wait[0], rows], 1), wait[1]
        if not rows.shape[1]:
            continue
        like_next = np.append(rows[0, 1:] == rows[0, :-1], False)
        like_last = np.concatenate([[held_before], like_next[:-1]])
        need = (like_next | like_last)[:-1]
        yield batch(*rows[:, :-1][:, need])
        wait = (rows[:, -1:], bool(like_last[-1]))
    if wait is not None and wait[1]:
        yield batch(*wait[0])


def with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the tuples asked for -> gram, key, first window, span."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            g, key, place, span = [], [], [], []
            part = b.slice(lo, 256)
            for k, text, asked in zip(part.column("key").to_pylist(), part.column("text"), part.column("asked").to_pylist(), strict=True):
                data = text.as_buffer()
                for x in asked:
                    p, n = x["place"] >> 8, x["place"] & 255
                    g.append(x["g"])
                    key.append(k)
                    place.append(p)
                    span.append(bytes(data[p : p + n + LENGTH - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(key, pa.int64()), pa.array(place, pa.int64()), pa.array(span, pa.binary())], names=["g", "key", "place", "span"])


def compare_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by gram, key and place -> runs of windows that an earlier span of the gram has too."""
    gram, seen = None, set()
    for b in batches:
        key, place, length = [], [], []
        for g, k, p, span in zip(*(b.column(c).to_pylist() for c in ("g", "key", "place", "span")), strict=True):
            if g != gram:
                gram, seen = g, set()
            run = None
            for i in range(len(span) - LENGTH + 1):
                w = span[i : i + LENGTH]
                if w in seen:
                    run = i if run is None else run
                else:
                    seen.add(w)
                    if run is not None:
                        key.append(k)
                        place.append(-1 - (p + run))
                        length.append(i - run + LENGTH - 1)
                        run = None
            if run is not None:
                key.append(k)
                place.append(-1 - (p + run))
                length.append(len(span) - run)
        yield batch(np.zeros(len(key), np.int64), *(np.array(x, np.int64) for x in (length, key, place)))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key long, unique and in document order. Where ids repeat or are null, key counts the rows sorted by (doc_id, text)."""
    docs = doc_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    twice = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not twice:
        return docs.withColumn("key", F.col("doc_id"))
    return checkpointed(docs.orderBy("doc_id", "text").withColumn("key", F.monotonically_increasing_id()))


def removed_runs(docs: DataFrame, big: int = BIG) -> DataFrame:
    """keyed docs -> key, place (-1 - start), r (bytes): runs to remove; they may overlap."""
    tuples = docs.select("key", "text").mapInArrow(scan, TUPLE)
    ordered = tuples.repartition("g").sortWithinPartitions("g", "r", "key", "place")
    compared = checkpointed(ordered.mapInArrow(compare_sorted, TUPLE))
    asked = compared.where("place >= 0")
    often = checkpointed(asked.groupBy("g").count().where(F.col("count") > big).select("g"))

    def spans(rows: DataFrame) -> DataFrame:
        by_doc = rows.groupBy("key").agg(F.collect_list(F.struct("g", "place")).alias("asked"))
        return docs.select("key", "text").join(by_doc, "key").mapInArrow(with_spans, "g long, key long, place long, span binary")

    some = often.limit(1).count()
    few = spans(asked.join(often, "g", "left_anti") if some else asked)
    runs = few.repartition("g").sortWithinPartitions("g", "key", "place").mapInArrow(compare_spans, TUPLE)
    out = compared.where("place < 0").unionByName(runs)
    if some:  # window by window, over the cluster
        window = spans(asked.join(often, "g", "left_semi")).select("key", "place", "span", F.explode(F.sequence(F.lit(0), F.length("span") - LENGTH)).alias("i"))
        window = window.select(F.struct("key", (F.col("place") + F.col("i")).alias("start")).alias("at"), F.substring("span", F.col("i") + 1, F.lit(LENGTH)).alias("w"))
        first = window.groupBy("w").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = window.join(first, "w").where("at <> first")
        out = out.unionByName(again.select(F.lit(0).cast("long").alias("g"), F.lit(LENGTH).cast("long").alias("r"), F.col("at.key").alias("key"), (-1 - F.col("at.start")).alias("place")))
    return out.select("key", "r", "place")


def remove_repeats(docs: DataFrame, big: int = BIG) -> DataFrame:
    """docs(doc_id, text) -> doc_id, kept binary (the bytes that stay), n_bytes, n_removed, n_spans, kept_sha256.

    Strings are judged on the input's UTF-8 bytes and never cross documents;
    earlier is a smaller doc_id, or an earlier start in the same document. Null
    text counts as empty. Rows that repeat a doc_id are documents of their own
    in the order of their texts; null ids come first. No documents: no rows.
    Other columns are ignored. kept may end inside a UTF-8 character.
    """
    with tidy_shuffles(docs.sparkSession):
        rows = keyed(docs)
        runs = removed_runs(rows, big)
        by_doc = checkpointed(runs.groupBy("key").agg(F.collect_list(F.struct(F.col("place"), F.col("r"))).alias("runs")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                kept, counts = [], []
                for text, runs in zip(part.column("text"), part.column("runs").to_pylist(), strict=True):
                    data = text.as_py()
                    stay, at, removed, n = [], 0, 0, 0
                    for start, end in sorted((-1 - x["place"], x["r"] - 1 - x["place"]) for x in runs or ()):
                        if start > at or not n:
                            stay.append(data[at:start])
                            n += 1
                            at = start
                        if end > at:
                            removed += end - at
                            at = end
                    stay.append(data[at:])
                    kept.append(b"".join(stay))
                    counts.append((len(data), removed, n, hashlib.sha256(kept[-1]).hexdigest()))
                n_bytes, n_removed, n_spans, sha = map(list, zip(*counts, strict=True)) if counts else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(sha, pa.string())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.join(by_doc, "key", "left").select("doc_id", "text", "runs").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
