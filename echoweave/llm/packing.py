"""Packing token sequences, balanced by attention cost.

Every document is tokenised, closed with an end id and cut into pieces of at
most ``CAPACITY`` ids. Full pieces are sequences of their own; the rest is
dealt, longest first, to the sequence of the lowest cost (linear plus quadratic
in each piece's length) that has room for it; it is cut where none has.

Scale: one pass without any shuffle. A task packs its own documents in blocks
of about ``BLOCK_BYTES`` of text, so memory doesn't grow with the partition and
one block pads less than one sequence. Sequence ids are the partition's number
and a counter in it; a retried task makes the same ones.
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns

CAPACITY = 1024
END_ID = 0
#: Cost of a piece of n ids: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Text of the documents that are packed together.
BLOCK_BYTES = 8 << 20
VOCABULARY = "byte_bpe_50k"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def encoder(vocabulary: str = VOCABULARY):
    """text -> ids as the tokenizers library gives them (add_special_tokens=False).

    The rank file holds the same vocabulary and merges and encodes several
    times faster; a text with the special token's own string goes to the
    tokenizers library, which reads it as one id.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    return encode


class Open:
    """Sequences with room, by room: a tree over the rooms finds the cheapest one of at least some room."""

    def __init__(self, n: int, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.best = [(np.inf, -1)] * (2 * self.size)
        self.heaps[capacity] = [(0.0, s) for s in range(n)]
        self.settle(capacity)

    def settle(self, room: int) -> None:
        heap, i = self.heaps[room], room + self.size
        self.best[i] = heap[0] if heap else (np.inf, -1)
        while i > 1:
            i //= 2
            self.best[i] = min(self.best[2 * i], self.best[2 * i + 1])

    def cheapest(self, room: int) -> tuple[float, int]:
        lo, hi, out = room + self.size, 2 * self.size, (np.inf, -1)
        while lo < hi:
            if lo & 1:
                out = min(out, self.best[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                out = min(out, self.best[hi])
            lo, hi = lo // 2, hi // 2
        return out

    def take(self, room: int) -> None:
        heapq.heappop(self.heaps[room])
        self.settle(room)

    def put(self, room: int, cost: float, s: int) -> None:
        heapq.heappush(self.heaps[room], (cost, s))
        self.settle(room)


def deal(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Token counts -> pieces (document, start, length, sequence, offset), sequences from 0 and gapless.

    Documents are taken by descending length of what is left after their full
    pieces, ties in order; a piece goes to the cheapest sequence that has room
    for it, ties to the first; if none has, it is cut to the cheapest one.
    """
    pieces, rests, n_seq = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        pieces += [(d, i * capacity, capacity, n_seq + i, 0) for i in range(full)]
        n_seq += full
        if n % capacity:
            rests.append((d, full * capacity, n % capacity))
    need = -(-sum(r[2] for r in rests) // capacity)
    used, left = [0] * need, Open(need, capacity)
    for d, start, n in sorted(rests, key=lambda r: -r[2]):
        while n:
            cost, s = left.cheapest(n)
            if s < 0:
                cost, s = left.cheapest(1)
            room = capacity - used[s]
            take = min(n, room)
            left.take(room)
            pieces.append((d, start, take, n_seq + s, used[s]))
            used[s] += take
            start, n = start + take, n - take
            if used[s] < capacity:
                left.put(capacity - used[s], cost + LINEAR * take + QUADRATIC * take * take, s)
    return pieces


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of a document, with the end id, lies in exactly one piece. Null text
    counts as empty: the end id alone. Rows that repeat a doc_id are packed each
    for itself. A null doc_id stays null. No documents: no rows. Other columns
    are ignored. crc32 is over the ids as little-endian unsigned 32-bit numbers.
    Ids are those of the tokenizers library's file; encoder() says where another
    library that reads the same vocabulary encodes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        base = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], np.uint32)

        def flush(ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal base
            rows = deal([len(t) for t in tokens], capacity)
            out = [[], [], [], [], [], [], []]
            for d, start, n, seq, offset in rows:
                t = tokens[d]
                for column, value in zip(out, (ids[d], start, n, zlib.crc32(t[start : start + n].astype("<u4", copy=False).tobytes()), len(t), base + seq, offset), strict=True):
                    column.append(value)
            base += max((r[3] for r in rows), default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in SCHEMA.split(", ")])

        ids, tokens, held = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id)
                tokens.append(np.concatenate([encode(text), end]))
                held += len(text)
                if held >= block_bytes:
                    yield flush(ids, tokens)
                    ids, tokens, held = [], [], 0
        if ids:
            yield flush(ids, tokens)

    return doc_columns(docs, "doc_id", "text").select("doc_id", F.col("text")).mapInArrow(run, SCHEMA)
