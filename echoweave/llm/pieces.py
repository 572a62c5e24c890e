"""SentencePiece encoding and decoding of merge-type models, exactly.

The model merges adjacent symbols, best score first and leftmost among equals,
until no two make a piece. The same tokens are found without merging: from each
place the longest piece is taken that fits the piece before it; where none does,
the place is marked in a bitfield and the piece before it is shortened. Two
pieces fit if merging their text anew gives the two again. The longest pieces
from every place are found by one Aho-Corasick pass.

Pieces have the space mark at their start only (checked when the model is read),
so no merge crosses from another character to a space mark: a text is encoded in
units of space marks and what follows them. Units repeat, and a task keeps those
it has met, UNITS at most.

Scale: one scan without a shuffle. A task holds an automaton of the vocabulary,
its bounded tables and one text. The work is linear in the text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a space.
MARK = "▁"
#: Units and pairs that a task keeps, and the longest unit that it keeps.
UNITS, PAIRS, LONGEST = 1 << 19, 1 << 19, 64
NO_PIECE = 0
#: A unit: space marks and the characters up to the next one.
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """Encoder and decoder of one model file; scores and kinds of pieces are read from the sentencepiece library."""

    def __init__(self, model: str) -> None:
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=public_tokenizers.path(model))
        every = range(sp.vocab_size())
        names = [sp.id_to_piece(i) for i in every]
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(names[i][3:5], 16): i for i in every if sp.is_byte(i)}
        # "a b" as "[mark]a[mark]b": spaces become marks and one stands before the text
        checks = [len(self.bytes) == 256, not any(MARK in p.lstrip(MARK) for p in self.ids), sp.unk_id() == NO_PIECE, sp.normalize(" a  Ⅸ") == f"{MARK}{MARK}a{MARK}{MARK}Ⅸ", {c for p in self.ids for c in p} <= self.ids.keys()]
        if not all(checks):
            raise ValueError(f"{model} is not a merge-type model with byte pieces, space marks at the start, unknown as id 0 and no normaliser")
        automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            automaton.add_word(p, i)
        automaton.make_automaton()
        self.matches = automaton.iter
        # by id, with NO_PIECE (unknown, which texts don't have) standing for a character that is no piece
        self.names = [p if self.ids.get(p) == i else "" for i, p in enumerate(names)]
        self.sizes = [len(p) or 1 for p in self.names]
        self.shorter = [next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), NO_PIECE) for p in self.names]
        self.packed = [i.to_bytes(4, "little") for i in every]
        # what an id is when decoded: text bytes; None for control ids
        self.surface: list[bytes | None] = [None] * len(names)
        for i in every:
            self.surface[i] = None if sp.is_control(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(MARK, " ").encode()
        self.byte_ids, self.controls = set(self.bytes.values()), {i for i in every if sp.is_control(i)}
        # pieces of several characters by the time of their merge, and the two that merge last
        order = {s: r for r, s in enumerate(sorted({s for p, s in self.scores.items() if len(p) > 1}, reverse=True))}
        self.rank = {p: order[s] for p, s in self.scores.items() if len(p) > 1}
        self.halves = {p: self.last_merge(p) for p in self.rank}
        self.fitting: dict[int, bool] = {}
        self.known = Known(self)

    def merged(self, text: str, before: str = "") -> list[str]:
        """The model's own merging of a short text; before: without the merge that makes this piece."""
        symbols, scores = list(text), self.scores
        while len(symbols) > 1:
            best = max(((s, -i) for i in range(len(symbols) - 1) if (both := symbols[i] + symbols[i + 1]) != before and (s := scores.get(both)) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def last_merge(self, piece: str) -> tuple[str, str]:
        symbols = self.merged(piece, before=piece)
        return (symbols[0], symbols[1]) if len(symbols) == 2 else ("", "")

    def fit(self, a: int, b: int) -> bool:
        """May piece b follow piece a: their text, merged anew, is the two again. A character that is no piece fits all."""
        x, y = self.names[a], self.names[b]
        # runs of marks are pieces of one score, so the order of their merges isn't that of the scores alone
        fits = not x or not y or (self.merged(x + y) == [x, y] if y[0] == MARK else self.stays_apart(x, y))
        if len(self.fitting) >= PAIRS:
            self.fitting.clear()
        self.fitting[a * len(self.names) + b] = fits
        return fits

    def stays_apart(self, a: str, b: str) -> bool:
        """fit() by taking the merges of both back, the latest first: at no time do their ends merge before that."""
        rank, until = self.rank, len(self.rank)
        while True:
            both = rank.get(a + b)
            if both is not None and both < until:
                return False
            x, y = rank.get(a, -1), rank.get(b, -1)
            if x > y:
                until, a = x, self.halves[a][1]
            elif y >= 0:
                until, b = y + 1, self.halves[b][0]  # of equal merges the left one is first
            else:
                return True

    def cut(self, text: str) -> list[int]:
        """Pieces of a text of marks and characters; NO_PIECE where a character is none."""
        size, shorter, fitting, n = self.sizes, self.shorter, self.fitting, len(self.names)
        longest = [NO_PIECE] * len(text)
        for last, i in self.matches(text):  # of the pieces that start at a place, the longest ends last
            longest[last - size[i] + 1] = i
        failed, any_failed = bytearray((len(text) >> 3) + 1), False  # a bit for each place from which no pieces go on
        out: list[int] = []
        at, i = 0, longest[0]
        while True:
            end = at + size[i]
            if any_failed and failed[end >> 3] >> (end & 7) & 1:
                fits = False
            elif out:
                fits = fitting.get(out[-1] * n + i)
                if fits is None:
                    fits = self.fit(out[-1], i)
            else:
                fits = True
            if fits:
                out.append(i)
                if end == len(text):
                    return out
                at, i = end, longest[end]
            elif shorter[i] != NO_PIECE:
                i = shorter[i]
            else:  # the piece before is tried again: it ends at a marked place now, so it is shortened
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                i = out.pop()
                at -= size[i]

    def unit(self, text: str) -> bytes:
        """Ids of a unit, little-endian unsigned 32-bit."""
        cut = self.cut(text)
        if NO_PIECE not in cut:
            return b"".join([self.packed[i] for i in cut])
        out, at = [], 0
        for i in cut:
            out += [self.packed[i]] if i != NO_PIECE else [self.packed[self.bytes[b]] for b in text[at].encode()]
            at += self.sizes[i]
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids with begin and end."""
        units = UNIT.findall(MARK + text.replace(" ", MARK)) if text else []
        return np.frombuffer(self.packed[self.begin] + b"".join(map(self.known.__getitem__, units)) + self.packed[self.end], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: marks are spaces, the first one goes; bytes that are no UTF-8 are replaced one by one."""
        listed = ids.tolist()
        parts = [p for p in map(self.surface.__getitem__, listed) if p is not None]
        data = b"".join(parts)
        first = next((i for i in listed if self.surface[i] is not None), None)
        if first is not None and first not in self.byte_ids and data[:1] == b" " and parts[0] != " ⁇ ".encode():
            data = data[1:]
        if not self.controls.isdisjoint(listed[1:-1]):
            return self.replaced(listed)
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self.replaced(listed)

    def replaced(self, listed: list[int]) -> str:
        """decode() where runs of byte ids, which control ids end too, aren't UTF-8: what can't be read is replaced byte by byte."""
        out, run = [], b""
        for i in [*listed, self.begin]:
            if i in self.byte_ids:
                run += self.surface[i]
                continue
            while run:
                n = next((n for n in (1, 2, 3, 4) if readable(run[:n])), 0)
                out.append(run[:n].decode() if n else "�")
                run = run[n or 1 :]
            if (surface := self.surface[i]) is not None:
                out.append(surface.decode()[1:] if not out and surface[:1] == b" " and surface != " ⁇ ".encode() else surface.decode())
        return "".join(out)


def readable(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


class Known(dict):
    """Ids of the units met so far."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces = pieces

    def __missing__(self, unit: str) -> bytes:
        ids = self.pieces.unit(unit)
        if len(unit) <= LONGEST:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = ids
        return ids


@functools.cache
def pieces(model: str = MODEL) -> Pieces:
    return Pieces(model)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>, decoded string.

    The ids are those of the sentencepiece library with begin and end ids and no
    sampling, the decoded text is that of these ids. Null text counts as empty:
    begin and end alone. One row a document, repeated rows each; a null id stays
    null. No documents: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_pieces = pieces(model)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = model_pieces.encode(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int32())), pa.array([model_pieces.decode(ids)])], names=["doc_id", "ids", "decoded"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded() as doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256; neither leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_pieces = pieces(model)
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in b.column(1):
                ids = model_pieces.encode(text.as_py() or "")
                for column, value in zip(out, (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(model_pieces.decode(ids).encode()).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return doc_columns(docs, "doc_id", "text").selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
