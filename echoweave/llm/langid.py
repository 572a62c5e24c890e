"""Language identification by error-correcting output codes.

Each language has a codeword; a linear classifier on hashed byte 2- and 3-grams
predicts each bit. Decoding adds, over the bits, the logistic loss of the
margin under each codeword, weighted by the bit's reliability; the language of
the smallest loss wins, and a text whose two best are close is flagged.

Scale: trained on a bounded sample (about ``SAMPLE_DOCS`` documents, dealt evenly
to the languages, chosen by hash); prediction is one pass without a shuffle over
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, id_bucket

SAMPLE_DOCS = 3_000
DIMENSIONS = 2_048
RIDGE = 1e-2
FOLDS, HELD_OUT_FOLD = 3, 1
UNKNOWN = "und"
#: A text is ambiguous if the best language's share isn't this much above the second's.
AMBIGUOUS_GAP = 0.2
#: n-grams of a text are counted in pieces of so many bytes: memory doesn't grow with the text.
PIECE = 1 << 20


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def ngram_vector(text: str) -> np.ndarray:
    """Square roots of the hashed 2- and 3-gram counts of the lower-cased text, of length 1."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.zeros(DIMENSIONS)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    for lo in range(0, max(len(data) - 1, 0), PIECE):
        b = data[lo : lo + PIECE + 2].astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) ^ b[1:] * np.uint32(0x85EBCA6B)
        out += np.bincount((two[:PIECE] * np.uint32(0x2C1B3C6D)) >> shift, minlength=DIMENSIONS)
        three = two[:-1] ^ b[2:] * np.uint32(0xC2B2AE35)
        out += np.bincount((three[:PIECE] * np.uint32(0x297A2D39)) >> shift, minlength=DIMENSIONS)
    out = np.sqrt(out)
    return out / (np.linalg.norm(out) or 1.0)


def codewords(n: int) -> np.ndarray:
    """n codewords of +-1: of random codes, the one whose closest words are farthest apart."""
    bits = max(7, 4 * int(np.ceil(np.log2(max(n, 2)))) + 3)
    rng, best, best_apart = np.random.default_rng(8), None, -1
    for _ in range(300):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        if n > 1 and code.shape[1]:
            apart = ((code.shape[1] - code @ code.T) / 2)[~np.eye(n, dtype=bool)].min()
            if apart > best_apart:
                best, best_apart = code, apart
    return best if best is not None else np.ones((n, 1))


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    code: np.ndarray | None = None
    weights: np.ndarray | None = None
    reliability: np.ndarray | None = None

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Rows by languages."""
        margin = 3.0 * (x @ self.weights[:-1] + self.weights[-1])
        return np.stack([(np.logaddexp(0, -margin * word) * self.reliability).sum(1) for word in self.code], 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share of the evidence from 0 to 1, and whether it is ambiguous."""
        lang, score, flag = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        if rows and len(self.languages) == 1:
            score[rows], flag[rows] = 1.0, False
            for i in rows:
                lang[i] = self.languages[0]
        elif rows:
            loss = self.losses(np.stack([ngram_vector(texts[i]) for i in rows]))
            share = np.exp(loss.min(1, keepdims=True) - loss)
            share /= share.sum(1, keepdims=True)
            two = np.sort(share, 1)[:, -2:]
            score[rows], flag[rows] = share.max(1), two[:, 1] - two[:, 0] < AMBIGUOUS_GAP
            for i, j in zip(rows, loss.argmin(1), strict=True):
                lang[i] = self.languages[j]
        return lang, score, flag


def fit(x: np.ndarray, langs: list[str]) -> Model:
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names)
    code = codewords(len(names))
    y = code[[names.index(v) for v in langs]]
    a = np.column_stack([x, np.ones(len(x))])
    w = np.linalg.solve(a.T @ a + RIDGE * np.eye(a.shape[1]), a.T @ y)
    right = (np.sign(a @ w) == y).mean(0).clip(0.5, 0.999)
    return Model(names, code, w, np.log(right / (1 - right)) / np.log(999) + 1e-3)


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of documents outside the held-out fold; null langs and texts, and texts without letters, don't count."""
    docs = doc_columns(docs, "doc_id", "text", "lang")
    known = docs.where("doc_id is not null and text is not null and lang is not null").where(id_bucket(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD)
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    n = counts.count()
    if not n:
        return Model()
    # of each language the ids whose hash is below its share: no window holds a language
    u = F.pmod(F.xxhash64(F.lit(8), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.select("doc_id", "lang").join(counts, "lang").where(u < max(8, SAMPLE_DOCS // n) / F.col("rows")).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(8), F.col("doc_id")), "doc_id").limit(max(16 * n, 2 * SAMPLE_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, v, ngram_vector(t).astype(np.float32).tobytes()) for i, t, v in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_pylist([{"doc_id": i, "lang": v, "x": x} for i, v, x in rows], pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())]))

    got = known.join(F.broadcast(picked), "doc_id", "left_semi").mapInArrow(run, "doc_id long, lang string, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.lang))
    return fit(np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float), [r.lang for r in got]) if got else Model()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score, ambiguous.

    Texts that are null or have no letter: ``und`` with score 0. A null doc_id
    counts as held out: it is in no fold. Repeated rows are predicted each for
    itself. No documents: no rows; nothing to learn from: ``und`` for all.
    Other columns, lang among them, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lang, score, flag = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(flag)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    out = doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    held = F.coalesce(id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
