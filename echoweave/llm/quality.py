"""Quality classifier from compression with zstandard dictionaries.

One dictionary is built from good and one from bad labelled text. A text is
compressed whole with each, and without one. Its score is calibrated, by
logistic regression, from normalised differences of sizes only: bad against good
dictionary (of the whole text, and the mean of its chunks, where a long text's
own history doesn't hide the dictionary), and no dictionary against good and
against bad.

Scale: half of the labelled documents (by hash of the id) give chunks to the
dictionaries, of which ``DICT_CHUNKS`` a class are drawn by hash from anywhere in
their texts; ``CALIBRATION_DOCS`` of the other half calibrate. Only these bounded
samples reach the driver. Scoring is one pass over the documents without a
shuffle; each text is held by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, id_bucket

#: Labelled documents, of both classes, whose chunks are offered to the dictionaries, and chunks that a dictionary is built from.
DICT_DOCS, DICT_CHUNKS = 4_000, 2_500
DICT_BYTES, CHUNK_BYTES = 112_640, 2_000
#: Other labelled documents, as they come, that the score is calibrated on.
CALIBRATION_DOCS = 4_000
#: Bytes of the chunks that are compressed by themselves.
PART_BYTES = 1_000
LEVEL = 3
FOLDS, HELD_OUT_FOLD = 5, 0
THRESHOLD = 0.3
FEATURES = 4


def chunks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of the chunks; of too few, the chunks themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(raw: bytes | None = None) -> zstandard.ZstdCompressor:
    """With a dictionary, or with none."""
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False}
    if raw is None:
        return zstandard.ZstdCompressor(**plain)
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_dict_id=False, **plain)


def difference(a: int, b: int) -> float:
    return (a - b) / max(a, b, 1)


def features(text: str, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, none: zstandard.ZstdCompressor) -> tuple[float, ...]:
    """The normalised differences of sizes."""
    data = text.encode("utf-8", "replace")
    size = lambda z, x: len(z.compress(x))
    g, b, n = (size(z, data) for z in (good, bad, none))
    parts = [difference(size(bad, x), size(good, x)) for x in chunks(data, PART_BYTES)] if len(data) > PART_BYTES else [difference(b, g)]
    return difference(b, g), float(np.mean(parts)), difference(n, g), difference(n, b)


def expand(x: np.ndarray) -> np.ndarray:
    """One, the features and their products."""
    return np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i, j in combinations_with_replacement(range(x.shape[1]), 2))])


@dataclass
class Model:
    """Dictionaries and calibration; without dictionaries every score is ``prior``."""

    good: bytes = b""
    bad: bytes = b""
    prior: float = 0.5
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 0.1) -> None:
        """Penalised logistic regression by Newton steps, each halved until it is better; ends when none is."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = expand((x - self.mean) / self.scale)

        def cost(w: np.ndarray) -> float:
            return float(np.logaddexp(0, a @ w).sum() - y @ (a @ w) + ridge / 2 * w @ w)

        w = np.zeros(a.shape[1])
        now = cost(w)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
            size = 1.0
            while size > 1e-9 and cost(w + size * step) >= now:
                size /= 2
            if size <= 1e-9 or now - cost(w + size * step) < 1e-10 * abs(now):
                break
            w = w + size * step
            now = cost(w)
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(expand((x - self.mean) / self.scale) @ self.weights, -30, 30)))

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        tools = compressor(self.good), compressor(self.bad), compressor()
        return self.score(np.array([features(t.as_py() or "", *tools) for t in texts]).reshape(-1, FEATURES))


def with_features(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """docs(doc_id, text) -> doc_id, x array<double>: the features of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = *map(compressor, shared.value), compressor()
        for batch in batches:
            x = [features(t.as_py() or "", *tools) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def drawn_chunks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, quality) -> quality, order, chunk: each chunk of the whole texts, and a hash that deals them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, text in zip(b.column("quality").to_pylist(), b.column("text"), strict=True):
                cut = chunks((text.as_py() or "").encode("utf-8", "replace"), CHUNK_BYTES)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(cut), pa.int32()), pa.array([xxhash.xxh64_intdigest(c) >> 1 for c in cut], pa.int64()), pa.array(cut, pa.binary())], names=["quality", "order", "chunk"])

    return docs.select("quality", "text").mapInArrow(run, "quality int, order long, chunk binary")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from documents outside the held-out fold. Null labels and ids don't count; of several labels of a document the largest does. Rows that repeat an id count each."""
    docs = doc_columns(docs, "doc_id", "text")
    known = (
        doc_columns(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .where(id_bucket(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD).withColumn("_h", F.xxhash64("doc_id"))
    )
    half = F.pmod("_h", F.lit(2))
    sample = lambda n, which: known.where(half == which).orderBy("_h", "doc_id").limit(n).select("doc_id", "quality")
    offered = drawn_chunks(docs.join(F.broadcast(sample(DICT_DOCS, 0)), "doc_id"))
    drawn = {q: [r.chunk for r in offered.where(F.col("quality") == q).orderBy("order", "chunk").limit(DICT_CHUNKS).collect()] for q in (0, 1)}
    if not drawn[0] or not drawn[1]:
        return Model(prior=1.0 if drawn[1] else 0.0 if drawn[0] else 0.5)
    model = Model(dictionary(drawn[1]), dictionary(drawn[0]))
    others = F.broadcast(sample(CALIBRATION_DOCS, 1))
    got = with_features(docs.join(others, "doc_id", "left_semi"), model.good, model.bad).join(others, "doc_id").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    y = np.array([r.quality for r in got], float)
    if 0 < y.sum() < len(y):
        model.calibrate(np.array([r.x for r in got]), y)
    return model


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted.

    Every whole text is scored, null as the empty one. A null doc_id counts as
    held out: it is in no fold. Repeated rows are scored each for itself. No
    documents: no rows; no labels of one class: a constant score. Other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score_texts(b.column("text")))], names=["doc_id", "score"])

    scored = doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, all their columns. One pass: the texts are not shuffled.

    Rows are judged each for itself, whatever their ids; null texts as empty
    ones; no documents: no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.value.score_texts(b.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
