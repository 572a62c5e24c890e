"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. Two segments that differ in at most two bits
have a value in common in their Hamming balls of radius one, so each segment's
ball is enumerated (of 32 bits 33 values) and looked up as a table key; the
members of a key are compared by complete distance.

near_duplicates(): 64 bits of four-word shingles, two segments. Fingerprints that
differ in at most RADIUS = 4 bits differ in at most two bits of one half, so all
links are found.

near_dedup(): five-word shingles and a Jaccard similarity of 0.8. At 0.8 some 15 %
of the bits differ, which 64 bits can't tell apart, so NEAR_WORDS * 64 bits and
NEAR_SEGMENTS segments are taken; candidates within NEAR_RADIUS bits are compared
by the exact similarity of their shingles. A pair of similarity s is found in a
segment with the chance that at most two of its bits differ: over 20 segments of
32 bits 0.93 at s = 0.8, 0.99 at 0.85; more segments find more. Shorter segments
find as much with fewer, but texts that have nothing in common meet in them too
often: of n texts, some n * n / 2 ** 24 pairs in one of 32 bits. Of a key's
candidates only a spanning forest is compared by shingles (see below).

Scale: fingerprints are taken in the scan; equal texts become one before the
tables are built. They are dealt evenly over the cluster before their balls are
enumerated; a table row is 16 bytes and only one segment's table of near_dedup()
is on disk at a time. Keys with one member are dropped by an aggregate. A key's
members are compared in blocks of ``BLOCK``: two blocks meet in one task, so a
key of n members moves n * n / BLOCK rows, and a task returns a minimum spanning
forest of the links it finds, never the pairs: each link left out is replaced by
a path of links no longer than itself. So a large group of near copies yields
rows in proportion to its members, and no task holds more than two blocks.
near_dedup() compares the links of the forests by shingles, so it can miss a
link whose path has one that isn't like enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, doc_columns, drop_rows, text_keys, tidy_shuffles
from .components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bits of a segment of near_duplicates().
SEGMENT_BITS = 32
#: near_dedup(): words of a shingle, similarity of near copies, 64-bit words of a fingerprint, bits in which candidates differ at most, segments and their bits.
NEAR_SHINGLE, SIMILARITY, NEAR_WORDS, NEAR_RADIUS, NEAR_SEGMENTS, NEAR_BITS = 5, 0.8, 10, 133, 20, 32
#: Segments of near_links() whose tables are on disk at once.
AT_ONCE = 2
#: Members of a key that are compared in one piece.
BLOCK = 4096
#: Shingles of a text that are hashed at once.
PIECE = 65_536


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes (uint64) of the shingles of ``shingle`` words, or of the whole of fewer words, in pieces; nothing without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    joined = memoryview(b" ".join(words))
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    for lo in range(0, n, PIECE):
        yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + PIECE], stops[lo : lo + PIECE], strict=True)), np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits: sums of bytes as far as a byte counts, then of these."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    return bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)


def majority(count: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: one where over half of the shingles' hashes, repeats included, have a one; zero without words."""
    count, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        count += bit_counts(h)
        n += len(h)
    return majority(count, n)


def shingle_set(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The different hashes (uint64) of the shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def wide_fingerprint(hashes: np.ndarray, words: int = NEAR_WORDS) -> list[int]:
    """``words`` longs; each takes the hashes mixed in another way."""
    out = []
    for w in range(words):
        x = hashes * np.uint64(2 * w + 1)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out.append(majority(bit_counts(x ^ (x >> np.uint64(32))), len(x)))
    return np.array(out, np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp: the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def forest(fps: np.ndarray, old: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A minimum spanning forest of the links of at most radius bits among fps (n, words). old: the first so many are only compared with the rest, 0: all with all."""
    left, out, i = np.arange(1, len(fps)), [], 0
    best, parent = np.full(len(fps), radius + 1), np.zeros(len(fps), np.int64)
    while len(left):
        d = np.bitwise_count(fps[left] ^ fps[i]).sum(1, dtype=np.int64)
        if old:
            d[(left < old) == (i < old)] = radius + 1
        nearer = d < best[left]
        best[left[nearer]], parent[left[nearer]] = d[nearer], i
        at = int(best[left].argmin())
        i = int(left[at])
        if best[i] <= radius:
            out.append((i, int(parent[i])))
        left = np.delete(left, at)
    return out


def segment(k: int, bits: int = SEGMENT_BITS) -> Column:
    """The k-th so many bits of the fingerprint f0, f1, ..., which may lie in two words."""
    word, low = divmod(k * bits, 64)
    out = F.shiftrightunsigned(f"f{word}", low)
    if low + bits > 64:
        out = out.bitwiseOR(F.shiftleft(f"f{word + 1}", 64 - low))
    return out.bitwiseAND(F.lit((1 << bits) - 1))


def dealt_out(fps: DataFrame) -> DataFrame:
    """fps by node, written once: each use of links() joins to it where it lies."""
    return checkpointed(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node"))


def links(dealt: DataFrame, segments: list[int], radius: int = RADIUS, block: int = BLOCK, bits: int = SEGMENT_BITS) -> DataFrame:
    """dealt(node, f0, f1, ...), see dealt_out(), each node once -> edges(a, b) that connect the nodes that share a key of a segment and are within radius bits."""
    words = [c for c in dealt.columns if c != "node"]
    # a key: which segment, and a value of its ball
    ball = lambda k: F.transform(F.array(*(F.lit(x) for x in [0, *(1 << i for i in range(bits))])), lambda x: segment(k, bits).bitwiseXOR(x.cast("long")) + F.lit(k << 32))
    keys = dealt.select("node", F.explode(F.concat(*map(ball, segments))).alias("key"))
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    members = keys.join(groups.hint("shuffle_hash"), "key").join(dealt, "node").withColumn("blocks", blocks).withColumn("own", own)
    # block i meets block j: one group for each i <= j
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    met = members.select("key", "node", *words, "own", F.explode(meets).alias("m")).select("key", "m.i", "m.j", (F.col("own") == F.col("m.i")).alias("first"), "node", *words)
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("first"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups lie one after the other; the last one of a batch waits for the next batch."""
        held: list[np.ndarray] = []

        def compare(rows: np.ndarray, ends: list[int]) -> pa.RecordBatch:
            fp, first, i, j = np.ascontiguousarray(rows[5:].T).view(np.uint64), rows[3], rows[1], rows[2]
            starts = np.array([0, *ends[:-1]])
            two = starts[np.array(ends) - starts == 2]  # most groups: compared at once
            two = two[((i[two] == j[two]) | (first[two] != first[two + 1])) & (np.bitwise_count(fp[two] ^ fp[two + 1]).sum(1, dtype=np.int64) <= radius)]
            a, b = [rows[4][two]], [rows[4][two + 1]]
            for lo, hi in zip(starts.tolist(), ends, strict=True):
                if hi - lo > 2:
                    for x, y in forest(fp[lo:hi], 0 if i[lo] == j[lo] else int(first[lo:hi].sum()), radius):
                        a.append(rows[4][lo + x : lo + x + 1])
                        b.append(rows[4][lo + y : lo + y + 1])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j", "first", "node", *words)])
            rows = np.concatenate([*held, rows], 1)
            ends = (np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1).tolist()
            if ends:
                yield compare(rows, ends)
                rows = rows[:, ends[-1] :]
            held = [rows]
        if held and held[0].shape[1]:
            yield compare(held[0], [held[0].shape[1]])

    edges = met.mapInArrow(run, "a long, b long")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint, component_id.

    Words are runs of anything but ASCII white space in the text with A-Z
    lower-cased; shingles of four words, repeats included, or the whole of fewer
    words. Null, empty and blank texts have the fingerprint zero and are linked
    like any other. component_id: the smallest doc_id reachable over links of at
    most four bits; repeated doc_ids keep a row each; null ids stay null and
    don't name a component unless it has no other. No documents: no rows. Other
    columns are ignored.
    """
    prints = checkpointed(fingerprints(docs))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    with tidy_shuffles(docs.sparkSession):
        parts = checkpointed(connected_components(links(dealt_out(least.select(F.col("fp").alias("node"), F.col("fp").alias("f0"))), [0, 1], block=block)))
    named = least.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """texts(k1, text) -> k1, s array<long>: the different hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("k1"), pa.array(sets, pa.list_(pa.int64()))], names=["k1", "s"])

    return texts.mapInArrow(run, "k1 long, s array<long>")


def wide_fingerprints(docs: DataFrame, shingle: int = NEAR_SHINGLE, words: int = NEAR_WORDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, k1, k2 (of the text), f0, f1, ... long."""
    names = ["doc_id", "k1", "k2", *(f"f{w}" for w in range(words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([wide_fingerprint(shingle_set(t.as_py(), shingle), words) for t in b.column("text")], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:3]), *(pa.array(f[:, w]) for w in range(words))], names=names)

    rows = docs.select("doc_id", *text_keys(F.col("text")), "text")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def near_links(texts: DataFrame, fps: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS, segments: int = NEAR_SEGMENTS, bits: int = NEAR_BITS) -> DataFrame:
    """texts(k1, text), fps(node, f0, ...) of k1 -> edges(a, b) of near copies: fingerprints meet in a segment and are near, shingles are like enough."""
    dealt, every = dealt_out(fps), list(range(segments))
    found = [checkpointed(links(dealt, every[k : k + AT_ONCE], radius, bits=bits)) for k in range(0, segments, AT_ONCE)]
    pairs = checkpointed(reduce(DataFrame.unionByName, found).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    sets = shingle_sets(texts.join(wanted, "k1", "left_semi").dropDuplicates(["k1"]), shingle)
    sets = checkpointed(sets)
    of = lambda c: sets.select(F.col("k1").alias(c), F.col("s").alias(f"s_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.size("s_a").alias("m"), F.size("s_b").alias("n"), F.size(F.array_intersect("s_a", "s_b")).alias("common"))
    return both.where(F.col("common") >= similarity * (F.col("m") + F.col("n") - F.col("common"))).select("a", "b")


def near_dedup(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, words: int = NEAR_WORDS, radius: int = NEAR_RADIUS) -> DataFrame:
    """Of each component of near copies one document, all its columns; the texts are not shuffled unless Spark must.

    Near copies: Jaccard similarity of the sets of five-word shingles (or wholes
    of fewer words) of at least 0.8; words as for near_duplicates(). Texts
    without words are copies of each other, null counts as empty. The smallest
    doc_id stays, of equal ones the smaller text key; null ids stay only where a
    component has no other. Rows that repeat a doc_id with another text are
    documents of their own; of rows that repeat both one stays. No documents: no
    rows. Other columns are kept as they are.
    """
    with tidy_shuffles(docs.sparkSession):
        rows = checkpointed(wide_fingerprints(doc_columns(docs, "doc_id", "text"), shingle, words))
        # texts without words have one fingerprint and no shingles: one node
        fps = rows.groupBy("k1").agg(*(F.first(f"f{w}").alias(f"f{w}") for w in range(words))).withColumnRenamed("k1", "node")
        texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"), "text")
        edges = near_links(texts, fps, shingle, similarity, radius)
        blank = fps.where(" and ".join(f"f{w} = 0" for w in range(words)))
        edges = edges.unionByName(blank.select(F.col("node").alias("a"), blank.agg(F.min("node")).scalar().alias("b")))
        parts = connected_components(edges).select(F.col("node").alias("k1"), "component")
        each = rows.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).join(parts, "k1", "left")
        each = each.select("doc_id", "k1", "k2", "n", F.coalesce("component", "k1").alias("part"), F.when(F.col("component").isNull(), F.col("k2")).otherwise(0).alias("part2"))
        each = checkpointed(each.withColumn("order", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")))
        best = each.groupBy("part", "part2").agg(F.min("order").alias("best"))
        marked = checkpointed(each.join(best, ["part", "part2"]).withColumn("stays", F.col("order") == F.col("best")).select("doc_id", "k1", "k2", "n", "stays"))
    return drop_rows(docs, marked.where("not stays"), marked.where("stays and n > 1"))
