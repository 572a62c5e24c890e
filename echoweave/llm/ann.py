"""Nearest neighbours by score-aware anisotropic quantisation.

Vectors are dealt to lists by their nearest coarse centre, and a query looks into
the lists of its nearest centres. Euclidean nearness there is turned into a
maximum inner product: a vector x becomes (x, -|x|^2 / 2), a query q becomes
(q, 1). Vectors are coded by 16 centres for each pair of coordinates; codes are
chosen so that the residual's part parallel to the vector, which moves the inner
product, weighs ``ETA`` times as much as the rest. Vectors are coded relative to
their list's centre, so that codes tell the vectors of a tight list apart. Two
4-bit codes share a byte; a query adds up a table of 256 sums for each byte. The
best ``RERANK`` of a block are measured exactly, in double precision, and with
them every vector whose code and kept coding error leave it a chance to be nearer:
a block loses none of its nearest, whatever the vectors are like.

Scale: all centres are fitted on a bounded sample, and so is the number of lists
that a query looks into: the least that hold ``COVER`` of the sample's true
neighbours. A query then looks into every other list that can hold a vector
nearer than the k-th it has found, by the list's radius and by the plane between
the centres; so the result is that of measuring all. Every vector is coded. There are about LISTS * sqrt(vectors) lists,
up to MAX_LISTS and never more than the sample has rows, and only their centres
and counts are broadcast. How many lists are looked into depends on the data: of
clustered vectors few, and work grows with their number to the power of 1.5; of
vectors without structure nearly all, and work grows with the square. A list with many vectors - one vector may
hold a third of the table - is cut into blocks of about ``BLOCK`` by the id's
hash. Queries of a block are packed too and meet it by a join on list and block,
so neither side is collected, and memory is that of two blocks. Equal vectors of
a block are coded once and measured once; no more than k + 1 of their ids, the
smallest, can be among the k nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, doc_columns

K, QUERY_EVERY = 10, 100
SAMPLE, CENTRES, ROUNDS, PASSES = 10_000, 16, 12, 2
ETA = 4.0
LISTS, MAX_LISTS, LIST_ROUNDS = 1, 16_384, 8
#: Share of the true neighbours of PROBE_QUERIES vectors of the sample that lie in the lists looked into.
COVER, PROBE_QUERIES = 0.98, 500
BLOCK, QUERY_BLOCK, RERANK = 8_192, 512, 128


def augmented(x: np.ndarray) -> np.ndarray:
    """(x, -|x|^2/2), padded to an even number of coordinates."""
    out = np.column_stack([x, -0.5 * (x * x).sum(1)])
    return out if out.shape[1] % 2 == 0 else np.column_stack([out, np.zeros(len(x))])


def encode(v: np.ndarray, centres: np.ndarray, eta: float = ETA, passes: int = PASSES) -> np.ndarray:
    """Codes (n, m) of augmented vectors: nearest centres first, then, one pair of coordinates after the other, the least anisotropic loss."""
    n, m = len(v), len(centres)
    parts = v.reshape(n, m, 2)
    unit = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)).reshape(n, m, 2)
    codes = np.empty((n, m), np.uint8)
    square = np.empty((n, m, CENTRES))
    along = np.empty((n, m, CENTRES))
    for j in range(m):
        r = parts[:, j, None, :] - centres[j][None]
        square[:, j] = (r * r).sum(2)
        along[:, j] = (r * unit[:, j, None, :]).sum(2)
        codes[:, j] = square[:, j].argmin(1)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None].astype(np.intp), 2).sum((1, 2))
    for _ in range(passes):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            loss = square[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2
            codes[:, j] = loss.argmin(1)
            total = rest + along[rows, j, codes[:, j]]
    return codes


def fit(v: np.ndarray, eta: float = ETA) -> np.ndarray:
    """Centres (m, 16, 2) of the sample's augmented vectors: Lloyd rounds whose assignment is the anisotropic one."""
    n, m = len(v), v.shape[1] // 2
    parts = v.reshape(n, m, 2)
    rng = np.random.default_rng(9)
    centres = np.stack([parts[rng.choice(n, CENTRES, n < CENTRES), j] for j in range(m)])
    for step in range(ROUNDS):
        codes = encode(v, centres, eta, passes=1 if step > ROUNDS // 2 else 0)
        for j in range(m):
            count = np.bincount(codes[:, j], minlength=CENTRES)
            for c in range(2):
                total = np.bincount(codes[:, j], parts[:, j, c], CENTRES)
                centres[j, :, c] = np.where(count > 0, total / np.maximum(count, 1), centres[j, :, c])
    return centres


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """(n, m) codes of four bits -> (n, ceil(m / 2)) bytes, the even code in the lower half."""
    if codes.shape[1] % 2:
        codes = np.column_stack([codes, np.zeros(len(codes), np.uint8)])
    return codes[:, ::2] | codes[:, 1::2] << 4


def byte_tables(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Queries -> (queries, bytes, 256): what each byte of two codes adds to the inner product."""
    width = centres.shape[0] * 2
    q_wide = np.column_stack([q, np.ones(len(q)), *([np.zeros(len(q))] if width > q.shape[1] + 1 else [])])
    t = np.einsum("qmd,mcd->qmc", q_wide.reshape(len(q), -1, 2), centres)
    if t.shape[1] % 2:
        t = np.concatenate([t, np.zeros((len(q), 1, CENTRES))], 1)
    return (t[:, 1::2, :, None] + t[:, ::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)


def made_block(ids: np.ndarray, x: np.ndarray, centres: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids by vector and then by id, where each vector's start, the different vectors, their packed codes relative to origin, what turns a score into a coded vector's squared distance, and the coding errors."""
    one, same = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, same.ravel()))
    starts = np.searchsorted(same.ravel()[order], np.arange(len(one) + 1))
    v = augmented(one - origin)
    codes = encode(v, centres)
    seen = centres[np.arange(len(centres)), codes].reshape(len(v), -1)
    square, last = (seen[:, : x.shape[1]] ** 2).sum(1), seen[:, x.shape[1]]
    return ids[order], starts, one, pack_codes(codes), square + 2 * last, np.linalg.norm((v - seen)[:, : x.shape[1]], axis=1)


def search_block(block: tuple[np.ndarray, ...], centres: np.ndarray, origin: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int = K, rerank: int = RERANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of each query's k nearest among the vectors of a made_block(), its own id left out."""
    ids, starts, one, codes, more, error = block
    depth = min(rerank, len(one))
    if k < depth < len(one):
        y = q - origin
        tables = byte_tables(y, centres)
        far = np.zeros((len(q), len(one)))
        for j in range(codes.shape[1]):
            far -= tables[:, j][:, codes[:, j]]
        size = (y * y).sum(1)[:, None]
        far = size + 2 * far + more  # squared distance of the coded vector
        slack = 1e-11 * (size + (centres * centres).sum(2).max(1).sum() + 2 * np.abs(centres[-1]).max())  # of rounding
        best = np.argpartition(far, depth - 1, axis=1)[:, :depth]
        least = np.sqrt(np.maximum(far - slack, 0)) - error  # no vector is nearer than its code's distance less its error
        reach = [np.partition(np.sqrt(((one[row] - x) ** 2).sum(1)), k)[k] for x, row in zip(q, best, strict=True)]
        best = [np.flatnonzero(low <= r * (1 + 1e-9)) for low, r in zip(least, reach, strict=True)]
    else:
        best = np.broadcast_to(np.arange(len(one)), (len(q), len(one)))
    out_q, out_v, out_d = [], [], []
    for q_id, x, row in zip(q_ids.tolist(), q, best, strict=True):
        d = np.sqrt(((one[row] - x) ** 2).sum(1))
        near = np.lexsort((ids[starts[row]], d))[: k + 1]
        found = sorted((d[j], v) for j in near for v in ids[starts[row[j]] : min(starts[row[j] + 1], starts[row[j]] + k + 1)].tolist() if v != q_id)
        for dist, v in found[:k]:
            out_q.append(q_id)
            out_v.append(v)
            out_d.append(dist)
    return np.array(out_q, np.int64), np.array(out_v, np.int64), np.array(out_d)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances but for |x|^2."""
    return (centres * centres).sum(1) - 2 * x @ centres.T


def least_distances(x: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(rows of x, lists): no vector of the list is nearer, by its radius and by the plane between its centre and x's own."""
    size = (x * x).sum(1)[:, None]
    square = np.maximum(size + distances(x, centres), 0)
    own = square.argmin(1)
    scale = size + (centres * centres).sum(1)
    ball = np.sqrt(square) - radius - 1e-7 * np.sqrt(scale)
    apart = np.sqrt(np.maximum((centres[own] ** 2).sum(1)[:, None] + distances(centres[own], centres), 0))
    known = apart > 1e-6 * np.sqrt(scale)
    plane = np.where(known, square - np.take_along_axis(square, own[:, None], 1) - 1e-13 * scale, 0) / np.where(known, 2 * apart, 1)
    return np.maximum(ball, plane * (1 - 1e-9))


def fit_lists(x: np.ndarray, n: int, k: int) -> tuple[np.ndarray, int]:
    """n coarse centres of the sample, and how many lists a query looks into."""
    rng = np.random.default_rng(9)
    centres = x[rng.choice(len(x), min(n, len(x)), False)].copy()
    for _ in range(LIST_ROUNDS):
        at = distances(x, centres).argmin(1)
        count = np.bincount(at, minlength=len(centres))
        total = np.stack([np.bincount(at, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    at = distances(x, centres).argmin(1)
    some = rng.choice(len(x), min(PROBE_QUERIES, len(x)), False)
    near = distances(x[some], x)
    near[np.arange(len(some)), some] = np.inf
    true = at[np.argsort(near, 1)[:, : min(k, len(x) - 1)]]  # lists of the true neighbours
    place = np.argsort(np.argsort(distances(x[some], centres), 1), 1)
    need = np.sort(np.take_along_axis(place, true, 1).ravel())
    return centres, int(need[min(len(need) - 1, int(np.ceil(COVER * len(need))))]) + 1 if len(need) else 1


def usable(vector: Column, dims: int) -> Column:
    """Not null, of the common length, with finite components only and one that isn't zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(rows: DataFrame, k: int = K, every: int = QUERY_EVERY, block: int = BLOCK, query_block: int = QUERY_BLOCK, rerank: int = RERANK) -> DataFrame:
    """rows(vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by ``every``.

    score is the Euclidean distance in double precision on the original vectors;
    ties go to the smaller vec_id. Null, zero and non-finite vectors, null ids,
    and vectors of another length than the most frequent one take no part. A
    query's own id is no candidate, in any row; other rows that repeat an id are
    candidates each for itself. Rows that repeat a query's id ask once, with the
    smallest of their vectors. Fewer rows than k: all of them. No rows: none.
    Other columns are ignored.
    """
    rows = doc_columns(rows, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None or lengths.dims < 1:
        return rows.sparkSession.createDataFrame([], schema)
    dims = lengths.dims
    rows = rows.where(usable(F.col("embedding"), dims)).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], schema)
    x = np.array([r.x for r in sample], float)
    middle = x.mean(0)
    x -= middle
    coarse, probes = fit_lists(x, max(1, min(MAX_LISTS, int(LISTS * rows.count() ** 0.5))), k)
    centres = fit(augmented(x - coarse[distances(x, coarse).argmin(1)]))
    shared = rows.sparkSession.sparkContext.broadcast((centres, coarse))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def origin(of: int) -> np.ndarray:
        return middle + shared.value[1][of]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                v = matrix(part.column("x")) - middle
                at = distances(v, shared.value[1]).argmin(1)
                far = np.linalg.norm(v - shared.value[1][at], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at, pa.int32()), pa.array(far)], names=["vec_id", "x", "list", "far"])

    listed = checkpointed(rows.mapInArrow(assigned, "vec_id long, x array<double>, list int, far double"))
    # a row for each list, MAX_LISTS at most
    lists = checkpointed(listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.max("far").alias("radius")))
    counts = F.broadcast(lists.select("list", "blocks"))

    def packed(size: int, make: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, ...]], names: list[str]) -> Callable:
        """Rows that lie together by list and block -> one row for each group, or of a larger one for each up to size: ids, vectors and more as bytes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(key: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(key[:1], pa.int32()), pa.array(key[1:], pa.int32()), *(pa.array([m.tobytes()], pa.binary()) for m in make(int(key[0]), ids, v))], names=["list", "part", *names])

            keys, ids, v = np.zeros((0, 2), np.int32), np.zeros(0, np.int64), np.zeros((0, dims))
            for b in batches:
                keys = np.concatenate([keys, np.column_stack([b.column(c).to_numpy() for c in ("list", "part")])])
                ids = np.concatenate([ids, b.column("vec_id").to_numpy()])
                v = np.concatenate([v, matrix(b.column("x"))])
                ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(ids)]
                lo = 0
                for hi in ends:  # the last group may go on in the next batch
                    while hi - lo >= size or (hi < len(ids) and hi > lo):
                        end = min(hi, lo + size)
                        yield out(keys[lo], ids[lo:end], v[lo:end])
                        lo = end
                keys, ids, v = keys[lo:], ids[lo:], v[lo:]
            if len(ids):
                yield out(keys[0], ids, v)

        return run

    part = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    dealt = listed.join(counts, "list").select("list", part.alias("part"), "vec_id", "x").repartition("list", "part").sortWithinPartitions("list", "part")
    parts = ["ids", "starts", "one", "codes", "more", "error"]
    kinds = [np.int64, np.int64, np.float64, np.uint8, np.float64, np.float64]
    index = checkpointed(dealt.mapInArrow(packed(2 * block, lambda at, i, v: made_block(i, v, shared.value[0], origin(at)), parts), "list int, part int, " + ", ".join(f"{c} binary" for c in parts)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of the nearest centres."""
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                near = np.argsort(distances(matrix(part.column("x")) - middle, shared.value[1]), 1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["vec_id", "x", "lists"])

    def search(asked: DataFrame) -> DataFrame:
        """asked(vec_id, x, lists) -> query_id, vec_id, score of the nearest in each block of the lists."""
        asked = asked.select("vec_id", "x", F.explode("lists").alias("list")).join(counts, "list")
        asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "vec_id", "x").repartition("list", "part").sortWithinPartitions("list", "part")
        asked = asked.mapInArrow(packed(query_block, lambda at, i, v: (i, v), ["q_ids", "q"]), "list int, part int, q_ids binary, q binary")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, q_ids, q, *made in zip(*(b.column(c) for c in ("list", "q_ids", "q", *parts)), strict=True):
                    of = lambda v, kind: np.frombuffer(v.as_buffer(), kind)
                    ids, starts, one, codes, more, error = (of(v, kind) for v, kind in zip(made, kinds, strict=True))
                    one = one.reshape(-1, dims)
                    found = search_block((ids, starts, one, codes.reshape(len(one), -1), more, error), shared.value[0], origin(at.as_py()), of(q_ids, np.int64), of(q, np.float64).reshape(-1, dims), k, rerank)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

        return index.join(asked, ["list", "part"]).select("list", "q_ids", "q", *parts).mapInArrow(scan, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        nth = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
        return checkpointed(found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    queries = listed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    out = ranked(search(queries.mapInArrow(first, "vec_id long, x array<double>, lists array<int>")))
    if probes < len(coarse):
        radius = np.zeros(len(coarse))
        for r in lists.select("list", "radius").collect():
            radius[r.list] = r.radius
        radii = rows.sparkSession.sparkContext.broadcast(radius)

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The other lists that can hold a vector as near as the k-th found; of a query that found fewer, all."""
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    v = matrix(part.column("x")) - middle
                    order = np.argsort(distances(v, shared.value[1]), 1, kind="stable")[:, probes:].astype(np.int32)
                    least = np.take_along_axis(least_distances(v, shared.value[1], radii.value), order, 1)
                    may = [row[low <= reach * (1 + 1e-9)] for row, low, reach in zip(order, least, part.column("reach").to_numpy(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), pa.array(may, pa.list_(pa.int32()))], names=["vec_id", "x", "lists"])

        kth = out.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("_s"))
        rest = queries.join(kth, "vec_id", "left").select("vec_id", "x", F.coalesce("_s", F.lit(float("inf"))).alias("reach"))
        out = ranked(out.drop("rank").unionByName(search(rest.mapInArrow(others, "vec_id long, x array<double>, lists array<int>"))))
    return out
