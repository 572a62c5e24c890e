"""Vectors: centroids, profiles, graphs and clustering.

Label tables (centroids, profiles) have one row per label and are joined to
rows by label or compared among themselves; vectors are compared with vectors
only in blocks or inside batches of a fixed size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoweave.functions import vectors as V

#: Fixed values of profile building and merging.
MEMBER_MIN, MERGE_MIN, GARBAGE_COHESION = 0.42, 0.78, 0.65


def centroids(df: DataFrame, label: str, vector: str, name: str = "centroid") -> DataFrame:
    """Mean vector of each label. Dimensions are averaged with map-side combine, so no label's vectors meet in one task."""
    parts = df.select(label, F.posexplode(vector).alias("_d", "_x")).groupBy(label, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias(name))


def mean_normalize(df: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    """Subtract the mean of the key's non-zero vectors from each of them; zero vectors stay zero."""
    live = df.withColumn("_live", F.exists(vector, lambda x: x != 0))
    mean = live.where("_live").select(*keys, F.posexplode(vector).alias("_d", "_x")).groupBy(*keys, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    mean = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("_mean"))
    out = F.when(F.col("_live"), F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m)).otherwise(F.transform(vector, lambda x: x.cast("double")))
    return live.join(mean, keys, "left").select(*keys, order, out.alias("vector"))


def profiles(df: DataFrame, label: str, vector: str, least: float = MEMBER_MIN) -> DataFrame:
    """Per label: centroid of the members whose cosine to the rough centroid is enough (all, if none is), members and their number."""
    rough = centroids(df, label, vector, "_rough")
    scored = df.join(rough, label).withColumn("_in", V.cosine(F.col(vector), F.col("_rough")) >= least)
    any_in = scored.groupBy(label).agg(F.bool_or("_in").alias("_any"))
    kept = scored.join(any_in, label).where(F.col("_in") | ~F.col("_any"))
    return centroids(kept, label, vector).join(kept.groupBy(label).agg(F.count(F.lit(1)).alias("members")), label)


def cohesion(df: DataFrame, label: str, vector: str, centers: DataFrame) -> DataFrame:
    """Mean cosine of each label's vectors to its centroid."""
    return df.join(centers.select(label, "centroid"), label).groupBy(label).agg(F.avg(V.cosine(F.col(vector), F.col("centroid"))).alias("cohesion"), F.count(F.lit(1)).alias("n"))


def against_centroids(df: DataFrame, keys: list[str], vector: str, centers: DataFrame, label: str, measure=V.cosine) -> DataFrame:
    """Long table (keys, label, score) of each vector and each centroid: one array of all centroids - a row per label - is looked up per vector."""
    table = centers.select(F.struct(F.col(label).alias("label"), F.col("centroid")).alias("c")).agg(F.array_sort(F.collect_list("c"), lambda a, b: F.when(a["label"] < b["label"], -1).otherwise(1)).alias("_all"))
    wide = df.select(*keys, F.col(vector).alias("_v"), table.scalar().alias("_all"))
    return wide.select(*keys, "_v", F.explode("_all").alias("_c")).select(*keys, F.col("_c.label").alias("cand"), measure(F.col("_v"), F.col("_c.centroid")).alias("score"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def best(df: DataFrame, keys: list[str], largest: bool = True) -> DataFrame:
    """Best candidate of each key, ties to the smaller label."""
    score = F.col("score") if largest else -F.col("score")
    return df.groupBy(*keys).agg(F.max(F.struct(score.alias("s"), (-F.col("cand")).alias("l"))).alias("b")).select(*keys, (-F.col("b.l")).alias("label"), (F.col("b.s") if largest else -F.col("b.s")).alias("score"))


def label_pairs(centers: DataFrame, label: str) -> DataFrame:
    """Cosines of all pairs of labels, a < b. One row per label on either side."""
    a = centers.select(F.col(label).alias("a"), F.col("centroid").alias("_x"))
    b = centers.select(F.col(label).alias("b"), F.col("centroid").alias("_y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", V.cosine(F.col("_x"), F.col("_y")).alias("cos"))


def profile_health(pairs: DataFrame, persons: DataFrame, few: float = 0.50, many: float = 0.75) -> DataFrame:
    """pairs(label, other, cos) both ways, persons(label, person) -> health by the most alike sibling of the same person.

    One profile: gray. Two: red below ``few``. Three or more: red below ``many``. Else green.
    """
    of = lambda name, who: persons.select(F.col("label").alias(name), F.col("person").alias(who))
    near = pairs.join(of("label", "_p"), "label").join(of("other", "_q"), "other").where(F.col("_p").eqNullSafe(F.col("_q")) & F.col("_p").isNotNull()).groupBy("label").agg(F.max("cos").alias("sibling"))
    size = persons.groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    rows = persons.join(size, "person").join(near, "label", "left")
    health = F.when((F.col("n") < 2) | F.col("sibling").isNull(), "gray").when(F.col("sibling") < F.when(F.col("n") == 2, few).otherwise(many), "red").otherwise("green")
    return rows.select("label", "person", "sibling", health.alias("health"))


def merged_labels(rows: dict[int, tuple[np.ndarray, int]], least: float = MERGE_MIN) -> dict[int, int]:
    """Greedy agglomeration of one job's label -> (centroid, members): the best pair merges, weighted by members, until no pair is alike enough.

    A queue holds each label's best partner among the larger ones, and outdated
    entries are dropped when they come up; after a merge only labels whose partner
    took part look for a new one. n log n steps of one row of cosines each, and no
    more memory than the centroids.
    """
    keys = sorted(rows)
    x, n = np.array([rows[k][0] for k in keys], float).reshape(len(keys), -1), np.array([rows[k][1] for k in keys], float)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    live, version, partner, score = np.ones(len(keys), bool), np.zeros(len(keys), int), np.full(len(keys), -1), np.full(len(keys), -2.0)
    queue: list[tuple[float, int, int, int]] = []

    def put(i: int, j: int, cos: float) -> None:
        partner[i], score[i] = j, cos
        version[i] += 1
        if cos >= least:
            heapq.heappush(queue, (-cos, i, j, int(version[i])))

    def search(i: int) -> None:
        others = i + 1 + np.flatnonzero(live[i + 1 :])
        if len(others):
            c = unit[others] @ unit[i]
            put(i, int(others[c.argmax()]), float(c.max()))
        else:
            put(i, -1, -2.0)

    for i in range(len(keys)):
        search(i)
    into = np.arange(len(keys))
    while queue:
        _, a, b, seen = heapq.heappop(queue)
        if not live[a] or seen != version[a]:
            continue
        live[b], into[b] = False, a
        x[a], n[a] = (x[a] * n[a] + x[b] * n[b]) / (n[a] + n[b]), n[a] + n[b]
        unit[a] = x[a] / max(np.linalg.norm(x[a]), 1e-300)
        search(a)
        before = np.flatnonzero(live[:a])
        c = unit[before] @ unit[a]
        for i, cos in zip(before.tolist(), c.tolist(), strict=True):
            if partner[i] in (a, b) and cos < score[i]:
                search(i)
            elif cos > score[i] or cos == score[i] and a <= partner[i] or partner[i] == b:
                put(i, a, cos)
        for i in (a + 1 + np.flatnonzero(live[a + 1 : b] & (partner[a + 1 : b] == b))).tolist():
            search(i)
    roots = {}
    for i in range(len(keys)):
        roots[i] = i if into[i] == i else roots[int(into[i])]  # a label goes into a smaller one
    order = {r: j for j, r in enumerate(sorted(set(roots.values())))}
    return {k: order[roots[i]] for i, k in enumerate(keys)}


def merge_labels(centers: DataFrame, label: str, least: float = MERGE_MIN, keys: tuple[str, ...] = ()) -> DataFrame:
    """centers(keys, label, centroid, members) -> keys, label, merged: merged_labels() of each job's label table, in a task for each job."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        into = merged_labels({k: (np.array(c), n) for k, c, n in zip(pdf[label], pdf["centroid"], pdf["members"], strict=True)}, least)
        return pdf[[*keys, label]].assign(merged=[into[k] for k in pdf[label]])

    types = {f.name: f.dataType.simpleString() for f in centers.schema.fields}
    grouped = centers.groupBy(*keys) if keys else centers.groupBy(F.lit("all"))
    return grouped.applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), f"{label} {types[label]}", "merged long"]))


def batch_ranges(total: Column, size: int = 4096, overlap: int = 256) -> Column:
    """Ranges of at most size, each overlapping the one before."""
    step = size - overlap
    n = F.when(total <= size, F.lit(1)).otherwise(F.ceil((total - overlap) / step))
    return F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.struct(i.alias("batch"), (i * step).alias("lo"), F.least(i * step + size, total).alias("hi")))


def batched(df: DataFrame, position: str, size: int = 4096, overlap: int = 256) -> DataFrame:
    """df with batch: each row in the batches of batch_ranges() that its position (from 0) lies in, two in an overlap."""
    step = size - overlap
    total = df.agg(F.count(F.lit(1))).scalar()
    last = F.when(total <= size, F.lit(0)).otherwise(F.ceil((total - overlap) / step) - 1)
    lo, hi = F.greatest(F.lit(0), F.floor((F.col(position) - size) / step) + 1), F.least(F.floor(F.col(position) / step), last)
    return df.withColumn("batch", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))


#: Rows of a batch's matrix that are held at a time.
STRIP = 256


def largest(c: np.ndarray, keep: int) -> np.ndarray:
    """Columns of each row's ``keep`` largest entries, falling, ties to the smaller column; NaN is below all."""
    c = np.where(np.isnan(c), -np.inf, c)
    keep = min(keep, c.shape[1])
    least = np.partition(c, c.shape[1] - keep, axis=1)[:, c.shape[1] - keep, None]
    row, column = np.nonzero(c >= least)
    order = np.lexsort((column, -c[row, column], row))
    first = np.searchsorted(row, np.arange(len(c)))
    return column[order][first[:, None] + np.arange(keep)]


def top_edges(df: DataFrame, batch: str, node: str, vector: str, keep: int) -> DataFrame:
    """Affinity edges inside each batch: of every node its ``keep`` most alike, itself included, ties to the smaller node.

    A batch is bounded by its maker (batch_ranges); of its matrix a task holds a strip of rows.
    """

    def run(rows: pa.Table) -> pa.Table:
        ids, x = rows.column(node).to_numpy(), rows.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        dst, w = [], []
        for lo in range(0, len(x), STRIP):
            c = np.round(x[lo : lo + STRIP] @ x.T, 12)
            best = largest(c, keep)
            dst.append(ids[best].ravel())
            w.append(np.take_along_axis(c, best, 1).ravel())
        n = min(keep, len(ids))
        return pa.table({batch: np.full(len(ids) * n, rows.column(batch)[0].as_py(), np.int64), "src": np.repeat(ids, n), "dst": np.concatenate(dst), "w": np.concatenate(w)})

    return df.select(batch, node, vector).groupBy(batch).applyInArrow(run, f"{batch} long, src long, dst long, w double")


#: Numbers of the rows that a task holds, at most so many rows; columns of a product that are rounded at a time, and of a group; tasks a core.
HELD, HELD_ROWS, TILE_COLUMNS, GROUP, TASKS = 1 << 22, 1 << 16, 2048, 256, 3
#: Scale of rounding to twelve digits, and what stands for the cosine of no vector.
DIGITS, NOTHING = 1e12, -1e300


def units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column, and which rows have none; a vector of length 0 is NaN, as are its cosines."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    x = np.zeros((len(column), width))
    x[~missing] = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True), missing


def strip_nearest(q: np.ndarray, q_missing: np.ndarray, r: np.ndarray, r_missing: np.ndarray, keep: int, strip: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and cosines, rounded to twelve digits, of the ``keep`` rows of r most alike to each of q, falling, ties to the smaller column; NaN first, nothing last.

    The largest of each group of columns are looked through, and of the found
    one's group only. strip: room for the cosines, of strip_of(), used again and
    again; tile: columns that are rounded at a time.
    """
    n, keep, rows = len(r), min(keep, len(r)), np.arange(len(q))
    c = strip[: len(q)]
    flat = c.reshape(len(q), -1)
    for lo in range(0, n, tile):
        part = flat[:, lo : min(lo + tile, n)]
        np.matmul(q, r[lo : lo + tile].T, out=part)
        part *= DIGITS
        np.rint(part, out=part)
    flat[:, :n][:, r_missing] = NOTHING
    flat[q_missing, :n] = NOTHING
    top, column, value = c.max(2), np.empty((len(q), keep), np.int64), np.empty((len(q), keep))
    for k in range(keep):
        group = top.argmax(1)
        of = c[rows, group]
        at = of.argmax(1)
        column[:, k], value[:, k] = group * c.shape[2] + at, of[rows, at]
        of[rows, at] = c[rows, group, at] = -np.inf
        top[rows, group] = of.max(1)
    return column, np.where(value == NOTHING, np.nan, value / DIGITS)


def strip_of(size: int, n: int, group: int) -> np.ndarray:
    """Room for the cosines of ``size`` rows to n rows, in groups; the last one's rest is below all."""
    return np.full((size, -(-n // group), group), -np.inf)


def nearest_edges(df: DataFrame, node: str, vector: str, keep: int) -> DataFrame:
    """Affinity edges (src, dst, w) over all rows: of every node its ``keep`` most alike, itself included, ties to the smaller node.

    Every pair is measured. Rows are dealt to parts that a task holds, parts to
    several tasks, and each query goes to one task a part, which takes queries as
    they come; what a query found in each part meets by node. A vector of
    length 0 has NaN cosines, which are first, and a null one null cosines, which are last.
    """
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    width = max(width or 0, 1)
    held = max(1, min(HELD_ROWS, HELD // width))
    parts = max(1, -(-n // held))
    spread = max(1, min(-(-TASKS * df.sparkSession.sparkContext.defaultParallelism // parts), -(-n // 1024)))
    size, group, tile, hashed = STRIP, GROUP, TILE_COLUMNS, F.xxhash64("id")
    own = lambda of: F.pmod(hashed, F.lit(of))
    each = lambda of: F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long"))
    places = F.concat(
        F.transform(each(spread), lambda s: F.struct((own(parts) * spread + s).alias("task"), F.lit(0).alias("asks"))),
        F.transform(each(parts), lambda p: F.struct((p * spread + own(spread)).alias("task"), F.lit(1).alias("asks"))),
    )
    dealt = df.select(F.col(node).cast("long").alias("id"), F.col(vector).alias("x")).select("id", "x", F.explode(places).alias("_to"))
    sorted_rows = dealt.select("_to.task", "_to.asks", "id", "x").repartitionById(parts * spread, F.col("task").cast("int")).sortWithinPartitions("asks", "id").select("asks", "id", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, missing, block = [], [], [], None
        for b in batches:
            first = int(np.searchsorted(b.column(0).to_numpy(), 1))
            if first:
                part = units(b.column(2).slice(0, first), width)
                ids.append(b.column(1).slice(0, first).to_numpy())
                x.append(part[0])
                missing.append(part[1])
            if first == b.num_rows or not ids:
                continue
            if block is None:
                block = np.concatenate(ids), np.concatenate(x), np.concatenate(missing)
                strip = strip_of(size, len(block[0]), group)
                x.clear()
            for lo in range(first, b.num_rows, size):
                of = b.slice(lo, size)
                q, none = units(of.column(2), width)
                column, w = strip_nearest(q, none, block[1], block[2], keep, strip, tile)
                null = none[:, None] | block[2][column]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of.column(1).to_numpy(), column.shape[1])), pa.array(block[0][column].ravel()), pa.array(w.ravel(), mask=null.ravel())], names=["src", "dst", "w"])

    found = sorted_rows.mapInArrow(run, "src long, dst long, w double")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc_nulls_last("w"), "dst"))
    return found if parts == 1 else found.withColumn("_k", rank).where(F.col("_k") <= keep).drop("_k")


def symmetrized(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Half the sum of the graph and its transpose."""
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select(*keys, "src", "dst", "w").unionByName(back).groupBy(*keys, "src", "dst").agg((F.sum("w") / 2).alias("w"))


def laplacian_degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Degree (sum of absolute weights, no diagonal) and number of neighbours in the symmetrised graph."""
    return symmetrized(edges, keys).where("src <> dst").groupBy(*keys, "src").agg(F.sum(F.abs("w")).alias("degree"), F.count(F.lit(1)).alias("neighbours"))


def spmv(edges: DataFrame, keys: list[str], vector: DataFrame) -> DataFrame:
    """Sparse matrix times vector(keys, node, x)."""
    v = vector.select(*keys, F.col("node").alias("dst"), "x")
    return edges.join(v, [*keys, "dst"]).groupBy(*keys, "src").agg(F.sum(F.col("w") * F.col("x")).alias("y"))


#: The first number of the sequence that k-means draws from, its factor and its step.
CONGRUENTIAL = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407


def seeded_kmeans(x: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """k-means whose first centre is row 0 and whose others are drawn, by squared distance, from a fixed 64-bit congruential sequence."""
    state, centers = CONGRUENTIAL[0], [x[0]]
    while len(centers) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centers], axis=0)
        state = (state * CONGRUENTIAL[1] + CONGRUENTIAL[2]) % (1 << 64)
        centers.append(x[min(int(np.searchsorted(np.cumsum(d), (state >> 11) / (1 << 53) * d.sum(), "right")), len(x) - 1)])
    c = np.stack(centers)
    label = np.full(len(x), -1)
    for _ in range(rounds):
        now = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if (now == label).all():
            break
        label = now
        c = np.stack([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
    return label


def speakers_of(values: np.ndarray, least: int = 2, most: int = 8) -> int:
    """Number of clusters: the first largest gap between ascending eigenvalues, from ``least`` on."""
    gaps = np.diff(values[least - 1 : most + 1])
    return least + int(gaps.argmax()) if len(gaps) else least


#: Eigenvalues below count as zero.
NEAR_ZERO = 1e-5
#: Larger matrices are solved for their smallest eigenvalues only. Rows solved at a time, blocks of the basis, restarts; shift and residual as parts of the spectrum's bound.
DENSE, TILE, BLOCKS, RESTARTS, SHIFT, RESIDUAL = 512, 256, 24, 10, 1e-4, 1e-11


def solver(a: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """x of a x = b, for a positive definite matrix: a Cholesky factor, gone through forwards and backwards by tiles."""
    c = np.linalg.cholesky(a)
    tiles = [(lo, min(lo + TILE, len(c))) for lo in range(0, len(c), TILE)]
    inverse = [np.linalg.inv(c[lo:hi, lo:hi]) for lo, hi in tiles]

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for (lo, hi), t in zip(tiles, inverse, strict=True):
            x[lo:hi] = t @ (x[lo:hi] - c[lo:hi, :lo] @ x[:lo])
        for (lo, hi), t in zip(reversed(tiles), reversed(inverse), strict=True):
            x[lo:hi] = t.T @ (x[lo:hi] - c[hi:, lo:hi].T @ x[hi:])
        return x

    return solve


def smallest_eigenpairs(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` smallest eigenvalues, rising, and their unit eigenvectors, of a symmetric matrix without negative eigenvalues.

    Block Lanczos on the inverse of the shifted matrix: a third of n^3 steps for
    its factor instead of some ten n^3 for all eigenvectors. A small matrix, and one
    that doesn't converge, is solved whole.
    """
    n, bound = len(a), 2 * float(np.max(np.diagonal(a), initial=0))
    if n > max(DENSE, 4 * BLOCKS * count // 3) and np.isfinite(bound) and bound > 0:
        try:
            solve = solver(a + bound * SHIFT * np.eye(n))
            x = np.linalg.qr(np.random.default_rng(0).normal(size=(n, count)))[0]
            for _ in range(RESTARTS):
                basis = x
                for _ in range(BLOCKS):
                    x = solve(x)
                    for _ in range(2):  # once leaves a part of the basis
                        x = np.linalg.qr(x - basis @ (basis.T @ x))[0]
                    basis = np.hstack([basis, x])
                values, turn = np.linalg.eigh(basis.T @ (a @ basis))
                values, x = values[:count], basis @ turn[:, :count]
                if np.abs(a @ x - x * values).max() <= RESIDUAL * bound:
                    return values, x
        except np.linalg.LinAlgError:
            pass
    values, vectors = np.linalg.eigh(a)
    return values[:count], vectors[:, :count]


def spectral(a: np.ndarray, x: np.ndarray | None, least: int = 2, most: int = 8, forced: int | None = None) -> np.ndarray:
    """Labels of the nodes of one affinity matrix from its Laplacian's smallest eigenvectors, renumbered by first node.

    forced: this many clusters, as far as there are eigenvectors for them. Where
    the solver fails, or more than ``most`` eigenvalues are zero and tell nothing,
    the vectors x themselves are clustered: into 3, or 2 of fewer than 4.
    """
    n = len(a)
    if n <= 1 or n <= least and not forced:
        return np.zeros(n, int)
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0)
    try:
        values, vectors = smallest_eigenpairs(np.diag(np.abs(a).sum(1)) - a, min(most + 4, n))
    except np.linalg.LinAlgError:
        values, vectors = np.zeros(min(most + 4, n)), None
    if x is not None and (vectors is None or (np.abs(values) < NEAR_ZERO).sum() > most):
        label = seeded_kmeans(x, 3 if n >= 4 else 2)
    elif vectors is None:
        label = np.zeros(n, int)
    else:
        k = min(max(1, forced), len(values), most) if forced else speakers_of(values, least, min(most, n - 1))
        label = seeded_kmeans(vectors[:, :k], k)
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def spectral_labels(edges: DataFrame, batch: str, least: int = 2, most: int = 8, rows: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """Labels of each batch's nodes: spectral(). rows (a table with the batch, its node and vector columns) are what the fallback clusters."""

    def labels(key: object, pdf: pd.DataFrame, x: pd.DataFrame | None) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        a = np.zeros((len(ids), len(ids)))
        a[np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])] = pdf["w"]
        vectors = None if x is None else np.array(x.set_index("_n")["_v"].loc[ids].tolist(), float)
        return pd.DataFrame({batch: key, "node": ids, "label": spectral(a, vectors, least, most)})

    schema = f"{batch} long, node long, label int"
    if rows is None:
        return edges.groupBy(batch).applyInPandas(lambda pdf: labels(pdf[batch].iloc[0], pdf, None), schema)
    df, node, vector = rows
    of = df.select(F.col(batch).alias("_b"), F.col(node).alias("_n"), F.col(vector).alias("_v"))
    return edges.groupBy(batch).cogroup(of.groupBy("_b")).applyInPandas(lambda key, pdf, x: labels(key[0], pdf, x), schema)


def block_topk(queries: DataFrame, rows: DataFrame, node: str, vector: str, k: int, size: int = 2048) -> DataFrame:
    """The k most alike rows of every query (its own id left out), ties to the smaller id.

    Both sides are packed into blocks; query blocks are dealt to every row block
    by a join on the block's group, and a pair of blocks is one matrix product.
    """

    def packed(prefix: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, size):
                    part = b.slice(lo, size)
                    x = np.array(part.column("x").to_pylist(), float)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=[f"{prefix}_ids", f"{prefix}_x"])

        return run

    take = lambda d: d.where(F.col(vector).isNotNull()).select(F.col(node).alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    index = take(rows).mapInArrow(packed("r"), "r_ids binary, r_x binary")
    groups = max(1, rows.count() // size + 1)
    index = index.withColumn("g", F.pmod(F.xxhash64("r_ids"), F.lit(groups)))
    dealt = take(queries).mapInArrow(packed("q"), "q_ids binary, q_x binary").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q_x, r_ids, r_x in zip(*(b.column(c).to_pylist() for c in ("q_ids", "q_x", "r_ids", "r_x")), strict=True):
                q, r = np.frombuffer(q_ids, np.int64), np.frombuffer(r_ids, np.int64)
                c = np.round(np.frombuffer(q_x).reshape(len(q), -1) @ np.frombuffer(r_x).reshape(len(r), -1).T, 9)
                c[q[:, None] == r[None]] = -3
                order = np.lexsort((np.broadcast_to(r, c.shape), -c), axis=1)[:, :k]
                out = pd.DataFrame({"query": np.repeat(q, order.shape[1]), "neighbour": r[order.ravel()], "cos": np.take_along_axis(c, order, 1).ravel()})
                yield pa.RecordBatch.from_pandas(out[out["cos"] > -3], preserve_index=False)

    found = index.join(dealt, "g").select("q_ids", "q_x", "r_ids", "r_x").mapInArrow(scan, "query long, neighbour long, cos double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cos"), "neighbour")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
