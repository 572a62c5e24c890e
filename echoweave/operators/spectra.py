"""The smallest eigenvalues of a graph's Laplacian, and k-means, over tables of any size.

Neither holds a matrix or all rows anywhere. Nodes are dealt to parts of a fixed
size; a sparse matrix is a table of packed blocks, one for two parts that share
an edge, and some vectors are a table with a packed row a part. In a sparse
product blocks meet parts, and sums meet by part. What reaches the driver is as
wide as the basis, not as long as the table: inner products and centres. A graph
that one part holds is solved in that part's task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .catalog import positioned
from .stages import materialized
from .vectors import CONGRUENTIAL, NEAR_ZERO, laplacian_degrees, speakers_of, symmetrized

#: Products of the filter, blocks of the basis, restarts, and the residual to reach as a part of the spectrum's bound; an eigenvalue's error is about its square.
DEGREE, BLOCKS, RESTARTS, TOLERANCE = 24, 5, 30, 1e-6
#: Nodes of a part; nodes that stay in one part, and entries of it that its task solves whole.
PART_NODES, WHOLE_NODES, WHOLE_ENTRIES = 1 << 14, 1 << 17, 1 << 23
KMEANS_ROUNDS = 30


class Spectrum(NamedTuple):
    """Eigenvalues, rising; vectors(node, v array<double>), the node's entries in their unit eigenvectors; the largest residual norm."""

    values: np.ndarray
    vectors: DataFrame
    residual: float


class Blocked(NamedTuple):
    """A symmetric matrix in blocks(i, j, rows, cols, w), packed, over nodes that place(node, part, at) numbers in so many parts; its size, largest diagonal entry and number of entries."""

    blocks: DataFrame
    place: DataFrame
    parts: int
    n: int
    most: float
    entries: int


def laplacian(edges: DataFrame) -> DataFrame:
    """Entries (src, dst, w) of degree less weight of the symmetrised graph; every node has its diagonal one."""
    off = symmetrized(edges, []).where("src <> dst").select("src", "dst", (-F.col("w")).alias("w"))
    nodes = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct()
    degrees = nodes.join(laplacian_degrees(edges, []), "src", "left").select("src", F.col("src").alias("dst"), F.coalesce("degree", F.lit(0.0)).alias("w"))
    return off.unionByName(degrees)


def blocked(entries: DataFrame, part_nodes: int | None) -> Blocked:
    """entries(src, dst, w), each diagonal one among them, dealt to parts by order: nodes of near numbers share a part, and so may their edges. part_nodes: None for one part of up to WHOLE_NODES, or parts of PART_NODES."""
    entries = materialized(entries)
    loop = F.col("src") == F.col("dst")
    n, most, size = entries.agg(F.count_if(loop), F.max(F.when(loop, F.col("w"))), F.count(F.lit(1))).first()
    share = part_nodes or (WHOLE_NODES if n <= WHOLE_NODES else PART_NODES)
    pos = F.col("pos") - 1
    place = positioned(entries.where(loop).select(F.col("src").alias("node")), [F.col("node")])
    place = materialized(place.select("node", F.floor(pos / share).cast("int").alias("part"), (pos % share).cast("int").alias("at")))

    def pack(rows: pa.Table) -> pa.Table:
        r, c, w = (rows.column(k).to_numpy() for k in ("r", "c", "w"))
        order = np.lexsort((c, r))
        data = {"rows": r[order].astype(np.uint32), "cols": c[order].astype(np.uint32), "w": w[order]}
        return pa.table({"i": rows.column("i").slice(0, 1), "j": rows.column("j").slice(0, 1)} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in data.items()})

    side = lambda node, p, a: place.select(F.col("node").alias(node), F.col("part").alias(p), F.col("at").alias(a))
    entries = entries.join(side("src", "i", "r"), "src").join(side("dst", "j", "c"), "dst").select("i", "j", "r", "c", "w")
    return Blocked(materialized(entries.groupBy("i", "j").applyInArrow(pack, "i int, j int, rows binary, cols binary, w binary")), place, -(-n // share) or 1, n, most or 0.0, size)


def matrix_of(data: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(data.as_py(), np.float64).reshape(-1, width)


def packed(**columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k in ("part", "i") else pa.binary()) for k, v in columns.items()], names=list(columns))


def multiplied(r: np.ndarray, c: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block, sorted by rows, that have entries, and what it gives there times x; a column at a time."""
    new = np.append(True, r[1:] != r[:-1])
    rows, at, c = r[new], np.cumsum(new) - 1, c.astype(np.intp)
    return rows, np.stack([np.bincount(at, w * v[c], len(rows)) for v in np.ascontiguousarray(x.T)], 1)


def step_of(m: Blocked, state: DataFrame, width: int, scale: float = 1.0, shift: float = 0.0, less: float = 0.0) -> DataFrame:
    """state(part, cur, prev) -> (part, cur, prev): scale * (matrix - shift) times cur less ``less`` times prev, and the cur before.

    A block meets the part of its columns; a part's diagonal block brings its own rows along, so that the state is read once.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, rows, cols, w, cur, prev in zip(*b.columns, strict=True):
                i, j = i.as_py(), j.as_py()
                r, c = (np.frombuffer(x.as_py(), np.uint32) for x in (rows, cols))
                w = (np.frombuffer(w.as_py(), np.float64) - shift * ((i == j) & (r == c))) * scale
                rows, sums = multiplied(r, c, w, matrix_of(cur, width))
                yield packed(i=[i], rows=[rows.tobytes()], sums=[sums.tobytes()], cur=[cur.as_py() if i == j else None], prev=[prev.as_py() if i == j else None])

    def merge(rows: pa.Table) -> pa.Table:
        own = next(k for k, x in enumerate(rows.column("cur")) if x.is_valid)
        cur, prev = rows.column("cur")[own], rows.column("prev")[own]
        total = np.zeros_like(matrix_of(cur, width)) if not less else -less * matrix_of(prev, width)
        for r, sums in zip(rows.column("rows"), rows.column("sums"), strict=True):
            total[np.frombuffer(r.as_py(), np.uint32)] += matrix_of(sums, width)
        return pa.Table.from_batches([packed(part=[rows.column("i")[0].as_py()], cur=[total.tobytes()], prev=[cur.as_py()])])

    met = m.blocks.join(state.select(F.col("part").alias("j"), "cur", "prev"), "j").select("i", "j", "rows", "cols", "w", "cur", "prev")
    return met.mapInArrow(partial, "i int, rows binary, sums binary, cur binary, prev binary").groupBy("i").applyInArrow(merge, "part int, cur binary, prev binary")


def filtered(m: Blocked, block: DataFrame, width: int, low: float, high: float, degree: int) -> DataFrame:
    """A Chebyshev polynomial of the matrix times block(part, x): at most 1 on [low, high], growing fast below.

    One job, whatever the degree, of a shuffle a product: a task holds a part's
    blocks by columns, and what they give meets at the part of their rows. A
    matrix of one part needs no other and is multiplied on in its task.
    """
    middle, half = (high + low) / 2, (high - low) / 2
    if m.parts == 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, rows, cols, w, x in zip(*b.columns, strict=True):
                    r, c = (np.frombuffer(v.as_py(), np.uint32) for v in (rows, cols))
                    w = (np.frombuffer(w.as_py(), np.float64) - middle * (r == c)) / half
                    cur = prev = matrix_of(x, width)
                    for k in range(degree):
                        total = np.zeros_like(cur)
                        at, sums = multiplied(r, c, w, cur)
                        total[at] = sums
                        cur, prev = 2 * total - prev if k else total, cur
                    yield packed(part=[part.as_py()], x=[np.ascontiguousarray(cur).tobytes()])

        met = m.blocks.join(block.select(F.col("part").alias("j"), "x"), "j")
        return met.select(F.col("i").alias("part"), "rows", "cols", "w", "x").mapInArrow(run, "part int, x binary")
    parts = m.parts

    def unpacked(r: Row) -> tuple:
        i, j, (rows, cols) = r.i, r.j, (np.frombuffer(v, np.uint32) for v in (r.rows, r.cols))
        return j, (i, rows, cols, (np.frombuffer(r.w, np.float64) - middle * ((i == j) & (rows == cols))) / half)

    def first(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, x in rows:
            yield x, np.zeros_like(x)

    def partial(met: tuple, scale: int) -> Iterator[tuple]:
        blocks, (cur, prev) = met
        for j, (i, rows, cols, w) in blocks:
            at, sums = multiplied(rows, cols, w, cur)
            sums *= scale
            yield i, (at, sums, (cur, prev) if i == j else None)

    def merged(rows: Iterator[tuple], goes_on: bool) -> Iterator[tuple]:
        rows = [x for _, x in rows]
        cur, prev = next(own for _, _, own in rows if own)
        total = -prev if goes_on else np.zeros_like(cur)
        for at, sums, _ in rows:
            total[at] += sums
        yield total, cur

    # an element a partition on either side: the part's blocks, and its rows of the vectors
    blocks = m.blocks.rdd.map(unpacked).partitionBy(parts, int).mapPartitions(lambda rows: [list(rows)])
    state = block.select("part", "x").rdd.map(lambda r: (r.part, np.frombuffer(r.x, np.float64).reshape(-1, width))).partitionBy(parts, int).mapPartitions(first)
    for k in range(degree):
        sums = blocks.zip(state).flatMap(lambda met, scale=2 if k else 1: partial(met, scale))
        state = sums.partitionBy(parts, int).mapPartitions(lambda rows, goes_on=k > 0: merged(rows, goes_on))
    out = state.mapPartitionsWithIndex(lambda part, rows: ((part, bytearray(np.ascontiguousarray(x).tobytes())) for x, _ in rows))
    return block.sparkSession.createDataFrame(out, "part int, x binary", verifySchema=False)


def products(df: DataFrame, widths: tuple[int, int], less: np.ndarray | None = None) -> np.ndarray:
    """Inner products of the columns of [q x] with those of x, of df(part, q, x); less: q times this comes off x first."""
    a, b = widths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((a + b, b))
        for batch in batches:
            for q, x in zip(*batch.columns, strict=True):
                q, x = matrix_of(q, a) if a else np.zeros((len(matrix_of(x, b)), 0)), matrix_of(x, b)
                x = x if less is None else x - q @ less
                total += np.concatenate([q, x], 1).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(a + b), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    sums = df.select("q", "x").mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((a + b, b))
    for r in sums:
        out[r.i, r.j] = r.x
    return out


def changed(df: DataFrame, of: Callable[..., dict[str, np.ndarray]], widths: dict[str, int], names: Sequence[str]) -> DataFrame:
    """df(part, packed columns) -> part and the named columns that ``of`` the matrices gives."""
    columns = list(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, *data in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
                rows = len(data[0].as_py()) // (8 * widths[columns[0]])
                new = of(**{c: matrix_of(x, widths[c]) if widths[c] else np.zeros((rows, 0)) for c, x in zip(columns, data, strict=True)})
                yield packed(part=[part], **{n: [np.ascontiguousarray(new[n]).tobytes()] for n in names})

    return df.select("part", *columns).mapInArrow(run, "part int, " + ", ".join(f"{n} binary" for n in names))


class Spread:
    """Vectors of a run as a table with a packed row a part: state(part, q, x), of a basis and the block that is to join it."""

    def __init__(self, m: Blocked) -> None:
        self.m = m

    def start(self, width: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield packed(part=[part], x=[np.random.default_rng(part).uniform(-1, 1, (rows, width)).tobytes()])

        return self.m.place.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).mapInArrow(run, "part int, x binary")

    def state(self, block: DataFrame) -> DataFrame:
        return materialized(block.select("part", F.lit(b"").alias("q"), "x"))

    def filtered(self, state: DataFrame, width: int, low: float, high: float, degree: int) -> DataFrame:
        image = filtered(self.m, state.select("part", "x"), width, low, high, degree)
        return materialized(state.select("part", "q").join(image, "part"))

    def image(self, state: DataFrame, size: int) -> DataFrame:
        """x is the matrix times q."""
        return materialized(step_of(self.m, state.select("part", F.col("q").alias("cur"), F.col("q").alias("prev")), size).select("part", F.col("cur").alias("x"), F.col("prev").alias("q")))

    def products(self, state: DataFrame, widths: tuple[int, int], less: np.ndarray | None = None) -> np.ndarray:
        return products(state, widths, less)

    def squared(self, state: DataFrame, size: int) -> np.ndarray:
        return products(state.select("q", F.col("q").alias("x")), (0, size))

    def changed(self, state: DataFrame, of: Callable[..., dict[str, np.ndarray]], widths: dict[str, int], names: Sequence[str]) -> DataFrame:
        return changed(state, of, widths, names)

    def kept(self, block: DataFrame) -> DataFrame:
        return materialized(block)


class Whole:
    """The same over a matrix of one part in its task: a state has the matrices q and x."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, w: np.ndarray, n: int) -> None:
        self.rows, self.cols, self.w, self.n = rows.astype(np.intp), cols.astype(np.intp), w, n

    def times(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.rows, w * v[self.cols], self.n) for v in np.ascontiguousarray(x.T)], 1)

    def start(self, width: int) -> dict[str, np.ndarray]:
        return {"x": np.random.default_rng(0).uniform(-1, 1, (self.n, width))}

    def state(self, block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return block | {"q": np.zeros((self.n, 0))}

    def filtered(self, state: dict[str, np.ndarray], width: int, low: float, high: float, degree: int) -> dict[str, np.ndarray]:
        middle, half = (high + low) / 2, (high - low) / 2
        w = (self.w - middle * (self.rows == self.cols)) / half
        cur = prev = state["x"]
        for k in range(degree):
            total = self.times(cur, w)
            cur, prev = 2 * total - prev if k else total, cur
        return state | {"x": cur}

    def image(self, state: dict[str, np.ndarray], size: int) -> dict[str, np.ndarray]:
        return state | {"x": self.times(state["q"], self.w)}

    def products(self, state: dict[str, np.ndarray], widths: tuple[int, int], less: np.ndarray | None = None) -> np.ndarray:
        q, x = state["q"][:, : widths[0]], state["x"]
        x = x if less is None else x - q @ less
        return np.concatenate([q, x], 1).T @ x

    def squared(self, state: dict[str, np.ndarray], size: int) -> np.ndarray:
        return state["q"].T @ state["q"]

    def changed(self, state: dict[str, np.ndarray], of: Callable[..., dict[str, np.ndarray]], widths: dict[str, int], names: Sequence[str]) -> dict[str, np.ndarray]:
        new = of(**{c: state[c] for c in widths})
        return {n: new[n] for n in names}

    def kept(self, block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return block


def lanczos(space: Spread | Whole, n: int, k: int, width: int, high: float, degree: int, blocks: int, restarts: int, tolerance: float) -> tuple[np.ndarray, DataFrame | dict[str, np.ndarray], float]:
    """The smallest eigenvalues of a matrix of n rows, rising, the block of their vectors, and the largest residual norm of the first k."""
    low = high / 8
    block = space.start(width)
    for _ in range(restarts):
        size, fresh = 0, width  # columns of the basis, and of the block that is to join it
        state = space.state(block)
        for step in range(blocks):
            if step:
                state = space.filtered(state, fresh, low, high, degree)
            g = space.products(state, (size, fresh))
            less = g[:size]
            g = space.products(state, (size, fresh), less)
            less, rest = less + g[:size], g[size:] - g[:size].T @ g[:size]
            scale, turn = np.linalg.eigh((rest + rest.T) / 2)
            kept = scale > max(scale.max(), 1e-300) * 1e-20 if step == 0 else scale > 1e-24
            if not kept.any():
                break
            turn = turn[:, kept] / np.sqrt(scale[kept])

            def joined(x: np.ndarray, q: np.ndarray, less: np.ndarray = less, turn: np.ndarray = turn) -> dict:
                new = (x - q @ less) @ turn
                return {"q": np.concatenate([q, new], 1), "x": new}

            state = space.changed(state, joined, {"x": fresh, "q": size}, ["q", "x"])
            size, fresh = size + int(kept.sum()), int(kept.sum())
            if size + width > n:
                break
        # the best vectors of the basis, by the matrix itself; of vectors that are unit up to rounding
        image = space.image(state, size)
        h = space.products(image, (size, size))[:size]
        g = space.squared(image, size)
        root = np.linalg.inv(np.linalg.cholesky((g + g.T) / 2)).T
        values, turn = np.linalg.eigh(root.T @ ((h + h.T) / 2) @ root)
        best = min(width, size)
        turn = (root @ turn)[:, :best]
        off = space.products(space.changed(image, lambda x, q: {"q": q[:, :0], "x": x @ turn - q @ turn * values[:best]}, {"x": size, "q": size}, ["q", "x"]), (0, best))  # noqa: B023  used at once
        block = space.kept(space.changed(image, lambda q: {"x": q @ turn}, {"q": size}, ["x"]))  # noqa: B023
        residual = float(np.sqrt(np.diag(off)[:k].clip(0)).max())
        if residual <= tolerance * high or best == n:
            break
        low = min(max(float(values[best - 1]), high * 1e-6), high / 2)
    return values[:best], block, residual


def smallest_eigenpairs(edges: DataFrame, k: int, degree: int = DEGREE, blocks: int = BLOCKS, restarts: int = RESTARTS, tolerance: float = TOLERANCE, part_nodes: int | None = None) -> Spectrum:
    """The k smallest eigenvalues of the Laplacian of edges(src, dst, w), which is symmetrised, and their vectors.

    Block Lanczos on a polynomial of the Laplacian that favours its low end, with
    full reorthogonalisation (twice) and restarts from the best vectors. A block
    finds eigenvalues that repeat, as of unconnected parts. A graph of one part
    and bounded entries is one task's work, so that the driver starts no job a
    step; of a larger one a step is a checkpoint of the basis and two passes of
    inner products. Fewer nodes than k: as many as there are; no edges: none.
    """
    m = blocked(laplacian(materialized(edges)), part_nodes)
    kind = edges.schema["src"].dataType.simpleString()
    if not m.n:
        return Spectrum(np.zeros(0), edges.sparkSession.createDataFrame([], f"node {kind}, v array<double>"), 0.0)
    n, k, width, high = m.n, min(k, m.n), min(k + 4, m.n), 2 * max(m.most, 1e-300)
    if m.parts == 1 and m.entries <= WHOLE_ENTRIES:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, rows, cols, w in zip(*b.columns, strict=True):
                    r, c = (np.frombuffer(v.as_py(), np.uint32) for v in (rows, cols))
                    values, block, residual = lanczos(Whole(r, c, np.frombuffer(w.as_py()), n), n, k, width, high, degree, blocks, restarts, tolerance)
                    x = pa.array([np.ascontiguousarray(block["x"]).tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), x, pa.array([values], pa.list_(pa.float64())), pa.array([residual])], names=["part", "x", "values", "residual"])

        block = materialized(m.blocks.select("i", "rows", "cols", "w").mapInArrow(run, "part int, x binary, values array<double>, residual double"))
        found = block.select("values", "residual").first()
        values, residual, block = np.array(found["values"]), found.residual, block.select("part", "x")
    else:
        values, block, residual = lanczos(Spread(m), n, k, width, high, degree, blocks, restarts, tolerance)
    best = len(values)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = matrix_of(x, best)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), part, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(list(v), pa.list_(pa.float64()))], names=["part", "at", "v"])

    return Spectrum(values[:k], m.place.join(block.mapInArrow(rows_of, "part int, at int, v array<double>"), ["part", "at"]).select("node", "v"), residual)


def speaker_count(values: np.ndarray, least: int = 2, most: int = 8) -> int:
    """Number of clusters: after the first largest gap of rising eigenvalues, from ``least`` on; fewer where there aren't as many."""
    return speakers_of(values, min(least, max(1, len(values) - 1)), min(most, max(1, len(values) - 1)))


def degenerate(values: np.ndarray, most: int = 8) -> bool:
    """Are so many eigenvalues zero that they tell nothing: the graph falls into more parts than ``most``."""
    return int((np.abs(values) < NEAR_ZERO).sum()) > most


def kmeans(df: DataFrame, node: str, vector: str, k: int, rounds: int = KMEANS_ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(node, label from 0; the centres): whole k-means as rounds over the table.

    Seeded as operators.vectors.seeded_kmeans(): the first centre is the first
    row in the order of nodes, the others are drawn by squared distance from its
    sequence. A draw sums the distances of each sorted range and then looks for
    the row in one range; a round sums each label's vectors in the tasks. Ends
    when no label changes. Null vectors have no row; fewer rows than k: as many
    labels as rows.
    """
    kind = df.schema[node].dataType.simpleString()
    ranged = df.where(F.col(vector).isNotNull()).select(F.col(node).alias("node"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = materialized(ranged.orderBy("node").withColumn("part", F.spark_partition_id()))
    total = rows.count()
    if not total:
        return rows.select(F.col("node").alias(node), F.lit(0).alias("label")), np.zeros((0, 0))

    def matrix(column: pa.ListArray) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((x[:, None] - centres[None]) ** 2).sum(2)

    def part_sums(centres: np.ndarray) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest(matrix(b.column(1)), centres).min(1))], names=["part", "d"])

        return sorted(rows.select("part", "v").mapInArrow(run, "part int, d double").groupBy("part").agg(F.sum("d").alias("d")).collect())  # a row a range

    def row_at(centres: np.ndarray, part: int, target: float) -> list[float]:
        """The first row of a range at which the sum of distances passes the target; else its last."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passed, last = 0.0, None
            for b in batches:
                sums = passed + np.cumsum(nearest(matrix(b.column(0)), centres).min(1))
                at = int(np.searchsorted(sums, target, "right"))
                if len(sums):
                    last, passed = b.slice(min(at, len(sums) - 1), 1), sums[-1]
                if at < len(sums):
                    break
            if last is not None:
                yield last

        return rows.where(F.col("part") == part).select("v").mapInArrow(run, "v array<double>").first().v

    centres, state = np.array([rows.orderBy("node").first().v]), CONGRUENTIAL[0]
    while len(centres) < min(k, total):
        sums = part_sums(centres)
        state = (state * CONGRUENTIAL[1] + CONGRUENTIAL[2]) % (1 << 64)
        target = (state >> 11) / (1 << 53) * sum(s.d for s in sums)
        for s in sums:
            if target < s.d or s is sums[-1]:
                break
            target -= s.d
        centres = np.concatenate([centres, [row_at(centres, s.part, target)]])

    def moved(now: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, int]:
        """Centres after a round, and how many labels it changed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts, changed = np.zeros(now.shape), np.zeros(len(now)), 0
            for b in batches:
                x = matrix(b.column(0))
                label = nearest(x, now).argmin(1)
                np.add.at(sums, label, x)
                counts += np.bincount(label, minlength=len(now))
                changed += len(x) if before is None else int((nearest(x, before).argmin(1) != label).sum())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(now) + 1), pa.int32()), pa.array([*counts, float(changed)]), pa.array([*sums, np.zeros(now.shape[1])], pa.list_(pa.float64()))], names=["label", "n", "s"])

        parts = rows.select("v").mapInArrow(run, "label int, n double, s array<double>").select("label", "n", F.posexplode("s").alias("d", "x"))
        found = parts.groupBy("label", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        new, changed = now.copy(), 0
        for r in found:
            if r.label == len(now):
                changed = int(r.n)
            elif r.n:
                new[r.label, r.d] = r.x / r.n
        return new, changed

    before = None
    for _ in range(rounds):
        new, changed = moved(centres, before)
        if not changed:
            break
        before, centres = centres, new
    final = centres if before is None or not changed else before  # the labels of the last round

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest(matrix(b.column(1)), final).argmin(1), pa.int32())], names=[node, "label"])

    return rows.select("node", "v").mapInArrow(label, f"{node} {kind}, label int"), centres
