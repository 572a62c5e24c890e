"""Spectrum, k-means, greedy merging and repair against dense solvers and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoweave.operators import clustering, repair, spectra
from echoweave.operators import vectors as X
from echoweave.plans import clusters

from .conftest import SF

EDGES = "src long, dst long, w double"


def dense(edges):
    ids = sorted({e[0] for e in edges} | {e[1] for e in edges})
    at = {v: i for i, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for s, d, w in edges:
        a[at[s], at[d]] += w
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0)
    return ids, np.diag(np.abs(a).sum(1)) - a


def graph(rng, sizes, links=4, low=0.0):
    """Unconnected random parts, with loops; low: the least weight of a link."""
    edges, base = {}, 0
    for n in sizes:
        for i in range(n):
            edges[base + i, base + (i + 1) % n] = float(rng.uniform(0.2, 1))
            for j in rng.integers(0, n, links):
                edges[base + i, base + int(j)] = float(rng.uniform(low, 1))
        base += n
    return [(s, d, w) for (s, d), w in edges.items()]


@pytest.mark.parametrize("sizes,low", [((90,), -0.1), ((40, 30, 5, 25), 0.0)])
def test_smallest_eigenvalues_equal_a_dense_solver(spark, sizes, low):
    edges = graph(np.random.default_rng(1), sizes, low=low)
    ids, laplacian = dense(edges)
    found = spectra.smallest_eigenpairs(spark.createDataFrame(edges, EDGES).repartition(3), 6, part_nodes=30)
    assert np.abs(found.values - np.linalg.eigvalsh(laplacian)[:6]).max() < 1e-8
    v = np.array([r.v for r in found.vectors.orderBy("node").collect()])
    assert np.abs(v.T @ v - np.eye(6)).max() < 1e-8 and np.linalg.norm(laplacian @ v - v * found.values, axis=0).max() < 1e-3
    assert low < 0 or (found.values < 1e-8).sum() == len(sizes)  # zero repeats once a part


def test_spectrum_of_few_nodes_and_of_none(spark):
    edges = [(1, 2, 1.0), (2, 3, 0.5), (7, 7, 2.0)]  # a node with a loop alone is a part of its own
    found = spectra.smallest_eigenpairs(spark.createDataFrame(edges, EDGES), 9)
    assert np.allclose(found.values, np.linalg.eigvalsh(dense(edges)[1]), atol=1e-9) and len(found.values) == 4
    none = spectra.smallest_eigenpairs(spark.createDataFrame([], EDGES), 3)
    assert len(none.values) == 0 and none.vectors.count() == 0


def test_number_of_clusters_and_degenerate_graphs():
    assert spectra.speaker_count(np.array([0, 0.01, 0.02, 0.9, 1.0])) == 3
    assert spectra.speaker_count(np.array([0, 0.5])) == 1 and spectra.speaker_count(np.array([0.0])) == 1
    assert spectra.degenerate(np.zeros(9)) and not spectra.degenerate(np.array([0.0] * 8 + [1.0]))


def test_spectrum_query(spark):
    rows = clusters.laplacian_spectrum(spark, SF).orderBy("pos").collect()
    edges = clusters.edges(spark, SF).groupBy("src", "dst").agg(F.max("w").alias("w")).collect()
    want = np.linalg.eigvalsh(dense([tuple(e) for e in edges])[1])[:12]
    assert np.allclose([r.value for r in rows], want, atol=1e-6) and {r.clusters for r in rows} == {spectra.speaker_count(want)}


@pytest.mark.parametrize("k", [1, 3, 7])
def test_kmeans_equals_a_plain_run(spark, k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(c, 1.0, (60, 4)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(999, None)], "id long, v array<double>").repartition(5)
    labels, centres = spectra.kmeans(df, "id", "v", k)
    want = X.seeded_kmeans(x, k)
    assert [r.label for r in labels.orderBy("id").collect()] == want.tolist()
    assert np.allclose(centres, [x[want == j].mean(0) for j in range(k)])


def test_kmeans_edges(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [5.0])], "id long, v array<double>")
    assert len({r.label for r in spectra.kmeans(df, "id", "v", 5)[0].collect()}) == 2
    assert spectra.kmeans(df.where("false"), "id", "v", 3)[0].count() == 0


def test_degenerate_batches_are_clustered_by_their_vectors(spark):
    """A batch of ten parts, of which the spectrum tells nothing, and a batch of one."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (10, 3)) for c in ((9, 0, 0), (0, 9, 0), (0, 0, 9))])
    edges = [(0, i, i, 1.0) for i in range(30)] + [(1, i, j, 1.0) for i in range(30) for j in range(30) if i // 10 == j // 10] + [(1, 9, 10, 0.1), (1, 19, 20, 0.1)]
    rows = spark.createDataFrame([(b, i, v) for b in (0, 1) for i, v in enumerate(x.tolist())], "batch long, n long, v array<double>")
    labels = X.spectral_labels(spark.createDataFrame(edges, f"batch long, {EDGES}"), "batch", rows=(rows, "n", "v")).orderBy("batch", "node").collect()
    assert [r.label for r in labels if r.batch == 0] == [i // 10 for i in range(30)]
    assert [r.label for r in labels if r.batch == 1] == [i // 10 for i in range(30)]


# -- greedy merging ---------------------------------------------------------------------------------------------


def brute_merge(rows, least):
    rows, into = dict(rows), {k: k for k in rows}
    while len(rows) > 1:
        keys = sorted(rows)
        m = np.stack([rows[k][0] / np.linalg.norm(rows[k][0]) for k in keys])
        c = np.where(np.triu(np.ones((len(keys), len(keys)), bool), 1), m @ m.T, -2.0)
        i, j = np.unravel_index(c.argmax(), c.shape)
        if c[i, j] < least:
            break
        a, b = keys[i], keys[j]
        (x, n), (y, k) = rows[a], rows.pop(b)
        rows[a] = ((x * n + y * k) / (n + k), n + k)
        into = {key: a if to == b else to for key, to in into.items()}
    order = {v: i for i, v in enumerate(sorted(set(into.values())))}
    return {k: order[v] for k, v in into.items()}


def random_labels(rng, n, groups, spread, d=8):
    centres = rng.normal(size=(groups, d))
    return {int(k): (centres[rng.integers(groups)] + rng.normal(size=d) * spread, int(rng.integers(1, 9))) for k in rng.permutation(3 * n)[:n]}


@pytest.mark.parametrize("n,groups,spread", [(1, 1, 0), (2, 1, 0.1), (60, 9, 0.5), (120, 40, 0.4), (300, 25, 0.6)])
def test_queue_merging_equals_brute_force(n, groups, spread):
    for seed in range(4):
        rows = random_labels(np.random.default_rng(seed), n, groups, spread)
        assert X.merged_labels(rows) == brute_merge(rows, X.MERGE_MIN)


def test_merging_of_labels_by_the_thousand(spark):
    rng = np.random.default_rng(7)
    rows = random_labels(rng, 1200, 300, 0.35)
    want = brute_merge(rows, X.MERGE_MIN)
    df = spark.createDataFrame([(j, k, c.tolist(), n) for j in ("a", "b") for k, (c, n) in rows.items()], "job string, label long, centroid array<double>, members long")
    got = {(r.job, r.label): r.merged for r in X.merge_labels(df, "label", keys=("job",)).collect()}
    assert got == {(j, k): m for j in ("a", "b") for k, m in want.items()} and 1 < len(set(want.values())) < 1000


def brute_fragments(profiles, total_ms):
    rows = {p["label"]: dict(p, centroid=np.asarray(p["centroid"], float)) for p in profiles}
    into = {k: k for k in rows}
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    def margin(p):
        others = sorted((cos(p["centroid"], q["centroid"]) for q in rows.values() if q is not p), reverse=True)
        return others[0] - others[1] if len(others) > 1 else 1.0

    def loose(p):
        return p["duration_ms"] < min(15_000, int(0.03 * total_ms)) and p["chunks"] <= 4 and p["cohesion"] < 0.78

    while len(rows) > 1:
        keys, margins = sorted(rows), {k: margin(p) for k, p in rows.items()}
        best = None
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                s = cos(rows[a]["centroid"], rows[b]["centroid"])
                if (s >= 0.84 or s >= 0.72 and (loose(rows[a]) or loose(rows[b])) and max(margins[a], margins[b]) >= 0.06) and (best is None or s > best[0]):
                    best = s, a, b
        if best is None or best[0] < 0.74:
            break
        _, a, b = best
        keep, gone = (a, b) if rows[a]["duration_ms"] >= rows[b]["duration_ms"] else (b, a)
        x, y = rows[keep], rows.pop(gone)
        w = x["chunks"] + y["chunks"]
        rows[keep] = x | {"centroid": (x["centroid"] * x["chunks"] + y["centroid"] * y["chunks"]) / w, "duration_ms": x["duration_ms"] + y["duration_ms"], "chunks": w, "cohesion": (x["cohesion"] * x["chunks"] + y["cohesion"] * y["chunks"]) / w}
        into = {k: keep if v == gone else v for k, v in into.items()}
    return into


def random_profiles(rng, n, groups, spread):
    rows = random_labels(rng, n, groups, spread)
    return [{"label": k, "centroid": c.tolist(), "chunks": m, "duration_ms": int(m * rng.integers(500, 3000)), "cohesion": float(rng.uniform(0.5, 1))} for k, (c, m) in rows.items()]


@pytest.mark.parametrize("n,groups,spread", [(1, 1, 0), (2, 1, 0.3), (3, 1, 0.3), (25, 6, 0.3), (60, 20, 0.3), (60, 5, 0.45)])
def test_fragment_merging_equals_brute_force(n, groups, spread):
    some = 0
    for seed in range(5):
        p = random_profiles(np.random.default_rng(seed), n, groups, spread)
        want = brute_fragments(p, 400_000)
        assert clustering.merge_fragments(p, 400_000) == want
        some += len(set(want.values())) < n
    assert some or n < 25


def test_fragments_of_a_thousand_labels(spark):
    p = random_profiles(np.random.default_rng(5), 1000, 200, 0.25)
    into = clustering.merge_fragments(p, 400_000)
    assert len(set(into.values())) < 900 and all(into[v] == v for v in into.values())


def test_merge_queries(spark):
    table = clusters.label_table(spark, SF).collect()
    merged = {(r.job, r.label): r.merged for r in clusters.label_merges(spark, SF).collect()}
    jobs = {r.job for r in table}
    for job in jobs:
        want = brute_merge({r.label: (np.array(r.centroid), r.members) for r in table if r.job == job}, X.MERGE_MIN)
        assert {k: merged[job, k] for k in want} == want
    into = {(r.job, r.label): r.into for r in clusters.fragment_merges(spark, SF).collect()}
    for job in jobs:
        rows = [dict(label=r.label, centroid=r.centroid, chunks=r.members, duration_ms=r.duration_ms, cohesion=r.cohesion) for r in table if r.job == job]
        want = brute_fragments(rows, sum(r["duration_ms"] for r in rows))
        assert {k: into[job, k] for k in want} == want


# -- repair -----------------------------------------------------------------------------------------------------


def rows_of(job, x, labels, step=1500):
    return [(job, i, i * step, (i + 1) * step, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]


REPAIR = "job string, pos long, start_ms long, end_ms long, vector array<double>, label long"


def test_repair_leaves_good_jobs_and_clusters_bad_ones_again(spark):
    rng = np.random.default_rng(2)
    people = np.eye(16)[:3] * 5
    clear = np.concatenate([rng.normal(size=(40, 16)) * 0.4 + people[j] for j in range(3)])
    order = rng.permutation(120)  # everybody speaks all along
    good = clear[order]
    truth = (np.arange(120) // 40)[order]
    # a label of a few windows that aren't alike is garbage
    noisy, noise = truth.copy(), [3, 50, 90, 100]
    noisy[noise] = 3
    heard = good.copy()
    heard[noise] = rng.normal(size=(4, 16))
    hopeless = rng.normal(size=(12, 16))  # short labels without any cohesion: no two are healthy
    df = spark.createDataFrame(rows_of("good", good, truth) + rows_of("noisy", heard, noisy) + rows_of("hopeless", hopeless, np.arange(12) % 4), REPAIR)
    found = repair.profiles(df).collect()
    assert {(r.job, r.label) for r in found if r.garbage} >= {("noisy", 3)} and not [r for r in found if r.garbage and r.job == "good"]
    got = {(r.job, r.pos): r for r in repair.repair(df).collect()}
    assert len(got) == 252
    rounds = {j: {got[k].rounds for k in got if k[0] == j} for j in ("good", "noisy", "hopeless")}
    assert rounds == {"good": {0}, "noisy": {1}, "hopeless": {0}}
    for job in ("good", "noisy"):
        pairs = {(truth[i], got[job, i].label) for i in range(120) if i not in noise}
        assert len(pairs) == 3 and len({b for _, b in pairs}) == 3
    assert {got["hopeless", i].fallback for i in range(12)} == {"few labels"}  # too few rows to be clustered anew
    assert {got["good", 0].fallback, got["noisy", 0].fallback} == {None}


def test_a_job_takes_rounds_until_none_is_garbage(spark, monkeypatch):
    """Clustering that finds another garbage label each time: three rounds, then its rows are reassigned."""
    rng = np.random.default_rng(4)
    people = np.eye(16)[:7] * 5
    x = np.concatenate([rng.normal(size=(30, 16)) * 0.3 + people[j] for j in range(6)] + [rng.normal(size=(8, 16))])
    labels = np.append(np.arange(180) // 30, [6] * 8)

    def stubborn(x, share, most, forced=None):
        return np.append(np.arange(180) // 30 % (forced - 1), [forced - 1] * 8)

    monkeypatch.setattr(repair, "clustered", stubborn)
    order = np.arange(188)
    df = spark.createDataFrame(rows_of("j", x[order], labels[order]), REPAIR)
    found = repair.repair(df).collect()
    assert {r.rounds for r in found} == {3} and len(found) == 188


def test_collapsed_coverage_is_clustered_anew(spark):
    rng = np.random.default_rng(6)
    people = np.eye(16)[:2] * 5
    truth = rng.integers(0, 2, 100)
    x = rng.normal(size=(100, 16)) * 0.3 + people[truth]
    labels = np.where(np.arange(100) >= 60, np.arange(100) % 2, 0)  # the first covers everything, the other begins late
    labels[99] = 0
    one = rows_of("one", x, np.zeros(100))
    got = repair.repair(spark.createDataFrame(rows_of("late", x, labels) + one, REPAIR)).collect()
    assert {(r.job, r.fallback) for r in got} == {("late", "collapsed coverage"), ("one", "few labels")}
    for job in ("late", "one"):
        pairs = {(truth[r.pos], r.label) for r in got if r.job == job}
        assert len(pairs) == 2 and len({b for _, b in pairs}) == 2


def test_repair_edges(spark):
    assert repair.repair(spark.createDataFrame([], REPAIR)).count() == 0
    df = spark.createDataFrame([("j", 0, 0, 10, [1.0, 0.0], 5), ("j", 1, 10, 20, None, 5)], REPAIR)
    assert [(r.pos, r.label, r.rounds, r.fallback) for r in repair.repair(df).collect()] == [(0, 0, 0, "few labels")]
