"""Steps that grew faster than their input: what their new forms give, and that they stay in their bounds."""

import numpy as np
from pyspark.sql import functions as F

from echoweave.operators import clustering, documents, folds, results, spectra, stages, vectors
from echoweave.plans.all import QUERIES

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fbank_frames_of_a_small_file_are_dealt(spark):
    assert QUERIES["fbank_frames"](spark, SF).rdd.getNumPartitions() >= 4


def random_tokens(seed, n=400):
    return np.random.default_rng(seed).choice(["a", "word", " ", "", "字", "你", "你", "。", "，", "end.", "x" * 25], n).tolist()


def test_sentences_of_whole_documents(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(150):
        tokens = random_tokens(k, k * 3)
        starts = np.cumsum(rng.integers(0, 400, len(tokens)) + 100).tolist()
        rows.append((k, tokens, starts, [s + 100 for s in starts]))
    df = spark.createDataFrame([*rows, (150, None, None, None)], "k long, tokens array<string>, starts array<long>, ends array<long>")
    flat = df.select("k", F.posexplode(F.arrays_zip("tokens", "starts", "ends")).alias("pos", "t")).select("k", "pos", F.col("t.tokens").alias("token"), F.col("t.starts").alias("start_ms"), F.col("t.ends").alias("end_ms"))
    want = sorted(map(tuple, folds.sentences(flat, ["k"]).collect()))
    assert len(want) > 1000 and sorted(map(tuple, folds.document_sentences(df, ["k"]).collect())) == want
    assert "Exchange" not in plan(QUERIES["sentence_split"](spark, SF))


def test_repeat_filter_of_whole_documents(spark):
    df = spark.createDataFrame([(k, random_tokens(k, k * 3)) for k in range(150)] + [(150, None), (151, ["plain", "words"])], "k long, tokens array<string>")
    want = folds.repeat_filter(df.select("k", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long")), ["k"]).orderBy("k", "pos").collect()
    got = [(r.k, t) for r in folds.document_repeat_filter(df.repartition(2), ["k"]).orderBy("k").collect() for t in r.tokens]
    assert got == [(r.k, r.token) for r in want]
    assert "Exchange" not in plan(QUERIES["repeat_filter"](spark, SF))


def test_repeat_guard_takes_few_documents_at_a_time(spark, monkeypatch):
    rows = [(k, ["a", "b", "c", "d", "e"] * (k % 7), [0, 0, 0, 0, 3] * (k % 7)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, tokens array<string>, marks array<int>").coalesce(1)
    few = {r.k: r.marks for r in documents.repeat_guard(df, ["k"]).collect()}
    monkeypatch.setattr(documents, "DOCUMENTS", 1)
    assert len(few) == 300 and few == {r.k: r.marks for r in documents.repeat_guard(df, ["k"]).collect()}
    assert "MapInArrow" in plan(documents.repeat_guard(df, ["k"]))


def test_largest_of_a_strip_with_ties():
    c = np.random.default_rng(2).integers(0, 5, (40, 30)).astype(float)
    c[3], c[5, :27], c[7, 4] = np.nan, np.nan, np.nan
    want = np.lexsort((np.broadcast_to(np.arange(30), c.shape), -c), axis=1)
    for keep in (1, 6, 30, 50):
        assert (vectors.largest(c, keep) == want[:, :keep]).all()


def test_top_edges_over_several_strips(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(0, i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in rng.permutation(300).tolist()], "batch long, id long, v array<double>")
    strips = sorted(map(tuple, vectors.top_edges(df, "batch", "id", "v", 6).collect()))
    monkeypatch.setattr(vectors, "STRIP", 1000)
    assert len(strips) == 1800 and strips == sorted(map(tuple, vectors.top_edges(df, "batch", "id", "v", 6).collect()))


def test_differing_counts_repeated_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "y"), (4, "y")], "k int, v string")
    assert sorted(map(tuple, documents.differing(a, b).collect())) == [(1, "x", 1), (3, "y", 1), (4, "y", 2)]
    assert "Except" not in QUERIES["recompute_diff"](spark, SF)._jdf.queryExecution().analyzed().toString()


def test_dealt_parts_stay_small(spark):
    df = stages.dealt(spark.range(10_000).selectExpr("id % 500 as k", "id"), "k", rows=1000)
    assert df.rdd.getNumPartitions() == 10 and df.count() == 10_000


def test_split_metadata_violations_by_one_sum(spark):
    splits = spark.createDataFrame([(1, ["a", "a", " ", " ", "z", None, None], 1), (2, [], 3), (None, ["a"], 1), (3, None, 1)], "job int, labels array<string>, version int")
    base = spark.createDataFrame([(1, "a"), (1, "q"), (2, "z"), (None, "a")], "job int, label string")
    out = results.split_metadata_violations(splits, "job", "labels", "version", base, "label")
    want = [(1, "blank", " "), (1, "blank", " "), (1, "duplicate", " "), (1, "duplicate", "a"), (1, "duplicate", None), (1, "unknown", "z"), (2, "version", "3"), (None, "unknown", "a")]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert "Join" not in plan(out)


def test_filter_plans_do_not_grow_with_the_degree(spark):
    edges = spark.createDataFrame([(i, (i + s) % 60, 1.0 + i % 3) for i in range(60) for s in (1, 7)], "src long, dst long, w double")
    got = []
    for part_nodes in (100, 20):
        m = spectra.blocked(spectra.laplacian(edges), part_nodes)
        rows = {(r.part, r.at): r.node for r in m.place.collect()}
        sizes = {p: sum(k[0] == p for k in rows) for p in {k[0] for k in rows}}
        x = spark.createDataFrame([(p, np.array([[rows[p, a], 1.0] for a in range(n)]).tobytes()) for p, n in sizes.items()], "part int, x binary")
        few, many = (spectra.filtered(m, x, 2, 1.0, 12.0, degree) for degree in (2, 6))
        assert plan(many).count("Join") == plan(few).count("Join") <= 1
        got.append({rows[r.part, a]: v for r in many.collect() for a, v in enumerate(np.frombuffer(r.x).reshape(-1, 2).tolist())})
    assert len(got[0]) == 60 and all(np.allclose(got[0][k], got[1][k]) for k in got[0])


def test_few_eigenpairs_without_all(monkeypatch):
    """The smallest eigenvalues and the labels of a large graph, without a solver of all eigenvectors."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.4, (240, 6)) for c in np.eye(6)[:3]])
    a = np.zeros((720, 720))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit @ unit.T
    best = vectors.largest(c, 6)
    np.put_along_axis(a, best, np.take_along_axis(c, best, 1), 1)
    sym = (a + a.T) / 2
    np.fill_diagonal(sym, 0)
    m = np.diag(abs(sym).sum(1)) - sym
    whole, basis = np.linalg.eigh(m)
    k = vectors.speakers_of(whole[:12])
    want = vectors.seeded_kmeans(basis[:, :k], k)
    sizes, eigh = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda b: (sizes.append(len(b)), eigh(b))[1])
    label = vectors.spectral(a, x)
    values, few = vectors.smallest_eigenpairs(m, 12)
    assert sizes and max(sizes) < 720 and np.allclose(values, whole[:12], atol=1e-10) and np.allclose(m @ few, few * values, atol=1e-8)
    assert len(set(zip(label.tolist(), want.tolist(), strict=True))) == len(set(want.tolist())) == len(set(label.tolist()))
    two = np.kron(np.eye(30), np.full((24, 24), -1.0) + 24 * np.eye(24))  # thirty parts: more zeros than are asked for
    assert np.abs(vectors.smallest_eigenpairs(two, 12)[0]).max() < 1e-9
    assert np.array_equal(vectors.smallest_eigenpairs(np.zeros((720, 720)), 3)[0], np.zeros(3))


def test_aligned_batches_equal_a_plain_fold(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(5, 4))
    rows = [(b, j, (base[rng.integers(5)] + rng.normal(0, 0.4, 4)).tolist()) for b in range(12) for j in range(3)] + [(12, 0, [0.0] * 4)]
    got = {(r.b, r.j): r.global_label for r in clustering.align_batches(spark.createDataFrame(rows, "b long, j int, v array<double>"), "b", "j", "v").collect()}
    known, want = [], {}
    for b, j, v in rows:
        scores = [float(np.dot(v, k) / ((np.linalg.norm(v) * np.linalg.norm(k)) or 1.0)) for k, _ in known]
        at = int(np.argmax(scores)) if scores and max(scores) >= clustering.SAME else len(known)
        known[at:at + 1] = [((known[at][0] * known[at][1] + np.array(v)) / (known[at][1] + 1), known[at][1] + 1)] if at < len(known) else [(np.array(v), 1)]
        want[b, j] = at
    assert got == want and len(set(want.values())) > 3


def test_a_graph_of_one_part_takes_few_jobs(spark, monkeypatch):
    """One task solves it: the driver starts no job a step. Beyond the bounds, steps over the table give the same."""
    rng = np.random.default_rng(8)
    edges = spark.createDataFrame([(i, int(j), float(rng.uniform(0.2, 1))) for i in range(400) for j in {(i + 1) % 400, *rng.integers(0, 400, 3)}], "src long, dst long, w double")
    last_job = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
    before = last_job()
    one = spectra.smallest_eigenpairs(edges, 4)
    between = last_job()
    assert between - before <= 30
    monkeypatch.setattr(spectra, "WHOLE_ENTRIES", 100)
    many = spectra.smallest_eigenpairs(edges, 4)
    assert last_job() - between > 30
    assert one.residual < 1e-4 and np.allclose(one.values, many.values, atol=1e-9)
    a, b = (np.array([r.v for r in x.vectors.orderBy("node").collect()]) for x in (one, many))
    assert a.shape == (400, 4) and np.allclose(abs((a * b).sum(0)), 1, atol=1e-6)


def test_edges_over_all_rows_equal_brute_force(spark, monkeypatch):
    """Over several parts, tasks, strips and groups; with ties, copies, a vector of length 0 and null ones."""
    rng = np.random.default_rng(4)
    x = [v.tolist() for v in rng.integers(-2, 3, (700, 4)).astype(float)]
    x[100:160], x[5], x[300], x[301] = [[1.0, 2.0, 0.0, 1.0]] * 60, [0.0] * 4, None, None
    df = spark.createDataFrame([(i * 3, x[i]) for i in rng.permutation(700).tolist()], "id long, v array<float>").repartition(5)
    unit = np.array([[0.0] * 4 if v is None else v for v in x])
    with np.errstate(invalid="ignore"):
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    c = np.round(unit @ unit.T, 12)
    none = np.array([v is None for v in x])
    key = np.where(none[:, None] | none, -9, np.where(np.isnan(c), 9, c))
    best = np.lexsort((np.broadcast_to(np.arange(700), c.shape), -key), axis=1)[:, :6]
    want = sorted((i * 3, int(j) * 3, str(None if none[i] or none[j] else c[i, j] + 0.0)) for i in range(700) for j in best[i])
    for held, groups, columns, strip in ((1 << 16, 256, 2048, 256), (150, 8, 30, 7), (64, 100, 2048, 1000)):
        for name, value in (("HELD_ROWS", held), ("GROUP", groups), ("TILE_COLUMNS", columns), ("STRIP", strip)):
            monkeypatch.setattr(vectors, name, value)
        assert sorted((r.src, r.dst, str(None if r.w is None else r.w + 0.0)) for r in vectors.nearest_edges(df, "id", "v", 6).collect()) == want
    few = vectors.nearest_edges(df.where("id < 9"), "id", "v", 6).collect()
    assert len(few) == 9 and vectors.nearest_edges(df.where("false"), "id", "v", 6).count() == 0


def test_topp_graph_meets_partners_of_far_rows(spark, tmp_path):
    """Rows 0 to 5 have their partners at the end of a table that is longer than a batch."""
    n, rng = 4400, np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(n, 7)), np.zeros((n, 1))], 1)
    x[n - 6 :] = x[:6] = np.eye(8)[7] * 5 + rng.normal(0, 0.1, (6, 8))
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in QUERIES["topp_graph"](spark, str(tmp_path)).collect():
        got.setdefault(r.src, set()).add(r.dst)
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = vectors.largest(np.round(x @ x.T, 12), 6)
    assert all(got[0] & {k} for k in (0, n - 6)) and got == {i: set(b) for i, b in enumerate(best.tolist())}


def test_jobs_of_a_filter_do_not_grow_with_the_degree(spark):
    """Over several parts, of nodes in order: the products of a filter are one job's."""
    edges = spark.createDataFrame([(i, (i + s) % 60, 1.0 + i % 3) for i in range(60) for s in (1, 2)], "src long, dst long, w double")
    m = spectra.blocked(spectra.laplacian(edges), 10)
    place = sorted((r.part, r.at, r.node) for r in m.place.collect())
    assert m.parts == 6 and [p[2] for p in place] == list(range(60)) and m.blocks.count() == 18  # a part meets itself and those beside it
    x = spark.createDataFrame([(p, np.arange(p * 10.0, p * 10 + 10)[:, None].tobytes()) for p in range(6)], "part int, x binary")
    last_job = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
    took = []
    for degree in (2, 6):
        before = last_job()
        assert spectra.filtered(m, x, 1, 1.0, 12.0, degree).count() == 6
        took.append(last_job() - before)
    assert took[0] == took[1]
