"""Punctuation, clustering over label tables, pauses, key failover."""

import random

import numpy as np
from pyspark.sql import functions as F

from echoweave.functions import vectors as V
from echoweave.operators import clustering, pauses, punctuation
from echoweave.operators import results as R
from echoweave.operators import vectors as X
from echoweave.sources import match_index
from echoweave.sources.failover import Keys


def test_align(spark):
    df = spark.createDataFrame([(1, ["甲", "乙"], "甲，乙。"), (2, ["甲", "乙"], "甲，丙。"), (3, ["甲", "乙"], "甲"), (4, [], "")], "k int, tokens array<string>, text string")
    got = {r.k: (r.tokens, r.failed_at) for r in punctuation.align(df, ["k"]).collect()}
    assert got == {1: (["甲，", "乙。"], None), 2: (["甲", "乙"], 2), 3: (["甲", "乙"], -1), 4: ([], None)}


def test_restore_carries_the_open_context(spark):
    df = spark.createDataFrame([("j", i, f"t{i}") for i in range(95)], "job string, pos long, token string")
    got = punctuation.restore(df, ["job"], lambda tokens: [3 if t[1:].endswith("7") else 1 for t in tokens]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(95)) and [r.pos for r in got if r.mark == 3] == list(range(7, 95, 10))
    assert punctuation.cut_after([1, 3, 1], 3) == 1 and punctuation.cut_after([1, 3], 2) == -1
    assert punctuation.cut_after([1, 1, 3], 3) == -1 and punctuation.cut_after([1, 2, 1], 201) == 1 and punctuation.cut_after([1, 1, 1], 401) == 2


def test_align_batches_and_reassign(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 6))
    rows = [(i, batch, label, (v + rng.normal(size=6) * 0.01).tolist()) for batch in (0, 1) for label, v in ((0, a if batch == 0 else b), (1, b if batch == 0 else a)) for i in range(batch * 10 + label * 5, batch * 10 + label * 5 + 5)]
    df = spark.createDataFrame(rows, "id long, batch long, label long, v array<double>")
    got = {(r.batch, r.label): r.global_label for r in clustering.align_batches(df, "batch", "label", "v").collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 0}
    one = df.where("batch = 0")
    valid = X.centroids(one.where("label = 0"), "label", "v")
    got = {r.id: r.new_label for r in clustering.reassign(one, "id", "label", "v", valid).collect()}
    c = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert got[0] == 0 and got[7] == (0 if c >= 0.4 else -1)


def test_merge_fragments():
    v = lambda *x: np.array(x, float)
    p = [{"label": 0, "centroid": v(1, 0, 0), "duration_ms": 600_000, "chunks": 400, "cohesion": 0.9}, {"label": 1, "centroid": v(0, 1, 0), "duration_ms": 500_000, "chunks": 300, "cohesion": 0.9}, {"label": 2, "centroid": v(0.8, 0.2, 0.55), "duration_ms": 4_000, "chunks": 3, "cohesion": 0.6}, {"label": 3, "centroid": v(0, 0.95, 0.1), "duration_ms": 100_000, "chunks": 60, "cohesion": 0.9}]
    assert clustering.merge_fragments(p, 1_200_000) == {0: 0, 1: 1, 2: 0, 3: 1}
    assert clustering.merge_fragments(p[:2], 1_200_000) == {0: 0, 1: 1}


def test_keep_raw_labels_if_merging_left_one(spark):
    rows = [("x", i, i % 2, 0) for i in range(40)] + [("few", i, i % 2, 0) for i in range(10)] + [("two", i, i % 3, i % 2) for i in range(40)] + [("same", i, 7, 7) for i in range(40)]
    df = spark.createDataFrame(rows, "job string, id long, raw long, merged long")
    got = {(r.job, r.id): r.label for r in clustering.keep_if_collapsed(df, ["job"], "raw", "merged").collect()}
    assert got == {(j, i): raw if j == "x" else merged for j, i, raw, merged in rows}


def test_confirm_pauses(spark):
    loud, quiet = 10.0, 1.0
    e = [("a", i, quiet if 100 <= i < 125 else loud) for i in range(300)] + [("b", i, loud) for i in range(300)]
    c = [("a", 1, 500, 2000, 1250), ("a", 2, 500, 2000, 1500), ("a", 3, 1100, 2000, 1250), ("b", 1, 0, 1000, 500), ("c", 1, 0, 100, 50)]
    got = pauses.confirm_pauses(spark.createDataFrame(c, "job_id string, pos int, lo_ms long, hi_ms long, boundary_ms long"), spark.createDataFrame(e, "job_id string, frame_id long, energy double"))
    assert {(r.job_id, r.pos): r.silence_ms for r in got.collect()} == {("a", 1): 250, ("a", 2): None, ("a", 3): None, ("b", 1): None, ("c", 1): None}


def test_key_failover():
    k = Keys([("x", 0, 1), ("y", 0, 2), ("z", 1, 0)])
    assert k.current(0) == "x"
    assert k.answer("x", 429, '{"retryDelay": "1m30s"}', 0) == "retry" and k.current(1) == "y" and k.current(91) == "x"
    assert k.answer("y", 429, "GenerateRequestsPerDay", 0) == "retry" and k.rest_until["y"] == 6 * 3600
    assert k.answer("x", 503, "", 100) == "retry" and k.current(100) == "z"
    assert k.answer("z", 400, "", 100) == "raise" and k.answer("z", 200, "", 100) == "ok"


def test_profile_health(spark):
    persons = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "c")], "label int, person string")
    cos = {(0, 1): 0.49, (2, 3): 0.8, (2, 4): 0.7, (3, 4): 0.6, (0, 5): 0.99}
    pairs = spark.createDataFrame([(x, y, c) for (a, b), c in cos.items() for x, y in ((a, b), (b, a))], "label int, other int, cos double")
    got = {r.label: r.health for r in X.profile_health(pairs, persons).collect()}
    assert got == {0: "red", 1: "red", 2: "green", 3: "green", 4: "red", 5: "gray"}


def test_merges_of_each_job(spark):
    near = [[1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.9, 0.3]]
    rows = [(job, k, v, 10) for job in (1, 2) for k, v in enumerate(near if job == 1 else near[1:3])]
    df = spark.createDataFrame(rows, "job int, label int, centroid array<double>, members int")
    got = {(r.job, r.label): r.merged for r in X.merge_labels(df, "label", keys=("job",)).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 1, (2, 0): 0, (2, 1): 1}
    profiles = df.select("job", "label", "centroid", (F.lit(20_000) - F.col("label") * 1000).alias("duration_ms"), F.lit(5).alias("chunks"), F.lit(0.9).alias("cohesion"), F.lit(100_000).alias("total_ms"))
    got = {(r.job, r.label): r.into for r in clustering.merged_fragments(profiles, "job").collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (1, 3): 2, (2, 0): 0, (2, 1): 1}


def test_labels_of_jobs_are_aligned_and_linked(spark):
    df = spark.createDataFrame([(j, b, k, v) for j in (1, 2) for b, k, v in [(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (1, 0, [0.1, 1.0]), (1, 1, [-1.0, 0.0])]], "job int, batch int, label int, v array<double>")
    got = {(r.job, r.batch, r.label): r.global_label for r in clustering.align_batches(df, "batch", "label", "v", keys=("job",)).collect()}
    assert got == {(j, *k): g for j in (1, 2) for k, g in {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 2}.items()}
    labels = spark.createDataFrame([(1, x) for x in "abcdefg"] + [(2, "a")], "job int, label string")
    pairs = spark.createDataFrame([(1, "f", "c"), (1, "a", "f"), (1, "d", "g"), (1, "g", "e")], "job int, a string, b string")
    got = {(r.job, r.label): r.root for r in clustering.linked_labels(labels, pairs, "job", "label").collect()}
    assert got == {(1, "a"): "a", (1, "b"): "b", (1, "c"): "a", (1, "d"): "d", (1, "e"): "d", (1, "f"): "a", (1, "g"): "d", (2, "a"): "a"}


def test_batches_overlap_as_their_ranges_say(spark):
    for n in (3, 10, 11, 17, 18, 25):
        rows = spark.range(n).select(F.col("id").alias("pos"))
        got = {(r.pos, r.batch) for r in X.batched(rows, "pos", 10, 3).collect()}
        ranges = spark.range(1).select(F.explode(X.batch_ranges(F.lit(n), 10, 3)).alias("r")).select("r.*").collect()
        assert got == {(p, r.batch) for r in ranges for p in range(r.lo, r.hi)}


def brute_times(peaks, alphas, n, longest):
    if n <= 0 or longest <= 0:
        return []
    places = [i - 1.5 for i, p in enumerate(peaks) if p >= 1 - 1e-4]
    if len(places) != n + 1 and alphas:
        places, acc, total = [], 0.0, sum(alphas)
        for i, a in enumerate(alphas if total > 1e-6 else []):
            acc += a * (n + 1) / total
            if acc >= 1 - 1e-4:
                places.append(i - 1.5)
                acc -= 1 - 1e-4
    if len(places) < 2:
        return [min(longest, i * 60) for i in range(n + 1)]
    out = [min(longest, max(0, int(p * 20 + 0.5))) for p in places[: n + 1]]
    last = out[-1]
    while len(out) < n + 1:
        out.append(min(longest, last + (len(out) - (len(places) - 1)) * 60))
    return out


def test_token_times(spark):
    rng = random.Random(8)
    peaks = lambda *at: [1.0 if i in at else 0.2 for i in range(70)]
    rows = [(peaks(0, 4, 11), [], n, 700) for n in (1, 2, 3, 5)] + [(peaks(6), [], 3, 100), ([], [], 2, 900), (peaks(3, 4, 42, 62), [], 6, 1000), (peaks(3, 9), [0.5] * 70, 0, 9), (peaks(3, 9), [0.5] * 70, 2, 0), (peaks(3), [0.0] * 70, 2, 900)]
    # a number of peaks that isn't the tokens' own: the weights decide; more fires than steps: at most one a step
    rows += [(peaks(3, 9, 20), [rng.random() for _ in range(70)], n, 5000) for n in (1, 2, 3, 9, 40, 90)]
    df = spark.createDataFrame(rows, "peaks array<double>, alphas array<double>, n int, longest int")
    got = df.select("*", V.token_times(F.col("peaks"), F.col("alphas"), F.col("n"), F.col("longest")).alias("t")).collect()
    assert [r.t for r in got] == [brute_times(r.peaks, r.alphas, r.n, r.longest) for r in got]


def test_token_times_of_known_cases(spark):
    times = lambda peaks, alphas, n, longest: spark.range(1).select(V.token_times(F.array(*map(F.lit, peaks)).cast("array<double>"), F.array(*map(F.lit, alphas)).cast("array<double>"), F.lit(n), F.lit(longest)).alias("t")).first().t
    assert times([], [0.5] * 4, 1, 10_000) == [0, 30]
    many = times([1.0] * 2000, [], 1999, 30_000)
    assert len(many) == 2000 and many[0] == 0 and many[-1] == 30_000 and all(0 <= t <= 30_000 for t in many)


def brute_matches(scores, target, limit, excluding=()):
    best = {}
    for t, c, person, score in scores:
        if t == target and person is not None and c not in excluding:
            best[person] = max(best.get(person, (-9, 0)), (score, -c))
    return [(p, s, -c, i + 1) for i, (p, (s, c)) in enumerate(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:limit])]


def test_match_index_reads_one_bucket_and_updates_those_it_must(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "index")
    schema = "target long, candidate long, person string, score double"
    scores = [(t, c, None if c == 5 else f"p{c % 4}", round(rng.random(), 2)) for t in range(30) for c in range(9) if c != t]
    match_index.write_index(spark.createDataFrame(scores, schema), path, buckets=8)
    look = lambda t, *a: [tuple(r) for r in match_index.matches(match_index.read_index(spark, path), t, *a, buckets=8).orderBy("rank").collect()]
    for t in (0, 3, 29, 99):
        assert look(t, 3) == brute_matches(scores, t, 3) and look(t, 9, [1, 2]) == brute_matches(scores, t, 9, (1, 2))
    plan = match_index.matches(match_index.read_index(spark, path), 3, 3, buckets=8)
    assert len({f.split("/")[-2] for f in plan.inputFiles()}) >= 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text or "PartitionFilters: [(isnotnull(bucket" in text or "bucket#" in text.split("PartitionFilters")[1][:60]
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("*.parquet")}
    before = files()
    changed = [(3, c, f"p{c % 4}", 0.5 + c / 100) for c in range(9) if c != 3]
    n = match_index.update_index(spark, path, spark.createDataFrame(changed, schema), spark.createDataFrame([], "id long"), buckets=8)
    assert n == 1 and len(files().keys() & before.keys()) > len(before) * 0.7
    scores = [s for s in scores if s[0] != 3] + changed
    assert look(3, 4) == brute_matches(scores, 3, 4) and look(4, 4) == brute_matches(scores, 4, 4)
    match_index.update_index(spark, path, spark.createDataFrame([], schema), spark.createDataFrame([(2,), (7,)], "id long"), buckets=8)
    scores = [s for s in scores if not {s[0], s[1]} & {2, 7}]
    for t in range(30):
        assert look(t, 4) == brute_matches(scores, t, 4)


def test_split_outcomes(spark):
    states = spark.createDataFrame([("a", "s1", ["M1"], "base a"), ("b", "s1", ["M1"], "base b"), ("c", "s2", ["M1"], "base c"), ("d", "s1", ["M1", "M2"], "base d")], "job string, identity string, labels array<string>, baseline string")
    requests = spark.createDataFrame([("a", "s1", "M0", "now"), ("b", "s1", "M1", "now"), ("c", "s1", "M1", "now"), ("d", "s1", "M9", "now"), ("e", "s1", "M0", "now")], "job string, identity string, label string, cleanup string")
    known = spark.createDataFrame([(j, f"M{i}") for j in "abcde" for i in range(3)], "job string, label string")
    got = {r.job: (r.outcome, r.labels, r.baseline) for r in R.split_outcomes(states, requests, known, "job").collect()}
    assert got == {"a": ("commit", ["M0", "M1"], "base a"), "b": ("restore", [], "base b"), "c": ("discard", [], "base c"), "d": ("refuse", ["M1", "M2"], "base d"), "e": ("commit", ["M0"], "now")}


def test_reader_order_of_case_and_accents(spark):
    df = spark.createDataFrame([(1, t) for t in ("zebra", "Édith", "edith", "Edith", "Zoe", "éa", "eb", "apple", None)], "k int, title string")
    got = [r.title for r in R.collated_order(df, ["k"], "title").orderBy("pos").collect()]
    assert got == [None, "apple", "éa", "eb", "edith", "Edith", "Édith", "zebra", "Zoe"]


def test_sentinel_has_its_own_label_and_fingerprint(spark):
    assert (R.SENTINEL, R.SENTINEL_ID) == ("Speaker", "fp_system_speaker")
