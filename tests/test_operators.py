"""Operators on literal cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoweave.functions import text as T
from echoweave.functions import timing
from echoweave.functions import vectors as V
from echoweave.operators import catalog, documents, folds, frames, intervals, runs, timeline, vectors, votes


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_overlaps_of_two_and_nested_tokens(spark):
    df = spark.createDataFrame([("a", 0, 0, 200), ("a", 1, 100, 300), ("b", 0, 0, 1000), ("b", 1, 100, 900), ("b", 2, 200, 300), ("c", 0, 5, 9)], "job string, pos int, s long, e long")
    got = rows(timeline.resolve_overlaps(df, ["job"], ["s", "pos"], "s", "e").select("job", "pos", "eff_start", "eff_end", "clipped"), "job", "pos")
    assert got == [("a", 0, 0, 150, True), ("a", 1, 150, 300, True), ("b", 0, 0, 250, True), ("b", 1, 250, 250, True), ("b", 2, 250, 300, True), ("c", 0, 5, 9, False)]


def test_turns_follow_time_and_merge_runs_follow_rows(spark):
    df = spark.createDataFrame([(1, 0, 100, "x"), (1, 200, 300, "x"), (1, 100, 250, "x"), (1, 300, 400, "y"), (1, 400, 450, "x")], "job int, s long, e long, l string")
    assert rows(runs.turns(df, ["job"], ["s"], "l", "s", "e").drop("run"), "start_ms") == [(1, "x", 0, 300, 3), (1, "y", 300, 400, 1), (1, "x", 400, 450, 1)]
    merged = runs.merge_runs(df, ["job"], ["s"], "l", "s", "e").select("merge_id", "l", "start_ms", "end_ms", "n")
    assert rows(merged, "merge_id") == [(1, "x", 0, 300, 3), (2, "y", 300, 400, 1), (3, "x", 400, 450, 1)]


def test_null_labels_make_one_run_and_empty_tables_none(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a")], "job int, pos int, l string")
    assert [r.run for r in runs.label_runs(df, ["job"], ["pos"], "l").orderBy("pos").collect()] == [0, 0, 1]
    assert runs.label_runs(df.where("false"), ["job"], ["pos"], "l").count() == 0


@pytest.mark.parametrize("segments,total,want", [
    ([(0, 2000), (3200, 5000)], 20_000, [(0, 5000, 0, 5000)]),
    ([(0, 2000), (3201, 5000)], 20_000, [(0, 2000, 0, 2000), (3201, 5000, 3201, 5000)]),
    ([(0, 5000), (6000, 15_000)], 20_000, [(0, 15_000, 0, 15_000)]),
    ([(0, 5000), (6000, 15_001)], 20_000, [(0, 5000, 0, 5000), (6000, 15_001, 6000, 15_001)]),
    ([(0, 14_900), (14_950, 15_050)], 20_000, [(0, 14_900, 0, 14_900), (14_950, 15_450, 14_950, 15_050)]),
    ([(1000, 1100), (1300, 1400)], 5000, [(1000, 1800, 1000, 1400)]),
])
def test_interval_batches(spark, segments, total, want):
    df = spark.createDataFrame([("j", a, b, total) for a, b in segments], "job_id string, start_ms long, end_ms long, total_ms long")
    assert rows(folds.interval_batches(df).drop("job_id", "batch_id"), "decode_start") == want


def test_midpoint_ownership_clips(spark):
    t = spark.createDataFrame([("j", 14_700, 14_800), ("j", 14_940, 15_030)], "job string, s long, e long")
    o = spark.createDataFrame([("j", 14_950, 15_050)], "job string, lo long, hi long")
    assert rows(intervals.ownership(t, o, ["job"], "s", "e", "lo", "hi", 1000).select("own_start", "own_end"), "own_start") == [(14_950, 15_030)]


def test_bucketed_join_equals_nested_loop(spark):
    rng = np.random.default_rng(1)
    p = [(int(k), int(x)) for k, x in zip(rng.integers(0, 3, 200), rng.integers(0, 5000, 200), strict=True)]
    r = [(int(k), int(a), int(a + n)) for k, a, n in zip(rng.integers(0, 3, 40), rng.integers(0, 5000, 40), rng.integers(0, 900, 40), strict=True)]
    got = intervals.point_in_interval(spark.createDataFrame(p, "k int, x long"), spark.createDataFrame(r, "k int, lo long, hi long"), ["k"], "x", "lo", "hi", 100)
    assert sorted((a.k, a.x, a.lo, a.hi) for a in got.collect()) == sorted((k, x, lo, hi) for k, x in p for j, lo, hi in r if j == k and lo <= x < hi)


def endpoints(flags):
    fold, out = folds.Endpoints(), []
    for f in flags:
        out += fold.push(f)
    return out + fold.end()


def test_endpoints_of_a_brief_pause_and_a_flush():
    got = endpoints([False] * 50 + [True] * 30 + [False] * 50 + [True] * 50 + [False] * 100)
    assert len(got) == 1 and got[0]["start_ms"] < 500 and got[0]["end_ms"] > 1800
    assert [(x["start_ms"], x["end_ms"]) for x in endpoints([True] * 80)] == [(0, 800)]
    assert endpoints([]) == [] and endpoints([False] * 500) == []


def test_packed_windows(spark):
    t = spark.createDataFrame([("j", 0, 0, 0, 70), ("j", 0, 1, 0, 70), ("j", 0, 2, 0, 270)], "job_id string, island_id long, pos long, sentence_id long, frames long")
    got = rows(folds.pack_windows(t).select("window_id", "first_pos", "last_pos", "frames", "overlong"), "window_id")
    assert got == [(1, 0, 1, 140, False), (2, 2, 2, 148, True), (3, 2, 2, 148, True), (4, 2, 2, 120, True)]
    assert rows(timeline.overlong_windows(spark.createDataFrame([(0, 270)], "lo long, hi long"), "lo", "hi").select("win_lo", "win_hi"), "win_lo") == [(0, 148), (75, 223), (150, 270)]


def test_sentences(spark):
    def texts(tokens, gap=0):
        df = spark.createDataFrame([("j", i, t, i * (100 + gap), i * (100 + gap) + 100) for i, t in enumerate(tokens)], "job_id string, pos int, token string, start_ms long, end_ms long")
        return [r.text for r in folds.sentences(df).orderBy("sentence_id").collect()]

    assert texts(["甲。", "乙"]) == ["甲。", "乙"]
    assert [len(t) for t in texts(["字"] * 29 + ["字，", "字"])] == [31, 1]
    assert [len(t) for t in texts(["字"] * 61)] == [60, 1]
    assert texts(["a", "b"], 299) == ["ab"] and texts(["a", "b"], 300) == ["a", "b"]


def test_repeat_filter(spark):
    def kept(tokens):
        df = spark.createDataFrame([("j", i, t) for i, t in enumerate(tokens)], "job_id string, pos long, token string")
        return [r.token for r in folds.repeat_filter(df).orderBy("pos").collect()]

    assert kept(["我", "我"]) == ["我"] and kept(["p", "p"]) == ["p", "p"] and kept(["是", "不", "是"]) == ["是", "不"]


def test_folds_hold_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select((F.col("id") % 3).alias("job"), F.col("id").alias("pos"), F.lit(10).cast("long").alias("size"))
        got = folds.greedy_chunks(df, ["job"], 40).groupBy("job").agg(F.max("chunk_id").alias("c"), F.count("*").alias("n")).orderBy("job").collect()
        assert [(r.job, r.c, r.n) for r in got] == [(0, 41, 167), (1, 41, 167), (2, 41, 166)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fire_places_and_fires(spark):
    a = F.array(*(F.lit(x) for x in (0.01, 0.5, 0.9998, 0.99995, 1.0)))
    assert one(spark, V.fire_places(a)) == [1.5, 2.5]
    assert one(spark, V.fires(F.array(*([F.lit(0.5)] * 4)))) == [1, 3]


def test_vector_functions(spark):
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, V.cosine(arr(0, 0), arr(1, 1))) == 0.0
    assert one(spark, V.cosine(arr(1, 0), arr(0.9, 0.1))) == pytest.approx(0.9939, abs=1e-4)
    assert one(spark, V.normalized(arr(0, 0))) is None
    assert one(spark, V.finite_mean(arr(1, float("nan"), 3))) == 2.0
    assert one(spark, V.finite_mean(arr(float("inf")))) == -math.inf
    assert one(spark, V.argmax(arr(1, 5, 5))) == 1
    assert one(spark, V.softmax_of_max(arr(0, 0))) == 0.5
    assert one(spark, V.padded(arr(1, 2, 3), 2)) == [1.0, 2.0] and one(spark, V.padded(arr(1), 2)) == [1.0, 0.0]


def test_text_functions(spark):
    assert one(spark, T.mixed_tokens(F.lit("ab 我们c d"))) == ["ab", "我", "们", "c", "d"]
    assert one(spark, T.render(F.array(F.lit("ab"), F.lit("cd"), F.lit("我"), F.lit("e")))) == "ab cd我e"
    assert one(spark, T.join_paragraphs(F.array(F.lit("甲"), F.lit(" "), F.lit("乙。"), F.lit("丙，")))) == "甲，乙。丙，。"
    assert one(spark, T.join_paragraphs(F.array().cast("array<string>"))) == ""
    assert one(spark, T.delay_seconds(F.lit("1m30s"))) == 90.0 and one(spark, T.delay_seconds(F.lit("now"))) is None
    assert one(spark, T.strip_label(F.lit("雅冬：你好"), F.lit("雅冬"))) == "你好"
    assert one(spark, T.key_prefix(F.lit("abcdefghijkl"))) == "abcd...ijkl" and one(spark, T.redact(F.lit("k=ab;"), F.lit("ab"))) == "k=***;"
    assert one(spark, timing.clock(F.lit(61_500))) == "01:01" and one(spark, timing.duration(F.lit(3_661))) == "1:01:01"
    assert one(spark, timing.memory_mb(F.lit(1), F.lit(False))) == 1805 and one(spark, timing.memory_mb(F.lit(1), F.lit(True))) == 2392
    assert one(spark, timing.frame_count(F.lit(399))) == 0 and one(spark, timing.frame_count(F.lit(560))) == 2


def test_votes(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("a", 1), ("b", 2)], "k string, l int")
    assert rows(votes.vote_majority(df, ["k"], "l"), "k") == [("a", 0, 2, 4, 0.5, False), ("b", 2, 1, 1, 1.0, True)]
    parts = spark.createDataFrame([(1, "direct", 0), (1, "other", None), (2, "direct", 0), (2, "pending", 0), (3, "direct", 4), (3, "direct", 4), (4, "direct", 1), (4, "direct", 2)], "k int, status string, label int")
    parts = parts.withColumns({"votes": F.lit(1), "margin": F.lit(0.5), "ratio": F.lit(1.0)})
    assert [(r.status, r.label) for r in votes.status_rollup(parts, ["k"]).orderBy("k").collect()] == [("other", None), ("pending", None), ("direct", 4), ("pending", None)]
    s = spark.createDataFrame([(1, 0, 0.76), (1, 1, 0.69), (2, 0, 0.76), (2, 1, 0.679), (3, 0, 0.3)], "t int, l int, s double")
    got = votes.token_route(votes.evidence_margin(s, ["t"], "l", "s")).orderBy("t").collect()
    assert [r.disposition for r in got] == ["deferred", "accepted", "other"]


def routed(spark, tokens):
    df = spark.createDataFrame([("j", i, s, mark, 10, scores) for i, (s, mark, scores) in enumerate(tokens)], "job_id string, pos long, sentence_id long, mark boolean, support long, scores map<int,double>")
    return [(r.level, r.status, r.label) for r in votes.vote_routing(df).orderBy("pos").collect()]


def test_routing_levels(spark):
    sure, weak = {0: 0.9, 1: 0.5}, {0: 0.62, 1: 0.60}
    assert routed(spark, [(0, False, sure)] * 3) == [("first", "direct", 0)] * 3
    # a weak part between two direct ones of label 0 doesn't take that label
    got = routed(spark, [(0, False, sure), (0, True, sure), (0, False, weak), (0, True, {1: 0.61, 0: 0.60}), (0, False, sure), (0, False, sure)])
    assert got[:2] == [("first", "direct", 0)] * 2 and got[4:] == [("first", "direct", 0)] * 2
    assert {x[2] for x in got[2:4]} == {1}
    assert routed(spark, [(0, False, {0: 0.1})]) == [("second", "direct", 0)]
    assert routed(spark, [(0, False, {})]) == [("second", "other", None)]


def test_split_reassign(spark):
    s = spark.createDataFrame([(1, 0, 0.9, 0), (1, 1, 0.7, 0), (2, 0, 0.8, 1), (2, 1, 0.6, 1)], "t int, l int, s double, final int")
    assert rows(votes.split_reassign(s, ["t"], "l", "s", "final", [0]).select("t", "effective"), "t") == [(1, 1), (2, 1)]


def test_pause_threshold(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 899, 900), (2, 0, 100), (2, 900, 910)], "k int, s long, e long")
    assert rows(timeline.pause_candidates(df, ["k"], ["s"], "s", "e", 800), "k") == [(2, 800, 1)]


def test_relabel_by_first_occurrence(spark):
    df = spark.createDataFrame([(5, 10), (3, 20), (-1, 0), (5, 30)], "l int, at long")
    assert sorted((r.l, r.new_label) for r in runs.relabel_first_seen(df, "l", "at").distinct().collect()) == [(-1, -1), (3, 1), (5, 0), (5, 0)]


def test_history_page_and_positions(spark):
    df = spark.range(51)
    got = catalog.page(df, 99, [F.desc("id")]).collect()
    assert [(r.id, r.total) for r in got] == [(0, 51)]
    assert [r.pos for r in catalog.positioned(spark.range(0, 1000, 1, 7), [F.desc("id")]).orderBy("id").collect()] == list(range(1000, 0, -1))
    assert catalog.page(df.where("false"), 3, [F.col("id")]).count() == 0


def test_entity_resolution(spark):
    names = spark.createDataFrame([(" Ann",), ("ann",), ("Bob",), (" ",), (None,)], "name string")
    assert [r.name for r in catalog.get_or_create(names, spark.createDataFrame([("BOB ",)], "name string"), "name").collect()] == ["Ann"]
    side = lambda *x: spark.createDataFrame(list(x), "k int, n long")
    got = catalog.delta_upsert(side((1, 5), (2, 1)), side((1, 2), (2, 9)), side((1, 4), (3, 7)), ["k"], "n")
    assert rows(got, "k") == [(1, 7), (2, 0), (3, 7)]


def test_documents(spark):
    ids = lambda *x: F.array(*(F.lit(v) for v in x))
    decide = lambda i, n, last=False: one(spark, documents.flush_decision(i, F.lit(n), F.lit(last)))
    assert decide(ids(1, 3, 1), 3) == 1 and decide(ids(1, 1, 3), 3) == -1 and decide(ids(1, 2, 1), 3) == -1
    assert decide(ids(1, 2, 1), 201) == 1 and decide(ids(1, 1, 1), 401) == 2 and decide(ids(1, 1), 2, True) == 1
    t = spark.createDataFrame([(1, list("我们说我们。走"), [0] * 7), (2, list("他说好他说好了"), [0, 0, 0, 0, 3, 0, 0])], "k int, tokens array<string>, marks array<int>")
    assert {r.k: r.marks for r in documents.repeat_guard(t, ["k"]).collect()}[2] == [0, 0, 0, 0, 0, 0, 0]
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "k string, pos int, t string")
    ident = documents.stable_identity(df, ["k"], ["pos"], ["t"]).first().identity
    assert len(ident) == 16 and ident != documents.stable_identity(df.where("pos = 1"), ["k"], ["pos"], ["t"]).first().identity


def test_profiles_and_graph(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(2, 8))
    data = [(i, i // 20, [float(x) for x in base[i // 20] + rng.normal(size=8) * 0.05]) for i in range(40)]
    df = spark.createDataFrame(data, "id long, label int, v array<double>")
    p = {r.label: r for r in vectors.profiles(df, "label", "v").collect()}
    assert p[0].members == 20 and np.allclose(p[0].centroid, np.mean([d[2] for d in data[:20]], 0))
    edges = vectors.top_edges(df.withColumn("batch", F.lit(0).cast("long")), "batch", "id", "v", 8)
    assert edges.count() == 320
    labels = {r.node: r.label for r in vectors.spectral_labels(edges, "batch").collect()}
    assert len(set(labels[i] for i in range(20))) == 1 and labels[0] != labels[39]
    merged = {r.label: r.merged for r in vectors.merge_labels(vectors.profiles(df.withColumn("label", (F.col("id") / 10).cast("int")), "label", "v"), "label").collect()}
    assert merged == {0: 0, 1: 0, 2: 1, 3: 1}
    top = {(r["query"], r["neighbour"]) for r in vectors.block_topk(df.where("id = 3"), df, "id", "v", 1, 16).collect()}
    x = np.array([d[2] for d in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x[3]
    c[3] = -2
    assert top == {(3, int(c.argmax()))}


def test_log_mel_peak_and_chunks(spark):
    tone = np.sin(2 * np.pi * 1000 * np.arange(16_000 + 240) / 16_000) * 0.5
    m = frames.log_mel(tone)
    assert m.shape == (100, 80)
    middle = frames.filterbank() @ (np.arange(257) == 32)
    assert m.mean(0).argmax() == middle.argmax()
    whole = frames.log_mel(tone)
    parts = np.vstack([frames.log_mel(tone[: 49 * 160 + 400]), frames.log_mel(tone[50 * 160 :])])
    assert np.allclose(whole, parts)


def test_frame_stack_repeats_the_ends(spark):
    df = spark.createDataFrame([(1, i, [float(i)]) for i in range(4)], "k int, pos int, v array<double>")
    got = frames.stack_frames(df, ["k"], ["pos"], "v", 5, 1).orderBy("pos").collect()
    assert got[0].stacked == [0, 0, 0, 1, 2] and got[3].stacked == [1, 2, 3, 3, 3]


def test_progress_throttle(spark):
    steps = [("a", 0.0), ("a", 0.02), ("a", 0.04), ("a", 0.06), ("b", 0.07), ("b", 0.1), ("b", 1.0)]
    df = spark.createDataFrame([("j", i, s, f) for i, (s, f) in enumerate(steps)], "job_id string, pos long, stage string, fraction double")
    assert [r.pos for r in folds.progress_throttle(df).orderBy("pos").collect()] == [0, 3, 4, 6]
