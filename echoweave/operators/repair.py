"""Repair of a job's clusters: garbage profiles, collapsed coverage, fragments.

All jobs go through the same rounds together; a job that needs no further round
leaves, and only the others are clustered again. Sums and cosines to centroids
are Spark aggregates over (job, label); a job's clustering is one task, and one
with more rows than an affinity matrix may have is clustered by its vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoweave.functions import vectors as V

from . import clustering
from . import vectors as X
from .stages import materialized

#: Fixed thresholds: rounds, length and cohesion of garbage, rows that a fallback needs, cosine to be reassigned.
ROUNDS, GARBAGE_MS, GARBAGE_COHESION, FALLBACK_ROWS, REASSIGN = 3, 18_000, 0.65, 30, 0.40
#: Coverage that looks collapsed: span of the widest label, its start, start of another, as parts of the whole.
COVERS, STARTS, LATE = 0.80, 0.05, 0.30
#: Clustering: share of edges kept, labels at most; of the first run and of the fallback.
FIRST, FALLBACK = (0.012, 8), (0.05, 15)
MATRIX_ROWS = 4096


def affinity(x: np.ndarray, share: float) -> np.ndarray:
    """Cosines of a job's vectors, each with those that it keeps of its own; 0 else."""
    n = len(x)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    c = np.round(unit @ unit.T, 12)
    p = 6 / n if n * share < 6 else share
    keep = n - min(n, max(0, int((1 - p) * n) if p <= 1 else 0))
    order = np.argsort(-c, axis=1, kind="stable")[:, :keep]
    out = np.zeros((n, n))
    np.put_along_axis(out, order, np.take_along_axis(c, order, 1), 1)
    return out


def clustered(x: np.ndarray, share: float, most: int, forced: int | None = None) -> np.ndarray:
    """Labels of one job's vectors: of its affinity graph, or of the vectors where the matrix would be too large; like labels merged, unless that leaves one."""
    raw = X.spectral(affinity(x, share), x, most=most, forced=forced) if len(x) <= MATRIX_ROWS else X.seeded_kmeans(x, min(len(x), forced or 3))
    into = X.merged_labels({int(k): (x[raw == k].mean(0), int((raw == k).sum())) for k in np.unique(raw)})
    merged = np.array([into[int(k)] for k in raw], int)
    return raw if len(x) >= FALLBACK_ROWS and len(np.unique(raw)) >= 2 and len(np.unique(merged)) < 2 else merged


def reclustered(rows: DataFrame, share: float, most: int) -> DataFrame:
    """rows(job, pos, start_ms, end_ms, vector, label, forced) with new labels; forced: clusters of the job, null for as many as its graph shows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        forced = pdf["forced"].iloc[0]
        return pdf.assign(label=clustered(np.array(pdf["vector"].tolist(), float), share, most, None if pd.isna(forced) else int(forced)))[["job", "pos", "label"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    new = rows.select("job", "pos", "vector", "forced").groupBy("job").applyInPandas(run, f"job {kinds['job']}, pos {kinds['pos']}, label long")
    return rows.drop("label").join(new, ["job", "pos"])


def profiles(rows: DataFrame) -> DataFrame:
    """rows(job, label, ...) -> job, label, centroid, chunks, duration_ms, cohesion, garbage, n (labels of the job). Labels below 0 have none.

    Garbage is a short profile of low cohesion in a job of three or more.
    """
    live = rows.where("label >= 0").withColumn("_k", F.struct("job", "label"))
    p = X.profiles(live, "_k", "vector")
    size = live.groupBy("_k").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("duration_ms"))
    out = p.select("_k", "centroid").join(size, "_k").join(X.cohesion(live, "_k", "vector", p).select("_k", "cohesion"), "_k").select("_k.*", "centroid", "chunks", "duration_ms", "cohesion")
    out = out.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("job")))
    return out.withColumn("garbage", (F.col("n") >= 3) & (F.col("duration_ms") < GARBAGE_MS) & (F.col("cohesion") < GARBAGE_COHESION))


def collapsed(rows: DataFrame) -> DataFrame:
    """job, collapsed: the widest label spans nearly everything from the start while another only begins late."""
    valid = rows.where("end_ms > start_ms")
    spans = valid.groupBy("job", "label").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    job = W.partitionBy("job")
    spans = spans.withColumns({"from": F.min("lo").over(job), "to": F.max("hi").over(job), "rank": F.row_number().over(job.orderBy(F.desc(F.col("hi") - F.col("lo")), "label"))})
    whole: Column = F.col("to") - F.col("from")
    first = (F.col("hi") - F.col("lo") >= COVERS * whole) & (F.col("lo") - F.col("from") <= STARTS * whole)
    return spans.groupBy("job").agg((F.bool_or((F.col("rank") == 1) & first) & F.bool_or((F.col("rank") > 1) & (F.col("lo") >= F.col("from") + F.floor(whole * LATE)))).alias("collapsed"))


def renumbered(rows: DataFrame) -> DataFrame:
    """Labels of 0 and more without gaps in each job; others stay."""
    dense = F.dense_rank().over(W.partitionBy("job", F.col("label") >= 0).orderBy("label")) - 1
    return rows.withColumn("label", F.when(F.col("label") >= 0, dense).otherwise(F.col("label")).cast("long"))


def reassigned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of garbage labels go to the job's most alike healthy label, to -1 if none is alike enough. rows and found (profiles) of the same jobs."""
    bad = found.where("garbage").select("job", "label")
    lost = rows.join(bad, ["job", "label"], "left_semi")
    healthy = found.where("not garbage").select("job", F.col("label").alias("cand"), "centroid")
    scored = lost.join(healthy, "job").select("job", "pos", "cand", V.cosine(F.col("vector"), F.col("centroid")).alias("cos"))
    best = scored.groupBy("job", "pos").agg(F.max(F.struct("cos", (-F.col("cand")).alias("l"))).alias("b")).select("job", "pos", F.when(F.col("b.cos") >= REASSIGN, -F.col("b.l")).otherwise(-1).alias("label"))
    moved = lost.drop("label").join(best, ["job", "pos"], "left").withColumn("label", F.coalesce("label", F.lit(-1)).cast("long"))
    return rows.join(bad, ["job", "label"], "left_anti").unionByName(moved)


def repair(rows: DataFrame) -> DataFrame:
    """rows(job, pos, start_ms, end_ms, vector, label) -> job, pos, label, rounds, fallback.

    Garbage profiles: up to ROUNDS times a job is clustered again into as many
    labels as are healthy; with fewer than two healthy ones, or garbage left in
    the end, its rows are reassigned. Then a job of fewer than two labels or of
    collapsed coverage is clustered anew with more edges (fallback is its reason,
    null for none) if it has enough rows and that finds two labels. At last like
    labels and fragments merge. rounds are the job's rounds of clustering again.
    No rows: none. (job, pos) is a key; null vectors are left out.
    """
    state = materialized(rows.where("vector is not null").select("job", "pos", "start_ms", "end_ms", F.transform("vector", lambda v: v.cast("double")).alias("vector"), F.col("label").cast("long").alias("label"), F.lit(0).alias("rounds")))
    columns, done = state.columns, None

    def leave(df: DataFrame) -> None:
        nonlocal done
        done = df.select(*columns) if done is None else done.unionByName(df.select(*columns))

    for round_ in range(ROUNDS + 1):
        found = materialized(profiles(state))
        jobs = found.groupBy("job").agg(F.count_if("garbage").alias("bad"), F.count_if(~F.col("garbage")).alias("healthy"))
        again = jobs.where("bad > 0 and healthy >= 2").select("job", F.col("healthy").alias("forced"))
        local = jobs.where("bad > 0 and healthy < 2").select("job")
        if round_ == ROUNDS:
            again, local = again.where("false"), jobs.where("bad > 0").select("job")
        leave(state.join(jobs.where("bad > 0").select("job"), "job", "left_anti"))
        leave(renumbered(reassigned(state.join(local, "job", "left_semi"), found.join(local, "job", "left_semi"))))
        if again.isEmpty():
            break
        state = materialized(reclustered(state.join(again, "job"), *FIRST).withColumn("rounds", F.col("rounds") + 1).select(*columns))
    state = materialized(done)

    labels = state.groupBy("job").agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("labels"), F.count(F.lit(1)).alias("n"))
    reason = F.when(F.col("labels") < 2, "few labels").when(F.col("collapsed"), "collapsed coverage")
    weak = materialized(labels.join(collapsed(state), "job", "left").select("job", "n", reason.alias("fallback")).where("fallback is not null"))
    tried = state.join(weak.where(F.col("n") >= FALLBACK_ROWS).select("job"), "job").withColumn("forced", F.lit(None).cast("int"))
    tried = materialized(reclustered(tried, *FALLBACK).select(*columns))
    better = tried.groupBy("job").agg(F.count_distinct("label").alias("k")).where("k >= 2").select("job")
    state = materialized(state.join(better, "job", "left_anti").unionByName(tried.join(better, "job", "left_semi")))

    total = state.groupBy("job").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("total_ms"))
    merged = clustering.merged_fragments(profiles(state).join(total, "job").select("job", "label", "centroid", "duration_ms", "chunks", "cohesion", "total_ms"), "job")
    state = state.join(merged, ["job", "label"], "left").withColumn("label", F.coalesce("into", "label")).drop("into")
    return renumbered(state).join(weak.select("job", "fallback"), "job", "left").select("job", "pos", "label", "rounds", "fallback")
