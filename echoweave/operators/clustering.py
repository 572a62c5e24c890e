"""Clusters over label tables: aligning batches, merging fragments, repairing weak profiles.

A label table has one row per label (and batch) of a job. Folds over it run in
one task for each job; everything with a row per window stays distributed.
Helpers that take a plain list (merge_fragments) fold over one job's table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as X

#: Fixed thresholds.
SAME, DUPLICATE, FRAGMENT, FRAGMENT_MARGIN, LOOSE, REASSIGN_MIN = 0.78, 0.84, 0.74, 0.06, 0.78, 0.40


def align_batches(df: DataFrame, batch: str, label: str, vector: str, least: float = SAME, keys: Sequence[str] = ()) -> DataFrame:
    """Local labels of each batch -> global labels, in batch order: the most alike known centroid, if alike enough, else a new one.

    Centroids are averaged in Spark; a job (keys) folds over its (batch, label) rows in one task.
    """
    job = F.struct(F.lit(0).alias("_"), *(F.col(k) for k in keys))
    key = df.withColumn("_k", F.struct(job.alias("job"), F.col(batch).alias("batch"), F.col(label).alias("label")))
    members = key.groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    table = X.centroids(key, "_k", vector).join(members, "_k").select(*(F.col(f"_k.job.{k}").alias(k) for k in keys), F.col("_k.batch").alias(batch), F.col("_k.label").alias(label), "centroid", "n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values([batch, label])
        table = np.array(pdf["centroid"].tolist(), float).reshape(len(pdf), -1)
        known, norms, sizes, m = np.zeros_like(table), np.zeros(len(pdf)), np.zeros(len(pdf)), 0
        for c, n in zip(table, pdf["n"], strict=True):
            scale = norms[:m] * np.linalg.norm(c)
            scores = known[:m] @ c / np.where(scale == 0, 1.0, scale)
            at = int(np.argmax(scores)) if m else -1
            if at >= 0 and scores[at] >= least:
                known[at] = (known[at] * sizes[at] + c * n) / (sizes[at] + n)
            else:
                at, m = m, m + 1
                known[at] = c
            norms[at], sizes[at] = np.linalg.norm(known[at]), sizes[at] + n
            out.append(at)
        return pdf[[*keys, batch, label]].assign(global_label=out)

    types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    grouped = table.groupBy(*keys) if keys else table.groupBy(F.lit("all"))
    return grouped.applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), f"{batch} {types[batch]}", f"{label} {types[label]}", "global_label long"]))


def merge_fragments(profiles: list[dict], total_ms: int) -> dict[int, int]:
    """profiles(label, centroid, duration_ms, chunks, cohesion) -> into which label each goes.

    While any pair is a duplicate, or one of it is a short loose fragment and one
    of it is clearly most alike a single other, the best such pair merges, the
    shorter into the longer. A profile's cosines and its best two are kept and
    brought up to date for what a merge changed: n^2 numbers, and n^2 steps of
    NumPy for the fragments.
    """
    rows = sorted(profiles, key=lambda p: p["label"])
    m = len(rows)
    x = np.array([p["centroid"] for p in rows], float).reshape(m, -1)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    took, chunks, tight = (np.array([p[c] for p in rows], float) for c in ("duration_ms", "chunks", "cohesion"))
    limit = min(15_000, int(0.03 * total_ms))
    c = unit @ unit.T
    np.fill_diagonal(c, -2.0)
    live, into = np.ones(m, bool), np.arange(m)
    first, second = np.full(m, -2.0), np.full(m, -2.0)

    def best_two(which: np.ndarray) -> None:
        if m > 1:
            top = -np.partition(-c[which], min(1, m - 1), axis=1)[:, :2]
            first[which], second[which] = top[:, 0], top[:, 1]

    best_two(np.arange(m))
    while live.sum() > 1:
        if first.max() >= DUPLICATE:
            a = int(first.argmax())
            b = int(c[a].argmax())
        else:
            clear = live & (np.where(second > -2.0, first - second, 1.0) >= FRAGMENT_MARGIN)
            short = np.flatnonzero(live & (took < limit) & (chunks <= 4) & (tight < LOOSE))
            if not len(short):
                break
            able = np.where(clear[short][:, None] | clear[None, :], c[short], -2.0)
            at = np.unravel_index(able.argmax(), able.shape)
            if able[at] < FRAGMENT:
                break
            a, b = sorted((int(short[at[0]]), int(at[1])))
        keep, gone = (a, b) if took[a] >= took[b] else (b, a)
        w = chunks[keep] + chunks[gone]
        x[keep] = (x[keep] * chunks[keep] + x[gone] * chunks[gone]) / w
        tight[keep] = (tight[keep] * chunks[keep] + tight[gone] * chunks[gone]) / w
        took[keep], chunks[keep] = took[keep] + took[gone], w
        unit[keep] = x[keep] / max(np.linalg.norm(x[keep]), 1e-300)
        touched = np.flatnonzero(live & ((c[:, keep] >= second) | (c[:, gone] >= second)))
        live[gone], into[gone] = False, keep
        new = np.where(live, unit @ unit[keep], -2.0)
        new[keep] = -2.0
        c[gone], c[:, gone], c[keep], c[:, keep] = -2.0, -2.0, new, new
        best_two(np.union1d(touched, np.append(np.flatnonzero(live & (new > second)), [keep, gone])))

    def root(i: int) -> int:
        while into[i] != i:
            i = int(into[i])
        return i

    return {p["label"]: rows[root(i)]["label"] for i, p in enumerate(rows)}


def merged_fragments(profiles: DataFrame, job: str) -> DataFrame:
    """profiles(job, label, centroid, duration_ms, chunks, cohesion, total_ms) -> job, label, into: merge_fragments() in each job."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        into = merge_fragments(pdf.to_dict("records"), int(pdf["total_ms"].iloc[0]))
        return pd.DataFrame({job: pdf[job].iloc[0], "label": list(into), "into": list(into.values())})

    types = {f.name: f.dataType.simpleString() for f in profiles.schema.fields}
    return profiles.groupBy(job).applyInPandas(run, f"{job} {types[job]}, label {types['label']}, into {types['label']}")


def linked_labels(labels: DataFrame, pairs: DataFrame, job: str, label: str) -> DataFrame:
    """labels(job, label), pairs(job, a, b) -> job, label, root: the smallest label that pairs lead to.

    A job's label table is small: its pairs are united in one task, job by job.
    """
    schema = f"{job} {labels.schema[job].dataType.simpleString()}, {label} {labels.schema[label].dataType.simpleString()}, root {labels.schema[label].dataType.simpleString()}"

    def run(key: tuple, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        root = {x: x for x in rows[label]}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(links["_a"], links["_b"], strict=True):
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return pd.DataFrame({job: key[0], label: list(root), "root": [find(x) for x in root]})

    links = pairs.select(F.col(job).alias("_job"), F.col("a").alias("_a"), F.col("b").alias("_b"))  # columns of their own: both tables may come from one
    return labels.groupBy(job).cogroup(links.groupBy("_job")).applyInPandas(run, schema)


def reassign(df: DataFrame, key: str, label: str, vector: str, valid: DataFrame, least: float = REASSIGN_MIN) -> DataFrame:
    """Rows of labels that aren't in valid(label, centroid) go to the most alike valid label, -1 if none is alike enough."""
    lost = df.join(valid.select(label), label, "left_anti")
    found = X.best(X.against_centroids(lost, [key], vector, valid, label), [key])
    found = found.select(F.col(key), F.when(F.col("score") >= least, F.col("label")).otherwise(-1).alias("_to"))
    return df.join(found, key, "left").withColumn("new_label", F.coalesce("_to", F.col(label))).drop("_to")


def keep_if_collapsed(rows: DataFrame, keys: Sequence[str], raw: str, merged: str, name: str = "label", least: int = 30) -> DataFrame:
    """rows with the label to go on with: a job's merged ones, unless they leave fewer than two of at least two, over enough rows; then its raw ones. One aggregate a job."""
    jobs = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(raw).alias("_raw"), F.count_distinct(merged).alias("_merged"))
    back = (F.col("_n") >= least) & (F.col("_raw") >= 2) & (F.col("_merged") < 2)
    return rows.join(jobs.select(*keys, back.alias("_back")), list(keys)).withColumn(name, F.when(F.col("_back"), F.col(raw)).otherwise(F.col(merged))).drop("_back")
