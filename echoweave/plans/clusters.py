"""Whole clustering jobs over the embeddings table: spectrum, k-means, greedy merging, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoweave.operators import clustering, repair, spectra
from echoweave.operators import vectors as X

from .registry import query, r6
from .vectors import edges, emb

S, D = SparkSession, str

#: Eigenvalues of a spectrum, and windows of a job of 750 ms each.
VALUES, WINDOWS, STEP_MS = 12, 125, 750


@query()
def laplacian_spectrum(spark: S, d: D) -> DataFrame:
    """The smallest eigenvalues of the whole table's affinity graph - that of the overlapping batches as one - and the number of clusters that their gaps show."""
    graph = edges(spark, d).groupBy("src", "dst").agg(F.max("w").alias("w"))
    found = spectra.smallest_eigenpairs(graph, VALUES)
    rows = [(i + 1, float(v), spectra.speaker_count(found.values), spectra.degenerate(found.values)) for i, v in enumerate(found.values)]
    return spark.createDataFrame(rows, "pos long, value double, clusters int, degenerate boolean").withColumn("value", r6("value") + 0.0)


@query()
def kmeans_labels(spark: S, d: D) -> DataFrame:
    """The vectors in three clusters by k-means over the whole table, as where a spectrum tells nothing."""
    return spectra.kmeans(emb(spark, d), "vec_id", "embedding", 3)[0].select("vec_id", "label")


def windows(spark: S, d: D) -> DataFrame:
    """Vectors as the windows of jobs: job, pos, start_ms, end_ms, vector, label."""
    start = (F.col("vec_id") % WINDOWS) * STEP_MS
    return emb(spark, d).select(F.floor(F.col("vec_id") / WINDOWS).alias("job"), F.col("vec_id").alias("pos"), start.alias("start_ms"), (start + 2 * STEP_MS).alias("end_ms"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def label_table(spark: S, d: D) -> DataFrame:
    """A job's labels cut in three parts each, with their centroids, members, durations and cohesion."""
    rows = windows(spark, d).withColumn("label", F.col("label") * 3 + F.col("pos") % 3)
    keyed = rows.withColumn("_k", F.struct("job", "label"))
    centers = X.centroids(keyed, "_k", "vector")
    size = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return centers.join(size, "_k").join(X.cohesion(keyed, "_k", "vector", centers).select("_k", "cohesion"), "_k").select("_k.*", "centroid", "members", "duration_ms", "cohesion")


@query()
def label_merges(spark: S, d: D) -> DataFrame:
    """Greedy merging of each job's like labels; parts of one label are alike."""
    return X.merge_labels(label_table(spark, d), "label", keys=("job",)).select("job", "label", "merged")


@query()
def fragment_merges(spark: S, d: D) -> DataFrame:
    """Duplicates and short loose fragments of each job go into the label that they are most alike."""
    p = label_table(spark, d).withColumnRenamed("members", "chunks")
    total = p.groupBy("job").agg(F.sum("duration_ms").alias("total_ms"))
    return clustering.merged_fragments(p.join(total, "job"), "job")


@query("""WITH w AS (SELECT vec_id, vec_id // 125 AS job, label, CASE WHEN vec_id // 125 % 2 = 0 THEN 0 ELSE label % 3 END AS merged FROM embeddings), j AS (SELECT job, count(*) >= 30 AND count(DISTINCT label) >= 2 AND count(DISTINCT merged) < 2 AS back FROM w GROUP BY job)
SELECT vec_id, job, CASE WHEN back THEN label ELSE merged END::BIGINT AS label FROM w JOIN j USING (job)""")
def kept_labels(spark: S, d: D) -> DataFrame:
    """Merged labels of jobs, and the raw ones where merging left a single one."""
    w = windows(spark, d).select(F.col("pos").alias("vec_id"), "job", F.col("label").alias("raw"), F.when(F.col("job") % 2 == 0, 0).otherwise(F.col("label") % 3).alias("merged"))
    return clustering.keep_if_collapsed(w, ["job"], "raw", "merged").select("vec_id", "job", "label")


@query()
def quality_repair(spark: S, d: D) -> DataFrame:
    """Labels of all jobs after the repair of garbage profiles, collapsed coverage and fragments."""
    return repair.repair(windows(spark, d))


PROFILES = """r AS (SELECT vec_id // 125 AS job, label::BIGINT AS label, embedding::DOUBLE[] AS v, (vec_id % 125) * 750 AS lo FROM embeddings),
 c AS (SELECT job, label, list(m ORDER BY d) AS c FROM (SELECT job, label, i AS d, avg(v[i]) AS m FROM r, unnest(range(1, 65)) t(i) GROUP BY job, label, i) GROUP BY job, label),
 s AS (SELECT r.*, list_cosine_similarity(v, c.c) AS cos FROM r JOIN c USING (job, label)),
 k AS (SELECT * FROM s WHERE cos >= 0.42 OR (job, label) NOT IN (SELECT (job, label) FROM s WHERE cos >= 0.42)),
 p AS (SELECT job, label, list(m ORDER BY d) AS c FROM (SELECT job, label, i AS d, avg(v[i]) AS m FROM k, unnest(range(1, 65)) t(i) GROUP BY job, label, i) GROUP BY job, label),
 h AS (SELECT r.job, r.label, avg(list_cosine_similarity(v, p.c)) AS cohesion, count(*) AS chunks, count(*) * 1500 AS duration_ms FROM r JOIN p USING (job, label) GROUP BY 1, 2)"""


@query(f"WITH {PROFILES} SELECT job, label, chunks, duration_ms::BIGINT AS duration_ms, round(cohesion, 6) AS cohesion, count(*) OVER (PARTITION BY job) >= 3 AND duration_ms < 18000 AND cohesion < 0.65 AS garbage FROM h")
def job_profiles(spark: S, d: D) -> DataFrame:
    """Profiles of every job's labels, and which are garbage."""
    return repair.profiles(windows(spark, d)).select("job", "label", "chunks", "duration_ms", r6("cohesion").alias("cohesion"), "garbage")


@query("""WITH s AS (SELECT vec_id // 125 AS job, label, min(vec_id % 125) * 750 AS lo, max(vec_id % 125) * 750 + 1500 AS hi FROM embeddings GROUP BY 1, 2),
 r AS (SELECT *, min(lo) OVER j AS "from", max(hi) OVER j AS "to", row_number() OVER (PARTITION BY job ORDER BY hi - lo DESC, label) AS rank FROM s WINDOW j AS (PARTITION BY job))
SELECT job, bool_or(rank = 1 AND hi - lo >= 0.8 * ("to" - "from") AND lo - "from" <= 0.05 * ("to" - "from")) AND bool_or(rank > 1 AND lo >= "from" + floor(0.3 * ("to" - "from"))) AS collapsed FROM r GROUP BY job""")
def collapsed_jobs(spark: S, d: D) -> DataFrame:
    """Jobs whose widest label spans nearly everything while another only begins late."""
    return repair.collapsed(windows(spark, d))

