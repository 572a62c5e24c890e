"""Vectors, evidence, graphs and clustering over the embeddings table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoweave.functions import vectors as V
from echoweave.functions.hashing import fingerprint_id
from echoweave.operators import catalog, clustering, frames, runs, stages, votes
from echoweave.operators import vectors as X
from echoweave.sources import match_index

from .registry import HOUR, KEYS, ORDER, TOK, query, r6, table, tokens

S, D = SparkSession, str

CENT = """c AS (SELECT label, list(m ORDER BY d) AS centroid FROM (SELECT label, i AS d, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) t(i) GROUP BY label, i) GROUP BY label)"""
COS = "list_cosine_similarity(e.embedding::DOUBLE[], c.centroid)"
PROF = f"""WITH {CENT}, s AS (SELECT e.vec_id, e.label, e.embedding, {COS} AS cos FROM embeddings e JOIN c USING (label)),
 k AS (SELECT * FROM s WHERE cos >= 0.42 OR label NOT IN (SELECT label FROM s WHERE cos >= 0.42)),
 p AS (SELECT label, list(m ORDER BY d) AS centroid FROM (SELECT label, i AS d, avg(embedding[i]::DOUBLE) AS m FROM k, unnest(range(1, 65)) t(i) GROUP BY label, i) GROUP BY label),
 n AS (SELECT label, count(*) AS members FROM k GROUP BY label),
 h AS (SELECT e.label, avg(list_cosine_similarity(e.embedding::DOUBLE[], p.centroid)) AS cohesion FROM embeddings e JOIN p USING (label) GROUP BY e.label)
"""
SCORES = f"WITH {CENT}, s AS (SELECT e.vec_id, c.label AS cand, {COS} AS score FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cand) AS k FROM s)"


def emb(spark: S, d: D) -> DataFrame:
    return table(spark, d, "embeddings")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def l2_normalize(spark: S, d: D) -> DataFrame:
    return emb(spark, d).select("vec_id", r6(V.norm(F.col("embedding"))).alias("norm"), r6(F.get(V.normalized(F.col("embedding")), 0)).alias("first"))


@query("SELECT count(*) AS n, sum(CASE WHEN len(embedding) <> 64 THEN 1 ELSE 0 END)::BIGINT AS bad_shape, sum(CASE WHEN len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 THEN 1 ELSE 0 END)::BIGINT AS not_finite, sum(CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) <= 1e-20::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS zero_norm FROM embeddings")
def vector_validation(spark: S, d: D) -> DataFrame:
    v = F.col("embedding")
    bad = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return emb(spark, d).agg(F.count(F.lit(1)).alias("n"), bad(F.size(v) != 64).alias("bad_shape"), bad(~V.all_finite(v)).alias("not_finite"), bad(V.dot(v, v) <= 1e-20).alias("zero_norm"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite FROM embeddings")
def finite_check(spark: S, d: D) -> DataFrame:
    return emb(spark, d).select("vec_id", V.all_finite(F.col("embedding")).alias("finite"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: isfinite(CASE WHEN x < 0 THEN 'inf'::FLOAT ELSE x END)))::INT AS kept FROM embeddings")
def drop_nonfinite(spark: S, d: D) -> DataFrame:
    """Scores by position with every score that isn't finite left out; negative ones stand for such."""
    scores = F.map_from_entries(F.transform("embedding", lambda x, i: F.struct(i, F.when(x < 0, F.lit(float("inf"))).otherwise(x.cast("double")))))
    return emb(spark, d).select("vec_id", F.size(F.map_filter(scores, lambda k, v: V.is_finite(v))).alias("kept"))


@query("SELECT vec_id, round(list_avg(list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x: isfinite(x))), 6) AS mean FROM embeddings")
def finite_mean(spark: S, d: D) -> DataFrame:
    return emb(spark, d).select("vec_id", r6(V.finite_mean(F.transform("embedding", lambda x: x.cast("double")))).alias("mean"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS token FROM embeddings")
def argmax_decode(spark: S, d: D) -> DataFrame:
    return emb(spark, d).select("vec_id", V.argmax(F.col("embedding")).alias("token"))


@query("WITH p AS (SELECT vec_id, 1 / list_sum(list_transform(embedding, lambda x: exp(20 * x::DOUBLE - 20 * list_max(embedding)::DOUBLE))) AS p FROM embeddings) SELECT vec_id, round(p, 6) AS p, p >= 0.2::DOUBLE AS pass FROM p")
def softmax_gate(spark: S, d: D) -> DataFrame:
    p = V.softmax_of_max(F.transform("embedding", lambda x: 20 * x.cast("double")))
    return emb(spark, d).select("vec_id", r6(p).alias("p"), (p >= 0.2).alias("pass"))


@query("WITH m AS (SELECT label, i AS d, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) t(i) GROUP BY label, i) SELECT e.vec_id, e.label, round(sum((e.embedding[m.d]::DOUBLE - m.m) * m.d), 6) AS checksum FROM embeddings e JOIN m USING (label) GROUP BY e.vec_id, e.label")
def mean_normalize_vectors(spark: S, d: D) -> DataFrame:
    t = X.mean_normalize(emb(spark, d), ["label"], "vec_id", "embedding")
    return t.select("vec_id", "label", r6(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)).alias("checksum"))


@query(f"WITH {CENT} SELECT label, round(sqrt(list_sum(list_transform(centroid, lambda x: x * x))), 6) AS norm, round(centroid[1], 6) AS first FROM c")
def label_centroids(spark: S, d: D) -> DataFrame:
    return X.centroids(emb(spark, d), "label", "embedding").select("label", r6(V.norm(F.col("centroid"))).alias("norm"), r6(F.get("centroid", 0)).alias("first"))


@query(PROF + "SELECT label, members, members * 1500 AS duration_ms, round(sqrt(list_sum(list_transform(centroid, lambda x: x * x))), 6) AS norm FROM p JOIN n USING (label)")
def profile_build(spark: S, d: D) -> DataFrame:
    return X.profiles(emb(spark, d), "label", "embedding").select("label", "members", (F.col("members") * 1500).alias("duration_ms"), r6(V.norm(F.col("centroid"))).alias("norm"))


@query(PROF + "SELECT label, round(cohesion, 6) AS cohesion FROM h")
def profile_cohesion(spark: S, d: D) -> DataFrame:
    e = emb(spark, d)
    return X.cohesion(e, "label", "embedding", X.profiles(e, "label", "embedding")).select("label", r6("cohesion").alias("cohesion"))


@query(PROF + "SELECT label, members, round(cohesion, 6) AS cohesion, (SELECT count(*) FROM n) >= 3 AND members * 1500 < 75000 AND cohesion < 0.65 AS garbage FROM n JOIN h USING (label)")
def profile_quality(spark: S, d: D) -> DataFrame:
    e = emb(spark, d)
    p = X.profiles(e, "label", "embedding")
    q = p.select("label", "members").join(X.cohesion(e, "label", "embedding", p).select("label", "cohesion"), "label")
    many = p.agg(F.count(F.lit(1)).alias("k")).select(F.col("k") >= 3).scalar()
    return q.select("label", "members", r6("cohesion").alias("cohesion"), (many & (F.col("members") * 1500 < 75_000) & (F.col("cohesion") < X.GARBAGE_COHESION)).alias("garbage"))


def scores(spark: S, d: D) -> DataFrame:
    e = emb(spark, d)
    return X.against_centroids(e, ["vec_id"], "embedding", X.centroids(e, "label", "embedding"), "label")


@query(SCORES + " SELECT vec_id, cand AS label, round(score, 6) AS score FROM r WHERE k = 1")
def nearest_centroid(spark: S, d: D) -> DataFrame:
    return X.best(scores(spark, d), ["vec_id"]).select("vec_id", F.col("label").cast("int").alias("label"), r6("score").alias("score"))


@query(f"""WITH {CENT}, s AS (SELECT e.vec_id, c.label AS cand, list_sum(list_transform(list_zip(e.embedding, c.centroid), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS score FROM embeddings e, c)
SELECT vec_id, arg_min(cand, (score, cand)) AS label, round(min(score), 6) AS score FROM s GROUP BY vec_id""")
def kmeans_assign(spark: S, d: D) -> DataFrame:
    e = emb(spark, d)
    t = X.against_centroids(e.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), ["vec_id"], "embedding", X.centroids(e, "label", "embedding"), "label", X.squared_distance)
    return X.best(t, ["vec_id"], largest=False).select("vec_id", F.col("label").cast("int").alias("label"), r6("score").alias("score"))


@query(SCORES + " SELECT a.vec_id, a.cand AS top_label, round(a.score, 6) AS top_score, round(a.score - coalesce(b.score, 0), 6) AS margin FROM r a LEFT JOIN r b ON a.vec_id = b.vec_id AND b.k = 2 WHERE a.k = 1")
def evidence_margin(spark: S, d: D) -> DataFrame:
    return votes.evidence_margin(scores(spark, d), ["vec_id"], "cand", "score").select("vec_id", "top_label", r6("top_score").alias("top_score"), r6("margin").alias("margin"))


ROUTE = ", e2 AS (SELECT a.vec_id, a.cand AS top_label, a.score AS top_score, a.score - coalesce(b.score, 0) AS margin FROM r a LEFT JOIN r b ON a.vec_id = b.vec_id AND b.k = 2 WHERE a.k = 1), d AS (SELECT *, CASE WHEN top_score < 0.40 THEN 'other' WHEN top_score >= 0.45 AND margin >= 0.08 THEN 'accepted' ELSE 'deferred' END AS disposition FROM e2)"


@query(SCORES + ROUTE + " SELECT vec_id, top_label, disposition FROM d")
def token_route(spark: S, d: D) -> DataFrame:
    return votes.token_route(votes.evidence_margin(scores(spark, d), ["vec_id"], "cand", "score")).select("vec_id", "top_label", "disposition")


@query(SCORES + ROUTE + " SELECT disposition, count(*) AS n FROM d GROUP BY disposition")
def disposition_counts(spark: S, d: D) -> DataFrame:
    return token_route(spark, d).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


EVID = f"""WITH {TOK}, nv AS (SELECT count(*) AS n FROM embeddings), {CENT},
 s AS (SELECT e.vec_id, c.label AS cand, {COS} AS cos FROM embeddings e, c),
 ev AS (SELECT t.user_id, s.cand, sum(s.cos * t.value) / sum(t.value) AS score, sum(t.value) AS support FROM tok t, nv JOIN s ON t.event_id % nv.n = s.vec_id GROUP BY t.user_id, s.cand)
"""


def evidence(spark: S, d: D) -> DataFrame:
    """Events hold windows of the embeddings, dealt round; weight is the event's value."""
    n = emb(spark, d).agg(F.count(F.lit(1)).alias("n")).scalar()
    t = tokens(spark, d).withColumn("vec_id", F.col("event_id") % n)
    return votes.token_evidence(t.join(scores(spark, d), "vec_id"), ["user_id"], "cand", "score", "value")


@query(EVID + "SELECT user_id, cand AS label, round(score, 6) AS score, round(support, 4) AS support FROM ev")
def token_evidence(spark: S, d: D) -> DataFrame:
    return evidence(spark, d).select("user_id", F.col("cand").alias("label"), r6("score").alias("score"), F.round("support", 4).alias("support"))


@query(EVID + "SELECT user_id, arg_max(cand, (round(score, 9), -cand)) AS label, round(max(score), 6) AS score FROM ev GROUP BY user_id")
def score_sum_winner(spark: S, d: D) -> DataFrame:
    t = evidence(spark, d).withColumn("score", F.round("score", 9))
    return X.best(t, ["user_id"]).select("user_id", F.col("label").cast("int").alias("label"), r6("score").alias("score"))


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
 p AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_cosine_similarity(q.x, r.x), 9) AS cos FROM n q JOIN n r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, neighbour, round(cos, 6) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cos DESC, neighbour) AS rank FROM p) WHERE rank <= 3""")
def cosine_topk(spark: S, d: D) -> DataFrame:
    """Queries: every row whose id is divisible by 20, against all rows."""
    e = emb(spark, d)
    return X.block_topk(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 3).select("query", "neighbour", r6("cos").alias("cos"), "rank")


PAIRS = f"WITH {CENT}, p AS (SELECT a.label AS a, b.label AS b, list_cosine_similarity(a.centroid, b.centroid) AS cos FROM c a JOIN c b ON a.label < b.label)"


def pairs(spark: S, d: D) -> DataFrame:
    return X.label_pairs(X.centroids(emb(spark, d), "label", "embedding"), "label")


@query(PAIRS + " SELECT a, b, round(cos, 6) AS cos FROM p")
def cosine_matrix(spark: S, d: D) -> DataFrame:
    return pairs(spark, d).select("a", "b", r6("cos").alias("cos"))


@query(PAIRS + " SELECT a, b, round(cos, 6) AS cos FROM p ORDER BY p.cos DESC, a, b LIMIT 1")
def best_merge_pair(spark: S, d: D) -> DataFrame:
    return pairs(spark, d).orderBy(F.desc("cos"), "a", "b").limit(1).select("a", "b", r6("cos").alias("cos"))


@query(PAIRS + ", n AS (SELECT label, count(*) AS k FROM embeddings GROUP BY label) SELECT p.a, p.b, cos >= 0.84 AS duplicate, cos >= 0.74 AND least(x.k, y.k) <= 60 AS fragment FROM p JOIN n x ON p.a = x.label JOIN n y ON p.b = y.label")
def fragment_pairs(spark: S, d: D) -> DataFrame:
    n = emb(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    t = pairs(spark, d).join(n.select(F.col("label").alias("a"), F.col("k").alias("ka")), "a").join(n.select(F.col("label").alias("b"), F.col("k").alias("kb")), "b")
    return t.select("a", "b", (F.col("cos") >= 0.84).alias("duplicate"), ((F.col("cos") >= 0.74) & (F.least("ka", "kb") <= 60)).alias("fragment"))


BOTH = ", q AS (SELECT a AS label, b AS other, cos FROM p UNION ALL SELECT b, a, cos FROM p)"


def both_ways(spark: S, d: D) -> DataFrame:
    p = pairs(spark, d)
    return p.select(F.col("a").alias("label"), F.col("b").alias("other"), "cos").unionByName(p.select(F.col("b").alias("label"), F.col("a").alias("other"), "cos"))


@query(PAIRS + BOTH + ", k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos DESC, other) AS r FROM q) SELECT label, round(max(CASE WHEN r = 1 THEN cos END) - max(CASE WHEN r = 2 THEN cos END), 6) AS margin FROM k GROUP BY label")
def similarity_margin(spark: S, d: D) -> DataFrame:
    t = both_ways(spark, d).withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("cos"), "other")))
    return t.groupBy("label").agg(r6(F.max(F.when(F.col("r") == 1, F.col("cos"))) - F.max(F.when(F.col("r") == 2, F.col("cos")))).alias("margin"))


@query(PAIRS + BOTH + """, w AS (SELECT label, CASE WHEN label = 9 THEN 9 ELSE label % 4 END AS person FROM c), z AS (SELECT person, count(*) AS n FROM w GROUP BY person),
 m AS (SELECT q.label, max(cos) AS sibling FROM q JOIN w a ON q.label = a.label JOIN w b ON q.other = b.label WHERE a.person = b.person GROUP BY q.label)
SELECT w.label, round(sibling, 6) AS sibling, CASE WHEN n < 2 OR sibling IS NULL THEN 'gray' WHEN sibling < CASE WHEN n = 2 THEN 0.50 ELSE 0.75 END THEN 'red' ELSE 'green' END AS health FROM w JOIN z USING (person) LEFT JOIN m USING (label)""")
def profile_health(spark: S, d: D) -> DataFrame:
    """Labels dealt to people: three of two or three profiles, one of a single one."""
    persons = emb(spark, d).select("label").distinct().withColumn("person", F.when(F.col("label") == 9, 9).otherwise(F.col("label") % 4))
    return X.profile_health(both_ways(spark, d), persons).select("label", r6("sibling").alias("sibling"), "health")


@query(PAIRS + BOTH + ", k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos DESC, other) AS rank FROM q) SELECT label, other, rank, CASE WHEN cos > 0.8 THEN 'high' WHEN cos > 0.6 THEN 'medium' ELSE 'low' END AS bucket FROM k WHERE rank <= 3")
def suggestions(spark: S, d: D) -> DataFrame:
    t = both_ways(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("cos"), "other")).cast("long")).where("rank <= 3")
    return t.select("label", "other", "rank", F.when(F.col("cos") > 0.8, "high").when(F.col("cos") > 0.6, "medium").otherwise("low").alias("bucket"))


#: Batches of 4,096 vectors, the last 256 of one the first of the next.
EDGES = """WITH o AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS total FROM embeddings),
 n AS (SELECT unnest(range(greatest(0, floor((pos - 4096) / 3840.0)::BIGINT + 1), least(pos // 3840, CASE WHEN total <= 4096 THEN 0 ELSE ceil((total - 256) / 3840.0)::BIGINT - 1 END) + 1)) AS batch, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM o),
 p AS (SELECT a.batch, a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.x, b.x), 12) AS w FROM n a JOIN n b ON a.batch = b.batch),
 e AS (SELECT batch, src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY batch, src ORDER BY w DESC, dst) AS k FROM p) WHERE k <= 6),
 y AS (SELECT batch, src, dst, sum(w) / 2 AS w FROM (SELECT * FROM e UNION ALL SELECT batch, dst, src, w FROM e) GROUP BY batch, src, dst)
"""


def batches(spark: S, d: D) -> DataFrame:
    rows = catalog.positioned(emb(spark, d).select("vec_id", "embedding"), [F.col("vec_id")])
    return X.batched(rows.withColumn("pos", F.col("pos") - 1), "pos").drop("pos")


def edges(spark: S, d: D) -> DataFrame:
    """Affinity graph inside the overlapping batches: six edges a node, itself included."""
    return X.top_edges(batches(spark, d).select("batch", "vec_id", "embedding"), "batch", "vec_id", "embedding", 6)


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
 p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.x, b.x), 12) AS w FROM n a, n b)
SELECT src, dst, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM p) WHERE k <= 6""")
def topp_graph(spark: S, d: D) -> DataFrame:
    """Affinity graph of the whole table: six edges a node, itself included, to the most alike of all nodes."""
    return X.nearest_edges(emb(spark, d), "vec_id", "embedding", 6).select("src", "dst", r6("w").alias("w"))


@query(EDGES + "SELECT batch, src, round(sum(abs(w)), 6) AS degree, count(*) AS neighbours FROM y WHERE src <> dst GROUP BY batch, src")
def graph_laplacian(spark: S, d: D) -> DataFrame:
    return X.laplacian_degrees(edges(spark, d), ["batch"]).select("batch", "src", r6("degree").alias("degree"), "neighbours")


@query(EDGES + "SELECT batch, src, round(sum(w * (dst % 7)), 6) AS y FROM y GROUP BY batch, src")
def spmv(spark: S, d: D) -> DataFrame:
    sym = X.symmetrized(edges(spark, d), ["batch"])
    v = batches(spark, d).select("batch", F.col("vec_id").alias("node"), (F.col("vec_id") % 7).alias("x"))
    return X.spmv(sym, ["batch"], v).select("batch", "src", r6("y").alias("y"))


@query()
def spectral_labels(spark: S, d: D) -> DataFrame:
    """Clusters of each batch, brought to one numbering by their centroids; a vector of two batches has the label of the first."""
    rows = batches(spark, d)
    # read three times below: each would solve all batches again
    of = stages.materialized(X.spectral_labels(X.top_edges(rows, "batch", "vec_id", "embedding", 6), "batch", rows=(rows, "vec_id", "embedding")))
    vectors = emb(spark, d).select(F.col("vec_id").alias("node"), "embedding")
    one = clustering.align_batches(of.join(vectors, "node"), "batch", "label", "embedding")
    return of.join(one, ["batch", "label"]).groupBy(F.col("node").alias("vec_id")).agg(F.min_by("global_label", "batch").alias("label"))


@query("WITH g AS (SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS i, lead(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) - s_acctbal AS gap FROM supplier) SELECT i AS k, round(gap, 6) AS gap FROM g WHERE i >= 2 AND gap IS NOT NULL ORDER BY g.gap DESC, i LIMIT 1")
def eigengap_k(spark: S, d: D) -> DataFrame:
    """Suppliers' balances stand for eigenvalues, a short list; the largest gap from rank 2 on, the first on a tie."""
    t = catalog.positioned(table(spark, d, "supplier").select("s_acctbal", "s_suppkey"), [F.col("s_acctbal"), F.col("s_suppkey")], "k")
    after = t.select((F.col("k") - 1).alias("k"), F.col("s_acctbal").alias("_next"))
    g = t.join(after, "k").withColumn("gap", F.col("_next") - F.col("s_acctbal"))
    return g.where("k >= 2 and gap is not null").orderBy(F.desc("gap"), "k").limit(1).select("k", r6("gap").alias("gap"))


@query("SELECT vec_id, (dense_rank() OVER (ORDER BY label) - 1)::INT AS new_label FROM embeddings")
def dense_relabel(spark: S, d: D) -> DataFrame:
    return runs.dense_relabel(emb(spark, d), "label").select("vec_id", "new_label")


@query("WITH f AS (SELECT label, row_number() OVER (ORDER BY min(vec_id), label) - 1 AS new_label FROM embeddings GROUP BY label) SELECT vec_id, new_label FROM embeddings JOIN f USING (label)")
def relabel_first_seen(spark: S, d: D) -> DataFrame:
    return runs.relabel_first_seen(emb(spark, d), "label", "vec_id").select("vec_id", "new_label")


@query("""WITH s AS (SELECT label, min(vec_id) * 750 AS lo, max(vec_id) * 750 + 1500 AS hi, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT max(hi) AS total FROM s),
 b AS (SELECT * FROM s ORDER BY n DESC, label LIMIT 1)
SELECT b.label, b.hi - b.lo >= 0.8 * t.total AND b.lo <= 0.05 * t.total AND (SELECT count(*) FROM s WHERE s.label <> b.label AND s.lo >= 0.3 * t.total) > 0 AS collapsed FROM b, t""")
def collapse_check(spark: S, d: D) -> DataFrame:
    """Does the biggest label span nearly everything from the start while another only begins late?"""
    s = emb(spark, d).groupBy("label").agg((F.min("vec_id") * 750).alias("lo"), (F.max("vec_id") * 750 + 1500).alias("hi"), F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("label", "lo", "hi"), F.struct("n", (-F.col("label")).alias("l"))).alias("b")
    one = s.agg(best, F.max("hi").alias("total"), F.collect_list(F.struct("label", "lo")).alias("all"))
    late = F.exists("all", lambda x: (x["label"] != F.col("b.label")) & (x["lo"] >= 0.3 * F.col("total")))
    return one.select("b.label", ((F.col("b.hi") - F.col("b.lo") >= 0.8 * F.col("total")) & (F.col("b.lo") <= 0.05 * F.col("total")) & late).alias("collapsed"))


PERSON = f"WITH {CENT}, m AS (SELECT c.label AS target, e.label AS person, {COS} AS cos FROM embeddings e JOIN c ON e.label <> c.label), g AS (SELECT target, person, max(cos) AS best, min(cos) AS worst, count(*) AS n FROM m GROUP BY target, person)"


@query(PERSON + " SELECT target, person, round(best, 6) AS best, round(worst, 6) AS worst, n FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(best, 9) DESC, person) AS r FROM g) WHERE r <= 3")
def person_topn(spark: S, d: D) -> DataFrame:
    """For every label as the target, the three other labels (people) with the most alike vector."""
    e = emb(spark, d)
    t = X.against_centroids(e, ["vec_id", "label"], "embedding", X.centroids(e, "label", "embedding"), "label").where("label <> cand")
    g = t.groupBy(F.col("cand").alias("target"), F.col("label").alias("person")).agg(F.max("score").alias("best"), F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))
    r = g.withColumn("r", F.row_number().over(W.partitionBy("target").orderBy(F.desc(F.round("best", 9)), "person"))).where("r <= 3")
    return r.select("target", "person", r6("best").alias("best"), r6("worst").alias("worst"), "n")


@query(SCORES + " SELECT vec_id, cand, round(score, 6) AS score FROM s WHERE vec_id >= 10")
def incremental_index(spark: S, d: D) -> DataFrame:
    """Old index of vec_id >= 0 with stale multiples of seven: rows of removed ids (below 10) go, changed ones are computed again, the rest is kept."""
    e = emb(spark, d)
    c = X.centroids(e, "label", "embedding")
    old = X.against_centroids(e, ["vec_id"], "embedding", c, "label").withColumn("score", F.when(F.col("vec_id") % 7 == 0, F.lit(0.0)).otherwise(F.col("score")))
    now = e.where("vec_id >= 10")
    changed = now.where("vec_id % 7 = 0")
    kept = old.join(now.select("vec_id"), "vec_id", "left_semi").join(changed.select("vec_id"), "vec_id", "left_anti")
    return kept.unionByName(X.against_centroids(changed, ["vec_id"], "embedding", c, "label")).select("vec_id", "cand", r6("score").alias("score"))


@query(SCORES + ", q AS (SELECT vec_id AS target, cand % 4 AS person, max(score) AS score, arg_max(cand, score) AS candidate FROM s WHERE vec_id IN (7, 42) GROUP BY 1, 2) SELECT target, person, round(score, 6) AS score, candidate, row_number() OVER (PARTITION BY target ORDER BY q.score DESC, person) AS rank FROM q QUALIFY rank <= 3")
def index_matches(spark: S, d: D) -> DataFrame:
    """Matches of two targets from an index on disk that was written with old scores and brought up to date; each look-up reads one bucket."""
    path = f"{stages.shared_folder(spark)}/match-index-{uuid.uuid4().hex}"
    now = scores(spark, d).select(F.col("vec_id").alias("target"), F.col("cand").alias("candidate"), (F.col("cand") % 4).alias("person"), "score")
    stale = (F.col("target") % 7 == 0) | (F.col("target") == 42)
    match_index.write_index(now.withColumn("score", F.when(stale, F.lit(0.5)).otherwise(F.col("score"))), path, buckets=16)
    match_index.update_index(spark, path, now.where(stale), spark.createDataFrame([], "id long"), buckets=16)
    index = match_index.read_index(spark, path)
    found = [match_index.matches(index, target, 3, buckets=16).withColumn("target", F.lit(target).cast("long")) for target in (7, 42)]
    return found[0].unionByName(found[1]).select("target", "person", r6("score").alias("score"), "candidate", "rank")


@query()
def fingerprint(spark: S, d: D) -> DataFrame:
    return emb(spark, d).select("vec_id", fingerprint_id(F.col("embedding")).alias("fingerprint"))


@query(f"""WITH {TOK}, f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sm, event_id) - 1 AS frame_id, value FROM tok)
SELECT user_id, frame_id // 100 AS window_id, count(*)::INT AS n, round(sum(value * (frame_id % 100 + 1)), 4) AS checksum FROM f GROUP BY user_id, frame_id // 100""")
def window_materialize(spark: S, d: D) -> DataFrame:
    """Windows of two spans of 50 frames each, gathered into blocks of 148 with zeros behind."""
    f = tokens(spark, d).select("user_id", (F.row_number().over(runs.ordered(KEYS, ORDER)) - 1).cast("long").alias("frame_id"), "value")
    half = f.select("user_id", F.floor(F.col("frame_id") / 50).alias("h")).distinct()
    spans = half.select("user_id", F.floor(F.col("h") / 2).alias("window_id"), (F.col("h") * 50).alias("src_lo"), (F.col("h") * 50 + 50).alias("src_hi"), (F.col("h") % 2 * 50).alias("dst_lo"))
    out = frames.materialize(spans, f, KEYS)
    return out.select("user_id", "window_id", "n", F.round(F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("checksum"))


@query()
def fbank_frames(spark: S, d: D) -> DataFrame:
    """Log-mel frames of a tone for each supplier: two chunks of a second, overlapping by a frame less a shift."""
    rate, n = 16_000, 16_240
    freq = 200 + (F.col("s_suppkey") % 50) * 50
    t = lambda chunk: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin((i + chunk * 16_000) * freq * (2 * 3.141592653589793 / rate)) * 0.5)
    suppliers = table(spark, d, "supplier")
    # a small file is one task's, but its frames are many
    suppliers = suppliers.repartition(max(spark.sparkContext.defaultParallelism, suppliers.count() // 500), "s_suppkey")
    chunk = suppliers.select(F.col("s_suppkey").cast("string").alias("job_id"), "s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk"))
    mel = frames.fbank_frames(chunk.select("job_id", (F.col("chunk") * 100).cast("long").alias("first_frame"), t(F.col("chunk")).alias("samples")))
    return mel.select("job_id", "frame_id", V.argmax(F.col("mel")).alias("peak_bin"), r6(V.finite_mean(F.col("mel"))).alias("energy"))


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type), t AS (SELECT user_id, sum(c)::BIGINT AS total, max(c) AS votes, arg_min(event_type, (-c, event_type)) AS winner FROM v GROUP BY user_id)
SELECT user_id, winner, votes, total, round(votes / total, 6) AS ratio, votes / total >= 0.3 AS direct FROM t""")
def vote_majority(spark: S, d: D) -> DataFrame:
    t = votes.vote_majority(table(spark, d, "events"), KEYS, "event_type", 0.3)
    return t.select("user_id", "winner", "votes", "total", r6("ratio").alias("ratio"), "direct")


@query(f"""WITH {TOK}, v AS (SELECT user_id, sm // 86400000 AS day, event_type, count(*) AS c FROM tok GROUP BY ALL),
 p AS (SELECT user_id, day, sum(c)::BIGINT AS total, max(c) AS votes, arg_min(event_type, (-c, event_type)) AS label FROM v GROUP BY user_id, day),
 s AS (SELECT *, CASE WHEN votes / total >= 0.6 THEN 'direct' WHEN total >= 6 THEN 'other' ELSE 'pending' END AS status, votes / total AS ratio FROM p),
 g AS (SELECT user_id, CASE WHEN bool_or(status = 'other') THEN 'other' WHEN bool_or(status = 'pending') OR count(DISTINCT label) <> 1 THEN 'pending' ELSE 'direct' END AS status, min(label) AS l, sum(votes)::BIGINT AS votes, max(ratio) AS max_ratio, sum(ratio * votes) / sum(votes) AS avg_margin FROM s GROUP BY user_id)
SELECT user_id, status, CASE WHEN status = 'direct' THEN l END AS label, votes, round(max_ratio, 9) AS max_ratio, round(avg_margin, 9) AS avg_margin FROM g""")
def status_rollup(spark: S, d: D) -> DataFrame:
    """Day-level votes of a user rolled up to one status."""
    t = tokens(spark, d).withColumn("day", F.floor(F.col("sm") / (24 * HOUR)))
    p = votes.vote_majority(t, ["user_id", "day"], "event_type")
    p = p.select("user_id", F.col("winner").alias("label"), "votes", "ratio", F.col("ratio").alias("margin"), F.when(F.col("direct"), "direct").when(F.col("total") >= 6, "other").otherwise("pending").alias("status"))
    return votes.status_rollup(p, KEYS).withColumns({c: F.round(c, 9) for c in ("max_ratio", "avg_margin")})


@query("SELECT user_id, event_type AS label, round(sum(value * greatest(event_id % 5, 1)) / sum(greatest(event_id % 5, 1)), 9) AS mean FROM events GROUP BY user_id, event_type")
def weighted_mean(spark: S, d: D) -> DataFrame:
    w = F.greatest(F.col("event_id") % 5, F.lit(1))
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 9).alias("mean"))


@query(SCORES + """, f AS (SELECT vec_id, label AS final FROM embeddings), a AS (SELECT s.* FROM s JOIN f USING (vec_id) WHERE NOT (f.final IN (0, 3) AND s.cand IN (0, 3))),
 b AS (SELECT vec_id, arg_max(cand, (round(score, 9), -cand)) AS best FROM a GROUP BY vec_id) SELECT f.vec_id, CASE WHEN final IN (0, 3) THEN best ELSE final END AS effective FROM f JOIN b USING (vec_id)""")
def split_reassign(spark: S, d: D) -> DataFrame:
    t = scores(spark, d).withColumn("score", F.round("score", 9)).join(emb(spark, d).select("vec_id", F.col("label").alias("final")), "vec_id")
    return votes.split_reassign(t, ["vec_id"], "cand", "score", "final", [0, 3]).select("vec_id", "effective")


@query(SCORES + ", p AS (SELECT e.label, r.cand, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, cand) AS q FROM r JOIN embeddings e USING (vec_id) WHERE r.cand <> e.label) r JOIN embeddings e USING (vec_id) WHERE q = 1 GROUP BY e.label, r.cand) SELECT label, cand AS target, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share, n / sum(n) OVER (PARTITION BY label) > 0.7 AS dominant FROM p")
def split_preview(spark: S, d: D) -> DataFrame:
    """For every label, if it were split: where its vectors would go."""
    t = scores(spark, d).withColumn("score", F.round("score", 9)).join(emb(spark, d).select("vec_id", "label"), "vec_id").where("cand <> label")
    to = t.groupBy("vec_id", "label").agg(F.max_by("cand", F.struct("score", (-F.col("cand")).alias("c"))).alias("target"))
    return votes.split_preview(to, "label", "target").withColumn("share", r6("share"))


@query(f"""WITH {TOK}, a AS (SELECT *, CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END AS eff, sm // 86400000 AS day FROM tok),
 b AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR day IS DISTINCT FROM lag(day) OVER w OR event_type IS DISTINCT FROM lag(event_type) OVER w OR eff IS DISTINCT FROM lag(eff) OVER w THEN 1 ELSE 0 END AS chg FROM a WINDOW w AS (PARTITION BY user_id ORDER BY sm, event_id)),
 c AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY sm, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM b),
 g AS (SELECT user_id, run, min(sm) AS s, max(em) AS e, count(*) AS n FROM c GROUP BY user_id, run)
SELECT user_id, run::BIGINT AS run, n, greatest(s, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS start_ms, e AS end_ms FROM g""")
def split_runs(spark: S, d: D) -> DataFrame:
    """Runs of (day, baseline, effective label); a start is clipped to what came before."""
    t = tokens(spark, d).withColumns({"eff": F.when(F.col("event_type") == "click", "view").otherwise(F.col("event_type")), "day": F.floor(F.col("sm") / (24 * HOUR))})
    t = runs.label_runs(t.withColumn("key", F.struct("day", "event_type", "eff")), KEYS, ORDER, "key")
    g = t.groupBy("user_id", "run").agg(F.min("sm").alias("s"), F.max("em").alias("end_ms"), F.count(F.lit(1)).alias("n"))
    before = F.max("end_ms").over(W.partitionBy("user_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    return g.select("user_id", "run", "n", F.greatest("s", F.coalesce(before, "s")).alias("start_ms"), "end_ms")


@query()
def vote_routing(spark: S, d: D) -> DataFrame:
    """Both levels of routing for the events of a user: days are sentences, a purchase ends a part, scores are to the centroids."""
    n = emb(spark, d).agg(F.count(F.lit(1)).alias("n")).scalar()
    t = tokens(spark, d).withColumn("vec_id", F.col("event_id") % n)
    maps = scores(spark, d).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("cand", "score"))).alias("scores"))
    t = t.join(maps, "vec_id").select("user_id", F.row_number().over(runs.ordered(KEYS, ORDER)).cast("long").alias("pos"), F.floor(F.col("sm") / (24 * HOUR)).alias("sentence_id"), (F.col("event_type") == "purchase").alias("mark"), F.ceil("value").alias("support"), "scores")
    return votes.vote_routing(t, KEYS)
