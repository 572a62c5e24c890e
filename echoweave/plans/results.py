"""Result documents, speaker mappings and batch outputs over orders, lineitem, customer, events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoweave.functions import vectors as V
from echoweave.operators import catalog, clustering, stages
from echoweave.operators import results as R

from .registry import KEYS, TOK, query, table, tokens

S, D = SparkSession, str

#: Lines of an order as segments; of every third order a derived layer whose label may differ.
SEG = "seg AS (SELECT l_orderkey AS job, l_linenumber AS seg, ('M' || l_suppkey % 7) AS label FROM lineitem), der AS (SELECT l_orderkey AS job, l_linenumber AS seg, CASE WHEN l_returnflag = 'R' THEN 'M3' ELSE ('M' || l_suppkey % 7) END AS label FROM lineitem WHERE l_orderkey % 3 = 0)"


def lines(spark: S, d: D) -> DataFrame:
    return table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "job", "l_linenumber": "seg"}).withColumn("mode", F.concat(F.lit("M"), (F.col("l_suppkey") % 7).cast("string")))


def layers(spark: S, d: D) -> tuple[DataFrame, DataFrame]:
    t = lines(spark, d)
    return t.select("job", "seg", F.col("mode").alias("label")), t.where("job % 3 = 0").select("job", "seg", F.when(F.col("l_returnflag") == "R", "M3").otherwise(F.col("mode")).alias("label"))


@query(f"WITH {SEG} SELECT * FROM seg WHERE job NOT IN (SELECT job FROM der) UNION ALL SELECT * FROM der")
def active_layer(spark: S, d: D) -> DataFrame:
    return R.active_layer(*layers(spark, d), ["job"])


@query(f"WITH {SEG} SELECT job, seg, label, CASE WHEN seg % 2 = 0 THEN upper(label) ELSE lower(label) END AS shown FROM der WHERE label IN ('M3', 'M1', 'M5')")
def label_projection(spark: S, d: D) -> DataFrame:
    return R.projection(layers(spark, d)[1], "label", ["M3", "M1", "M5"], F.when(F.col("seg") % 2 == 0, F.upper("label")).otherwise(F.lower("label")))


@query(f"WITH {SEG} SELECT der.job, der.seg, der.label, seg.label AS baseline FROM der JOIN seg ON der.job = seg.job AND der.seg = seg.seg WHERE der.label <> seg.label")
def changed_labels(spark: S, d: D) -> DataFrame:
    base, derived = layers(spark, d)
    return R.changed_labels(derived.join(base.withColumnRenamed("label", "baseline"), ["job", "seg"]), "label", "baseline")


@query("""WITH l AS (SELECT l_orderkey AS job, arg_max(l_quantity::BIGINT * 1000, l_linenumber * 100 + l_quantity) AS e, count(DISTINCT ('M' || l_suppkey % 7)) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS job, greatest((o_orderkey % 40)::DOUBLE, coalesce(e, 0) / 1000.0::DOUBLE) AS duration, coalesce(n, 0) AS total_speakers, 0::BIGINT AS named_speakers FROM orders LEFT JOIN l ON o_orderkey = job""")
def success_metrics(spark: S, d: D) -> DataFrame:
    source = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_orderkey") % 40).cast("double").alias("seconds"))
    rows = lines(spark, d).withColumns({"end": F.col("l_quantity").cast("long") * 1000, "at": F.col("seg") * 100 + F.col("l_quantity")})
    return R.success_metrics(rows, "job", "at", "end", "mode", source)


@query("WITH f AS (SELECT l_orderkey AS job, ('M' || l_suppkey % 7) AS label, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) SELECT job, label, row_number() OVER (PARTITION BY job ORDER BY first, label) AS pos FROM f")
def distinct_in_order(spark: S, d: D) -> DataFrame:
    t = layers(spark, d)[0]
    return R.distinct_in_order(t, ["job"], "seg", "label").withColumn("pos", F.col("pos").cast("long"))


@query("""WITH l AS (SELECT DISTINCT c_nationkey AS job, CASE WHEN c_custkey % 9 = 0 THEN 'Speaker' ELSE c_mktsegment END AS label FROM customer),
f AS (SELECT c_nationkey AS job, c_mktsegment AS label, min(c_name) AS fingerprint_id FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2), p AS (SELECT c_nationkey AS job, c_mktsegment AS label, min(c_custkey) AS profile_id FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1, 2)
SELECT job, label, CASE WHEN label = 'Speaker' THEN 'fp_system_speaker' ELSE fingerprint_id END AS fingerprint_id, profile_id FROM l LEFT JOIN f USING (job, label) LEFT JOIN p USING (job, label)""")
def speaker_rows(spark: S, d: D) -> DataFrame:
    c = table(spark, d, "customer").withColumnsRenamed({"c_nationkey": "job"})
    labels = c.select("job", F.when(F.col("c_custkey") % 9 == 0, R.SENTINEL).otherwise(F.col("c_mktsegment")).alias("label")).distinct()
    by = lambda rows, out: rows.groupBy("job", F.col("c_mktsegment").alias("label")).agg(out)
    return R.speaker_rows(labels, ["job"], "label", by(c.where("c_custkey % 2 = 0"), F.min("c_name").alias("fingerprint_id")), by(c.where("c_custkey % 5 = 0"), F.min("c_custkey").alias("profile_id")))


MAPPING = "m AS (SELECT c_nationkey AS job, c_mktsegment AS label, CASE WHEN min(c_custkey) % 2 = 0 THEN min(c_custkey) END AS profile_id FROM customer GROUP BY 1, 2)"


def mapping(spark: S, d: D) -> DataFrame:
    least = F.min("c_custkey")
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("job"), F.col("c_mktsegment").alias("label")).agg(F.when(least % 2 == 0, least).alias("profile_id"))


@query(f"WITH {MAPPING}, p AS (SELECT c_nationkey AS job, c_mktsegment AS label, max(c_custkey) AS id FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1, 2) SELECT job, label, coalesce(profile_id, id) AS profile_id, profile_id IS NULL AND id IS NOT NULL AS changed FROM m LEFT JOIN p USING (job, label)")
def hydrated_mapping(spark: S, d: D) -> DataFrame:
    current = table(spark, d, "customer").where("c_custkey % 3 = 0").groupBy(F.col("c_nationkey").alias("job"), F.col("c_mktsegment").alias("label")).agg(F.max("c_custkey").alias("id"))
    return R.hydrated(mapping(spark, d), current, ["job"], "label")


@query(f"WITH {MAPPING}, b AS (SELECT c_custkey AS profile_id, c_custkey % 7 AS person FROM customer WHERE c_custkey % 3 = 0) SELECT job, count(DISTINCT person) AS named, count(DISTINCT coalesce('p:' || person, 'u:' || profile_id)) AS total FROM m LEFT JOIN b USING (profile_id) GROUP BY job")
def bound_counts(spark: S, d: D) -> DataFrame:
    binding = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("profile_id"), (F.col("c_custkey") % 7).alias("person"))
    return R.bound(mapping(spark, d), ["job"], "profile_id", binding)


@query("SELECT label, count(*) AS n, CASE WHEN count(*) = 1 THEN 'single' WHEN NOT bool_and(coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false)) THEN 'rejected' WHEN count(*) > 40 THEN 'batched' ELSE 'proceed' END AS action FROM embeddings GROUP BY label")
def cluster_preflight(spark: S, d: D) -> DataFrame:
    return R.preflight(table(spark, d, "embeddings"), ["label"], "embedding", 64, 40)


@query("""WITH c AS (SELECT o_custkey, count(*) * 40 AS n FROM orders GROUP BY o_custkey), p AS (SELECT *, CASE WHEN n * 0.012::DOUBLE < 6 THEN 6.0::DOUBLE / n ELSE 0.012::DOUBLE END AS p FROM c)
SELECT o_custkey, n, greatest(0, n - least(n, greatest(0, CASE WHEN p <= 1 THEN floor((1 - p) * n)::BIGINT ELSE 0 END)))::BIGINT AS kept FROM p""")
def retained_edges(spark: S, d: D) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 40).alias("n"))
    return n.select("o_custkey", "n", R.retained_edges(F.col("n"), 0.012).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, (l_linenumber * 60000 + i * 500)::BIGINT AS start_ms, (l_linenumber * 60000 + i * 500 + 400)::BIGINT AS end_ms, 'w' || i AS word FROM lineitem, unnest(range(0, (l_quantity % 4)::BIGINT)) t(i)")
def offset_tokens(spark: S, d: D) -> DataFrame:
    t = table(spark, d, "lineitem").withColumn("count", (F.col("l_quantity") % 4).cast("int"))
    words = F.transform(F.when(F.col("count") > 0, F.sequence(F.lit(0), F.col("count") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("text"), (i * 500).cast("long").alias("start"), (i * 500 + 400).cast("long").alias("end")))
    moved = t.select("l_orderkey", "l_linenumber", F.explode(R.offset_tokens(words, F.col("l_linenumber").cast("long") * 60_000)).alias("w"))
    return moved.select("l_orderkey", "l_linenumber", F.col("w.start").alias("start_ms"), F.col("w.end").alias("end_ms"), F.col("w.text").alias("word"))


@query(f"WITH {TOK} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY sm, em, event_id) AS pos FROM tok")
def merged_outputs(spark: S, d: D) -> DataFrame:
    t = tokens(spark, d)
    parts = [t.where(F.col("event_id") % 3 == k) for k in range(3)]
    return R.merged_outputs(parts, KEYS, ["sm", "em", "event_id"]).select("user_id", "event_id", F.col("pos").cast("long").alias("pos"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 2 > 0 THEN least(l_linenumber - 2, (l_extendedprice::BIGINT) // 8404) ELSE l_extendedprice::BIGINT // 8404 END AS n FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS l_extendedprice FROM lineitem)")
def effective_tokens(spark: S, d: D) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", R.effective_tokens(F.col("l_linenumber") - 2, F.floor("l_extendedprice"), 8404).cast("long").alias("n"))


@query("""SELECT l_orderkey AS win, min(CASE WHEN l_quantity > 3 THEN l_partkey * 10 ELSE NULL END) IS NULL AS bare, coalesce(min(CASE WHEN l_quantity > 3 THEN l_partkey END), 0)::BIGINT * 10 AS start_ms,
 greatest(coalesce(max(CASE WHEN l_quantity > 3 THEN l_partkey + l_quantity::BIGINT % 5 END), 0), coalesce(min(CASE WHEN l_quantity > 3 THEN l_partkey END), 0) + 1)::BIGINT * 10 AS end_ms FROM lineitem GROUP BY l_orderkey""")
def source_range(spark: S, d: D) -> DataFrame:
    """The time that a window's spans come from; of windows without spans, and with empty ones, a frame."""
    span = F.when(F.col("l_quantity") > 3, F.struct(F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long") % 5).alias("hi")))
    w = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("win")).agg(F.collect_list(span).alias("spans"))
    return w.select("win", (F.size("spans") == 0).alias("bare"), R.source_range(F.col("spans")).alias("r")).select("win", "bare", "r.start_ms", "r.end_ms")


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN ' ' ELSE '  ' || coalesce(text, '') END AS text FROM conversations))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, t) AS segment_id, 'Speaker1' AS label, length(t)::INT AS size FROM t WHERE t <> ''""")
def partial_results(spark: S, d: D) -> DataFrame:
    text = F.when(F.col("turn") % 4 == 1, " ").otherwise(F.concat(F.lit("  "), F.coalesce("text", F.lit(""))))
    t = table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    return R.partial_results(t, "conv_id", ["turn", "text"], "text").select("conv_id", "segment_id", "label", F.length("text").alias("size"))


@query("""WITH h AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderkey::VARCHAR END AS job, CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey + 1)::VARCHAR WHEN o_orderkey % 5 <> 0 THEN o_orderkey::VARCHAR END AS expected, o_orderkey % 3 AS version, CASE WHEN o_orderkey % 11 = 0 THEN -o_totalprice WHEN o_orderkey % 17 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 19 = 0 THEN 'inf'::DOUBLE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS seconds FROM orders)
SELECT job, unnest(list_filter([CASE WHEN trim(job) = '' THEN 'empty id' END, CASE WHEN expected IS NOT NULL AND expected <> job THEN 'other id' END, CASE WHEN version NOT IN (1, 2) THEN 'version' END, CASE WHEN seconds IS NOT NULL AND (isnan(seconds) OR isinf(seconds) OR seconds < 0) THEN 'cleanup seconds' END], lambda x: x IS NOT NULL)) AS rule FROM h""")
def header_violations(spark: S, d: D) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    seconds = F.when(k % 11 == 0, -F.col("o_totalprice")).when(k % 17 == 0, float("nan")).when(k % 19 == 0, float("inf")).when(k % 4 != 0, F.col("o_totalprice"))
    heads = o.select(F.when(k % 13 == 0, " ").otherwise(k.cast("string")).alias("job"), F.when(k % 7 == 0, (k + 1).cast("string")).when(k % 5 != 0, k.cast("string")).alias("expected"), (k % 3).alias("version"), seconds.alias("seconds"))
    return R.header_violations(heads, "job", "expected", "version", "seconds", (1, 2))


@query(f"""WITH RECURSIVE {TOK}, e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sm, event_id) AS i, sm, event_id % 13 AS op, value, event_id % 2 = 0 AS flag FROM tok),
s(user_id, i, status, cleaned_at, model, seconds, before) AS (SELECT DISTINCT user_id, 0::BIGINT, 'none', NULL::BIGINT, NULL::VARCHAR, 0::DOUBLE, 0::DOUBLE FROM e UNION ALL
 SELECT s.user_id, e.i, CASE WHEN op IN (0, 6) THEN 'running' WHEN op IN (1, 7) THEN 'done' WHEN op = 2 THEN 'cancelled' WHEN op IN (3, 8) THEN 'failed' WHEN op = 4 THEN 'none' WHEN op = 5 THEN 'done' ELSE status END,
  CASE WHEN op IN (0, 6) AND NOT flag OR op IN (3, 8) AND flag OR op = 4 THEN NULL WHEN op IN (1, 7) THEN sm WHEN op = 5 THEN 5 ELSE cleaned_at END,
  CASE WHEN op IN (0, 6) AND NOT flag OR op IN (3, 8) AND flag OR op = 4 THEN NULL WHEN op IN (1, 7) THEN 'm' || op WHEN op = 5 THEN 'base' ELSE model END,
  CASE WHEN op IN (0, 6) AND NOT flag OR op = 4 THEN 0 WHEN op IN (1, 7) THEN value WHEN op = 5 THEN 0.5 ELSE seconds END::DOUBLE,
  CASE WHEN op IN (0, 6) THEN CASE WHEN flag THEN seconds ELSE 0 END WHEN op = 4 THEN 0 ELSE before END::DOUBLE
 FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, status, cleaned_at, model, seconds, before FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def cleanup_states(spark: S, d: D) -> DataFrame:
    """A user's events as the events of a job's cleanup."""
    k = F.col("event_id") % 13
    op = F.when(k.isin(0, 6), "run").when(k.isin(1, 7), "complete").when(k == 2, "cancel").when(k.isin(3, 8), "fail").when(k == 4, "invalidate").when(k == 5, "restore").otherwise("seen")
    base = F.struct(F.lit("done").alias("status"), F.lit(5).cast("long").alias("cleaned_at"), F.lit("base").alias("model"), F.lit(0.5).alias("seconds"))
    e = tokens(spark, d).select("user_id", "sm", "event_id", op.alias("op"), F.col("sm").alias("at"), F.concat(F.lit("m"), k.cast("string")).alias("model"), F.col("value").alias("seconds"), (F.col("event_id") % 2 == 0).alias("flag"), base.alias("baseline"))
    return catalog.cleanup_states(e, "user_id", ["sm", "event_id"])


@query(f"WITH {TOK}, v AS (SELECT user_id, sm // 86400000 AS win, event_type AS label, count(*) AS votes FROM tok WHERE event_id % 4 <> 0 GROUP BY 1, 2, 3) SELECT user_id, win, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id, win ORDER BY votes DESC, label) = 1")
def window_majority(spark: S, d: D) -> DataFrame:
    t = tokens(spark, d).select("user_id", F.floor(F.col("sm") / 86_400_000).alias("win"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("label"))
    return R.window_majority(t, ["user_id", "win"], "label")


@query("""WITH s AS (SELECT l_orderkey AS job, list(CASE WHEN l_linenumber % 5 = 0 THEN ' ' WHEN l_quantity > 45 THEN 'M9' ELSE ('M' || l_suppkey % 7) END ORDER BY l_linenumber) AS labels, 1 + (l_orderkey % 10 = 0)::INT AS version FROM lineitem GROUP BY l_orderkey), e AS (SELECT job, unnest(labels) AS value FROM s)
SELECT job, 'version' AS rule, version::VARCHAR AS value FROM s WHERE version <> 1 UNION ALL SELECT job, 'blank', value FROM e WHERE trim(value) = '' UNION ALL SELECT job, 'duplicate', value FROM e GROUP BY job, value HAVING count(*) > 1
UNION ALL SELECT DISTINCT job, 'unknown', value FROM e WHERE trim(value) <> '' AND (job, value) NOT IN (SELECT (l_orderkey, ('M' || l_suppkey % 7)) FROM lineitem)""")
def split_metadata(spark: S, d: D) -> DataFrame:
    t = stages.dealt(lines(spark, d).select("job", "seg", "mode", "l_quantity"), "job")
    label = F.when(F.col("seg") % 5 == 0, " ").when(F.col("l_quantity") > 45, "M9").otherwise(F.col("mode"))
    splits = t.groupBy("job").agg(F.collect_list(label).alias("labels")).withColumn("version", 1 + (F.col("job") % 10 == 0).cast("int"))
    return R.split_metadata_violations(splits, "job", "labels", "version", t, "mode")


@query("""WITH s AS (SELECT l_orderkey AS job, list_sort(list_distinct(list(('M' || l_suppkey % 7)))) AS labels FROM lineitem GROUP BY l_orderkey)
SELECT job, array_to_string(list_sort(CASE WHEN list_contains(labels, 'M3') THEN list_filter(labels, lambda x: x <> 'M3') ELSE list_append(labels, 'M3') END), ',') AS labels FROM s""")
def toggled_split(spark: S, d: D) -> DataFrame:
    s = lines(spark, d).groupBy("job").agg(F.array_sort(F.collect_set("mode")).alias("labels"))
    return s.select("job", F.array_join(R.toggled(F.col("labels"), F.lit("M3")), ",").alias("labels"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS job, ('M' || l_suppkey % 7) AS label FROM lineitem),
s AS (SELECT job, list_sort(list(label))[1 : 1 + job % 2] AS labels, 's' || job % 5 AS identity, 'c' || job AS baseline FROM k WHERE job % 3 <> 0 GROUP BY job),
r AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 7 = 0 THEN 's9' ELSE 's' || o_orderkey % 5 END AS identity, CASE WHEN o_orderkey % 11 = 0 THEN 'M8' ELSE coalesce((SELECT min(label) FROM k WHERE k.job = o_orderkey), 'M8') END AS label, 'd' || o_orderkey AS cleanup FROM orders),
j AS (SELECT r.*, s.identity AS was, coalesce(s.labels, []::VARCHAR[]) AS before, s.baseline, list_contains(coalesce(s.labels, []::VARCHAR[]), r.label) AS marked, (r.job, r.label) IN (SELECT (job, label) FROM k) AS may FROM r LEFT JOIN s USING (job)),
t AS (SELECT *, CASE WHEN marked THEN list_filter(before, lambda x: x <> label) ELSE list_sort(list_append(before, label)) END AS after FROM j),
o AS (SELECT *, CASE WHEN was IS NOT NULL AND was <> identity THEN 'discard' WHEN NOT marked AND NOT may THEN 'refuse' WHEN len(after) = 0 THEN 'restore' ELSE 'commit' END AS outcome FROM t)
SELECT job, outcome, array_to_string(CASE WHEN outcome = 'commit' THEN after WHEN outcome = 'refuse' THEN before ELSE []::VARCHAR[] END, ',') AS labels, CASE WHEN outcome = 'commit' THEN coalesce(baseline, cleanup) ELSE baseline END AS baseline FROM o""")
def split_outcomes(spark: S, d: D) -> DataFrame:
    """Toggles of a label in the splits of jobs: committed, restored, discarded or refused."""
    known = lines(spark, d).select("job", F.col("mode").alias("label")).distinct()
    each = known.groupBy("job").agg(F.array_sort(F.collect_set("label")).alias("all"))
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    states = each.where("job % 3 <> 0").select("job", name("s", F.col("job") % 5).alias("identity"), F.slice("all", F.lit(1), (1 + F.col("job") % 2).cast("int")).alias("labels"), name("c", F.col("job")).alias("baseline"))
    order = table(spark, d, "orders").select(F.col("o_orderkey").alias("job")).join(each, "job", "left")
    label = F.when(F.col("job") % 11 == 0, "M8").otherwise(F.coalesce(F.try_element_at("all", F.lit(1)), F.lit("M8")))
    requests = order.select("job", F.when(F.col("job") % 7 == 0, "s9").otherwise(name("s", F.col("job") % 5)).alias("identity"), label.alias("label"), name("d", F.col("job")).alias("cleanup"))
    return R.split_outcomes(states, requests, known, "job").select("job", "outcome", F.array_join("labels", ",").alias("labels"), "baseline")


@query("""WITH w AS (SELECT DISTINCT lang, regexp_extract(text, '[a-zA-ZÀ-ÖØ-öø-ÿ]+') AS word FROM documents WHERE text IS NOT NULL),
k AS (SELECT lang, word, replace(replace(replace(strip_accents(lower(replace(word, 'ẞ', 'ß'))), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae') AS base FROM w WHERE word <> '')
SELECT lang, base, count(*) AS words, dense_rank() OVER (PARTITION BY lang ORDER BY base) AS place FROM k GROUP BY lang, base""")
def reader_order(spark: S, d: D) -> DataFrame:
    """Words that begin texts in a reader's order, those that differ in case and accents only together."""
    words = table(spark, d, "documents").where("text is not null").select("lang", F.regexp_extract("text", "[a-zA-ZÀ-ÖØ-öø-ÿ]+", 0).alias("word")).distinct().where("word <> ''")
    ranked = R.collated_order(words, ["lang"], "word")
    alike = W.partitionBy("lang").orderBy(F.collate(F.col("word"), "UNICODE_CI_AI"))
    ranked = ranked.withColumn("place", F.dense_rank().over(alike).cast("long"))
    # the base form of a group is spelled from its first word
    base = F.lower(F.regexp_replace(F.expr("translate(first, 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy')"), "ß", "ss"))
    return ranked.groupBy("lang", "place").agg(F.min_by("word", "pos").alias("first"), F.count(F.lit(1)).alias("words")).select("lang", base.alias("base"), "words", "place")


@query("""WITH a AS (SELECT o_orderkey, list_filter([o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, o_orderstatus], lambda x: x IS NOT NULL) AS p FROM orders)
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY min(i)) - 1)::INT AS pos, path FROM (SELECT o_orderkey, unnest(p) AS path, generate_subscripts(p, 1) AS i FROM a) GROUP BY o_orderkey, path""")
def artifact_paths(spark: S, d: D) -> DataFrame:
    t = table(spark, d, "orders").withColumn("again", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    return R.artifact_paths(t, "o_orderkey", ["o_orderpriority", "again", "o_orderstatus"])


@query(f"""WITH RECURSIVE {TOK}, f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sm, event_id) - 1 AS i, value / 100 AS peak, 1 + round(value * 100)::BIGINT % 400 AS alpha FROM tok),
u AS (SELECT user_id, 1 + user_id % 9 + CASE WHEN user_id % 3 = 0 THEN (count(*) FILTER (peak >= 1 - 1e-4::DOUBLE)) ELSE 0 END AS n, count(*) FILTER (peak >= 1 - 1e-4::DOUBLE) AS seen, sum(alpha)::DOUBLE AS total FROM f GROUP BY user_id),
c(user_id, i, acc, fired) AS (SELECT user_id, -1::BIGINT, 0::DOUBLE, false FROM u WHERE seen <> n + 1 UNION ALL
 SELECT user_id, i, CASE WHEN t >= 1 - 1e-4::DOUBLE THEN t - (1 - 1e-4::DOUBLE) ELSE t END, t >= 1 - 1e-4::DOUBLE FROM (SELECT c.user_id, f.i, c.acc + f.alpha::DOUBLE * ((u.n + 1)::DOUBLE / u.total) AS t FROM c JOIN f ON f.user_id = c.user_id AND f.i = c.i + 1 JOIN u ON u.user_id = c.user_id)),
p AS (SELECT user_id, list((i - 1.5::DOUBLE) * 20 ORDER BY i) AS places FROM (SELECT user_id, i FROM c WHERE fired UNION ALL SELECT user_id, i FROM f JOIN u USING (user_id) WHERE seen = n + 1 AND peak >= 1 - 1e-4::DOUBLE) GROUP BY user_id),
r AS (SELECT u.user_id, n, coalesce(p.places, []::DOUBLE[]) AS places, i FROM u LEFT JOIN p USING (user_id), unnest(range(0, n + 1)) t(i))
SELECT user_id, i::INT AS pos, CASE WHEN len(places) < 2 THEN least(900, i * 60) WHEN i < len(places) THEN least(900, greatest(0, round(places[i + 1])::BIGINT))
 ELSE least(900, least(900, greatest(0, round(places[len(places)])::BIGINT)) + (i - len(places) + 1) * 60) END::BIGINT AS ms FROM r""")
def token_times(spark: S, d: D) -> DataFrame:
    """Times of a recording's tokens from its peaks, or from its weights where the peaks are not as many as the tokens; missing ones are padded."""
    item = F.struct("sm", "event_id", (F.col("value") / 100).alias("peak"), (1 + F.round(F.col("value") * 100).cast("long") % 400).cast("double").alias("alpha"))
    t = tokens(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("f"))
    t = t.select("user_id", F.transform("f", lambda x: x["peak"]).alias("peaks"), F.transform("f", lambda x: x["alpha"]).alias("alphas"))
    more = F.when(F.col("user_id") % 3 == 0, F.size(V.fire_places(F.col("peaks")))).otherwise(0)
    t = t.withColumn("n", (1 + F.col("user_id") % 9 + more).cast("int"))
    return t.select("user_id", F.posexplode(V.token_times(F.col("peaks"), F.col("alphas"), F.col("n"), F.lit(900))).alias("pos", "ms")).select("user_id", "pos", F.col("ms").cast("long").alias("ms"))


PROFILES = """p AS (SELECT c_nationkey AS job, c_mktsegment AS label, round(sum(c_acctbal))::BIGINT AS x, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT job, sum(n) AS total FROM p GROUP BY job),
e AS (SELECT a.job, a.label AS a, b.label AS b FROM p a JOIN p b ON a.job = b.job AND a.label < b.label JOIN t ON a.job = t.job WHERE abs(a.x - b.x) <= 9000 AND (abs(a.x - b.x) <= 4000 OR least(a.n, b.n) < 0.15 * total))"""


@query(f"""WITH RECURSIVE {PROFILES}, s AS (SELECT job, a, b FROM e UNION SELECT job, b, a FROM e), c AS (SELECT job, label, label AS root FROM p UNION SELECT c.job, s.b, c.root FROM c JOIN s ON c.job = s.job AND c.label = s.a)
SELECT job, label, min(root) AS root FROM c GROUP BY job, label""")
def linked_labels(spark: S, d: D) -> DataFrame:
    """Labels of a job that are alike, or alike enough with a small share, are one: union-find over each job's label table."""
    p = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("job"), F.col("c_mktsegment").alias("label")).agg(F.round(F.sum("c_acctbal")).cast("long").alias("x"), F.count(F.lit(1)).alias("n"))
    total = p.groupBy("job").agg(F.sum("n").alias("total"))
    a, b = (p.select("job", F.col("label").alias(k), F.col("x").alias(f"x{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    gap = F.abs(F.col("xa") - F.col("xb"))
    pairs = a.join(b, "job").where("a < b").join(total, "job").where((gap <= 9000) & ((gap <= 4000) | (F.least("na", "nb") < 0.15 * F.col("total"))))
    return clustering.linked_labels(p.select("job", "label"), pairs.select("job", "a", "b"), "job", "label")
