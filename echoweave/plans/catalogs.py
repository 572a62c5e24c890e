"""Catalog queries over orders, customer, lineitem, nation, supplier and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoweave.functions import hashing
from echoweave.functions.timing import epoch_ms
from echoweave.operators import catalog as C

from .registry import KEYS, ORDER, TOK, query, r6, table, tokens

S, D = SparkSession, str
DAY = "epoch_us(o_orderdate)//86400000000"


def orders(spark: S, d: D) -> DataFrame:
    return table(spark, d, "orders").withColumn("day", F.floor(epoch_ms("o_orderdate") / 86_400_000))


def customers(spark: S, d: D) -> DataFrame:
    return table(spark, d, "customer")


@query("WITH k AS (SELECT c_custkey, sha256(lower(trim('/audio/' || c_name || '/', '/'))) AS h FROM customer) SELECT c_custkey, h AS key, 'stage/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.result.json' AS path FROM k")
def hash_partition_path(spark: S, d: D) -> DataFrame:
    key = hashing.path_key(F.concat(F.lit("/audio/"), "c_name", F.lit("/")))
    return customers(spark, d).select("c_custkey", key.alias("key")).withColumn("path", hashing.hash_path(F.col("key")))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def catalog_point_lookup(spark: S, d: D) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {DAY} DESC, o_orderkey DESC) AS pos FROM orders WHERE o_orderstatus IN ('F', 'P')")
def history_order(spark: S, d: D) -> DataFrame:
    return C.history(orders(spark, d).select("o_orderkey", "o_orderstatus", "day"), "o_orderstatus", ["F", "P"], "day", "o_orderkey").select("o_orderkey", "pos")


@query(f"SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'P') AND lower(o_orderpriority) LIKE '%urgent%') AS total FROM orders WHERE o_orderstatus IN ('F', 'P') AND lower(o_orderpriority) LIKE '%urgent%' ORDER BY {DAY} DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def history_page(spark: S, d: D) -> DataFrame:
    t = orders(spark, d).where(F.col("o_orderstatus").isin("F", "P") & F.lower("o_orderpriority").contains("urgent"))
    return C.page(t, 2, [F.desc("day"), F.desc("o_orderkey")]).select("o_orderkey", "total")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END NULLS LAST, {DAY} DESC, o_orderkey) AS pos FROM orders")
def queue_order(spark: S, d: D) -> DataFrame:
    """Queued ones first in their order, then all others by time. (The two are one total order here.)"""
    q = F.col("o_orderstatus") == "O"
    return C.positioned(orders(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority", "day"), [F.when(q, 0).otherwise(1), F.asc_nulls_last(F.when(q, F.col("o_orderpriority"))), F.desc("day"), F.col("o_orderkey")]).select("o_orderkey", "pos")


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, {DAY}, o_orderkey) - 1 AS queue_order FROM orders WHERE o_orderstatus = 'O'")
def queue_renumber(spark: S, d: D) -> DataFrame:
    t = orders(spark, d).where("o_orderstatus = 'O'")
    return C.renumber(t, ["o_custkey"], [F.col("o_orderpriority"), F.col("day"), F.col("o_orderkey")]).select("o_orderkey", "queue_order")


@query(f"SELECT o_orderkey, {DAY} AS day FROM orders ORDER BY {DAY} DESC, o_orderkey DESC LIMIT 12")
def top12_recent(spark: S, d: D) -> DataFrame:
    return orders(spark, d).orderBy(F.desc("day"), F.desc("o_orderkey")).limit(12).select("o_orderkey", "day")


@query(f"""WITH {TOK}, a AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY sm, event_id) AS before FROM tok)
SELECT event_id, before, event_type FROM a WHERE before IS NOT NULL AND before <> event_type AND NOT ((before = 'view' AND event_type IN ('click', 'signup')) OR (before = 'click' AND event_type IN ('purchase', 'error')) OR (before = 'error' AND event_type = 'view'))""")
def illegal_transitions(spark: S, d: D) -> DataFrame:
    allowed = {"view": ("click", "signup"), "click": ("purchase", "error"), "error": ("view",)}
    return C.illegal_transitions(tokens(spark, d), KEYS, ORDER, "event_type", allowed).select("event_id", "before", "event_type")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'done' END AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS cleanup FROM orders")
def stale_reset(spark: S, d: D) -> DataFrame:
    """What was running at a crash has failed, what was being cleaned is not cleaned."""
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("done")
    return table(spark, d, "orders").select("o_orderkey", F.when(status.isin("running", "processing"), "failed").otherwise(status).alias("status"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("cleanup"))


@query("SELECT l_orderkey, round(sum(l_quantity + l_discount + l_tax) * 1000)::BIGINT AS ms, count(*)::VARCHAR || ' stages / ' || round(sum(l_quantity))::BIGINT::VARCHAR || ' s' AS summary FROM lineitem GROUP BY l_orderkey")
def stage_metrics(spark: S, d: D) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") + F.col("l_discount") + F.col("l_tax")) * 1000).cast("long").alias("ms"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity")).cast("long").alias("q"))
    return s.select("l_orderkey", "ms", F.concat_ws(" / ", F.concat(F.col("n").cast("string"), F.lit(" stages")), F.concat(F.col("q").cast("string"), F.lit(" s"))).alias("summary"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey % 3, s_acctbal DESC, s_suppkey) AS pos FROM supplier WHERE s_acctbal > 0")
def tiered_order(spark: S, d: D) -> DataFrame:
    t = table(spark, d, "supplier").where("s_acctbal > 0")
    return C.positioned(t, [F.col("s_nationkey") % 3, F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "pos")


@query("WITH s AS (SELECT o_custkey, max(o_totalprice) AS score FROM orders GROUP BY o_custkey) SELECT c_custkey, row_number() OVER (ORDER BY s.score DESC NULLS LAST, c_name, c_custkey) AS pos FROM customer LEFT JOIN s ON c_custkey = o_custkey WHERE contains(lower(c_name), '7')")
def picker_order(spark: S, d: D) -> DataFrame:
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("score"))
    t = customers(spark, d).where(F.lower("c_name").contains("7")).join(s, F.col("c_custkey") == F.col("o_custkey"), "left")
    return C.positioned(t, [F.desc_nulls_last("score"), F.col("c_name"), F.col("c_custkey")]).select("c_custkey", "pos")


@query("WITH c AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey) SELECT c_custkey, CASE WHEN s IS NULL THEN 'insert' WHEN s = 'P' THEN 'replace' ELSE 'keep' END AS action FROM customer LEFT JOIN c ON c_custkey = o_custkey")
def import_dedup(spark: S, d: D) -> DataFrame:
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"))
    known = last.select("c_custkey", F.when(F.col("s") == "P", "failed").when(F.col("s") == "F", "done").otherwise("queued").alias("status"))
    return C.import_dedup(customers(spark, d).select("c_custkey"), known, "c_custkey", "status")


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'active' END AS display, CASE WHEN o_orderpriority LIKE '1%' THEN 'decode' WHEN o_orderpriority LIKE '2%' THEN 'recognise' ELSE 'decode' END AS stage, count(*) AS n FROM orders GROUP BY ALL")
def status_map(spark: S, d: D) -> DataFrame:
    """Display class and broad stage by look-up; what isn't known is the first stage."""
    classes = spark.createDataFrame([("F", "done"), ("O", "queued"), ("P", "active")], "o_orderstatus string, display string")
    stages = spark.createDataFrame([("1-URGENT", "decode"), ("2-HIGH", "recognise")], "o_orderpriority string, stage string")
    t = table(spark, d, "orders").join(classes, "o_orderstatus", "left").join(stages, "o_orderpriority", "left")
    return t.groupBy("display", F.coalesce("stage", F.lit("decode")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT c_nationkey) AS people, count(*) AS profiles, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS unbound FROM customer")
def library_stats(spark: S, d: D) -> DataFrame:
    bound = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    t = customers(spark, d).join(bound, F.col("c_custkey") == F.col("k"), "left")
    return t.agg(F.count_distinct("c_nationkey").alias("people"), F.count(F.lit(1)).alias("profiles"), F.count_if(F.col("k").isNull()).alias("unbound"))


@query("WITH n AS (SELECT lower(trim(p_name)) AS key, min(trim(p_name)) AS p_name FROM part WHERE trim(p_name) <> '' GROUP BY 1) SELECT * FROM n WHERE key NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_size > 45)")
def get_or_create(spark: S, d: D) -> DataFrame:
    p = table(spark, d, "part")
    return C.get_or_create(p.select("p_name"), p.where("p_size > 45"), "p_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def semi_join_or(spark: S, d: D) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("by_id"), F.lit(None).cast("int").alias("by_nation"))
    s = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.lit(None).cast("long").alias("by_id"), F.col("s_nationkey").alias("by_nation"))
    return C.referenced(customers(spark, d), o.unionByName(s), [("c_custkey", "by_id"), ("c_nationkey", "by_nation")]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')")
def anti_join_double(spark: S, d: D) -> DataFrame:
    o = table(spark, d, "orders")
    p = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("a"), F.lit(None).cast("long").alias("b"))
    r = o.join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.lit(None).cast("long").alias("a"), F.col("o_custkey").alias("b"))
    return C.unreferenced(customers(spark, d), p.unionByName(r), [("c_custkey", "a"), ("c_custkey", "b")]).select("c_custkey")


@query("SELECT n_name, count(c_custkey) AS n, coalesce(string_agg(c_name, ',' ORDER BY c_name), '') AS members FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND (contains(lower(c_name), '5') OR contains(lower(n_name), '1')) GROUP BY n_name")
def bound_groups(spark: S, d: D) -> DataFrame:
    n, c = table(spark, d, "nation"), customers(spark, d)
    on = (F.col("n_nationkey") == F.col("c_nationkey")) & (F.lower("c_name").contains("5") | F.lower("n_name").contains("1"))
    g = n.join(c, on, "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"), F.array_sort(F.collect_list("c_name")).alias("m"))
    return g.select("n_name", "n", F.array_join("m", ",").alias("members"))


@query("SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def unbound_list(spark: S, d: D) -> DataFrame:
    return customers(spark, d).join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_nationkey, count(DISTINCT coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), '__unbound__:' || c_custkey)) AS n FROM customer GROUP BY c_nationkey")
def named_distinct(spark: S, d: D) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return customers(spark, d).groupBy("c_nationkey").agg(F.count_distinct(F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("__unbound__:"), F.col("c_custkey").cast("string")))).alias("n"))


@query("SELECT o_orderkey, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE trim(n_name) <> ''")
def name_map_join(spark: S, d: D) -> DataFrame:
    t = table(spark, d, "orders").join(customers(spark, d), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.where(F.trim("n_name") != "").select("o_orderkey", F.col("n_name").alias("name"))


@query("WITH e AS (SELECT p_name, min(p_partkey) AS id FROM part WHERE p_size <= 25 GROUP BY p_name), f AS (SELECT p_name, min(p_partkey) + 1000000 AS id FROM part GROUP BY p_name) SELECT p.p_partkey, coalesce(e.id, f.id) AS id FROM part p LEFT JOIN e USING (p_name) JOIN f USING (p_name)")
def resolve_ids(spark: S, d: D) -> DataFrame:
    """An existing id by name, else one new id for all rows of the name."""
    p = table(spark, d, "part")
    known = p.where("p_size <= 25").groupBy("p_name").agg(F.min("p_partkey").alias("known"))
    new = p.groupBy("p_name").agg((F.min("p_partkey") + 1_000_000).alias("new"))
    return p.join(known, "p_name", "left").join(new, "p_name").select("p_partkey", F.coalesce("known", "new").alias("id"))


@query("""WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey), w AS (SELECT o_custkey, count(*) * 2 AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
SELECT o_custkey, (greatest(0, coalesce(t.n, 0) - coalesce(o.n, 0)) + coalesce(w.n, 0))::BIGINT AS n FROM t FULL JOIN o USING (o_custkey) FULL JOIN w USING (o_custkey)""")
def delta_upsert(spark: S, d: D) -> DataFrame:
    o = table(spark, d, "orders")
    n = lambda df, k=1: df.groupBy("o_custkey").agg((F.count(F.lit(1)) * k).alias("n"))
    return C.delta_upsert(n(o), n(o.where("o_orderstatus = 'O'")), n(o.where("o_orderstatus = 'P'"), 2), ["o_custkey"], "n")


@query("WITH r AS (SELECT l.*, coalesce(a.s_suppkey, b.s_suppkey) AS k FROM lineitem l LEFT JOIN supplier a ON l.l_suppkey = a.s_suppkey AND a.s_acctbal > 0 LEFT JOIN supplier b ON l.l_suppkey % 10 = b.s_suppkey) SELECT k, count(*) AS n, round(sum(l_quantity), 2) AS seconds FROM r WHERE k IS NOT NULL GROUP BY k")
def backfill_counts(spark: S, d: D) -> DataFrame:
    """Resolve by id, else by a second key; then counts and sums."""
    s = table(spark, d, "supplier")
    a = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("ka"))
    b = s.select(F.col("s_suppkey").alias("kb"))
    l = table(spark, d, "lineitem").join(a, F.col("l_suppkey") == F.col("ka"), "left").join(b, F.col("l_suppkey") % 10 == F.col("kb"), "left")
    return l.withColumn("k", F.coalesce("ka", "kb")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("seconds"))


@query("WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem) SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') AND l_orderkey IS NULL THEN 'failed' WHEN o_orderstatus = 'O' AND l_orderkey IS NOT NULL THEN 'done' ELSE o_orderstatus END AS status FROM orders LEFT JOIN a ON o_orderkey = l_orderkey")
def reconcile_status(spark: S, d: D) -> DataFrame:
    a = table(spark, d, "lineitem").select("l_orderkey").distinct()
    t = table(spark, d, "orders").join(a, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    there, s = F.col("l_orderkey").isNotNull(), F.col("o_orderstatus")
    return t.select("o_orderkey", F.when(s.isin("F", "P") & ~there, "failed").when((s == "O") & there, "done").otherwise(s).alias("status"))


@query("SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal < 0, s_suppkey % 3, -s_acctbal, s_suppkey)) AS key FROM supplier WHERE s_acctbal > -500 GROUP BY s_nationkey")
def eligible_key(spark: S, d: D) -> DataFrame:
    """Of each group the next usable key: not cooling down, lowest tier, highest priority."""
    at = F.struct((F.col("s_acctbal") < 0).alias("cooling"), (F.col("s_suppkey") % 3).alias("tier"), (-F.col("s_acctbal")).alias("p"), "s_suppkey")
    return table(spark, d, "supplier").where("s_acctbal > -500").groupBy("s_nationkey").agg(F.min_by("s_suppkey", at).alias("key"))


@query(f"WITH m AS (SELECT max({DAY}) AS now FROM orders) SELECT o_orderkey, {DAY} AS day FROM orders, m WHERE {DAY} < now - 365")
def retention_filter(spark: S, d: D) -> DataFrame:
    """Rows older than the retention before the latest one."""
    o = orders(spark, d)
    now = o.agg(F.max("day").alias("now")).scalar()
    return o.where(F.col("day") < now - 365).select("o_orderkey", "day")
