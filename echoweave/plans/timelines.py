"""Timelines, runs and intervals over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoweave.functions import timing
from echoweave.functions import vectors as V
from echoweave.operators import folds, frames, intervals, runs, timeline

from .registry import HOUR, KEYS, ORDER, TOK, query, r6, table, tokens

S, D = SparkSession, str

RUN_SQL = f"""WITH {TOK}, m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS chg
  FROM tok WINDOW w AS (PARTITION BY user_id ORDER BY sm, event_id)),
 r AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY sm, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM m)
"""


@query(RUN_SQL + "SELECT user_id, run::BIGINT AS run, event_type AS label, min(sm) AS start_ms, max(sm) AS end_ms, count(*) AS n FROM r GROUP BY user_id, run, event_type")
def speaker_turns(spark: S, d: D) -> DataFrame:
    t = runs.turns(tokens(spark, d), KEYS, ORDER, "event_type", "sm", "sm")
    return t.withColumnRenamed("event_type", "label")


@query(RUN_SQL + "SELECT user_id, (run + 1)::BIGINT AS merge_id, event_type AS label, arg_min(sm, (sm, event_id)) AS start_ms, arg_max(em, (sm, event_id)) AS end_ms, count(*) AS n FROM r GROUP BY user_id, run, event_type")
def merge_runs(spark: S, d: D) -> DataFrame:
    return runs.merge_runs(tokens(spark, d), KEYS, ORDER, "event_type", "sm", "em").withColumnRenamed("event_type", "label")


@query(f"""WITH {TOK}, m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w OR sm - lag(em) OVER w >= 10800000 THEN 1 ELSE 0 END AS chg
  FROM tok WINDOW w AS (PARTITION BY user_id ORDER BY sm, event_id)),
 r AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY sm, event_id ROWS UNBOUNDED PRECEDING) - 1 AS island FROM m)
SELECT user_id, island::BIGINT AS island_id, event_type AS label, count(*) AS n, min(sm) AS start_ms, max(em) AS end_ms FROM r GROUP BY user_id, island, event_type""")
def gap_islands(spark: S, d: D) -> DataFrame:
    t = timeline.gap_islands(tokens(spark, d), KEYS, ORDER, "sm", "em", 3 * HOUR, "event_type")
    return t.groupBy("user_id", "island_id", F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("sm").alias("start_ms"), F.max("em").alias("end_ms"))


@query(f"""WITH {TOK}, a AS (SELECT *, lead(sm) OVER w AS ns, lead(em) OVER w AS ne FROM tok WINDOW w AS (PARTITION BY user_id ORDER BY sm, event_id)),
 b AS (SELECT *, CASE WHEN em > ns THEN (least(em, ne) + ns) // 2 END AS cut FROM a),
 c AS (SELECT *, coalesce(sum(CASE WHEN cut IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain FROM b),
 e AS (SELECT *, CASE WHEN cut IS NOT NULL THEN min(cut) OVER (PARTITION BY user_id, chain ORDER BY sm, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS rb FROM c),
 f AS (SELECT *, lag(rb) OVER (PARTITION BY user_id ORDER BY sm, event_id) AS lb FROM e)
SELECT event_id, user_id, greatest(sm, coalesce(lb, sm)) AS eff_start, greatest(greatest(sm, coalesce(lb, sm)), least(em, coalesce(rb, em))) AS eff_end,
  (greatest(sm, coalesce(lb, sm)) <> sm OR least(em, coalesce(rb, em)) <> em) AS clipped FROM f""")
def resolve_overlaps(spark: S, d: D) -> DataFrame:
    return timeline.resolve_overlaps(tokens(spark, d), KEYS, ORDER, "sm", "em").select("event_id", "user_id", "eff_start", "eff_end", "clipped")


@query(f"""WITH {TOK}, l AS (SELECT min(sm) + 86400000 AS lo, max(sm) - 86400000 AS hi FROM tok),
 c AS (SELECT t.*, least(greatest(sm, lo), hi) AS a, least(greatest(em, lo), hi) AS b FROM tok t, l)
SELECT user_id, event_id, least(a, b) AS start_ms, greatest(a, b) AS end_ms, (a <> sm OR b <> em) AS clamped,
 row_number() OVER (PARTITION BY user_id ORDER BY sm, em, event_id) <> row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS out_of_order FROM c""")
def timeline_clamp_flags(spark: S, d: D) -> DataFrame:
    t = tokens(spark, d)
    limits = t.agg((F.min("sm") + 24 * HOUR).alias("lo"), (F.max("sm") - 24 * HOUR).alias("hi")).first()
    return timeline.clamp_flags(t, KEYS, "sm", "em", "event_id", F.lit(limits.lo), F.lit(limits.hi))


@query(f"""WITH {TOK} SELECT event_id, sm AS start_ms, CASE WHEN em > lead(sm) OVER w THEN greatest(sm, lead(sm) OVER w) ELSE em END AS end_ms FROM tok WINDOW w AS (PARTITION BY user_id ORDER BY sm, event_id)""")
def clamp_overlap_lead(spark: S, d: D) -> DataFrame:
    return timeline.clamp_overlap(tokens(spark, d), KEYS, ORDER, "sm", "em").select("event_id", F.col("sm").alias("start_ms"), F.col("em").alias("end_ms"))


@query("""WITH p AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CASE WHEN len(s) = 0 THEN 0 ELSE i - 1 END::INT AS item_idx, CASE WHEN len(s) = 0 THEN 0 ELSE length(s[i]) END::INT AS n_chars, len(s) = 0 AS fallback
FROM p, unnest(range(1, greatest(len(s), 1) + 1)) t(i)""")
def explode_with_fallback(spark: S, d: D) -> DataFrame:
    t = timeline.explode_with_fallback(table(spark, d, "documents"), ["doc_id"], F.split(F.coalesce("text", F.lit("")), "\n"))
    return t.select("doc_id", "item_idx", F.length("item").alias("n_chars"), "fallback")


@query(f"""WITH {TOK}, s AS (SELECT *, CASE WHEN em - sm <= 5400000 THEN 0 ELSE (em - sm - 5400000 + 2699999) // 2700000 END AS steps FROM tok),
 c AS (SELECT event_id, sm, i AS chunk_idx, least(sm + i * 2700000 + 5400000, em) AS chunk_end FROM s, unnest(range(0, steps + 1)) t(i)),
 e AS (SELECT event_id, chunk_idx::BIGINT AS chunk_idx, greatest(chunk_end - 5400000, sm) AS chunk_start, chunk_end FROM c)
SELECT * FROM e WHERE chunk_end - chunk_start > 60000""")
def sliding_chunks(spark: S, d: D) -> DataFrame:
    return timeline.sliding_chunks(tokens(spark, d), "sm", "em", 90 * 60_000, 45 * 60_000, 60_000).select("event_id", "chunk_idx", "chunk_start", "chunk_end")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, (l_quantity * 20)::BIGINT AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, i::BIGINT AS window_idx, (i * 75)::BIGINT AS win_lo, least(i * 75 + 148, hi)::BIGINT AS win_hi FROM s, unnest(range(0, greatest((hi - 148 + 74) // 75, 0) + 1)) t(i)""")
def overlong_windows(spark: S, d: D) -> DataFrame:
    spans = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).cast("long").alias("lo"), (F.col("l_quantity") * 20).cast("long").alias("hi"))
    return timeline.overlong_windows(spans, "lo", "hi").select("l_orderkey", "l_linenumber", "window_idx", "win_lo", "win_hi")


@query(f"""WITH {TOK}, a AS (SELECT user_id, row_number() OVER w AS pos, greatest(em - sm, lead(sm) OVER w - em) AS gap, lead(sm) OVER w IS NULL AS last FROM tok WINDOW w AS (PARTITION BY user_id ORDER BY sm, event_id))
SELECT user_id, max(gap) AS gap_ms, arg_max(pos, (gap, -pos)) AS pos FROM a WHERE NOT last AND gap >= 21600000 GROUP BY user_id""")
def pause_candidates(spark: S, d: D) -> DataFrame:
    return timeline.pause_candidates(tokens(spark, d), KEYS, ORDER, "sm", "em", 6 * HOUR)


@query(f"""WITH {TOK}, q AS (SELECT user_id, value AS p FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM tok) WHERE r = round((n - 1) * 0.25) + 1),
 a AS (SELECT t.user_id, t.sm, t.event_id, t.value <= q.p AS hit, row_number() OVER (PARTITION BY t.user_id ORDER BY t.sm, t.event_id) AS pos FROM tok t JOIN q USING (user_id)),
 b AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, hit ORDER BY pos) AS g FROM a),
 c AS (SELECT user_id, g, count(*) AS n, min(pos) AS first_pos FROM b WHERE hit GROUP BY user_id, g)
SELECT user_id, max(n) AS n, arg_max(first_pos, (n, -first_pos)) AS first_pos FROM c GROUP BY user_id""")
def longest_quiet_run(spark: S, d: D) -> DataFrame:
    t = tokens(spark, d)
    p = frames.nearest_rank(t, KEYS, "value", "event_id", 0.25).select("user_id", "percentile")
    return runs.longest_run(t.join(p, "user_id"), KEYS, ORDER, F.col("value") <= F.col("percentile"))


@query(f"""WITH {TOK}, a AS (SELECT user_id, event_type = 'error' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY sm, event_id) AS pos FROM tok),
 b AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, hit ORDER BY pos) AS g FROM a)
SELECT user_id, count(*) AS n, min(pos) AS first_pos FROM b WHERE hit GROUP BY user_id, g HAVING count(*) >= 2""")
def consecutive_runs(spark: S, d: D) -> DataFrame:
    return runs.runs_where(tokens(spark, d), KEYS, ORDER, F.col("event_type") == "error", 2).select("user_id", "n", "first_pos")


@query("""WITH a AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS gaps FROM orders)
SELECT o_custkey, sum(CASE WHEN gaps = 0 THEN 1 ELSE 0 END)::BIGINT AS done_through, count(*) AS total FROM a GROUP BY o_custkey""")
def contiguous_prefix(spark: S, d: D) -> DataFrame:
    return runs.contiguous_prefix(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F")


@query("SELECT conv_id, role, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS idx FROM conversations GROUP BY conv_id, role")
def index_lists(spark: S, d: D) -> DataFrame:
    t = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list("turn")).alias("i"))
    return t.select("conv_id", "role", F.array_join("i", ",").alias("idx"))


@query(f"""WITH {TOK}, a AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (row_number() OVER w > 2 AND lag(event_type = 'purchase') OVER w) THEN 1 ELSE 0 END AS chg FROM tok WINDOW w AS (PARTITION BY user_id ORDER BY sm, event_id)),
 b AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY sm, event_id ROWS UNBOUNDED PRECEDING) - 1 AS sub FROM a)
SELECT user_id, sub::BIGINT AS sub_id, count(*) AS n, min(sm) AS start_ms FROM b GROUP BY user_id, sub""")
def sub_sentences(spark: S, d: D) -> DataFrame:
    t = timeline.sub_sentences(tokens(spark, d), KEYS, ORDER, F.col("event_type") == "purchase")
    return t.groupBy("user_id", "sub_id").agg(F.count(F.lit(1)).alias("n"), F.min("sm").alias("start_ms"))


OWNED = "o AS (SELECT user_id, (sm // 86400000) * 86400000 + 28800000 AS lo, (sm // 86400000) * 86400000 + 72000000 AS hi FROM tok GROUP BY ALL)"


@query(f"""WITH {TOK}, {OWNED} SELECT t.event_id, greatest(t.sm, o.lo) AS own_start, least(t.em, o.hi) AS own_end FROM tok t JOIN o ON t.user_id = o.user_id AND (t.sm + t.em) // 2 >= o.lo AND (t.sm + t.em) // 2 < o.hi""")
def interval_ownership_join(spark: S, d: D) -> DataFrame:
    t = tokens(spark, d)
    day = F.floor(F.col("sm") / (24 * HOUR)) * 24 * HOUR
    owned = t.select("user_id", (day + 8 * HOUR).alias("lo"), (day + 20 * HOUR).alias("hi")).distinct()
    return intervals.ownership(t, owned, KEYS, "sm", "em", "lo", "hi", 24 * HOUR).select("event_id", "own_start", "own_end")


@query(RUN_SQL + """, g AS (SELECT user_id, run, min(sm) AS lo, max(sm) AS hi FROM r GROUP BY user_id, run)
SELECT t.event_id, g.run::BIGINT AS run FROM r t JOIN g ON t.user_id = g.user_id AND t.sm >= g.lo AND t.sm <= g.hi""")
def interval_containment_join(spark: S, d: D) -> DataFrame:
    t = tokens(spark, d)
    turns = runs.turns(t, KEYS, ORDER, "event_type", "sm", "sm").select("user_id", "run", F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"))
    return intervals.containment(t.withColumn("stop", F.col("sm")), turns, KEYS, "sm", "stop", "lo", "hi", 24 * HOUR).select("event_id", "run")


@query(f"""WITH {TOK}, a AS (SELECT event_id, sm, max(em) OVER (PARTITION BY user_id ORDER BY sm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tok) SELECT event_id, sm, reach FROM a WHERE sm < reach""")
def overlap_violations(spark: S, d: D) -> DataFrame:
    return intervals.overlap_violations(tokens(spark, d), KEYS, ORDER, "sm", "em").select("event_id", "sm", "reach")


@query("""WITH c AS (SELECT l_orderkey, least(greatest(round(l_extendedprice * 10)::BIGINT, 0), 500000) AS s, least(greatest(round((l_extendedprice + l_quantity * 200) * 10)::BIGINT, 0), 500000) AS e FROM lineitem),
 g AS (SELECT l_orderkey, s AS start_ms, e AS end_ms, false AS fallback FROM c WHERE e - s > 50)
SELECT * FROM g UNION ALL SELECT l_orderkey, 0 AS start_ms, 500000 AS end_ms, true AS fallback FROM c WHERE l_orderkey NOT IN (SELECT l_orderkey FROM g) GROUP BY l_orderkey""")
def clamp_filter_fallback(spark: S, d: D) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 10).cast("long").alias("s"), F.round((F.col("l_extendedprice") + F.col("l_quantity") * 200) * 10).cast("long").alias("e"))
    return intervals.clamp_filter_fallback(t, ["l_orderkey"], "s", "e", F.lit(500_000).cast("long"), 50)


@query("""SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate)//1000 AS ship_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE epoch_us(l_shipdate)//1000 < epoch_us(o_orderdate)//1000 OR epoch_us(l_shipdate)//1000 + 86400000 > epoch_us(o_orderdate)//1000 + 8640000000 OR false""")
def containment_violations(spark: S, d: D) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", timing.epoch_ms("o_orderdate").alias("lo"))
    t = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("ship_ms", timing.epoch_ms("l_shipdate"))
    t = t.withColumns({"stop": F.col("ship_ms") + 24 * HOUR, "hi": F.col("lo") + 2400 * HOUR})
    return intervals.containment_violations(t, "ship_ms", "stop", "lo", "hi").select("l_orderkey", "l_linenumber", "ship_ms")


@query("SELECT user_id, value AS percentile, n FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = round((n - 1) * 0.75) + 1")
def nearest_rank_percentile(spark: S, d: D) -> DataFrame:
    return frames.nearest_rank(table(spark, d, "events"), KEYS, "value", "event_id", 0.75)


@query(f"""WITH {TOK}, a AS (SELECT *, row_number() OVER w AS pos, sum(least(round(value * 100), 5000)::BIGINT) OVER w AS c, least(round(value * 100), 5000)::BIGINT AS x FROM tok WINDOW w AS (PARTITION BY user_id ORDER BY sm, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, pos FROM a WHERE c // 5000 > (c - x) // 5000""")
def integrate_and_fire(spark: S, d: D) -> DataFrame:
    """The library's fold over each recording's array of weights; no step is above the threshold, so SQL can say it by a running sum."""
    x = F.least(F.round(F.col("value") * 100), F.lit(5000)).cast("double")
    t = tokens(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sm", "event_id", x.alias("x")))), lambda s: s["x"]).alias("alphas"))
    return t.select("user_id", F.explode(V.fires(F.col("alphas"), 5000.0)).alias("pos")).select("user_id", (F.col("pos") + 1).cast("long").alias("pos"))


@query(f"""WITH {TOK}, a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY sm, event_id) - 1 AS i FROM tok) SELECT user_id, i - 1.5::DOUBLE AS place FROM a WHERE value / 100 >= 1 - 1e-4::DOUBLE""")
def threshold_positions(spark: S, d: D) -> DataFrame:
    t = tokens(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sm", "event_id", "value"))), lambda s: s["value"] / 100).alias("peaks"))
    return t.select("user_id", F.explode(V.fire_places(F.col("peaks"))).alias("place"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 16)::BIGINT AS n, (l_quantity * 37)::BIGINT AS a, (l_quantity * 91)::BIGINT AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, n * 1000 // 16000 AS ms, CASE WHEN n < 400 THEN 0 ELSE (n - 400) // 160 + 1 END AS frames, least(a * 16, n) AS lo, least(b * 16, n) AS hi FROM s""")
def time_bucket_math(spark: S, d: D) -> DataFrame:
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 16).cast("long").alias("n"), (F.col("l_quantity") * 37).cast("long").alias("a"), (F.col("l_quantity") * 91).cast("long").alias("b"))
    lo, hi = timing.sample_range(F.col("a"), F.col("b"), F.col("n"))
    return s.select("l_orderkey", "l_linenumber", timing.samples_to_ms(F.col("n")).alias("ms"), timing.frame_count(F.col("n")).alias("frames"), lo.alias("lo"), hi.alias("hi"))


@query("SELECT o_orderkey, 1500 + 305 * (o_totalprice / 10000) + CASE WHEN o_orderstatus = 'P' THEN 587 * (o_totalprice / 10000) ELSE 0 END AS mb FROM orders")
def memory_estimate(spark: S, d: D) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", timing.memory_mb(F.col("o_totalprice") / 10000, F.col("o_orderstatus") == "P").alias("mb"))


@query(f"""WITH {TOK}, a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY sm, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM tok)
SELECT a.user_id, a.p // 3 AS out_frame, round(sum(b.value * (j + 3)), 6) AS checksum FROM a CROSS JOIN unnest(range(-2, 3)) t(j) JOIN a b ON a.user_id = b.user_id AND b.p = least(greatest(a.p + j, 0), a.n - 1) WHERE a.p % 3 = 0 GROUP BY a.user_id, a.p""")
def frame_stack(spark: S, d: D) -> DataFrame:
    t = tokens(spark, d).withColumn("v", F.array("value"))
    out = frames.stack_frames(t, KEYS, ORDER, "v", 5, 3)
    return out.select("user_id", "out_frame", r6(F.aggregate(F.transform("stacked", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)).alias("checksum"))


@query("SELECT role AS label, sum(greatest(length(text) * 60, 0))::BIGINT AS total_ms, count(*) AS n FROM conversations GROUP BY role")
def speaker_durations(spark: S, d: D) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("role").alias("label")).agg(F.sum(F.greatest(F.length("text") * 60, F.lit(0))).alias("total_ms"), F.count(F.lit(1)).alias("n"))


NAMES = "CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE '(' || event_type || ')' END"


def named(spark: S, d: D) -> DataFrame:
    """Display names by a look-up of a few names; a label without one is shown in brackets."""
    names = spark.createDataFrame([("click", "browse"), ("view", "browse"), ("signup", " ")], "event_type string, name string")
    return tokens(spark, d).join(names, "event_type", "left").withColumn("display", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("("), "event_type", F.lit(")"))))


@query(f"SELECT event_id, {NAMES} AS display FROM events")
def display_names(spark: S, d: D) -> DataFrame:
    return named(spark, d).select("event_id", "display")


@query(f"""WITH {TOK}, a AS (SELECT *, {NAMES} AS display FROM tok), b AS (SELECT *, CASE WHEN display IS DISTINCT FROM lag(display) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS chg FROM a WINDOW w AS (PARTITION BY user_id ORDER BY sm, event_id)),
 c AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY sm, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM b),
 f AS (SELECT user_id, run, display, event_type, min((sm, event_id)) AS first, count(*) AS k FROM c GROUP BY ALL)
SELECT user_id, run::BIGINT AS run, display, string_agg(event_type, ',' ORDER BY first) AS labels, sum(k)::BIGINT AS n FROM f GROUP BY user_id, run, display""")
def merge_by_name(spark: S, d: D) -> DataFrame:
    t = runs.label_runs(named(spark, d), KEYS, ORDER, "display")
    first = t.groupBy("user_id", "run", "display", "event_type").agg(F.min(F.struct("sm", "event_id")).alias("first"), F.count(F.lit(1)).alias("k"))
    out = first.groupBy("user_id", "run", "display").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("l"), F.sum("k").alias("n"))
    return out.select("user_id", "run", "display", F.array_join(F.transform("l", lambda x: x["event_type"]), ",").alias("labels"), "n")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS segment_id, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> ''")
def segments_from_turns(spark: S, d: D) -> DataFrame:
    from echoweave.functions.text import strip

    t = table(spark, d, "conversations").withColumn("text", strip(F.col("text"))).where("text <> ''")
    return t.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("segment_id"), "role", "text")


@query("""WITH n AS (SELECT user_id, count(*) AS total FROM events GROUP BY user_id)
SELECT user_id, i::BIGINT AS batch, (i * 48)::BIGINT AS lo, least(i * 48 + 64, total)::BIGINT AS hi FROM n, unnest(range(0, CASE WHEN total <= 64 THEN 1 ELSE (total - 16 + 47) // 48 END)) t(i)""")
def batch_ranges(spark: S, d: D) -> DataFrame:
    from echoweave.operators.vectors import batch_ranges as ranges

    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return n.select("user_id", F.explode(ranges(F.col("total"), 64, 16)).alias("r")).select("user_id", "r.batch", "r.lo", "r.hi")


@query()
def pack_windows(spark: S, d: D) -> DataFrame:
    """Tokens of a recording with a size in frames; days are sentences."""
    t = tokens(spark, d).withColumns({"pos": F.row_number().over(runs.ordered(KEYS, ORDER)).cast("long"), "sentence_id": F.floor(F.col("sm") / (24 * HOUR)), "frames": F.ceil(F.col("value")).cast("long")})
    return folds.pack_windows(t, KEYS)


@query()
def endpoint_segments(spark: S, d: D) -> DataFrame:
    """Frames of a recording per user: speech where the event isn't an error."""
    t = tokens(spark, d).select("user_id", F.row_number().over(runs.ordered(KEYS, ORDER)).alias("frame_id"), (F.col("event_type") != "error").alias("is_speech"))
    return folds.endpoint_segments(t, KEYS, window=4, enter=3, leave=2, start_back=2, quiet=2, end_back=1, longest=300)


@query()
def interval_batch_merge(spark: S, d: D) -> DataFrame:
    """Segments of a user's month, in hours as seconds."""
    t = tokens(spark, d)
    first = t.groupBy("user_id").agg(F.min("sm").alias("t0"))
    seg = t.join(first, "user_id").select("user_id", F.floor((F.col("sm") - F.col("t0")) / 3600).alias("start_ms"), F.floor((F.col("em") - F.col("t0")) / 3600).alias("end_ms"), F.lit(900_000).cast("long").alias("total_ms"))
    return folds.interval_batches(seg, KEYS)


@query(f"WITH {TOK}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sm, event_id) AS heard, count(*) OVER (PARTITION BY user_id) AS frames FROM tok) SELECT user_id, event_id, round(0.3 * heard / greatest(frames, 1) + 0.7 * least(value / 500, 1), 9) AS progress FROM n")
def combined_progress(spark: S, d: D) -> DataFrame:
    """How far a recording is, from the frames heard and the fraction recognised."""
    t = tokens(spark, d).withColumns({"heard": F.row_number().over(runs.ordered(KEYS, ORDER)), "recognised": F.least(F.col("value") / 500, F.lit(1.0))})
    t = t.withColumn("frames", F.count(F.lit(1)).over(W.partitionBy("user_id")))
    return t.select("user_id", "event_id", F.round(timing.combined_progress(F.col("heard"), F.col("frames"), F.col("recognised")), 9).alias("progress"))


@query()
def progress_throttle(spark: S, d: D) -> DataFrame:
    t = tokens(spark, d).select("user_id", F.row_number().over(runs.ordered(KEYS, ORDER)).cast("long").alias("pos"), F.col("event_type").alias("stage"), F.least(F.col("value") / 200, F.lit(1.0)).alias("fraction"))
    return folds.progress_throttle(t, KEYS)
