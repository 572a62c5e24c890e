"""Mixing sources to target weights (DataFrame functions only).

Efraimidis-Spirakis sampling: every document draws the exponential key
``-ln(u) / weight`` and documents are taken in key order until their source's
word budget is used up. A budget above the source's size is first served by
complete epochs; only the fraction that is left is selected by key.

Scale: word counts are computed in the scan; only (doc_id, source, size, key)
moves. The running sum inside a source is taken in two levels - sums of key
ranges, then rows inside one range - so a source with most of the rows is still
dealt over ``KEY_RANGES`` groups, and no window ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import doc_columns, word_count

#: Key ranges of a source: rows of a range meet in one task.
KEY_RANGES = 1024
#: Source weights, repeated over the sources in code point order.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Sampling weight of a document by its quality label.
QUALITY_WEIGHT = {1: 4.0, 0: 1.0, None: 2.0}


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) -> source, source_size, target; one row per source.

    Targets share the whole size by weight; a target stops at ``max_epochs``
    times its source's size and the excess is shared again by weight. With the
    sources in the order of cap / weight the capped ones are a prefix, so one
    ordered pass finds them; the table has one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    ordered = W.orderBy("cap_per_weight", F.asc_nulls_last("source"))
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest_size = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    capped = (
        per_source.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.col("cap") * rest_weight <= F.col("weight") * rest_size)
    )
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    free_size = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.try_divide(F.col("weight") * free_size.cast("double"), free_weight.cast("double")))
    return capped.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, key_ranges: int = KEY_RANGES) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken.

    taken: words that the mix takes from the document, repeats counted: whole
    epochs of its source, then, in key order, words of the fractional epoch;
    the last document of a source may be taken in part, so taken words come to
    the target but for a fraction of a word. At most ``max_epochs`` times the size.

    Null or empty text: size 0, taken 0. A null source is a source of its own.
    quality(doc_id, quality) sets the sampling weight; documents without a
    label, or with a null one, have the weight of None; of several labels the
    largest counts. Equal keys are taken by doc_id, size and text, so reruns
    agree; rows that repeat a doc_id are taken one after the other. No documents: no rows. Other columns are ignored.
    """
    return mixed_rows(docs, quality, weights, max_epochs, key_ranges).drop("text_key")


def mixed_rows(docs: DataFrame, quality: DataFrame | None, weights: tuple[int, ...], max_epochs: int, key_ranges: int) -> DataFrame:
    """mix() with text_key, which tells rows of one doc_id apart."""
    sized = doc_columns(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))
    if quality is not None:
        labels = doc_columns(quality, "doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("_q"))
        sized = sized.join(labels, "doc_id", "left")
    else:
        sized = sized.withColumn("_q", F.lit(None).cast("int"))
    wt = F.when(F.col("_q") == 1, QUALITY_WEIGHT[1]).when(F.col("_q") == 0, QUALITY_WEIGHT[0]).otherwise(QUALITY_WEIGHT[None])
    # u in (0, 1) from the first 52 bits of the id's digest: reruns and retries agree
    # (of a null id: from the text's key, so that such documents are dealt over the ranges)
    seed = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("text_key").cast("string")))
    bits = F.conv(F.substring(F.md5(seed.cast("binary")), 1, 13), 16, 10).cast("long")
    u = (bits.cast("double") + 0.5) / float(2**52)
    keyed = sized.select("doc_id", "source", "size", "text_key", (-F.log(u) / wt).alias("key"))
    # the key's own order, cut into ranges of about equal counts where weights are equal
    keyed = keyed.withColumn("range", F.floor((1 - F.exp(-F.col("key") * QUALITY_WEIGHT[None])) * key_ranges))
    by_range = keyed.groupBy("source", "range").agg(F.sum("size").alias("size"))
    targets = source_targets(by_range, weights, max_epochs)
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = by_range.select("source", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("range_before"))
    same = lambda a, b: a.eqNullSafe(b)
    t = targets.alias("t")
    ranges = ranges.alias("r").join(t, same(F.col("r.source"), F.col("t.source"))).select("r.*", "t.source_size", "t.target")
    k, r = keyed.alias("k"), ranges.alias("r")
    rows = k.join(r, same(F.col("k.source"), F.col("r.source")) & (F.col("k.range") == F.col("r.range"))).select("k.*", "r.range_before", "r.source_size", "r.target")
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, -1)
    prefix = F.col("range_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0))
    rows = rows.withColumn("prefix", prefix).withColumn("epochs", epochs.cast("long"))
    left = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("prefix")))
    return rows.select("doc_id", "text_key", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, key_ranges: int = KEY_RANGES) -> DataFrame:
    """The mixed corpus: every document, all its columns, as often as it is taken - whole, so taken / size is rounded.

    A source misses its target by half a document at most, and by the rounding
    of each group of rows that repeat an id and a text: these are all taken as
    often as they are on average. Documents without words, and so null texts,
    are not taken; null ids and null sources are like any other value.
    """
    taken = mixed_rows(docs, quality, weights, max_epochs, key_ranges).where("taken > 0")
    times = taken.groupBy("doc_id", "text_key").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("_times")).where("_times > 0")
    times = times.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_times")
    rows = docs.join(times, docs["doc_id"].eqNullSafe(times["_id"]) & (F.xxhash64(docs["text"]) == times["_key"]))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*(docs[f"`{c}`"] for c in docs.columns))


#: The whole query in DuckDB.
MIX_SQL = """
WITH sized AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / (CASE l.q WHEN 1 THEN 4.0::DOUBLE WHEN 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS cap,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_size,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM per_source
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * ((sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))::BIGINT::DOUBLE)
    / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::BIGINT::DOUBLE END AS target
  FROM (SELECT *, cap * rest_weight <= weight * rest_size AS capped FROM ordered)
), rows AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - prefix)))::BIGINT AS taken
FROM rows
"""
