"""Catalog queries: history, paging, queue, transitions, entity resolution, incremental totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import materialized

PAGE = 50
#: A status, and the statuses that may follow it.
TRANSITIONS = {"queued": ("running", "cancelled"), "running": ("done", "partial", "failed", "cancelled"), "partial": ("queued",), "failed": ("queued",), "cancelled": ("queued",), "done": ("queued",)}


def latest(*times: str) -> Column:
    """The latest of some nullable times."""
    return F.greatest(*times)


def history(df: DataFrame, status: str, shown: Sequence[str], activity: str, key: str) -> DataFrame:
    """Rows of the shown statuses, the latest activity first, ties to the larger key; pos from 1.

    The position over the whole catalog needs its total order: a range-partitioned
    sort counts the rows before each partition instead of one window over all.
    """
    return positioned(df.where(F.col(status).isin(*shown)), [F.desc(activity), F.desc(key)])


def positioned(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Number all rows from 1 in a total order, without one task holding all: sorted ranges, and their counts before."""
    ranged = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    # the ranges' bounds come from samples: counts and rows have to come from one evaluation
    ranged = materialized(ranged.withColumns({"_p": F.shiftright("_id", 33), "_i": F.col("_id").bitwiseAND((1 << 33) - 1)}))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", before.alias("_before"))
    return ranged.join(starts, "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_id", "_p", "_i", "_before")


def page(df: DataFrame, number: int, order: Sequence[Column], size: int = PAGE) -> DataFrame:
    """A page of rows with the number of all; a page beyond the last is the last."""
    total = df.count()
    number = min(max(number, 0), max(0, (total - 1) // size))
    return df.orderBy(*order).offset(number * size).limit(size).withColumn("total", F.lit(total).cast("long"))


def renumber(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "queue_order") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def illegal_transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], status: str, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Neighbouring statuses that the table doesn't allow; staying in one is no transition."""
    before = F.lag(status).over(W.partitionBy(*keys).orderBy(*order))
    ok = F.lit(False)
    for a, follow in allowed.items():
        ok = ok | ((F.col("before") == a) & F.col(status).isin(*follow))
    return df.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(status)) & ~ok)


def referenced(df: DataFrame, refs: DataFrame, paths: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows that refs mention by any of the paths (column, column of refs): one equi semi-join a path, no OR in a join."""
    out = None
    for key, ref in paths:
        hit = df.join(refs.select(F.col(ref).alias("_r")).where("_r is not null").distinct(), F.col(key) == F.col("_r"), "left_semi")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def unreferenced(df: DataFrame, refs: DataFrame, paths: Sequence[tuple[str, str]]) -> DataFrame:
    for key, ref in paths:
        df = df.join(refs.select(F.col(ref).alias("_r")).where("_r is not null").distinct(), F.col(key) == F.col("_r"), "left_anti")
    return df


def get_or_create(names: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Names that no known one equals, blanks and case aside; the first spelling of each."""
    key = F.lower(F.trim(name))
    new = names.where(F.trim(name) != "").groupBy(key.alias("key")).agg(F.min(F.trim(name)).alias(name))
    return new.join(known.select(key.alias("key")).distinct(), "key", "left_anti")


def delta_upsert(totals: DataFrame, old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """total = max(0, total - old) + new for each key of any side: applying the same contribution again changes nothing."""
    side = lambda df, n: df.select(*keys, F.col(value).alias(n))
    rows = side(totals, "_t").join(side(old, "_o"), list(keys), "full_outer").join(side(new, "_n"), list(keys), "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(*keys, (F.greatest(F.lit(0), zero("_t") - zero("_o")) + zero("_n")).alias(value))


def import_dedup(incoming: DataFrame, catalog: DataFrame, key: str, status: str) -> DataFrame:
    """What to do with each incoming file: keep what is done or active, replace what failed, insert what is new."""
    joined = incoming.join(catalog.select(key, F.col(status).alias("_s")), key, "left")
    return joined.withColumn("action", F.when(F.col("_s").isNull(), "insert").when(F.col("_s").isin("failed", "cancelled"), "replace").otherwise("keep")).drop("_s")


#: What a cleanup's state is before anything has happened.
CLEANUP_NONE = "none"


def cleanup_states(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The state of each job's cleanup after its events, in order: key, status, cleaned_at, model, seconds, before (seconds that a resumed run goes on from).

    events(key, order, op, at, model, seconds, flag, baseline): ``run`` starts
    (flag: resumes, which keeps what was done), ``complete`` sets model, time and
    seconds, ``cancel`` and ``fail`` leave them (flag: a failure clears the
    completion), ``invalidate`` forgets everything, ``restore`` takes the baseline
    (struct of status, cleaned_at, model, seconds). Other events change nothing.
    """
    at = events.schema["at"].dataType.simpleString()
    kind = f"struct<status:string,cleaned_at:{at},model:string,seconds:double,before:double>"
    null = lambda t: F.lit(None).cast(t)

    def state(status: Column, cleaned: Column, model: Column, seconds: Column, before: Column) -> Column:
        return F.struct(status.alias("status"), cleaned.alias("cleaned_at"), model.alias("model"), seconds.cast("double").alias("seconds"), before.cast("double").alias("before")).cast(kind)

    def step(s: Column, e: Column) -> Column:
        keep = (s["cleaned_at"], s["model"], s["seconds"], s["before"])
        fresh = state(F.lit("running"), null(at), null("string"), F.lit(0.0), F.lit(0.0))
        ran = F.when(e["flag"], state(F.lit("running"), s["cleaned_at"], s["model"], s["seconds"], s["seconds"])).otherwise(fresh)
        failed = F.when(e["flag"], state(F.lit("failed"), null(at), null("string"), s["seconds"], s["before"])).otherwise(state(F.lit("failed"), *keep))
        b = e["baseline"]
        return (
            F.when(e["op"] == "run", ran).when(e["op"] == "complete", state(F.lit("done"), e["at"], e["model"], e["seconds"], s["before"])).when(e["op"] == "cancel", state(F.lit("cancelled"), *keep)).when(e["op"] == "fail", failed)
            .when(e["op"] == "invalidate", state(F.lit(CLEANUP_NONE), null(at), null("string"), F.lit(0.0), F.lit(0.0))).when(e["op"] == "restore", state(b["status"], b["cleaned_at"], b["model"], b["seconds"], s["before"])).otherwise(s)
        )

    ordered = F.array_sort(F.collect_list(F.struct(*order, "op", "at", "model", "seconds", "flag", "baseline")))
    start = state(F.lit(CLEANUP_NONE), null(at), null("string"), F.lit(0.0), F.lit(0.0))
    return events.groupBy(key).agg(ordered.alias("_e")).select(key, F.aggregate("_e", start, step).alias("s")).select(key, "s.*")
