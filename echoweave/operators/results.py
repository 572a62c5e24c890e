"""Result documents: layers, projections, speaker mappings, split sets and the figures of a finished job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runs import ordered

#: The label and the fingerprint of rows that no profile owns.
SENTINEL, SENTINEL_ID = "Speaker", "fp_system_speaker"
#: Vectors of a batch at most; edges that a node keeps at least.
BATCH_LIMIT, LEAST_EDGES = 4096, 6


def active_layer(base: DataFrame, derived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The derived rows of each key that has any, else its base rows. Both have the same columns."""
    return base.join(derived.select(*keys).distinct(), list(keys), "left_anti").select(*base.columns).unionByName(derived)


def projection(rows: DataFrame, label: str, included: Sequence[str], text: Column) -> DataFrame:
    """Rows of the included labels with the text of the view."""
    return rows.where(F.col(label).isin(*included)).withColumn("shown", text)


def changed_labels(derived: DataFrame, label: str, baseline: str) -> DataFrame:
    """Derived rows whose label isn't their baseline's."""
    return derived.where(~F.col(label).eqNullSafe(F.col(baseline)))


def success_metrics(utterances: DataFrame, key: str, order: str, end_ms: str, label: str, source_seconds: DataFrame) -> DataFrame:
    """key, duration (the longer of the source, source_seconds(key, seconds), and the end of the last utterance), total and named speakers."""
    last = utterances.groupBy(key).agg(F.max_by(end_ms, order).alias("_end"), F.count_distinct(label).alias("total_speakers"))
    rows = source_seconds.join(last, key, "left")
    return rows.select(key, F.greatest("seconds", F.coalesce("_end", F.lit(0)) / 1000.0).alias("duration"), F.coalesce("total_speakers", F.lit(0)).alias("total_speakers"), F.lit(0).cast("long").alias("named_speakers"))


def distinct_in_order(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Each key's different values in the order of their first occurrence, with pos from 1."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    return first.withColumn("pos", F.row_number().over(ordered(keys, ["_first", value]))).drop("_first")


def speaker_rows(labels: DataFrame, keys: Sequence[str], label: str, fingerprints: DataFrame, profiles: DataFrame) -> DataFrame:
    """labels with fingerprint_id and profile_id by key and label, null where there is none; the sentinel label has its fixed fingerprint."""
    on = [*keys, label]
    rows = labels.join(fingerprints, on, "left").join(profiles, on, "left")
    return rows.withColumn("fingerprint_id", F.when(F.col(label) == SENTINEL, SENTINEL_ID).otherwise(F.col("fingerprint_id")))


def hydrated(mapping: DataFrame, current: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """mapping(keys, label, profile_id) with missing ids filled from the profiles of the same job, current(keys, label, id), and whether a row changed."""
    rows = mapping.join(current.select(*keys, label, F.col("id").alias("_id")), [*keys, label], "left")
    changed = F.col("profile_id").isNull() & F.col("_id").isNotNull()
    return rows.withColumns({"profile_id": F.coalesce("profile_id", "_id"), "changed": changed}).drop("_id")


def bound(mapping: DataFrame, keys: Sequence[str], profile: str, binding: DataFrame) -> DataFrame:
    """Counts of each key after binding(profile, person): named profiles (different persons) and all (persons and unbound profiles)."""
    rows = mapping.join(binding, profile, "left")
    who = F.coalesce(F.concat(F.lit("p:"), F.col("person").cast("string")), F.concat(F.lit("u:"), F.col(profile).cast("string")))
    return rows.groupBy(*keys).agg(F.count_distinct("person").alias("named"), F.count_distinct(who).alias("total"))


def preflight(vectors: DataFrame, keys: Sequence[str], vector: str, dims: int, limit: int = BATCH_LIMIT) -> DataFrame:
    """What clustering does with each key's vectors: single, rejected (a wrong length or a value that isn't finite), batched or proceed. A key without rows has none: it is empty."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce((F.size(vector) == dims) & finite, F.lit(False))
    rows = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("good"))
    return rows.select(*keys, "n", F.when(F.col("n") == 1, "single").when(~F.col("good"), "rejected").when(F.col("n") > limit, "batched").otherwise("proceed").alias("action"))


def retained_edges(n: Column, share: float, least: int = LEAST_EDGES) -> Column:
    """Edges that a node of n keeps: a share of n, of a small n at least a fixed number."""
    p = F.when(n * F.lit(share) < least, F.try_divide(F.lit(float(least)), n)).otherwise(F.lit(share))
    pruned = F.least(n, F.greatest(F.lit(0).cast("long"), F.when(p <= 1, F.floor((1 - p) * n)).otherwise(0)))
    return F.greatest(F.lit(0).cast("long"), n - pruned)


def offset_tokens(tokens: Column, by: Column) -> Column:
    """array<struct(text, start, end)> moved by the start of their batch."""
    return F.transform(tokens, lambda t: F.struct(t["text"].alias("text"), (t["start"] + by).alias("start"), (t["end"] + by).alias("end")))


def merged_outputs(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The workers' rows of each key in one order, with pos from 1."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("pos", F.row_number().over(ordered(keys, order)))


def effective_tokens(token_num: Column, values: Column, vocabulary: int) -> Column:
    """How many steps of values / vocabulary are decoded: token_num of them, 0 or less means all."""
    steps = F.floor(values / vocabulary)
    return F.when(token_num > 0, F.least(token_num.cast("long"), steps)).otherwise(steps)


def window_majority(votes: DataFrame, window: Sequence[str], label: str) -> DataFrame:
    """The most frequent label of each window, ties to the smaller one; windows without a label have no row."""
    n = votes.where(F.col(label).isNotNull()).groupBy(*window, label).agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(ordered(window, [F.desc("votes"), F.col(label)]))
    return n.withColumn("_r", rank).where("_r = 1").drop("_r")


def split_metadata_violations(splits: DataFrame, key: str, labels: str, version: str, baseline: DataFrame, label: str) -> DataFrame:
    """splits(key, labels array, version) against the labels of baseline(key, label) -> key, rule, value."""
    each = splits.select(key, F.explode(labels).alias("value"), F.lit(1).alias("n"), F.lit(0).alias("known"))
    known = baseline.select(key, F.col(label).alias("value"), F.lit(0).alias("n"), F.lit(1).alias("known"))
    # a sum a label instead of a table a rule: nothing is sorted or joined
    sums = each.unionByName(known).groupBy(key, "value").agg(F.sum("n").cast("int").alias("n"), F.max("known").alias("known")).where("n > 0")
    blank, none = F.trim("value") == "", F.array().cast("array<string>")
    rules = F.concat(
        F.when(blank, F.array_repeat(F.lit("blank"), F.col("n"))).otherwise(none),
        F.when(F.col("n") > 1, F.array(F.lit("duplicate"))).otherwise(none),
        F.when(~blank & ((F.col("known") == 0) | F.col(key).isNull()), F.array(F.lit("unknown"))).otherwise(none),
    )
    value = F.col("value").cast("string").alias("value")
    versions = splits.where(F.col(version) != 1).select(key, F.lit("version").alias("rule"), F.col(version).cast("string").alias("value"))
    return versions.unionByName(sums.select(key, F.explode(rules).alias("rule"), value))


def toggled(labels: Column, label: Column) -> Column:
    """The split set with the label taken out if it was in, else put in, in order."""
    return F.array_sort(F.when(F.array_contains(labels, label), F.array_except(labels, F.array(label))).otherwise(F.array_union(labels, F.array(label))))


#: The one label of a result without speakers.
ONLY_LABEL = "Speaker1"


def partial_results(sentences: DataFrame, key: str, order: Sequence[str], text: str) -> DataFrame:
    """Segments of a result that has no speakers yet: the sentences that aren't blank, trimmed, numbered from 1, all of one label."""
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    kept = sentences.withColumn(text, trimmed).where(F.col(text) != "")
    return kept.withColumns({"segment_id": F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"), "label": F.lit(ONLY_LABEL)})


def source_range(spans: Column, frame_ms: int = 10) -> Column:
    """struct(start_ms, end_ms) of a window's spans (array of struct(lo, hi) in frames): from the first to the last, a frame at least; without spans the first frame."""
    start = F.coalesce(F.array_min(F.transform(spans, lambda s: s["lo"])), F.lit(0))
    end = F.greatest(F.coalesce(F.array_max(F.transform(spans, lambda s: s["hi"])), start), start + 1)
    return F.struct((start * frame_ms).cast("long").alias("start_ms"), (end * frame_ms).cast("long").alias("end_ms"))


def header_violations(documents: DataFrame, key: str, expected: str, version: str, seconds: str, versions: Sequence[int] = (1,)) -> DataFrame:
    """What is wrong with documents' heads: key, rule. Blank or unexpected ids, unknown versions, cleanup seconds that are negative or not finite; null ones aren't checked."""
    rules = {
        "empty id": F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "", "other id": F.col(expected).isNotNull() & ~F.col(expected).eqNullSafe(F.col(key)), "version": F.col(version).isNotNull() & ~F.col(version).isin(*versions),
        "cleanup seconds": F.col(seconds).isNotNull() & (F.isnan(F.col(seconds).cast("double")) | (F.abs(F.col(seconds)) == float("inf")) | (F.col(seconds) < 0)),
    }
    each = F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules.items())))
    return documents.select(F.col(key), F.explode(each).alias("rule"))


def split_outcomes(states: DataFrame, requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What toggling a label does to a job's split: key, outcome, labels, baseline.

    states(key, identity, labels, baseline) has the jobs with an open split,
    requests(key, identity, label, cleanup) one toggle of each job, known(key,
    label) the labels that may be split. A split of another snapshot's identity is
    discarded, with its baseline given back; a label that is neither marked nor
    known is refused and changes nothing; a set that becomes empty restores the
    baseline; else the new set is committed, with the cleanup before the first
    split as its baseline.
    """
    state = states.select(key, F.col("identity").alias("_was"), F.col("labels").alias("_labels"), "baseline")
    may = known.select(key, "label", F.lit(True).alias("_may")).distinct()
    rows = requests.join(state, key, "left").join(may, [key, "label"], "left")
    before = F.coalesce("_labels", F.array().cast("array<string>"))
    after, marked = toggled(before, F.col("label")), F.array_contains(before, F.col("label"))
    outcome = F.when(F.col("_was").isNotNull() & (F.col("_was") != F.col("identity")), "discard").when(~marked & F.col("_may").isNull(), "refuse").when(F.size(after) == 0, "restore").otherwise("commit")
    rows = rows.withColumn("outcome", outcome)
    labels = F.when(F.col("outcome") == "commit", after).when(F.col("outcome") == "refuse", before).otherwise(F.array().cast("array<string>"))
    baseline = F.when(F.col("outcome") == "commit", F.coalesce("baseline", "cleanup")).otherwise(F.col("baseline"))
    return rows.select(key, "outcome", labels.alias("labels"), baseline.alias("baseline"))


def collated_order(df: DataFrame, keys: Sequence[str], title: str, name: str = "pos") -> DataFrame:
    """Rows numbered from 1 as a reader sorts their titles: letters before accents before case, titles alike by their code points. Null titles come first."""
    order = [F.collate(F.col(title), "UNICODE_CI_AI"), F.collate(F.col(title), "UNICODE_CI"), F.collate(F.col(title), "UNICODE"), F.col(title)]
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))


def artifact_paths(df: DataFrame, key: str, paths: Sequence[str]) -> DataFrame:
    """All different files of a job in the order of the columns, with pos from 0; null ones are left out."""
    return df.select(key, F.posexplode(F.array_distinct(F.array_compact(F.array(*paths)))).alias("pos", "path"))
