"""Result documents: constraints, edits, upserts, punctuation decisions, identities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoweave.functions.hashing import fnv1a64
from echoweave.functions.text import strip

from .folds import DOCUMENTS, lists, ordered_fold

#: The model's marks by id (from 0), its limits of context.
MARKS = ("<unk>", "_", "，", "。", "？", "、")
MODEL_TERMINAL = ("。", "？")
POP_AFTER, FLUSH_AFTER = 200, 400


def duplicate_keys(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_keys(df: DataFrame, known: DataFrame, on: Column) -> DataFrame:
    return df.join(known, on, "left_anti")


def violations(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule of a row, in one pass."""
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of both; a value of ``new`` wins unless it is null."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    return joined.select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in (*keys, *values)))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that the tables don't have equally often, and n, by how many they differ: one sum over both."""
    both = a.withColumn("n", F.lit(1)).unionByName(b.withColumn("n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.abs(F.sum("n")).alias("n")).where("n > 0")


def carry_overrides(fresh: DataFrame, old: DataFrame, key: Sequence[str], same: Sequence[str], override: str) -> DataFrame:
    """An old row's override stays where all its ``same`` columns are unchanged."""
    o = old.select(*(F.col(c).alias(f"_{c}") for c in (*key, *same, override)))
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    unchanged = F.lit(True)
    for c in same:
        unchanged = unchanged & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return fresh.join(o, on, "left").withColumn(override, F.when(unchanged, F.col(f"_{override}"))).select(*fresh.columns, override)


def apply_cleanup(df: DataFrame, cleaned: Column, raw: Column, label: Column) -> DataFrame:
    """Cleaned text without a label in front; a blank one falls back to the marked raw text and is a failure."""
    from echoweave.functions.text import strip_label

    text = strip(F.coalesce(strip_label(cleaned, label), F.lit("")))
    return df.withColumns({"content": F.when(text == "", F.concat(F.lit("⚠️"), raw)).otherwise(text), "failed": text == ""})


def flush_decision(ids: Column, tokens: Column, last: Column) -> Column:
    """Where a chunk's context may be cut: the last index to flush, -1 for none; the last position is never looked at."""
    n = F.size(ids)
    at = lambda marks: F.array_max(F.filter(F.transform(ids, lambda x, i: F.when((i < n - 1) & x.isin(*[MARKS.index(m) for m in marks]), i).otherwise(-1)), lambda i: i >= 0))
    end, comma = at(MODEL_TERMINAL), at(["，"])
    middle = F.least(F.floor(tokens / 2), n - 1)
    return F.when(last, n - 1).when(n == 0, -1).when(end.isNotNull(), end).when((tokens > POP_AFTER) & comma.isNotNull(), comma).when(tokens > FLUSH_AFTER, middle).otherwise(-1).cast("int")


def repeat_guard(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """docs(keys, tokens array<string>, marks array<int>) -> keys, marks with those cleared that break a phrase seen before.

    A cleared mark counts for the marks behind it, so a document is one fold. It
    is linear: earlier phrases are looked up by content. A phrase at j counts
    once the mark behind its second token is none.
    """

    def guard(tokens: list[str], marks: list[int]) -> list[int]:
        marks, n = list(marks), len(tokens)
        back, ahead = set(), set()
        for i in range(n):
            # phrases at j = i - 1 become known: the mark of j + 1 = i is not yet decided, so it is looked at as it stands
            j = i - 1
            if j >= 0 and marks[i] == 0:
                if j >= 1:
                    back.add(tuple(tokens[j - 1 : j + 2]))
                if j + 2 < n:
                    ahead.add(tuple(tokens[j : j + 3]))
            if marks[i] < 2 or MARKS[marks[i]] not in MODEL_TERMINAL or tokens[i] in MODEL_TERMINAL or i < 1 or i + 1 >= n or tokens[i] == tokens[i + 1]:
                continue
            if tuple(tokens[i - 1 : i + 2]) in back or i + 2 < n and tuple(tokens[i : i + 3]) in ahead:
                marks[i] = 0
                if j >= 1:
                    back.add(tuple(tokens[j - 1 : j + 2]))
                if j + 2 < n:
                    ahead.add(tuple(tokens[j : j + 3]))
        return marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, DOCUMENTS):  # few documents at a time are Python objects
                part = b.slice(lo, DOCUMENTS)
                marks = [guard(t, m) for t, m in zip(lists(part.column("tokens")), lists(part.column("marks")), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(marks, pa.list_(pa.int32()))], names=[*keys, "marks"])

    types = dict(docs.dtypes)
    return docs.select(*keys, "tokens", "marks").mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "marks array<int>"]))


class Identity:
    SCHEMA = "identity string"

    def __init__(self):
        self.state = fnv1a64(b"")

    def add(self, row: dict) -> list[dict]:
        self.state = fnv1a64(("\x1f".join("" if v is None else str(v) for v in row.values()) + "\x1e").encode(), self.state)
        return []

    def end(self) -> list[dict]:
        return [{"identity": f"{self.state:016x}"}]


def stable_identity(df: DataFrame, keys: Sequence[str], order: Sequence[str], content: Sequence[str]) -> DataFrame:
    """FNV-1a 64 of each key's content in its canonical order."""
    return ordered_fold(df.select(*keys, *order, *content), keys, order, lambda row: Identity(), Identity.SCHEMA)


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
