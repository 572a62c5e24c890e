"""A query is a function of (spark, sf_dir); its SQL, if any, stands beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoweave.functions.timing import epoch_ms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tokens of a recording per user: start and end in ms, ends made to overlap."""
    sm = epoch_ms("ts")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", sm.alias("sm"), (sm + HOUR * (1 + F.col("event_id") % 5)).alias("em"))


TOK = "tok AS (SELECT event_id, user_id, event_type, value, epoch_us(ts)//1000 AS sm, epoch_us(ts)//1000 + 3600000*(1 + event_id%5) AS em FROM events)"
KEYS, ORDER = ["user_id"], ["sm", "event_id"]


def r6(c):
    return F.round(c, 6)
