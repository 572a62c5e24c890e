"""Evidence, votes and routing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import ordered_fold

#: Fixed thresholds of the routing policy.
OTHER_MAX, ACCEPT, MARGIN = 0.40, 0.45, 0.08
MIN_VOTES, DIRECT_RATIO, MIN_MARGIN, PROTECTED_RATIO = 1, 0.60, 0.10, 0.80


def winner(label: str, count: str) -> Column:
    """Aggregate: the label with the largest count, the smaller label on a tie (any orderable label)."""
    return F.min_by(label, F.struct((-F.col(count)).alias("c"), F.col(label).alias("l")))


def vote_majority(df: DataFrame, keys: Sequence[str], label: str, ratio: float = DIRECT_RATIO) -> DataFrame:
    """winner, votes, total, ratio and whether the winner's share is enough."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("c"))
    out = counts.groupBy(*keys).agg(winner(label, "c").alias("winner"), F.max("c").alias("votes"), F.sum("c").alias("total"))
    return out.withColumn("ratio", F.col("votes") / F.col("total")).withColumn("direct", F.col("ratio") >= ratio)


def status_rollup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts (status, label, votes, margin, ratio) -> one status: any other, else any pending, else direct if all agree."""
    out = df.groupBy(*keys).agg(
        F.bool_or(F.col("status") == "other").alias("_other"), F.bool_or(F.col("status") == "pending").alias("_pending"), F.count_distinct("label").alias("_labels"),
        F.min("label").alias("_label"), F.sum("votes").alias("votes"), F.max("ratio").alias("max_ratio"), F.try_divide(F.sum(F.col("margin") * F.col("votes")), F.sum("votes")).alias("avg_margin"),
    )
    status = F.when(F.col("_other"), "other").when(F.col("_pending") | (F.col("_labels") != 1), "pending").otherwise("direct")
    return out.select(*keys, status.alias("status"), F.when(status == "direct", F.col("_label")).alias("label"), "votes", "max_ratio", "avg_margin")


def evidence_margin(scores: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Long scores -> top label, top score and margin to the second; ties to the smaller label, NaN last, one label: its score."""
    usable = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    w = W.partitionBy(*keys).orderBy(F.desc(score), label)
    top = usable.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    out = top.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col(label))).alias("top_label"), F.max(F.when(F.col("_r") == 1, F.col(score))).alias("top_score"), F.max(F.when(F.col("_r") == 2, F.col(score))).alias("second"))
    return out.withColumn("margin", F.col("top_score") - F.coalesce("second", F.lit(0.0))).drop("second")


def token_route(df: DataFrame) -> DataFrame:
    """top_score, margin -> disposition of a single token."""
    ok = (F.col("top_score") >= ACCEPT) & (F.col("margin") >= MARGIN)
    return df.withColumn("disposition", F.when(F.col("top_score") < OTHER_MAX, "other").when(ok, "accepted").otherwise("deferred"))


def token_evidence(windows: DataFrame, keys: Sequence[str], label: str, cosine: str, weight: str) -> DataFrame:
    """Weighted mean cosine of each token and label over the windows that hold the token; no support: minus infinity."""
    out = windows.groupBy(*keys, label).agg(F.sum(F.col(cosine) * F.col(weight)).alias("_s"), F.sum(weight).alias("support"))
    return out.select(*keys, label, F.coalesce(F.try_divide("_s", "support"), F.lit(float("-inf"))).alias("score"), "support")


@dataclass
class Sub:
    """A part of a sentence and its vote."""

    rows: list[dict]
    excluded: tuple = ()
    votes: dict = field(default_factory=dict)
    total: int = 0
    margin: float = 0.0
    status: str = "pending"
    label: int | None = None
    best: int | None = None

    @property
    def ratio(self) -> float:
        return self.votes[self.best] / self.total if self.total else 0.0


def largest(values: dict) -> int | None:
    return min(values, key=lambda k: (-values[k], k)) if values else None


def vote(rows: list[dict], excluded: tuple = ()) -> Sub:
    """First level: each usable token votes for its top label; a token whose top label is excluded drops out."""
    sub = Sub(rows, excluded)
    for r in rows:
        ranked = sorted((-s, k) for k, s in r["scores"].items() if s == s)
        if not ranked or not r["support"] or not OTHER_MAX <= -ranked[0][0] < float("inf") or ranked[0][1] in excluded:
            continue
        gap = -ranked[0][0] + (ranked[1][0] if len(ranked) > 1 else 0.0)
        sub.votes[ranked[0][1]] = sub.votes.get(ranked[0][1], 0) + 1
        sub.total += 1
        sub.margin += gap if abs(gap) < float("inf") else 0.0
    sub.margin = sub.margin / sub.total if sub.total else 0.0
    sub.label = sub.best = largest(sub.votes)
    if sub.total >= MIN_VOTES and sub.margin >= MIN_MARGIN and sub.ratio >= DIRECT_RATIO:
        sub.status = "direct"
    return sub


def settle(sub: Sub, excluded: tuple) -> Sub:
    """Second level for a pending part: excluded labels give way to the next best; else the largest sum of scores; else other."""
    base = vote(sub.rows)
    if base.margin >= MIN_MARGIN or base.ratio >= PROTECTED_RATIO:
        excluded = ()
    out = Sub(sub.rows, excluded, base.votes, base.total, base.margin)
    if excluded:
        counts: dict = {}
        for r in sub.rows:
            top = largest({k: s for k, s in r["scores"].items() if s == s})
            if top is None or not r["support"] or r["scores"][top] < OTHER_MAX:
                continue
            other = largest({k: s for k, s in r["scores"].items() if s == s and k not in excluded}) if top in excluded else top
            if other is not None:
                counts[other] = counts.get(other, 0) + 1
        best = largest(counts)
        out.votes, out.total, out.best = counts, sum(counts.values()), best
        if best is not None and counts[best] / out.total >= DIRECT_RATIO:
            out.status, out.label = "direct", best
            return out
    sums: dict = {}
    for r in sub.rows:
        for k, s in r["scores"].items():
            sums[k] = sums.get(k, 0.0) + s
    best = largest({k: s for k, s in sums.items() if k not in excluded and abs(s) < float("inf")})
    out.best = out.best if out.best in out.votes else largest(out.votes)
    out.status, out.label = ("direct", best) if best is not None else ("other", None)
    return out


class Routing:
    """Tokens in order, with scores by label -> a decision each. Holds one sentence, its right neighbour and the label to the left."""

    SCHEMA = "pos long, sentence_id long, sub_id long, level string, status string, label int"

    def __init__(self):
        self.rows: list[dict] = []
        self.first: tuple | None = None  # a sentence at level one, waiting for the next one
        self.left_direct, self.left_settled = None, None

    @staticmethod
    def direct(sub: Sub | None) -> int | None:
        return sub.label if sub is not None and sub.status == "direct" else None

    def level_one(self) -> list[Sub]:
        parts: list[list[dict]] = [[]]
        for i, r in enumerate(self.rows):
            if i > 1 and self.rows[i - 1]["mark"]:
                parts.append([])
            parts[-1].append(r)
        subs = [vote(p) for p in parts]
        for i, sub in enumerate(subs):
            if sub.margin >= MIN_MARGIN or sub.ratio >= PROTECTED_RATIO:
                continue
            left = self.direct(subs[i - 1]) if i else self.left_direct
            right = self.direct(subs[i + 1]) if i + 1 < len(subs) else None
            if left is not None and left == right:
                subs[i] = vote(sub.rows, (left,))
        self.left_direct = self.direct(subs[-1])
        return subs

    def level_two(self, subs: list[Sub], right: Sub | None) -> list[dict]:
        out, done = [], []
        for i, sub in enumerate(subs):
            level = "first"
            if sub.status == "pending":
                left = self.direct(subs[i - 1]) if i else self.left_settled
                next_label = self.direct(subs[i + 1]) if i + 1 < len(subs) else self.direct(right)
                sub, level = settle(sub, (left,) if left is not None and left == next_label else ()), "second"
            done.append(sub)
            out += [{"pos": r["pos"], "sentence_id": r["sentence_id"], "sub_id": i, "level": level, "status": sub.status, "label": sub.label} for r in sub.rows]
        self.left_settled = self.direct(done[-1])
        return out

    def sentence(self) -> list[dict]:
        now, out = self.level_one(), []
        if self.first is not None:
            out = self.level_two(self.first, now[0])
        self.first, self.rows = now, []
        return out

    def add(self, row: dict) -> list[dict]:
        out = self.sentence() if self.rows and self.rows[0]["sentence_id"] != row["sentence_id"] else []
        row["scores"] = dict(row["scores"] or [])
        self.rows.append(row)
        return out

    def end(self) -> list[dict]:
        out = self.sentence() if self.rows else []
        return out + (self.level_two(self.first, None) if self.first is not None else [])


def vote_routing(tokens: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """tokens(keys, pos, sentence_id, mark boolean, support, scores map<int,double>) -> a decision for each token.

    mark: the token ends a part of its sentence. A part between two direct
    neighbours of one label that it doesn't clearly differ from may not take
    that label.
    """
    return ordered_fold(tokens.select(*keys, "pos", "sentence_id", "mark", "support", "scores"), keys, ["sentence_id", "pos"], lambda row: Routing(), Routing.SCHEMA)


def split_reassign(scores: DataFrame, keys: Sequence[str], label: str, score: str, final: str, split: Sequence) -> DataFrame:
    """Tokens whose final label is split take their best other label; all others are frozen."""
    open_ = F.col(final).isin(*split)
    allowed = scores.where(~(open_ & F.col(label).isin(*split)))
    best = allowed.groupBy(*keys).agg(F.max_by(label, F.struct(F.col(score), (-F.col(label)).alias("l"))).alias("_best"))
    return scores.select(*keys, final).distinct().join(best, list(keys), "left").withColumn("effective", F.when(open_, F.col("_best")).otherwise(F.col(final))).drop("_best")


def split_preview(df: DataFrame, group: str, target: str, share: float = 0.70) -> DataFrame:
    """Where a split label's tokens go: counts, shares, and whether one destination dominates."""
    counts = df.groupBy(group, target).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group))).withColumn("dominant", F.col("share") > share)
