"""Punctuation: restoring it in chunks with a carried context, and writing it back onto tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from .documents import FLUSH_AFTER, MARKS, MODEL_TERMINAL, POP_AFTER
from .folds import ordered_fold

#: Fixed value: tokens that are given to the model at a time.
CHUNK = 20
#: Fixed set: marks that are written back onto the token before them.
WRITE_BACK = "，。？、,.?!;；"


def cut_after(ids: Sequence[int], tokens: int) -> int:
    """Last index that may leave the context, -1 for none; the last position is never looked at."""
    marks = [MARKS[i] if 0 <= i < len(MARKS) else "" for i in ids[:-1]]
    ends = [i for i, m in enumerate(marks) if m in MODEL_TERMINAL]
    commas = [i for i, m in enumerate(marks) if m == "，"]
    if ends:
        return ends[-1]
    if commas and tokens > POP_AFTER:
        return commas[-1]
    return min(tokens // 2, len(ids) - 1) if tokens > FLUSH_AFTER else -1


class Restorer:
    """Marks for tokens: each chunk is judged together with what the chunks before left open."""

    SCHEMA = "pos long, token string, mark int"

    def __init__(self, predict: Callable[[list[str]], list[int]]):
        self.predict, self.open, self.chunk = predict, [], []

    def judge(self, last: bool) -> list[dict]:
        self.open, self.chunk = self.open + self.chunk, []
        if not self.open:
            return []
        ids = list(self.predict([r["token"] for r in self.open]))
        if len(ids) != len(self.open):
            raise ValueError(f"{len(self.open)} tokens, {len(ids)} marks")
        n = len(ids) if last else cut_after(ids, len(ids)) + 1
        done, self.open = self.open[:n], self.open[n:]
        return [{**r, "mark": int(i)} for r, i in zip(done, ids, strict=False)]

    def add(self, row: dict) -> list[dict]:
        # a full chunk waits until it is known not to be the last
        out = self.judge(False) if len(self.chunk) == CHUNK else []
        self.chunk.append(row)
        return out

    def end(self) -> list[dict]:
        return self.judge(True)


def restore(tokens: DataFrame, keys: Sequence[str], predict: Callable[[list[str]], list[int]]) -> DataFrame:
    """tokens(keys, pos, token) -> a mark for each; predict is the model, called with the open context."""
    return ordered_fold(tokens.select(*keys, "pos", "token"), keys, ["pos"], lambda row: Restorer(predict), Restorer.SCHEMA)


def align(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df(keys, tokens array<string>, text) -> tokens with the text's marks behind them; failed_at is where text and tokens part.

    Characters are matched against the tokens' first characters. On a failure
    the tokens stay as they are; failed_at -1 means that tokens were left over.
    """
    types = dict(df.dtypes)

    def one(tokens: list[str], text: str) -> tuple[list[str], int | None]:
        out, at = list(tokens), 0
        for i, c in enumerate(text):
            if c == " ":
                continue
            if at < len(tokens) and tokens[at][:1] == c:
                at += 1
            elif at and c in WRITE_BACK:
                out[at - 1] += c
            else:
                return list(tokens), i
        return (out, None) if at == len(tokens) else (list(tokens), -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [one(list(t), x or "") for t, x in zip(b["tokens"], b["text"], strict=True)]
            yield b[list(keys)].assign(tokens=[d[0] for d in done], failed_at=pd.array([d[1] for d in done], "Int64"))

    return df.select(*keys, "tokens", "text").mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "tokens array<string>, failed_at long"]))
