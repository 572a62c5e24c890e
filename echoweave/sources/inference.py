"""Models as a pluggable stage: rows of tensors in, rows of tensors out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def infer(df: DataFrame, keys: list[str], column: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], shape: tuple[int, ...], out: str = "output") -> DataFrame:
    """Run a model over a column of equal-sized arrays, a batch at a time.

    load() is called once a task, on the executor. Inputs of another size and
    outputs that aren't finite fail the task with a message that names the row.
    """
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        size = int(np.prod(shape))
        for b in batches:
            for k, v in zip(b[keys].itertuples(index=False), b[column], strict=True):
                if len(v) != size:
                    raise ValueError(f"{tuple(k)}: {len(v)} values, {size} are needed")
            if not len(b):
                continue
            y = np.asarray(model(np.stack(b[column].to_list()).reshape(-1, *shape)), float).reshape(len(b), -1)
            bad = ~np.isfinite(y).all(1)
            if bad.any():
                raise ValueError(f"{b[keys].iloc[int(bad.argmax())].tolist()}: the model's output isn't finite")
            yield b[keys].assign(**{out: list(y)})

    return df.select(*keys, column).mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), f"{out} array<double>"]))


def onnx(path: str, input_name: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader for infer(): an ONNX session on one thread."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(path, options)
        return lambda x: session.run(None, {input_name: x.astype(np.float32)})[0]

    return load


def remote(df: DataFrame, keys: list[str], prompt: str, call: Callable[[str], str]) -> DataFrame:
    """Call a text service for each row; call() is given by the caller (and mocked in tests). Errors become rows, not failures."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = [], []
            for p in b[prompt]:
                try:
                    answers.append(call(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b[keys].assign(answer=answers, error=errors)

    return df.select(*keys, prompt).mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "answer string, error string"]))
