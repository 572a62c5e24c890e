"""Identities: digests of vectors and of ordered content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fingerprint_id(vector: Column) -> Column:
    """fp_ and 12 hex digits of the SHA-256 of the vector's little-endian 32-bit floats (no built-in casts floats to bytes)."""

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: None if v is None else "fp_" + hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest()[:12])

    return F.pandas_udf(ids, "string")(vector)


def fnv1a64(data: bytes, state: int = FNV_OFFSET) -> int:
    for b in data:
        state = (state ^ b) * FNV_PRIME % (1 << 64)
    return state


def path_key(path: Column) -> Column:
    """SHA-256 of a location, without slashes at its ends, in lower case."""
    return F.sha2(F.lower(F.regexp_replace(path, "^/+|/+$", "")), 256)


def hash_path(key: Column) -> Column:
    """Two levels of folders by the first digits of a key."""
    return F.concat_ws("/", F.lit("stage"), F.substring(key, 1, 2), F.substring(key, 3, 2), F.concat(key, F.lit(".result.json")))
