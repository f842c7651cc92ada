"""Vector arithmetic on array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Length, null for a zero vector, so that it is never ranked."""
    return F.nullif(F.sqrt(dot(v, v)), F.lit(0.0))


def normalized(v: Column) -> Column:
    """v at length 1; null for a zero vector."""
    n = norm(v)
    return F.when(n.isNotNull(), F.transform(v.cast("array<double>"), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def from_bytes(blob: str = "embedding"):
    """A float32 byte string as array<float>, for imports."""
    @F.pandas_udf("array<float>")
    def decoded(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return decoded(F.col(blob))


def to_bytes(v: str = "embedding"):
    """array<float> as a float32 byte string, for exports."""
    @F.pandas_udf("binary")
    def encoded(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return encoded(F.col(v))
