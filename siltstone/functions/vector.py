"""Vector functions. Products are floats, sums doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the lengths differ or a norm is 0. Null vectors give null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def literal(q: list[float]) -> Column:
    return F.array(*map(F.lit, q)).cast("array<float>")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(blob: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; trailing bytes are dropped."""
    return blob.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // 4 * 4], "<f4"))


@F.pandas_udf(T.BinaryType())
def to_bytes(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
