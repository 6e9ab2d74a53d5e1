"""Vector distances in double, and query vectors given as base64."""

from __future__ import annotations

import base64
import binascii
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if a vector is all zero."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def parse_query_vector(text: str | None, dims: int | None, model: str | None, most: int = 4096) -> tuple[list[float] | None, str | None, str | None]:
    """Little-endian float32 values in base64: values, model (trimmed, lower case), error code."""
    model = model.strip().lower() if model and model.strip() else None
    if not text or not text.strip() or dims is None:
        return None, model, "query_embedding_missing"
    if not 0 < dims <= most:
        return None, model, "query_embedding_dims_invalid"
    try:
        raw = base64.b64decode(text.strip(), validate=True)
    except (binascii.Error, ValueError):
        return None, model, "query_embedding_invalid_base64"
    if len(raw) % 4:
        return None, model, "query_embedding_invalid_length"
    if len(raw) // 4 != dims:
        return None, model, "embedding_dims_mismatch"
    return list(struct.unpack(f"<{dims}f", raw)), model, None


@F.pandas_udf(ArrayType(FloatType()))
def decoded(column: pd.Series) -> pd.Series:
    """Little-endian float32 values in base64, as parse_query_vector reads them; null for what can't be read."""

    def one(text: str | None) -> np.ndarray | None:
        try:
            raw = base64.b64decode(text.strip(), validate=True) if text and text.strip() else b"?"
        except (binascii.Error, ValueError):
            return None
        return np.frombuffer(raw, dtype="<f4") if len(raw) % 4 == 0 else None

    return column.map(one)
