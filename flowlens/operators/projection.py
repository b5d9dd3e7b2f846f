"""Projection to the fixed column order of a result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from flowlens.schema import RESULT_DEFAULTS


def project_to(
    df: DataFrame,
    schema: T.StructType,
    by: Sequence[str] = (),
    defaults: Mapping[str, Any] = RESULT_DEFAULTS,
) -> DataFrame:
    """Only the fields of `schema`, in its order; absent ones take their default.
    Columns in `by` (the client) are kept in front."""
    present = set(df.columns)
    fields = [
        (F.col(f.name) if f.name in present else F.lit(defaults.get(f.name)))
        .cast(f.dataType)
        .alias(f.name)
        for f in schema.fields
    ]
    return df.select(*by, *fields)
