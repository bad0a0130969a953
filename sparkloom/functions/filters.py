"""Metadata filters as one predicate, which Spark pushes into the scan where it can."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(filters: dict[str, Any] | None) -> dict[str, Any]:
    """Without values that are None or empty collections; conditions other than equality and membership are refused."""
    out = {k: v for k, v in (filters or {}).items() if v is not None and not (isinstance(v, (dict, list, tuple, set)) and not v)}
    if bad := [k for k, v in out.items() if isinstance(v, dict)]:
        raise ValueError(f"filters on {', '.join(bad)}: a value or a list of values is expected")
    return out


def predicate(df: DataFrame, filters: dict[str, Any] | None) -> Column:
    """All keys must match; a list matches any of its values; a column that isn't there matches nothing."""
    out = F.lit(True)
    for key, value in normalized(filters).items():
        if key not in df.columns:
            return F.lit(False)
        one = F.col(key).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(key) == value
        out = out & F.coalesce(one, F.lit(False))
    return out
