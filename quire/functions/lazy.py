"""Arrow-batched functions that can be defined before there is a Spark session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, functions as F


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """As pandas_udf, but its type is parsed where a column is made."""

    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def column(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return column

    return decorate
