"""Arrow-batched column functions that can be defined before there is a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str) -> Callable:
    """A decorator: a function of pandas Series as a column function with a result type as DDL."""

    def decorate(f: Callable) -> Callable[..., Column]:
        made = []

        @functools.wraps(f)
        def column(*columns) -> Column:
            if not made:
                made.append(F.pandas_udf(f, kind))
            return made[0](*columns)

        return column

    return decorate
