"""A name for a value within one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for a row.

    An expression that a lambda names is otherwise worked out again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
