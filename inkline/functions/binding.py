"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, worked out once a row: a lambda would work out an outer expression anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
