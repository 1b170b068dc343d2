"""Binding an expression to a name inside a larger one, so that it is evaluated once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
