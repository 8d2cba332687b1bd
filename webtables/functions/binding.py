"""Use a computed value several times in one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once.

    Spark computes an expression anew at each place in a conditional that uses
    it; a lambda variable holds it instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
