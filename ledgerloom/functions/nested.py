"""Helpers for logic inside one row: arrays of structs instead of exploded rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, also inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def first_of_runs(ordered: Column, *fields: str) -> Column:
    """Of neighbours in ``ordered`` that agree in ``fields`` the first."""

    def fresh(items: Column, item: Column, at: Column) -> Column:
        before = F.get(items, at - 1)
        same = F.lit(True)
        for field in fields:
            same = same & item[field].eqNullSafe(before[field])
        return (at == 0) | ~same

    return let(ordered, lambda items: F.filter(items, lambda item, at: fresh(items, item, at)))


def contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def count_contained(text: Column, words) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + text.contains(word).cast("int")
    return total
