"""Rates with defined values on empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 to 4 places."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(ratio(2 * p * r, p + r), 4)}


def share_of(counts: Column, keys: tuple[str, ...], total: Column) -> Column:
    """Share of some keys of a map of counts."""
    return ratio(sum((F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0)) for k in keys), F.lit(0)), total)
