"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_by(arr, *fields: str) -> Column:
    """``array_sort`` of structs by the given fields only (works when other fields,
    such as maps or VARIANTs, have no ordering)."""

    def cmp(left, right):
        out = F.lit(0)
        for f in reversed(fields):
            out = F.when(left[f] < right[f], F.lit(-1)).when(left[f] > right[f], F.lit(1)).otherwise(out)
        return out

    return F.array_sort(arr if isinstance(arr, Column) else F.col(arr), cmp)
