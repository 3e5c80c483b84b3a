"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once; inside an array function it would be worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered(xs: Column) -> Column:
    """array<long>: a hash of each entry and its occurrence number, so that sets of them compare like multisets. Time n log n."""

    def of_sorted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda b: F.flatten(F.transform(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), lambda lo, r: F.transform(F.slice(s, lo + 1, F.get(b, r + 1) - lo), lambda x, i: F.xxhash64(x, i)))))

    return let(F.sort_array(xs), lambda s: F.when(F.size(s) == 0, F.array().cast("array<bigint>")).otherwise(of_sorted(s)))
