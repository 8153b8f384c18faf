"""Overlap of bags: arrays whose repeats count, which the set-based array functions lose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    """Sum over distinct elements of the smaller of the two counts. Each element is numbered among its equals, which makes
    repeats distinct; nothing leaves the row, and but for the sort the work is linear in both lengths."""

    def ranked(x: Column) -> Column:
        def number(s: Column) -> Column:
            n, none = F.size(s), F.slice(F.sequence(F.lit(0), F.lit(0)), 1, 0)
            begins = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))).otherwise(none)
            equals = lambda b: F.flatten(F.transform(b, lambda at, j: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(b, j + 1), n) - at), lambda k: F.struct(F.get(s, at).alias("v"), k.alias("k")))))
            return F.transform(F.array(begins), equals)[0]

        # a one-element array binds what it holds to a variable, so it is not computed again for every element
        return F.transform(F.array(F.sort_array(x)), number)[0]

    return F.size(F.array_intersect(ranked(a), ranked(b)))
