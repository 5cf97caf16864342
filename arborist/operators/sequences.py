"""Sequences in array columns: positional edits, limits and cardinality checks of the function library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subsequence(items: Column, start: Column, length: Column | None = None) -> Column:
    """Items p with round(start) <= p < round(start) + round(length)."""
    lo = F.floor(start.cast("double") + 0.5)
    hi = F.lit(None) if length is None else lo + F.floor(length.cast("double") + 0.5)
    inside = (lambda p: p >= lo) if length is None else (lambda p: (p >= lo) & (p < hi))
    return F.filter(items, lambda x, k: inside(k + 1))


def reverse(items: Column) -> Column:
    return F.reverse(items)


def insert_before(items: Column, position: Column, inserts: Column) -> Column:
    """inserts before the place; places are cut to 1 .. size + 1."""
    at = F.least(F.greatest(position, F.lit(1)), F.size(items) + 1).cast("int")
    return F.concat(F.slice(items, F.lit(1), at - 1), inserts, F.filter(items, lambda x, k: k + 1 >= at))


def remove(items: Column, position: Column) -> Column:
    return F.filter(items, lambda x, k: (k + 1) != position)


def index_of(items: Column, value: Column) -> Column:
    """Places of an item, counted from 1."""
    return F.filter(F.transform(items, lambda x, k: F.when(x == value, k + 1)), lambda k: k.isNotNull())


def distinct_values(items: Column) -> Column:
    """First occurrences in order; NaN equals itself here."""
    return F.array_distinct(items)


def checked(items: Column, what: str) -> Column:
    """zero-or-one, one-or-more or exactly-one: the sequence, or the error of its cardinality."""
    code, ok = {
        "zero-or-one": ("FORG0003", F.size(items) <= 1), "one-or-more": ("FORG0004", F.size(items) >= 1), "exactly-one": ("FORG0005", F.size(items) == 1),
    }[what]
    return F.when(ok, items).otherwise(F.raise_error(F.lit(f"{code}: {what}")))


def range_(lo: Column, hi: Column) -> Column:
    """lo to hi; a descending range is empty."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def range_sum(lo: Column, hi: Column) -> Column:
    """sum(lo to hi) in closed form."""
    a, b = lo.cast("decimal(18,0)"), hi.cast("decimal(18,0)")
    return F.when(lo <= hi, ((a + b) * (b - a + 1) / 2).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))


def range_count(lo: Column, hi: Column) -> Column:
    return F.greatest(hi - lo + 1, F.lit(0)).cast("bigint")
