"""xsl:sort: sort keys as columns and orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborist.functions.numeric import to_double


@dataclass
class Key:
    """A sort key: a string column and how it orders."""

    value: Column
    descending: bool = False
    data_type: str = "text"  # or number
    lang: str | None = None  # an ICU locale
    case_order: str | None = None  # upper-first or lower-first


def orders(keys: list[Key]) -> list[Column]:
    """Orders of keys: an empty key first, then what is no number, then values; descending turns all around."""
    out = []
    for k in keys:
        columns = []
        if k.data_type == "number":
            n = to_double(k.value)
            columns.append(F.when(k.value.isNull(), 0).when(n.isNull() | F.isnan(n), 1).otherwise(2))
            columns.append(F.when(n.isNull() | F.isnan(n), F.lit(None)).otherwise(n))
        else:
            columns.append(F.when(k.value.isNull(), 0).otherwise(1))
            text = F.collate(k.value, k.lang) if k.lang else k.value
            if k.case_order:
                columns.append(F.lower(text))
                swapped = F.translate(k.value, *_swap()) if k.case_order == "lower-first" else k.value
                columns.append(swapped)
            else:
                columns.append(text)
        out += [c.desc_nulls_last() if k.descending else c.asc_nulls_first() for c in columns]
    return out


def _swap() -> tuple[str, str]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return upper + lower, lower + upper


def positions(items: DataFrame, part: list[str], keys: list[Key], tie: list[str], name: str = "pos") -> DataFrame:
    """Items with their place in the sorted order of their population; the sort is stable in `tie`."""
    return items.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*orders(keys), *tie)))


def top(items: DataFrame, keys: list[Key], tie: list[str], k: int) -> DataFrame:
    """The first k items of the whole relation, without a global sort (TakeOrderedAndProject)."""
    return items.orderBy(*orders(keys), *tie).limit(k)
