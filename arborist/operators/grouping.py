"""xsl:for-each-group over a relation of items: the four ways of grouping as aggregations and windows.

`part` names the columns of the population (such as the document) and `order` its order; results have the group's
number in order of first appearance as column `group`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(part: list[str], order: list) -> Window:
    return Window.partitionBy(*part).orderBy(*order)


def group_by(items: DataFrame, part: list[str], keys: Column, order: list[str], aggregates: list[Column], name: str = "key") -> DataFrame:
    """One row a group: part, key, group and the aggregates; keys: an array of strings, an item joins the group of each.

    Keys are compared as strings. Groups are numbered by their first item.
    """
    each = items.withColumn(name, F.explode(F.array_distinct(keys)))
    groups = each.groupBy(*part, name).agg(F.min(F.struct(*order)).alias("__first"), *aggregates)
    number = F.row_number().over(Window.partitionBy(*part).orderBy("__first", name)) if part else None
    if number is None:
        return groups.drop("__first")
    return groups.withColumn("group", number).drop("__first")


def group_adjacent(items: DataFrame, part: list[str], key: Column, order: list[str]) -> DataFrame:
    """Items with group: a new one where the key differs from the item before; items with a null key are left out."""
    keyed = items.withColumn("__key", key).where(F.col("__key").isNotNull())
    w = _order(part, order)
    changed = F.coalesce((F.col("__key") != F.lag("__key").over(w)).cast("int"), F.lit(1))
    marked = keyed.withColumn("__new", changed)
    return marked.withColumn("group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new").withColumnRenamed("__key", "key")


def group_starting(items: DataFrame, part: list[str], starts: Column, order: list[str]) -> DataFrame:
    """Items with group: one begins at every item that matches, and at the first."""
    w = _order(part, order)
    marked = items.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(starts, F.lit(False)).cast("int")))
    return marked.withColumn("group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def group_ending(items: DataFrame, part: list[str], ends: Column, order: list[str]) -> DataFrame:
    """Items with group: one ends at every item that matches."""
    w = _order(part, order)
    marked = items.withColumn("__end", F.coalesce(ends, F.lit(False)).cast("int"))
    before = F.coalesce(F.sum("__end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("group", before + 1).drop("__end")
