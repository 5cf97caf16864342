"""String values, canonical subtree hashes and other per-node values that need the subtree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.xdm import ATTRIBUTE, COMMENT, ELEMENT, NAMESPACE, PI, TEXT


def string_values(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, sv): the concatenated descendant text of some nodes (doc_id, pre, last)."""
    texts = nodes.where(F.col("kind") == TEXT).select(F.col("doc_id").alias("__d"), F.col("pre").alias("__p"), F.col("value").alias("__v"))
    inside = wanted.join(texts, (F.col("__d") == F.col("doc_id")) & (F.col("__p") > F.col("pre")) & (F.col("__p") <= F.col("last")), "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("__p").isNotNull(), F.struct("__p", "__v"))))
    return inside.groupBy("doc_id", "pre").agg(F.array_join(F.transform(parts, lambda x: x["__v"]), "").alias("sv"))


def with_string_value(df: DataFrame, nodes: DataFrame, p: str, name: str) -> DataFrame:
    """df with the string value of the node with prefix p as column `name`; stored values are used where there are any."""
    wanted = df.where(F.col(p + "value").isNull() & F.col(p + "pre").isNotNull()).select(*[F.col(p + c).alias(c) for c in ("doc_id", "pre", "last")]).distinct()
    found = string_values(wanted, nodes).select(F.col("doc_id").alias("__sd"), F.col("pre").alias("__sp"), F.col("sv").alias("__sv"))
    joined = df.join(found, (F.col(p + "doc_id") == F.col("__sd")) & (F.col(p + "pre") == F.col("__sp")), "left")
    return joined.withColumn(name, F.coalesce(F.col(p + "value"), F.col("__sv"))).drop("__sd", "__sp", "__sv")


def subtree_hash(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, canon): a hash that is equal for deep-equal nodes.

    The hash is of the subtree's rows in order: relative level, kind, name and value; attributes count in order of
    name, comments and processing instructions below the node do not count, adjacent text is one.
    """
    rows = nodes.where(~F.col("kind").isin(COMMENT, PI, NAMESPACE)).select(
        F.col("doc_id").alias("__d"), F.col("pre").alias("__p"), F.col("level").alias("__l"), F.col("kind").alias("__k"), F.col("uri").alias("__u"),
        F.col("local").alias("__n"), F.col("value").alias("__v"), F.col("parent").alias("__par"),
    )
    inside = wanted.join(rows, (F.col("__d") == F.col("doc_id")) & (F.col("__p") >= F.col("pre")) & (F.col("__p") <= F.col("last")))
    owner = F.when(F.col("__k") == ATTRIBUTE, F.col("__par")).otherwise(F.col("__p"))
    part = F.struct(
        owner.alias("o"), (F.col("__k") == ATTRIBUTE).alias("a"), F.when(F.col("__k") == ATTRIBUTE, F.concat_ws("}", "__u", "__n")).alias("n"),
        F.when(F.col("__k") != ATTRIBUTE, F.col("__p")).alias("p"), (F.col("__l") - F.col("level")).alias("l"), F.col("__k").alias("k"),
        F.concat_ws("}", "__u", "__n").alias("q"), F.when(F.col("__k").isin(ATTRIBUTE, TEXT), F.col("__v")).alias("v"),
    )
    ordered = F.array_sort(F.collect_list(part))
    flat = F.transform(ordered, lambda x: F.concat_ws("\x01", x["l"], x["k"], x["q"], F.coalesce(x["v"], F.lit(""))))
    return inside.groupBy("doc_id", "pre").agg(F.sha2(F.array_join(flat, "\x02"), 256).alias("canon"))


def deep_equal(pairs: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with a column deep_equal: whether the nodes with prefixes a and b are deep-equal."""
    for k, p in enumerate((a, b)):
        wanted = pairs.select(*[F.col(p + c).alias(c) for c in ("doc_id", "pre", "last", "level")]).distinct()
        found = subtree_hash(wanted, nodes).select(F.col("doc_id").alias(f"__hd{k}"), F.col("pre").alias(f"__hp{k}"), F.col("canon").alias(f"__h{k}"))
        pairs = pairs.join(found, (F.col(p + "doc_id") == F.col(f"__hd{k}")) & (F.col(p + "pre") == F.col(f"__hp{k}")), "left")
    return pairs.withColumn("deep_equal", F.col("__h0").eqNullSafe(F.col("__h1"))).drop(*[f"__h{x}{k}" for x in ("d", "p", "") for k in (0, 1)])


def leaf(nodes: DataFrame) -> DataFrame:
    """Elements without element children."""
    return nodes.where((F.col("kind") == ELEMENT) & F.col("value").isNotNull())
