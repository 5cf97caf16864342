"""The thirteen axes as joins of a context relation with the node table.

Context and result columns carry prefixes. Every join is on the document, and on the parent where the axis allows;
the rest are range conditions on (pre, last), which Spark evaluates as residual predicates of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborist.xdm import ATTRIBUTE, COLUMNS, ELEMENT, KIND_NAMES, NAMESPACE, XML, XdmError
from arborist.xpath.ast import Test

REVERSE = {"parent", "ancestor", "preceding-sibling", "preceding", "ancestor-or-self"}
#: Axes that reach a node from one context node at most once, and from two context nodes never.
INJECTIVE = {"child", "attribute", "self"}


#: Nodes of a span, the unit by which nodes meet those whose subtrees they are in.
SPAN = 64


def span(pre: Column) -> Column:
    return F.floor(pre / SPAN)


def spanned(df: DataFrame, pre: str, last: str, name: str) -> DataFrame:
    """A row for each span of a node's subtree, numbered in `name`: a node inside meets it in its own span only.

    That leaves a node the few hundred candidates of its span, however large its document is. Rows grow by a sixty-fourth
    of the subtree.
    """
    return df.withColumn(name, F.explode(F.sequence(span(F.col(pre)), span(F.col(last)))))


def prefixed(nodes: DataFrame, p: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(p + c) for c in COLUMNS])


def tested(nodes: DataFrame, axis: str, test: Test) -> DataFrame:
    """Node rows that an axis may return and that pass a node test, as a filter that reaches the scan."""
    kind = F.col("kind")
    principal = {"attribute": ATTRIBUTE, "namespace": NAMESPACE}.get(axis, ELEMENT)
    if axis == "attribute":
        keep = kind == ATTRIBUTE
    elif axis == "namespace":
        keep = kind == NAMESPACE
    elif axis in ("self", "ancestor-or-self", "descendant-or-self"):
        keep = F.lit(True)
    else:
        keep = ~kind.isin(ATTRIBUTE, NAMESPACE)
    return nodes.where(keep & condition(test, principal))


def condition(test: Test, principal: int = ELEMENT, p: str = "") -> Column:
    """A node test over the columns of a node."""
    kind, uri, local = F.col(p + "kind"), F.col(p + "uri"), F.col(p + "local")
    named = F.lit(True)
    if test.uri is not None:
        named = named & (uri == test.uri)
    if test.local is not None:
        named = named & (local == test.local)
    if test.kind == "name":
        return (kind == principal) & named
    if test.kind == "node":
        return F.lit(True)
    if test.kind == "namespace-node":
        return kind == NAMESPACE
    if test.kind not in KIND_NAMES:
        raise XdmError("XPST0008", test.kind)
    return (kind == KIND_NAMES.index(test.kind)) & named


def step(context: DataFrame, nodes: DataFrame, axis: str, test: Test, c: str, n: str) -> DataFrame:
    """context joined with the nodes of an axis: the context's columns and those of the result, prefixed n."""
    col = F.col
    if axis == "namespace":
        return namespaces(context, nodes, c, n)
    if axis == "self":
        same = context.where(condition(test, ELEMENT, c))
        return same.select("*", *[col(c + x).alias(n + x) for x in COLUMNS])
    found = prefixed(tested(nodes, axis, test), n)
    doc = col(n + "doc_id") == col(c + "doc_id")
    pre, last, parent = col(n + "pre"), col(n + "last"), col(n + "parent")
    a, z, up = col(c + "pre"), col(c + "last"), col(c + "parent")
    plain = ~col(c + "kind").isin(ATTRIBUTE, NAMESPACE)
    on = {
        "child": parent == a,
        "attribute": parent == a,
        "descendant": (pre > a) & (pre <= z),
        "descendant-or-self": ((pre > a) & (pre <= z) & ~col(n + "kind").isin(ATTRIBUTE, NAMESPACE)) | (pre == a),
        "parent": pre == up,
        "ancestor": (pre < a) & (last >= a) & ~col(n + "kind").isin(ATTRIBUTE, NAMESPACE),
        "ancestor-or-self": ((pre < a) & (last >= a) & ~col(n + "kind").isin(ATTRIBUTE, NAMESPACE)) | (pre == a),
        "following-sibling": (parent == up) & (pre > a) & plain,
        "preceding-sibling": (parent == up) & (pre < a) & plain,
        "following": pre > z,
        "preceding": (last < a) & (col(n + "kind") != 0),
    }[axis]
    if axis in ("ancestor", "ancestor-or-self"):
        return context.join(spanned(found, n + "pre", n + "last", n + "span"), doc & (col(n + "span") == span(a)) & on).drop(n + "span")
    return context.join(found, doc & on)


def namespaces(context: DataFrame, nodes: DataFrame, c: str, n: str) -> DataFrame:
    """In-scope namespaces of elements: the nearest declaration of each prefix, without undeclared ones, and xml."""
    rows = prefixed(nodes.where(F.col("kind") == NAMESPACE), n)
    owners = prefixed(nodes.where(F.col("kind") == ELEMENT), "__o_").select("__o_doc_id", "__o_pre", "__o_last", "__o_level")
    scoped = rows.join(owners, (F.col(n + "doc_id") == F.col("__o_doc_id")) & (F.col(n + "parent") == F.col("__o_pre")))
    inside = (F.col(c + "doc_id") == F.col(n + "doc_id")) & (F.col("__o_pre") <= F.col(c + "pre")) & (F.col("__o_last") >= F.col(c + "pre"))
    found = context.where(F.col(c + "kind") == ELEMENT).join(scoped, inside)
    nearest = Window.partitionBy(c + "doc_id", c + "pre", n + "local").orderBy(F.col("__o_level").desc())
    near = found.withColumn("__k", F.row_number().over(nearest)).where("__k = 1").where(F.col(n + "value") != "")
    near = near.drop("__k", "__o_doc_id", "__o_pre", "__o_last", "__o_level")
    implied = {"doc_id": F.col(c + "doc_id"), "pre": F.col(c + "pre"), "last": F.col(c + "pre"), "parent": F.col(c + "pre"), "kind": F.lit(NAMESPACE), "local": F.lit("xml"), "value": F.lit(XML), "uri": F.lit(""), "prefix": F.lit("")}
    types = {f.name: f.dataType for f in nodes.schema}
    xml = context.where(F.col(c + "kind") == ELEMENT).select("*", *[implied.get(x, F.lit(None)).cast(types[x]).alias(n + x) for x in COLUMNS])
    return near.unionByName(xml)
