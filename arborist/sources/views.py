"""Node tables built from relational tables, in DataFrame operations only.

A view is described by a tree of element specifications; every level is a relation with its parent's key, and
document order and subtree ends come from counts, so nothing is parsed and nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborist.xdm import ATTRIBUTE, DOCUMENT, ELEMENT, NODE, TEXT

#: Nodes of a large document that stay together.
RANGE = 1 << 16


@dataclass
class Element:
    """Elements named `name`, one for each row of `rows`.

    keys: columns that, from the outermost element on, name an element (the last ones are new at this level); order:
    columns that order it among its siblings of the same specification; attributes and children: (name, column)
    pairs, children being leaf elements with text; nested: specifications of element children, after the leaves.
    """

    name: str
    rows: DataFrame
    keys: list[str]
    order: list[str | Column]
    attributes: list[tuple[str, str]] = field(default_factory=list)
    children: list[tuple[str, str]] = field(default_factory=list)
    nested: list[Element] = field(default_factory=list)
    text: str | None = None


@dataclass
class Placed:
    """A specification, its rows with __doc, __parent, __pre and __size, and its nested ones."""

    spec: Element
    rows: DataFrame
    nested: list[Placed] = field(default_factory=list)


@dataclass
class View:
    """A node table and what it is made of.

    nodes: a union of one relation for each kind of node of a specification, so that filters on kind and name leave the
    scans of those nodes only; branches: those relations, with kind and name; held: the kept relations, one row an
    element; records: the same with doc_id, pre and the attributes as strings, and the names of the attributes; root: the
    same by specification.
    """

    nodes: DataFrame
    branches: list[tuple[int, str | None, DataFrame]] = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list)
    records: list[tuple[DataFrame, list[str]]] = field(default_factory=list)
    root: Placed | None = None


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def own_size(spec: Element) -> int:
    """Rows of an element in the node table without those of nested elements."""
    return 1 + len(spec.attributes) + 2 * len(spec.children) + (spec.text is not None)


def _inner(spec: Element, child: Element, out: str) -> DataFrame:
    """spec's keys and the rows that its elements have by one nested specification."""
    return _sizes(child).groupBy(*spec.keys).agg(F.sum("__size").alias(out))


def _sizes(spec: Element) -> DataFrame:
    """keys of every element and __size, its number of rows in the node table."""
    size = F.lit(own_size(spec)).cast("bigint")
    total = spec.rows.select(*spec.keys)
    for k, child in enumerate(spec.nested):
        total = total.join(_inner(spec, child, f"__i{k}"), spec.keys, "left")
        size = size + F.coalesce(f"__i{k}", F.lit(0))
    return total.select(*spec.keys, size.alias("__size"))


def _dealt(spec: Element, parts: int, by: list[str]) -> Element:
    """A specification whose rows, at every level, lie by the outermost keys: what follows does not shuffle."""
    return replace(spec, rows=spec.rows.repartition(parts, *by), nested=[_dealt(x, parts, by) for x in spec.nested])


def _place(spec: Element, parents: DataFrame | Column, level: int, path: str, view: View, hold: Callable[[DataFrame], DataFrame]) -> Placed:
    """Adds the node rows of all elements of a specification; parents: outer keys, __doc, __parent and __from (next free pre), for roots their document."""
    rows, size = spec.rows, F.lit(own_size(spec)).cast("bigint")
    for k, child in enumerate(spec.nested):
        rows = rows.join(_inner(spec, child, f"__inner{k}"), spec.keys, "left")
        size = size + F.coalesce(f"__inner{k}", F.lit(0))
    rows = rows.withColumn("__size", size.cast("int"))
    if isinstance(parents, Column):
        rows = rows.withColumns({"__doc": parents, "__parent": F.lit(0), "__pre": F.lit(1)})
    else:
        outer = [c for c in parents.columns if not c.startswith("__")]
        before = Window.partitionBy(*outer).orderBy(*spec.order).rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum("__size").over(before), F.lit(0))
        rows = rows.join(parents.hint("merge"), outer).withColumn("__pre", (F.col("__from") + ahead).cast("int"))
    shown = [c for _, c in (*spec.attributes, *spec.children)] + ([spec.text] if spec.text else [])
    inside = [f"__inner{k}" for k in range(len(spec.nested))]
    rows = hold(rows.select(*dict.fromkeys([*spec.keys, "__doc", "__parent", "__pre", "__size", *shown, *inside])))
    view.held.append(rows)
    placed = Placed(spec, rows)
    view.records.append((
        rows.select(F.col("__doc").alias("doc_id"), F.col("__pre").alias("pre"), *[F.col(c).cast("string").alias(name) for name, c in spec.attributes]),
        [name for name, _ in spec.attributes],
    ))
    here = f"{path}/{spec.name}"
    own = F.col("__pre")

    def node(pre: Column, last: Column, lev: int, parent: Column, kind: int, local: str | None, value: Column, at: str) -> None:
        made = {
            "doc_id": F.col("__doc"), "pre": pre, "last": last, "level": F.lit(lev), "parent": parent, "kind": F.lit(kind), "uri": F.lit(""),
            "local": F.lit(local), "prefix": F.lit(""), "value": value, "name_path": F.lit(at),
        }
        view.branches.append((kind, local, rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE])))

    simple = not spec.children and not spec.nested
    text = F.col(spec.text).cast("string") if spec.text else F.lit("") if simple else F.lit(None)
    node(own, own + F.col("__size") - 1, level, F.col("__parent"), ELEMENT, spec.name, text, here)
    at = 1
    for name, col in spec.attributes:
        node(own + at, own + at, level + 1, own, ATTRIBUTE, name, F.col(col).cast("string"), f"{here}/@{name}")
        at += 1
    if spec.text:
        node(own + at, own + at, level + 1, own, TEXT, None, F.col(spec.text).cast("string"), here)
        at += 1
    for name, col in spec.children:
        value = F.col(col).cast("string")
        node(own + at, own + at + 1, level + 1, own, ELEMENT, name, value, f"{here}/{name}")
        node(own + at + 1, own + at + 1, level + 2, own + at, TEXT, None, value, f"{here}/{name}")
        at += 2
    begin = own + at
    for k, child in enumerate(spec.nested):
        base = rows.select(*spec.keys, "__doc", own.alias("__parent"), begin.cast("int").alias("__from"))
        placed.nested.append(_place(child, base, level + 1, here, view, hold))
        begin = begin + F.coalesce(f"__inner{k}", F.lit(0))
    return placed


def kept(rows: DataFrame) -> DataFrame:
    """Rows kept with a plan that does not change at run time, so that it is known how they are dealt and sorted."""
    name = "spark.sql.adaptive.enabled"
    before = rows.sparkSession.conf.get(name)
    rows.sparkSession.conf.set(name, "false")
    try:
        return rows.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        rows.sparkSession.conf.set(name, before)


def build(root: Element, doc_id: str | None = None, parts: int | None = None) -> View:
    """The node table of one document for each root element; doc_id: its column (a single document 0 where it is None).

    parts: elements are kept, on disk where memory is short, in so many partitions by document, or by ranges of their
    documents where one document is larger than a few partitions. What is dealt out and kept are the rows that elements
    are made of, not their nodes, which are made anew where they are read.
    """
    hold = lambda rows: rows
    if parts is not None:
        documents = _sizes(root).agg(F.max("__size").alias("most"), F.sum(F.col("__size") + 1).alias("all")).first()
        if documents.most is not None and documents.most > 4 * documents["all"] / parts:
            hold = lambda rows: kept(rows.repartition(parts, "__doc", F.floor(F.col("__pre") / RANGE)))
        else:
            root = _dealt(root, parts, root.keys)
            hold = lambda rows: kept(rows.sortWithinPartitions("__doc", "__pre"))
    view = View(root.rows)
    view.root = _place(root, (F.col(doc_id) if doc_id else F.lit(0)).cast("bigint"), 1, "", view, hold)
    roots = view.held[0].select(
        *[
            {
                "doc_id": F.col("__doc"), "pre": F.lit(0), "last": F.col("__size"), "level": F.lit(0), "kind": F.lit(DOCUMENT), "uri": F.lit(""),
                "prefix": F.lit(""), "name_path": F.lit(""), "value": F.lit(None),
            }.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in NODE
        ]
    )
    view.branches.insert(0, (DOCUMENT, None, roots))
    view.nodes = united([df for _, _, df in view.branches])
    return view


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_xml(spark, sf_dir: str, parts: int | None = None) -> View:
    """order(@id, @cust, @status, @total, line*(@no, @part, @supp, @qty, @price, @disc, @flag)), one document an order."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus", "o_totalprice")
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    line = Element(
        "line", lines, ["k", *order], order,
        [("no", "l_linenumber"), ("part", "l_partkey"), ("supp", "l_suppkey"), ("qty", "l_quantity"), ("price", "l_extendedprice"), ("disc", "l_discount"), ("flag", "l_returnflag")],
    )
    return build(Element("order", orders, ["k"], ["k"], [("id", "k"), ("cust", "o_custkey"), ("status", "o_orderstatus"), ("total", "o_totalprice")], nested=[line]), "k", parts)


def geo_xml(spark, sf_dir: str, parts: int | None = None) -> View:
    """world(region*(@id, name, nation*(@id, name, customer*(@id, @bal, name)))), a document for each region."""
    regions = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), "r_name")
    nations = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), "n_name")
    customers = (
        _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("c"), "c_name", "c_acctbal")
        .join(nations.select("r", "n"), "n")
    )
    customer = Element("customer", customers, ["r", "n", "c"], ["c"], [("id", "c"), ("bal", "c_acctbal")], [("name", "c_name")])
    nation = Element("nation", nations, ["r", "n"], ["n"], [("id", "n")], [("name", "n_name")], [customer])
    region = Element("region", regions, ["r"], ["r"], [("id", "r")], [("name", "r_name")], [nation])
    return build(Element("world", regions.select("r"), ["r"], ["r"], nested=[region]), "r", parts)


def events_xml(spark, sf_dir: str, parts: int | None = None) -> View:
    """user(@id, event*(@id, @ts, @type, value)), a document a user, events in order of time."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), "event_id", "ts", "event_type", "value")
    event = Element("event", events, ["u", "ts", "event_id"], ["ts", "event_id"], [("id", "event_id"), ("ts", "ts"), ("type", "event_type")], [("value", "value")])
    return build(Element("user", events.select("u").distinct(), ["u"], ["u"], [("id", "u")], nested=[event]), "u", parts)


def conv_xml(spark, sf_dir: str, parts: int | None = None) -> View:
    """conv(@id, turn*(@no, @role, text)), a document a conversation."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), "turn", "role", F.col("text").alias("body"))
    turn = Element("turn", turns, ["k", "turn"], ["turn"], [("no", "turn"), ("role", "role")], [("text", "body")])
    return build(Element("conv", turns.select("k").distinct(), ["k"], ["k"], [("id", "k")], nested=[turn]), "k", parts)
