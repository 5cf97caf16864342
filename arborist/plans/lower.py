"""Loop-lifted lowering of XPath 2.0 to DataFrames.

An expression is compiled relative to a *loop*, a relation with one row an iteration (named by its key columns) that
holds the focus and all variables in columns. Singletons become columns of the loop (paths are attached by joins on
the keys), sequences become relations that repeat the loop's columns and add order and item columns. A `for` turns
the rows of a sequence into a new loop, so nesting decorrelates by construction; existential tests become semi and
anti joins; positions become windows. Nothing is evaluated on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborist.functions import dates, numeric, strings
from arborist.operators import axes
from arborist.operators.values import with_string_value
from arborist.plans.registry import NUMERIC, SCALAR, Val, as_string, compare, convert, ebv_value, numeric_type, promote, qname
from arborist.sources.views import View, united
from arborist.xdm import ATTRIBUTE, COLUMNS, DOCUMENT, ELEMENT, KIND_NAMES, NAMESPACE, TEXT, XdmError
from arborist.xpath import ast as X
from arborist.xpath.parser import parse, uses_position

#: Names of complex elements that the driver holds at most.
MOST_NAMES = 10_000

#: The variable that holds what current() returns.
CURRENT = "current()"

_names = count()


def fresh(what: str) -> str:
    return f"__{what}{next(_names)}_"


@dataclass(frozen=True)
class Node:
    """A node in the columns with a prefix; `simple`: its string value is stored."""

    prefix: str
    simple: bool = False


@dataclass(frozen=True)
class Atom:
    """An atomic value in a column."""

    col: str
    type: str


@dataclass(frozen=True)
class Loop:
    df: DataFrame
    keys: tuple[str, ...]
    focus: Node | Atom | None
    env: tuple[tuple[str, Node | Atom | Seq], ...] = ()
    position: str | None = None
    size: str | None = None
    attrs: tuple[tuple[tuple[str, str, str], str], ...] = ()  # (prefix, uri, local) of attributes already in columns

    base: DataFrame | None = None  # the relation before columns were joined to it

    def over(self, df: DataFrame) -> Loop:
        """The loop with more columns; sequences are still built on the relation without them."""
        return replace(self, df=df, base=self.df if self.base is None else self.base)

    def rebased(self, df: DataFrame) -> Loop:
        """The loop over other rows, or with columns that sequences need."""
        return replace(self, df=df, base=None)

    def fork(self) -> Loop:
        """The loop without joined columns, so that several sequences over it do not contain each other's plans."""
        if self.base is None:
            return self
        have = set(self.base.columns)
        return replace(self, df=self.base, base=None, attrs=tuple(a for a in self.attrs if a[1] in have))


@dataclass(frozen=True)
class Seq:
    """A sequence for every iteration: rows of df, in `order`, items in `item`; single: at most one an iteration."""

    df: DataFrame
    order: tuple[str, ...]
    item: Node | Atom
    single: bool = False
    distinct: bool = True


def together(spark: SparkSession) -> None:
    """Nodes that are partitioned by document stay so through joins on (document, node): no shuffle between steps."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


class Engine:
    """Queries over a node table."""

    def __init__(
        self, nodes: DataFrame, namespaces: dict[str, str] | None = None, keys: dict | None = None,
        collections: dict[str | None, list[str] | None] | None = None, base_uri: str | None = None, decimal_formats: dict | None = None,
        view: View | None = None,
    ) -> None:
        """collections: names (None: the default one) to base URIs of their documents (None: all); without any, all documents are the default one.

        view: what the nodes are made of, where they are a view of tables; none of its names has a namespace.
        """
        together(nodes.sparkSession)
        self.view = view
        self.nodes = nodes.select(*COLUMNS)
        self.namespaces = namespaces or {}
        self.keys = keys or {}
        self.collections = {None: None} if collections is None else collections
        self.base_uri, self.decimal_formats = base_uri, decimal_formats or {}
        self._complex: set[str] | None = None

    # entry points

    def documents(self) -> Loop:
        """One iteration for each document, with its document node as focus."""
        roots = axes.prefixed(self.some((DOCUMENT,)).where(F.col("kind") == DOCUMENT), "__root_")
        root = Node("__root_")
        return Loop(roots, ("__root_doc_id",), root, ((CURRENT, root),))

    def xpath(self, text: str, **literals) -> DataFrame:
        """(doc_id, pos, item columns) of an expression for every document; keyword arguments are literal variables.

        Nodes give pre, kind, name and value, atomic values give value.
        """
        loop = self.documents()
        for name, value in literals.items():
            c = fresh("lit")
            kind = {bool: "boolean", int: "integer", float: "double"}.get(type(value), "string")
            loop = replace(loop, df=loop.df.withColumn(c, F.lit(value)), env=(*loop.env, (name, Atom(c, kind))))
        return self.result(self.sequence(parse(text, self.namespaces), loop))

    def result(self, seq: Seq) -> DataFrame:
        pos = F.row_number().over(Window.partitionBy("__root_doc_id").orderBy(*seq.order)) if not seq.single else F.lit(1)
        doc = F.col("__root_doc_id").alias("doc_id")
        if isinstance(seq.item, Atom):
            col = F.col(seq.item.col)
            return seq.df.select(doc, pos.alias("pos"), (as_string(Val(col, seq.item.type)) if seq.item.type in ("mixed", "QName") else col).alias("value"))
        p = seq.item.prefix
        df = seq.df.withColumn("__pos", pos)
        df = self.valued(df, seq.item, "__value")
        return df.select(doc, F.col("__pos").alias("pos"), F.col(p + "pre").alias("pre"), F.col(p + "kind").alias("kind"), F.col(p + "local").alias("name"), F.col("__value").alias("value"))

    # nodes and values

    def some(self, kinds: tuple[int, ...], local: str | None = None) -> DataFrame:
        """A part of the nodes that has all nodes of some kinds, and of a name where one is given: what views need not make is left out."""
        if self.view is None:
            return self.nodes
        found = [df for kind, name, df in self.view.branches if kind in kinds and (local is None or name == local)]
        return united(found).select(*COLUMNS) if found else self.view.branches[0][2].select(*COLUMNS).where(F.lit(False))

    def reached(self, axis: str, test: X.Test) -> DataFrame:
        """A part of the nodes that has all nodes which an axis may return and which pass a node test."""
        principal = {"attribute": ATTRIBUTE, "namespace": NAMESPACE}.get(axis, ELEMENT)
        if axis == "namespace":
            return self.nodes
        if test.kind == "name":
            return self.some((principal,), test.local)
        if test.kind in ("element", "attribute", "text", "document-node"):
            return self.some((KIND_NAMES.index(test.kind),), test.local)
        return self.nodes

    def complex_name(self, local: str) -> bool:
        """Whether elements of a local name may not store their string value; with over MOST_NAMES such names all count as such."""
        if self._complex is None:
            rows = self.some((ELEMENT,)).where((F.col("kind") == ELEMENT) & F.col("value").isNull()).select("local").distinct().limit(MOST_NAMES + 1).collect()
            self._complex = {r.local for r in rows}
        return len(self._complex) > MOST_NAMES or local in self._complex

    def valued(self, df: DataFrame, node: Node, name: str) -> DataFrame:
        if node.simple:
            return df.withColumn(name, F.col(node.prefix + "value"))
        return with_string_value(df, self.some((TEXT,)), node.prefix, name)

    def simple(self, axis: str, test: X.Test) -> bool:
        if axis in ("attribute", "namespace") or test.kind in ("text", "attribute", "comment", "processing-instruction"):
            return True
        return test.kind in ("name", "element") and test.local is not None and not self.complex_name(test.local)

    def atomized(self, loop: Loop, item: Node | Atom) -> tuple[Loop, Val]:
        if isinstance(item, Atom):
            return loop, Val(F.col(item.col), item.type)
        name = fresh("v")
        return loop.over(self.valued(loop.df, item, name)), Val(F.col(name), "untyped")

    def lookup(self, loop: Loop, name: str) -> Node | Atom | Seq:
        for n, bound in reversed(loop.env):
            if n == name:
                return bound
        raise XdmError("XPST0008", f"${name} is not declared")

    def focus(self, loop: Loop) -> Node | Atom:
        if loop.focus is None:
            raise XdmError("XPDY0002", "there is no context item")
        return loop.focus

    # attributes

    @staticmethod
    def attribute_step(e: X.Expr) -> bool:
        return isinstance(e, X.Step) and e.axis == "attribute" and not e.predicates and e.test.kind == "name" and e.test.local is not None and e.test.uri is not None

    def attribute_of(self, e: X.Expr, loop: Loop) -> tuple[str, str, str] | None:
        """(prefix, uri, local) where an expression is an attribute of the focus or of a node variable."""
        if self.attribute_step(e) and isinstance(loop.focus, Node):
            return loop.focus.prefix, e.test.uri, e.test.local
        if isinstance(e, X.Path) and self.attribute_step(e.right):
            base = loop.focus if isinstance(e.left, X.Ctx) else dict(loop.env).get(e.left.name) if isinstance(e.left, X.Var) else None
            if isinstance(base, Node):
                return base.prefix, e.right.test.uri, e.right.test.local
        return None

    def prefetch(self, loop: Loop, *exprs: X.Expr) -> Loop:
        """The loop with all attributes of its nodes that the expressions name, by one aggregation and one join a node."""
        wanted: dict[str, set[tuple[str, str]]] = {}
        have = dict(loop.attrs)

        def walk(e: X.Expr) -> None:
            found = self.attribute_of(e, loop)
            if found:
                if found not in have:
                    wanted.setdefault(found[0], set()).add(found[1:])
                return
            if isinstance(e, X.Path):
                walk(e.left)
            elif isinstance(e, X.Filter):
                walk(e.base)
            elif isinstance(e, (X.Binary,)):
                walk(e.left)
                walk(e.right)
            elif isinstance(e, (X.Unary, X.TypeOp)):
                walk(e.arg)
            elif isinstance(e, X.If):
                walk(e.test), walk(e.then), walk(e.other)
            elif isinstance(e, X.Call):
                for a in e.args:
                    walk(a)
            elif isinstance(e, X.Sequence):
                for a in e.items:
                    walk(a)
            elif isinstance(e, (X.For, X.Quantified)):
                walk(e.source)

        for e in exprs:
            walk(e)
        for prefix, names in wanted.items():
            group = fresh("at")
            ordered = sorted(names)
            rows = self.attribute_rows(ordered, group)
            on = (F.col(prefix + "doc_id") == F.col(group + "d")) & (F.col(prefix + "pre") == F.col(group + "p"))
            df = loop.df.join(rows, on, "left").drop(group + "d", group + "p")
            loop = replace(loop, df=df, attrs=(*loop.attrs, *[((prefix, u, n), f"{group}{k}") for k, (u, n) in enumerate(ordered)]))
        return loop

    def attribute_rows(self, ordered: list[tuple[str, str]], group: str) -> DataFrame:
        """Elements with some of the attributes (uri, local) and a column for each: `group` with d, p and the attributes' numbers."""
        d, p = F.col("doc_id").alias(group + "d"), group + "p"
        if self.view is None:
            rows = self.nodes.where(F.col("kind") == ATTRIBUTE).where(F.col("local").isin([n for _, n in ordered]))
            made = [F.max(F.when((F.col("uri") == u) & (F.col("local") == n), F.col("value"))).alias(f"{group}{k}") for k, (u, n) in enumerate(ordered)]
            return rows.groupBy(d, F.col("parent").alias(p)).agg(*made)
        held = [x for x in self.view.records if any(not u and n in x[1] for u, n in ordered)] or self.view.records[:1]
        parts = [
            df.select(d, F.col("pre").alias(p), *[(F.col(n) if not u and n in had else F.lit(None).cast("string")).alias(f"{group}{k}") for k, (u, n) in enumerate(ordered)])
            for df, had in held
        ]
        return united(parts)

    # singletons

    def scalar(self, e: X.Expr, loop: Loop) -> tuple[Loop, Val]:
        """An expression of at most one item as a column over the loop, which may have been joined with more columns."""
        if isinstance(e, X.Lit):
            if e.type == "integer" and abs(int(e.value)) >= 2**63:
                raise XdmError("FOAR0002", f"{e.value} is beyond 64 bits")
            value = F.lit(e.value)
            return loop, Val(value.cast("decimal(38,18)") if e.type == "decimal" else value.cast("bigint") if e.type == "integer" else value, e.type, lit=e.value)
        if isinstance(e, X.Ctx):
            return self.atomized(loop, self.focus(loop))
        place = self.attribute_of(e, loop)
        if place is not None:
            loop = self.prefetch(loop, e)
            return loop, Val(F.col(dict(loop.attrs)[place]), "untyped")
        if isinstance(e, X.Var):
            bound = self.lookup(loop, e.name)
            return self.attach(Seq(bound.df, bound.order, bound.item), loop) if isinstance(bound, Seq) else self.atomized(loop, bound)
        if isinstance(e, X.Sequence) and not e.items:
            return loop, Val(F.lit(None).cast("string"), "empty")
        if isinstance(e, X.Unary):
            loop, v = self.scalar(e.arg, loop)
            folded = None if v.lit is None or isinstance(v.lit, str) else -v.lit if e.op == "-" else v.lit
            v = convert(v, numeric_type(v.type))
            return loop, Val(-v.col if e.op == "-" else v.col, v.type, folded)
        if isinstance(e, X.If):
            loop, test = self.boolean(e.test, loop)
            loop, a = self.scalar(e.then, loop)
            loop, b = self.scalar(e.other, loop)
            a, b = promote(a, b)
            return loop, Val(F.when(test, a.col).otherwise(b.col), a.type)
        if isinstance(e, X.Binary):
            return self.binary(e, loop)
        if isinstance(e, X.Quantified):
            loop, b = self.boolean(e, loop)
            return loop, Val(b, "boolean")
        if isinstance(e, X.TypeOp):
            return self.type_op(e, loop)
        if isinstance(e, X.Call):
            return self.call(e, loop)
        return self.attach(self.sequence(e, loop), loop)

    def attach(self, seq: Seq, loop: Loop) -> tuple[Loop, Val]:
        """The first item of a sequence, atomized, as a column of the loop."""
        inner = Loop(seq.df, loop.keys, seq.item)
        inner, v = self.atomized(inner, seq.item)
        name = fresh("s")
        keys = [F.col(k).alias(f"{name}{j}") for j, k in enumerate(loop.keys)]
        rows = inner.df.select(*keys, *[F.col(o).alias(f"{name}o{j}") for j, o in enumerate(seq.order)], v.col.alias(name))
        ids = [f"{name}{j}" for j in range(len(loop.keys))]
        if not seq.single:
            order = F.struct(*[f"{name}o{j}" for j in range(len(seq.order))]) if seq.order else F.lit(0)
            rows = rows.groupBy(*ids).agg(F.min_by(name, order).alias(name))
        on = [F.col(k) == F.col(f"{name}{j}") for j, k in enumerate(loop.keys)]
        df = loop.df.join(rows.select(*ids, name), on, "left").drop(*ids)
        return loop.over(df), Val(F.col(name), v.type)

    def aggregate(self, seq: Seq, loop: Loop, make, kind: str, empty=None) -> tuple[Loop, Val]:
        """An aggregate of a sequence for every iteration, joined to the loop; `empty` where there is no row."""
        inner, v = self.atomized(Loop(seq.df, loop.keys, seq.item), seq.item) if make.__code__.co_argcount - len(make.__defaults__ or ()) else (Loop(seq.df, loop.keys, seq.item), None)
        name = fresh("a")
        ids = [f"{name}{j}" for j in range(len(loop.keys))]
        made = make(v) if v is not None else make()
        rows = inner.df.groupBy(*[F.col(k).alias(i) for k, i in zip(loop.keys, ids, strict=True)]).agg(made.alias(name))
        on = [F.col(k) == F.col(i) for k, i in zip(loop.keys, ids, strict=True)]
        df = loop.df.join(rows, on, "left").drop(*ids)
        col = F.col(name) if empty is None else F.coalesce(F.col(name), empty)
        return loop.over(df), Val(col, kind)

    def flag(self, found: DataFrame, loop: Loop) -> tuple[Loop, Column]:
        """Whether an iteration's keys are among those of found."""
        name = fresh("f")
        ids = [f"{name}{j}" for j in range(len(loop.keys))]
        rows = found.select(*[F.col(k).alias(i) for k, i in zip(loop.keys, ids, strict=True)]).distinct().withColumn(name, F.lit(True))
        on = [F.col(k) == F.col(i) for k, i in zip(loop.keys, ids, strict=True)]
        return loop.over(loop.df.join(rows, on, "left").drop(*ids)), F.coalesce(F.col(name), F.lit(False))

    # truth

    def is_many(self, e: X.Expr, loop: Loop) -> bool:
        """Whether an expression may have several items."""
        if self.attribute_of(e, loop) is not None:
            return False
        if isinstance(e, (X.Path, X.Filter, X.For)):
            return True
        if isinstance(e, X.Step):
            return not (e.axis in ("self", "parent") or (e.axis == "attribute" and e.test.local is not None and e.test.uri is not None))
        if isinstance(e, X.Sequence):
            return len(e.items) != 1 or self.is_many(e.items[0], loop)
        if isinstance(e, X.Binary):
            return e.op in ("to", "union", "intersect", "except")
        if isinstance(e, X.If):
            return self.is_many(e.then, loop) or self.is_many(e.other, loop)
        if isinstance(e, X.Var):
            return isinstance(self.lookup(loop, e.name), Seq)
        if isinstance(e, X.Call):
            return e.name in SEQUENCE_CALLS
        return False

    def is_node(self, e: X.Expr, loop: Loop) -> bool:
        if isinstance(e, (X.Step, X.Root)):
            return True
        if isinstance(e, X.Path):
            return self.is_node(e.right, loop)
        if isinstance(e, X.Filter):
            return self.is_node(e.base, loop)
        if isinstance(e, X.Binary):
            return e.op in ("union", "intersect", "except")
        if isinstance(e, X.Ctx):
            return isinstance(loop.focus, Node)
        if isinstance(e, X.Var):
            bound = self.lookup(loop, e.name)
            return isinstance(bound.item if isinstance(bound, Seq) else bound, Node)
        return isinstance(e, X.Call) and (e.name in ("id", "idref", "key", "root", "doc", "document", "collection") or (e.name == "current" and self.is_node(X.Var(CURRENT), loop)))

    def existential(self, e: X.Expr, loop: Loop) -> DataFrame | None:
        """Rows with the keys of the iterations for which a test holds because some item exists; None for other tests."""
        if isinstance(e, X.Call) and e.name in ("exists", "boolean") and len(e.args) == 1 and self.is_node(e.args[0], loop) and self.attribute_of(e.args[0], loop) is None:
            return self.sequence(e.args[0], loop).df
        if self.attribute_of(e, loop) is not None:
            return None
        if self.is_node(e, loop) and not isinstance(e, (X.Ctx, X.Var)):
            return self.sequence(e, loop).df
        if isinstance(e, X.Binary) and e.op in ("=", "!=", "<", "<=", ">", ">="):
            a, b = self.is_many(e.left, loop), self.is_many(e.right, loop)
            if not a and not b:
                return None
            if a and b:
                return self.both_many(e, loop)
            many, one = (e.left, e.right) if a else (e.right, e.left)
            if isinstance(many, X.Binary) and many.op == "to":
                return None
            loop, single = self.scalar(one, loop)
            name = fresh("c")
            if single.lit is None:
                loop = loop.rebased(loop.df.withColumn(name, single.col))
            seq = self.sequence(many, loop)
            inner, v = self.atomized(Loop(seq.df, loop.keys, seq.item), seq.item)
            other = single if single.lit is not None else Val(F.col(name), single.type)
            left, right = (v, other) if a else (other, v)
            return inner.df.where(compare(e.op, left, right, general=True))
        if isinstance(e, X.Quantified) and e.some:
            source = self.sequence(e.source, loop)
            inner = self.iterate(source, loop, e.var)
            inner, test = self.boolean(e.body, inner)
            return inner.df.where(test)
        return None

    def both_many(self, e: X.Binary, loop: Loop) -> DataFrame:
        """Equality is an equi join of both sides; ordered comparisons need the extremes only, inequality both extremes."""
        sides = []
        for side in (e.left, e.right):
            seq = self.sequence(side, loop)
            inner, v = self.atomized(Loop(seq.df, loop.keys, seq.item), seq.item)
            sides.append((inner.df, v))
        a, b = sides[0][1], sides[1][1]
        if a.type == b.type == "untyped":
            kind = "string"
        elif "untyped" in (a.type, b.type):
            other = b.type if a.type == "untyped" else a.type
            kind = "double" if other in NUMERIC else other
        else:
            kind = promote(a, b)[0].type
        name = fresh("m")
        keys = [f"{name}{j}" for j in range(len(loop.keys))]
        left = sides[0][0].select(*loop.keys, convert(a, kind).col.alias(name + "a"))
        right = sides[1][0].select(*[F.col(k).alias(i) for k, i in zip(loop.keys, keys, strict=True)], convert(b, kind).col.alias(name + "b"))
        on = [F.col(k) == F.col(i) for k, i in zip(loop.keys, keys, strict=True)]
        if e.op == "=":
            return left.join(right, [*on, F.col(name + "a") == F.col(name + "b")], "left_semi")
        x, y = left.groupBy(*loop.keys).agg(F.min(name + "a").alias("__lo"), F.max(name + "a").alias("__hi")), right.groupBy(*keys).agg(
            F.min(name + "b").alias("__lo2"), F.max(name + "b").alias("__hi2")
        )
        test = {
            "<": F.col("__lo") < F.col("__hi2"), "<=": F.col("__lo") <= F.col("__hi2"), ">": F.col("__hi") > F.col("__lo2"),
            ">=": F.col("__hi") >= F.col("__lo2"), "!=": (F.col("__lo") != F.col("__hi2")) | (F.col("__hi") != F.col("__lo2")),
        }[e.op]
        return x.join(y, on).where(test)

    def boolean(self, e: X.Expr, loop: Loop) -> tuple[Loop, Column]:
        """The effective boolean value of an expression as a column of the loop, never null."""
        if isinstance(e, X.Binary) and e.op in ("and", "or"):
            loop, a = self.boolean(e.left, loop)
            loop, b = self.boolean(e.right, loop)
            return loop, (a & b) if e.op == "and" else (a | b)
        if isinstance(e, X.Call) and e.name in ("not", "empty") and len(e.args) == 1:
            if e.name == "empty":
                loop, b = self.boolean(X.Call("exists", e.args), loop)
            else:
                loop, b = self.boolean(e.args[0], loop)
            return loop, ~b
        if isinstance(e, X.Quantified) and not e.some:
            loop, b = self.boolean(X.Quantified(True, e.var, e.source, X.Call("not", [e.body])), loop)
            return loop, ~b
        if isinstance(e, X.Binary) and e.op == "=" and isinstance(e.right, X.Binary) and e.right.op == "to" and not self.is_many(e.left, loop):
            loop, v = self.scalar(e.left, loop)
            loop, lo = self.scalar(e.right.left, loop)
            loop, hi = self.scalar(e.right.right, loop)
            n = convert(v, "double").col
            return loop, F.coalesce((n >= convert(lo, "double").col) & (n <= convert(hi, "double").col) & (n == F.floor(n)), F.lit(False))
        found = self.existential(e, loop)
        if found is not None:
            return self.flag(found, loop)
        if isinstance(e, X.Call) and e.name == "exists":
            if self.is_many(e.args[0], loop):
                return self.flag(self.sequence(e.args[0], loop).df, loop)
            loop, v = self.scalar(e.args[0], loop)
            return loop, v.col.isNotNull()
        if self.attribute_of(e, loop) is not None:
            loop, v = self.scalar(e, loop)
            return loop, v.col.isNotNull()
        loop, v = self.scalar(e, loop)
        return loop, ebv_value(v)

    # operators

    def binary(self, e: X.Binary, loop: Loop) -> tuple[Loop, Val]:
        op = e.op
        if op in ("and", "or"):
            loop, b = self.boolean(e, loop)
            return loop, Val(b, "boolean")
        if op in ("is", "<<", ">>"):
            loop, a = self.node_key(e.left, loop)
            loop, b = self.node_key(e.right, loop)
            return loop, Val({"is": a == b, "<<": a < b, ">>": a > b}[op], "boolean")
        if op in ("=", "!=", "<", "<=", ">", ">=") and (self.is_many(e.left, loop) or self.is_many(e.right, loop)):
            loop, b = self.boolean(e, loop)
            return loop, Val(b, "boolean")
        if op in ("to", "union", "intersect", "except"):
            return self.attach(self.sequence(e, loop), loop)
        loop, a = self.scalar(e.left, loop)
        loop, b = self.scalar(e.right, loop)
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return loop, Val(F.coalesce(compare(op, a, b, general=True), F.lit(False)), "boolean")
        if op in ("eq", "ne", "lt", "le", "gt", "ge"):
            sign = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}[op]
            return loop, Val(compare(sign, a, b, general=False), "boolean")
        return loop, arithmetic(op, a, b)

    def node_key(self, e: X.Expr, loop: Loop) -> tuple[Loop, Column]:
        """(doc_id, pre) of a node expression; null where it is empty."""
        seq = self.sequence(e, loop)
        name = fresh("k")
        p = seq.item.prefix
        df = seq.df.withColumn(name + "x", F.struct(F.col(p + "doc_id"), F.col(p + "pre")))
        ids = [f"{name}{j}" for j in range(len(loop.keys))]
        rows = df.groupBy(*[F.col(k).alias(i) for k, i in zip(loop.keys, ids, strict=True)]).agg(F.min(name + "x").alias(name + "x"))
        on = [F.col(k) == F.col(i) for k, i in zip(loop.keys, ids, strict=True)]
        return loop.over(loop.df.join(rows, on, "left").drop(*ids)), F.col(name + "x")

    def type_op(self, e: X.TypeOp, loop: Loop) -> tuple[Loop, Val]:
        kind = e.type.item.removeprefix("xs:")
        if e.op == "instance":
            return self.instance_of(e, loop)
        loop, v = self.scalar(e.arg, loop)
        if e.op == "treat":
            return loop, v
        made = convert(v, kind, castable=True)
        if e.op == "castable":
            return loop, Val(F.when(v.col.isNull(), F.lit(e.type.occurs == "?")).otherwise(made.col.isNotNull()), "boolean")
        failed = F.raise_error(F.concat(F.lit(f"FORG0001: cannot cast to {e.type.item}: "), v.col.cast("string")))
        missing = F.lit(None) if e.type.occurs == "?" else F.raise_error(F.lit("XPTY0004: empty sequence"))
        cast = made.col
        return loop, Val(F.when(v.col.isNull(), missing).when(cast.isNotNull(), cast).otherwise(failed), made.type)

    def instance_of(self, e: X.TypeOp, loop: Loop) -> tuple[Loop, Val]:
        """Decided by static types, and by counting where the number of items matters."""
        from arborist.plans.registry import derives

        t = e.type
        least, most = {"": (1, 1), "?": (0, 1), "*": (0, None), "+": (1, None)}[t.occurs]
        if self.is_node(e.arg, loop):
            seq = self.sequence(e.arg, loop)
            p = seq.item.prefix
            ok = F.lit(True) if t.item == "item()" else axes.condition(t.test, ELEMENT, p) if t.test else F.lit(False)
            loop, n = self.aggregate(seq, loop, lambda: F.count("*"), "integer", F.lit(0))
            loop, bad = self.aggregate(replace(seq, df=seq.df.where(~ok)), loop, lambda: F.count("*"), "integer", F.lit(0))
            inside = (n.col >= least) & ((n.col <= most) if most is not None else F.lit(True))
            return loop, Val((bad.col == 0) & (F.lit(False) if t.item == "empty-sequence()" else inside), "boolean")
        if self.is_many(e.arg, loop):
            seq = self.sequence(e.arg, loop)
            loop, n = self.aggregate(seq, loop, lambda: F.count("*"), "integer", F.lit(0))
            kind, number = seq.item.type, n.col
        else:
            loop, v = self.scalar(e.arg, loop)
            kind, number = v.type, F.when(v.col.isNull(), 0).otherwise(1)
        inside = (number >= least) & ((number <= most) if most is not None else F.lit(True))
        if t.item == "empty-sequence()":
            return loop, Val(number == 0, "boolean")
        fits = t.item == "item()" or (t.item.startswith("xs:") and derives(kind, t.item[3:]))
        return loop, Val(inside & (F.lit(fits) | (number == 0)), "boolean")

    def call(self, e: X.Call, loop: Loop) -> tuple[Loop, Val]:
        name, args = e.name, e.args
        n = len(args)
        if name == "position" and not n:
            return loop, Val(F.col(loop.position).cast("bigint"), "integer")
        if name == "last" and not n:
            return loop, Val(F.col(loop.size).cast("bigint"), "integer")
        if name in ("not", "empty", "exists", "boolean"):
            loop, b = self.boolean(e, loop) if name != "boolean" else self.boolean(args[0], loop)
            return loop, Val(b, "boolean")
        if name == "count" and n == 1 and self.beside(args[0], loop):
            return self.count_beside(args[0], loop)
        if name in ("count", "sum", "avg", "min", "max") and n:
            if isinstance(args[0], X.Binary) and args[0].op == "to":
                return self.range_aggregate(name, args[0], loop)
            return self.aggregate_call(name, self.sequence(args[0], loop), loop, args)
        if name == "current" and not n:
            return self.scalar(X.Var(CURRENT), loop)
        if name == "static-base-uri" and not n:
            return loop, Val(F.lit(self.base_uri).cast("string"), "anyURI" if self.base_uri is not None else "empty")
        if name == "resolve-uri" and n == 1:
            if self.base_uri is None:
                raise XdmError("FONS0005", "there is no base URI")
            loop, v = self.scalar(args[0], loop)
            return loop, Val(strings.resolve_uri(convert(v, "string").col, F.lit(self.base_uri)), "anyURI")
        if name == "format-number" and n == 3:
            loop, v = self.scalar(args[0], loop)
            loop, p = self.scalar(args[1], loop)
            loop, f = self.scalar(args[2], loop)
            if f.lit not in self.decimal_formats or p.lit is None:
                raise XdmError("XTDE1280", f"no decimal format {f.lit}")
            return loop, Val(numeric.format_number(convert(v, "double").col, str(p.lit), self.decimal_formats[f.lit]), "string")
        if name == "doc-available" and n == 1:
            loop, v = self.scalar(args[0], loop)
            u = fresh("u")
            known = self.nodes.where((F.col("kind") == DOCUMENT) & F.col("base_uri").isNotNull()).select(F.col("base_uri").alias(u)).distinct()
            df = loop.df.join(known, convert(v, "string").col == F.col(u), "left")
            return loop.over(df), Val(F.col(u).isNotNull(), "boolean")
        if name in ("resolve-QName", "namespace-uri-for-prefix") and n == 2:
            return self.prefix_call(name, args, loop)
        if name == "codepoints-to-string" and n == 1:
            seq = self.sequence(args[0], loop)
            order = [F.col(o) for o in seq.order]
            made = lambda v: F.transform(F.array_sort(F.collect_list(F.struct(*order, convert(v, "integer").col.alias("v")))), lambda x: x["v"])
            loop, v = self.aggregate(seq, loop, lambda v: made(v), "array")
            return loop, Val(F.coalesce(strings.codepoints_to_string(v.col), F.lit("")), "string")
        if name == "string-join":
            loop, sep = self.scalar(args[1], loop) if n > 1 else (loop, Val(F.lit(""), "string"))
            seq = self.sequence(args[0], loop)
            order = [F.col(o) for o in seq.order]
            parts = lambda v: F.transform(F.array_sort(F.collect_list(F.struct(*order, convert(v, "string").col.alias("v")))), lambda x: x["v"])
            loop, v = self.aggregate(seq, loop, lambda v: parts(v), "array")
            return loop, Val(F.coalesce(strings.string_join(v.col, convert(sep, "string").col), F.lit("")), "string")
        if name in ("name", "local-name", "namespace-uri", "node-name", "base-uri", "document-uri", "generate-id", "line-number", "column-number", "nilled"):
            return self.node_call(name, args, loop)
        if name == "lang":
            return self.lang(args, loop)
        if name == "deep-equal":
            return self.deep_equal(args, loop)
        if name in ("string", "data", "number", "string-length", "normalize-space") and not n:
            args = [X.Ctx()]
            n = 1
        if name in ("zero-or-one", "exactly-one", "one-or-more", "trace", "unordered", "data", "distinct-values", "reverse", "subsequence") and n and self.is_many(X.Call(name, args), loop):
            return self.attach(self.sequence(e, loop), loop)
        if name in ("zero-or-one", "exactly-one", "one-or-more", "unordered", "distinct-values", "reverse", "data"):
            return self.scalar(args[0], loop)
        made = SCALAR.get((name, n)) or SCALAR.get((name, None))
        if made is None:
            raise XdmError("XPST0017", f"{name}#{n} is not known")
        values = []
        for a in args:
            loop, v = self.scalar(a, loop)
            values.append(v)
        return loop, made(*values)

    def prefix_call(self, name: str, args: list[X.Expr], loop: Loop) -> tuple[Loop, Val]:
        """The namespace of a prefix among those in scope at an element, or a lexical name resolved by it."""
        loop, v = self.scalar(args[0], loop)
        c = fresh("q")
        loop = loop.rebased(loop.df.withColumn(c, convert(v, "string").col))
        text = F.coalesce(F.col(c), F.lit(""))
        prefix = text if name == "namespace-uri-for-prefix" else F.when(F.contains(text, F.lit(":")), F.substring_index(text, ":", 1)).otherwise("")
        seq = self.sequence(args[1], loop)
        spaces = self.sequence(X.Step("namespace", X.Test("name")), replace(self.iterate(seq, loop, None), focus=seq.item))
        p = spaces.item.prefix
        spaces = replace(spaces, df=spaces.df.where(F.coalesce(F.col(p + "local"), F.lit("")) == prefix))
        loop, uri = self.aggregate(spaces, loop, lambda: F.max(F.col(p + "value")), "anyURI")
        if name == "namespace-uri-for-prefix":
            return loop, uri
        missing = F.raise_error(F.concat(F.lit("FONS0004: prefix is not declared: "), prefix)).cast("string")
        return loop, qname(F.coalesce(uri.col, F.when(prefix == "", "").otherwise(missing)), F.col(c))

    def beside(self, e: X.Expr, loop: Loop) -> bool:
        """Whether an expression is all nodes of a test before or after a focus that is a node."""
        return isinstance(e, X.Step) and e.axis in ("preceding", "following") and not e.predicates and isinstance(loop.focus, Node)

    def count_beside(self, e: X.Step, loop: Loop) -> tuple[Loop, Val]:
        """count(preceding::x) and count(following::x): running counts along each document, not pairs of nodes.

        The nodes before a node are those whose last descendant lies before it; those after it begin behind its own.
        """
        p, w = loop.focus.prefix, fresh("w")
        before = e.axis == "preceding"
        counted = axes.prefixed(self.reached(e.axis, e.test).where(~F.col("kind").isin(ATTRIBUTE, NAMESPACE, DOCUMENT)), w)
        counted = counted.where(axes.condition(e.test, ELEMENT, w))
        rows = counted.select(F.col(w + "doc_id").alias("d"), F.col(w + ("last" if before else "pre")).alias("k"), F.lit(1).alias("one"), F.lit(None).cast("int").alias("at"))
        place = F.col(p + ("pre" if before else "last"))
        asked = loop.df.select(F.col(p + "doc_id").alias("d"), place.alias("k"), F.lit(0).alias("one"), F.col(p + "pre").alias("at")).distinct()
        # those that ask come before what ends at the same place, and after what begins there
        run = Window.partitionBy("d").orderBy(F.col("k"), F.col("one").asc() if before else F.col("one").desc()).rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum("one").over(Window.partitionBy("d"))
        counts = rows.unionByName(asked).withColumn("n", F.sum("one").over(run)).withColumn("all", total).where(F.col("at").isNotNull())
        value = F.col("n") if before else F.col("all") - F.col("n")
        name = fresh("n")
        counts = counts.select(F.col("d").alias(name + "d"), F.col("at").alias(name + "p"), value.cast("bigint").alias(name))
        df = loop.df.join(counts, (F.col(p + "doc_id") == F.col(name + "d")) & (F.col(p + "pre") == F.col(name + "p")), "left").drop(name + "d", name + "p")
        return loop.over(df), Val(F.coalesce(F.col(name), F.lit(0).cast("bigint")), "integer")

    def range_aggregate(self, name: str, e: X.Binary, loop: Loop) -> tuple[Loop, Val]:
        """Aggregates of lo to hi in closed form: no range is made."""
        from arborist.operators import sequences

        loop, a = self.scalar(e.left, loop)
        loop, b = self.scalar(e.right, loop)
        lo, hi = convert(a, "integer").col, convert(b, "integer").col
        full = lo <= hi
        made = {
            "count": lambda: Val(sequences.range_count(lo, hi), "integer"), "sum": lambda: Val(sequences.range_sum(lo, hi), "decimal"),
            "min": lambda: Val(F.when(full, lo), "integer"), "max": lambda: Val(F.when(full, hi), "integer"),
            "avg": lambda: Val(F.when(full, ((lo + hi) / F.lit(2)).cast("decimal(38,18)")), "decimal"),
        }
        return loop, made[name]()

    def aggregate_call(self, name: str, seq: Seq, loop: Loop, args: list[X.Expr]) -> tuple[Loop, Val]:
        if name == "count":
            return self.aggregate(seq, loop, lambda: F.count("*"), "integer", F.lit(0).cast("bigint"))
        kind = seq.item.type if isinstance(seq.item, Atom) else "untyped"
        kind = "double" if kind == "untyped" else kind
        value = lambda v: convert(v, kind).col
        if name == "sum":
            loop, v = self.aggregate(seq, loop, lambda v: F.sum(value(v)), kind)
            zero = F.lit(0)
            if len(args) > 1:
                loop, z = self.scalar(args[1], loop)
                zero = convert(z, kind).col if z.type != "empty" else F.lit(None)
            return loop, Val(F.coalesce(v.col, zero), kind)
        if name == "avg":
            if kind in ("integer", "decimal"):
                exact = lambda v: (F.sum(value(v).cast("decimal(30,6)")) / F.count(value(v))).cast("decimal(38,18)")
                return self.aggregate(seq, loop, lambda v: exact(v), "decimal")
            return self.aggregate(seq, loop, lambda v: F.avg(value(v)), kind)
        # NaN is the largest double for Spark, so max has it already
        make = F.max if name == "max" else F.min
        if kind == "double" and name == "min":
            return self.aggregate(seq, loop, lambda v: F.when(F.max(F.isnan(value(v))), numeric.nan()).otherwise(F.min(value(v))), kind)
        return self.aggregate(seq, loop, lambda v: make(value(v)), kind)

    def node_call(self, name: str, args: list[X.Expr], loop: Loop) -> tuple[Loop, Val]:
        if args and not isinstance(args[0], X.Ctx):
            seq = self.sequence(args[0], loop)
            p, wanted = seq.item.prefix, fresh("n")
            cols = ("doc_id", "pre", "kind", "uri", "local", "prefix", "base_uri", "line", "col")
            ids = [f"{wanted}{j}" for j in range(len(loop.keys))]
            rows = seq.df.groupBy(*[F.col(k).alias(i) for k, i in zip(loop.keys, ids, strict=True)]).agg(
                F.min_by(F.struct(*[F.col(p + c).alias(c) for c in cols]), F.col(p + "pre")).alias(wanted)
            )
            on = [F.col(k) == F.col(i) for k, i in zip(loop.keys, ids, strict=True)]
            loop = loop.over(loop.df.join(rows, on, "left").drop(*ids))
            at = lambda c: F.col(wanted)[c]
        else:
            p = self.focus(loop).prefix
            at = lambda c: F.col(p + c)
        local = F.coalesce(at("local"), F.lit(""))
        if name == "name":
            return loop, Val(F.when(F.coalesce(at("prefix"), F.lit("")) != "", F.concat(at("prefix"), F.lit(":"), local)).otherwise(local), "string")
        made = {
            "local-name": (local, "string"), "namespace-uri": (F.coalesce(at("uri"), F.lit("")), "anyURI"),
            "node-name": (F.when(at("local").isNotNull(), F.struct(F.coalesce(at("uri"), F.lit("")).alias("uri"), F.coalesce(at("prefix"), F.lit("")).alias("prefix"), local.alias("local"))), "QName"),
            "base-uri": (at("base_uri"), "anyURI"), "document-uri": (F.when(at("kind") == DOCUMENT, at("base_uri")), "anyURI"),
            "generate-id": (F.when(at("pre").isNull(), "").otherwise(F.concat(F.lit("d"), at("doc_id").cast("string"), F.lit("n"), at("pre").cast("string"))), "string"),
            "line-number": (at("line").cast("bigint"), "integer"), "column-number": (at("col").cast("bigint"), "integer"),
        }
        if name == "nilled":
            nil = self.nodes.where((F.col("kind") == ATTRIBUTE) & (F.col("local") == "nil") & (F.col("uri") == "http://www.w3.org/2001/XMLSchema-instance"))
            nil = nil.where(F.col("value").isin("true", "1")).select(F.col("doc_id").alias("__nd"), F.col("parent").alias("__np"), F.lit(True).alias("__nil"))
            df = loop.df.join(nil, (at("doc_id") == F.col("__nd")) & (at("pre") == F.col("__np")), "left").drop("__nd", "__np")
            out = fresh("nil")
            return loop.over(df.withColumnRenamed("__nil", out)), Val(F.when(at("kind") == ELEMENT, F.coalesce(F.col(out), F.lit(False))), "boolean")
        col, kind = made[name]
        return loop, Val(col, kind)

    def lang(self, args: list[X.Expr], loop: Loop) -> tuple[Loop, Val]:
        """Whether the nearest xml:lang is the language asked for, or a part of it."""
        loop, want = self.scalar(args[0], loop)
        p = self.focus(loop).prefix
        context = Loop(loop.df, loop.keys, Node(p))
        seq = self.sequence(parse("ancestor-or-self::*/@xml:lang"), context)
        q = seq.item.prefix
        loop, v = self.aggregate(seq, loop, lambda: F.max_by(F.col(q + "value"), F.col(q + "level")), "string")
        a, b = F.lower(v.col), F.lower(want.col)
        return loop, Val(F.coalesce((a == b) | F.startswith(a, F.concat(b, F.lit("-"))), F.lit(False)), "boolean")

    def deep_equal(self, args: list[X.Expr], loop: Loop) -> tuple[Loop, Val]:
        """Equality of the ordered canonical hashes of two node sequences."""
        from arborist.operators.values import subtree_hash

        values = []
        for a in args[:2]:
            seq = self.sequence(a, loop)
            if isinstance(seq.item, Atom):
                order = [F.col(o) for o in seq.order]
                col = F.col(seq.item.col)
                loop, v = self.aggregate(seq, loop, lambda order=order, col=col: F.array_sort(F.collect_list(F.struct(*order, col.alias("v")))), "array")
                values.append(F.coalesce(F.array_join(F.transform(v.col, lambda x: x["v"].cast("string")), "\x01"), F.lit("")))
                continue
            p = seq.item.prefix
            wanted = seq.df.select(*[F.col(p + c).alias(c) for c in ("doc_id", "pre", "last", "level")]).distinct()
            hashed = subtree_hash(wanted, self.nodes).select(F.col("doc_id").alias("__hd"), F.col("pre").alias("__hp"), "canon")
            df = seq.df.join(hashed, (F.col(p + "doc_id") == F.col("__hd")) & (F.col(p + "pre") == F.col("__hp")))
            parts = lambda p=p: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(p + "doc_id"), F.col(p + "pre"), "canon"))), lambda x: x["canon"]), "")
            loop, v = self._joined(replace(seq, df=df), loop, parts())
            values.append(v.col)
        return loop, Val(values[0] == values[1], "boolean")

    def _joined(self, seq: Seq, loop: Loop, made: Column) -> tuple[Loop, Val]:
        return self.aggregate(seq, loop, lambda: made, "string", F.lit(""))

    # sequences

    def iterate(self, seq: Seq, loop: Loop, var: str | None) -> Loop:
        """A loop over the items of a sequence: keys grow by the item's order; the item is bound to a variable."""
        item = seq.item
        env = (*loop.env, (var, item)) if var else loop.env
        keys = (*loop.keys, *[o for o in seq.order if o not in loop.keys])
        attrs = tuple(a for a in loop.attrs if a[1] in seq.df.columns)
        return Loop(seq.df, keys, loop.focus, env, loop.position, loop.size, attrs)

    def sequence(self, e: X.Expr, loop: Loop) -> Seq:
        """Any expression as a relation."""
        loop = loop.fork()
        if isinstance(e, X.Root):
            p = fresh("r")
            f = self.focus(loop)
            roots = axes.prefixed(self.some((DOCUMENT,)).where(F.col("kind") == DOCUMENT), p)
            return Seq(loop.df.join(roots, F.col(f.prefix + "doc_id") == F.col(p + "doc_id")), (p + "pre",), Node(p), True)
        if isinstance(e, X.Step):
            item = self.focus(loop)
            if not isinstance(item, Node):
                raise XdmError("XPTY0020", "the context item is no node")
            return self.step(e, Seq(loop.df, (), item, True), loop)
        if isinstance(e, X.Path):
            return self.path(e, loop)
        if isinstance(e, X.Filter):
            seq = self.sequence(e.base, loop)
            return self.filtered(seq, e.predicates, loop)
        if isinstance(e, X.Ctx):
            item = self.focus(loop)
            return Seq(loop.df, self.order_of(item), item, True)
        if isinstance(e, X.Var):
            bound = self.lookup(loop, e.name)
            if isinstance(bound, Seq):
                return bound
            return Seq(loop.df, self.order_of(bound), bound, True)
        if isinstance(e, X.For):
            source = self.sequence(e.source, loop)
            inner = self.iterate(source, loop, e.var)
            body = self.sequence(e.body, inner)
            return Seq(body.df, (*source.order, *body.order), body.item, source.single and body.single, False)
        if isinstance(e, X.Sequence):
            return self.concatenated([self.sequence(i, loop) for i in e.items], loop)
        if isinstance(e, X.If) and self.is_many(e, loop):
            loop, test = self.boolean(e.test, loop)
            name = fresh("t")
            loop = loop.rebased(loop.df.withColumn(name, test))
            yes, no = loop.rebased(loop.df.where(F.col(name))), loop.rebased(loop.df.where(~F.col(name)))
            return self.concatenated([self.sequence(e.then, yes), self.sequence(e.other, no)], loop)
        if isinstance(e, X.Binary) and e.op in ("union", "intersect", "except"):
            return self.set_operation(e, loop)
        if isinstance(e, X.Binary) and e.op == "to":
            from arborist.operators.sequences import range_

            loop, a = self.scalar(e.left, loop)
            loop, b = self.scalar(e.right, loop)
            name = fresh("i")
            made = range_(convert(a, "integer").col, convert(b, "integer").col)
            return Seq(loop.df.select("*", F.explode(made).alias(name)), (name,), Atom(name, "integer"))
        if isinstance(e, X.Call) and e.name in SEQUENCE_CALLS:
            return self.sequence_call(e, loop)
        loop, v = self.scalar(e, loop)
        name = fresh("x")
        return Seq(loop.df.withColumn(name, v.col).where(F.col(name).isNotNull()), (), Atom(name, v.type), True)

    @staticmethod
    def order_of(item: Node | Atom) -> tuple[str, ...]:
        return (item.prefix + "doc_id", item.prefix + "pre") if isinstance(item, Node) else ()

    def path(self, e: X.Path, loop: Loop) -> Seq:
        left = self.sequence(e.left, loop)
        if not isinstance(left.item, Node):
            raise XdmError("XPTY0019", "a path step on atomic values")
        if isinstance(e.right, X.Step):
            return self.step(e.right, left, loop)
        inner = self.iterate(replace(left, order=self.order_of(left.item)), loop, None)
        inner = replace(inner, focus=left.item)
        if uses_position(e.right):
            pos, size = fresh("p"), fresh("z")
            w = Window.partitionBy(*loop.keys)
            inner = replace(inner, df=inner.df.withColumn(pos, F.row_number().over(w.orderBy(*self.order_of(left.item)))).withColumn(size, F.count("*").over(w)), position=pos, size=size)
        right = self.sequence(e.right, inner)
        if isinstance(right.item, Node):
            return self.document_order(right, loop)
        return Seq(right.df, (*self.order_of(left.item), *right.order), right.item, left.single and right.single, False)

    def document_order(self, seq: Seq, loop: Loop) -> Seq:
        p = seq.item.prefix
        df = seq.df if seq.distinct and seq.single else seq.df.dropDuplicates([*loop.keys, p + "doc_id", p + "pre"])
        return Seq(df, (p + "doc_id", p + "pre"), seq.item, seq.single)

    def step(self, e: X.Step, left: Seq, loop: Loop) -> Seq:
        c, n = left.item.prefix, fresh("n")
        if not left.single and e.axis not in axes.INJECTIVE and not left.distinct:
            left = self.document_order(left, loop)
        df = axes.step(left.df, self.reached(e.axis, e.test), e.axis, e.test, c, n)
        one = e.axis in ("self", "parent") or (e.axis == "attribute" and e.test.local is not None and e.test.uri is not None)
        seq = Seq(df, (n + "doc_id", n + "pre"), Node(n, self.simple(e.axis, e.test)), left.single and one, left.single or e.axis in axes.INJECTIVE)
        if e.predicates:
            order = F.col(n + "pre").desc() if e.axis in axes.REVERSE else F.col(n + "pre").asc()
            seq = self.filtered(seq, e.predicates, loop, [*loop.keys, c + "doc_id", c + "pre"], [F.col(n + "doc_id"), order])
        if not seq.distinct:
            seq = replace(self.document_order(replace(seq, single=False), loop), distinct=True)
        return seq

    def filtered(self, seq: Seq, predicates: list[X.Expr], loop: Loop, part: list[str] | None = None, order: list[Column] | None = None) -> Seq:
        """Predicates in turn; positions count within `part`, which are the iteration's keys for filter expressions."""
        part = list(dict.fromkeys(part or loop.keys))
        order = order or [F.col(o) for o in seq.order] or [F.lit(0)]
        for p in predicates:
            seq = self.predicate(seq, p, loop, part, order)
        return seq

    def predicate(self, seq: Seq, p: X.Expr, loop: Loop, part: list[str], order: list[Column]) -> Seq:
        df = seq.df
        pos, size = fresh("p"), fresh("z")
        w = Window.partitionBy(*part)
        if isinstance(p, X.Lit) and p.type != "string":
            kept = df.withColumn(pos, F.row_number().over(w.orderBy(*order))).where(F.col(pos) == F.lit(float(p.value))).drop(pos)
            return replace(seq, df=kept, single=list(part) == list(loop.keys) or seq.single)
        if isinstance(p, X.Call) and p.name == "last" and not p.args:
            numbered = df.withColumn(pos, F.row_number().over(w.orderBy(*order))).withColumn(size, F.count("*").over(w))
            return replace(seq, df=numbered.where(F.col(pos) == F.col(size)).drop(pos, size), single=list(part) == list(loop.keys) or seq.single)
        positions = uses_position(p) or not self.is_boolean(p, loop, seq)
        if positions:
            df = df.withColumn(pos, F.row_number().over(w.orderBy(*order))).withColumn(size, F.count("*").over(w))
        item = seq.item
        own = (item.prefix + "doc_id", item.prefix + "pre") if isinstance(item, Node) else seq.order
        keys = tuple(dict.fromkeys((*part, *own)))
        inner = Loop(df, keys, item, loop.env, pos if positions else None, size if positions else None)
        inner = self.prefetch(inner, p)
        df = inner.df
        columns = seq.df.columns
        negated = isinstance(p, X.Call) and p.name in ("not", "empty") and len(p.args) == 1
        inside = X.Call("exists", p.args) if negated and p.name == "empty" else p.args[0] if negated else p
        if not positions and not (isinstance(inside, X.Binary) and inside.op in ("and", "or")):
            found = self.existential(inside, inner)
            if found is not None:
                name = fresh("j")
                ids = [f"{name}{j}" for j in range(len(keys))]
                rows = found.select(*[F.col(k).alias(i) for k, i in zip(keys, ids, strict=True)])
                on = [F.col(k) == F.col(i) for k, i in zip(keys, ids, strict=True)]
                return replace(seq, df=df.join(rows, on, "left_anti" if negated else "left_semi").select(*columns))
        if isinstance(p, X.Binary) and p.op == "and" and not positions:
            return self.predicate(self.predicate(seq, p.left, loop, part, order), p.right, loop, part, order)
        if positions and not self.is_boolean(p, loop, seq):
            inner, v = self.scalar(p, inner)
            test = (convert(v, "double").col == F.col(pos)) if v.type in ("integer", "decimal", "double") else ebv_value(v)
        else:
            inner, test = self.boolean(p, inner)
        return replace(seq, df=inner.df.where(test).select(*columns))

    def is_boolean(self, p: X.Expr, loop: Loop, seq: Seq) -> bool:
        """Whether a predicate's value is a truth value whatever its items are."""
        if isinstance(p, X.Binary):
            return p.op in ("and", "or", "=", "!=", "<", "<=", ">", ">=", "eq", "ne", "lt", "le", "gt", "ge", "is", "<<", ">>", "union", "intersect", "except")
        if isinstance(p, (X.Step, X.Path, X.Quantified, X.Root)):
            return True
        if isinstance(p, X.TypeOp):
            return p.op in ("instance", "castable")
        if isinstance(p, X.Call):
            return p.name in ("not", "boolean", "exists", "empty", "contains", "starts-with", "ends-with", "matches", "true", "false", "deep-equal", "lang", "nilled", "codepoint-equal")
        return isinstance(p, X.Lit) and p.type == "string"

    def concatenated(self, parts: list[Seq], loop: Loop) -> Seq:
        """Sequences one after another: all nodes, or all atomic values of one promoted type."""
        if not parts:
            name = fresh("x")
            return Seq(loop.df.where(F.lit(False)).withColumn(name, F.lit(None).cast("string")), (), Atom(name, "string"))
        if len(parts) == 1:
            return parts[0]
        branch, name = fresh("b"), fresh("u")
        keep = loop.df.columns
        rows = []
        if all(isinstance(s.item, Node) for s in parts):
            for k, s in enumerate(parts):
                order = F.struct(*[F.col(o).cast("bigint").alias(f"o{j}") for j, o in enumerate(s.order)]) if s.order else F.lit(None)
                ranked = s.df.withColumn(branch + "r", F.row_number().over(Window.partitionBy(*loop.keys).orderBy(order)))
                rows.append(ranked.select(*keep, F.lit(k).alias(branch), F.col(branch + "r"), *[F.col(s.item.prefix + c).alias(name + c) for c in COLUMNS]))
            item: Node | Atom = Node(name, all(s.item.simple for s in parts))
        else:
            values = []
            for s in parts:
                inner, v = self.atomized(Loop(s.df, loop.keys, s.item), s.item)
                values.append((s, inner.df, v))
            kind = values[0][2].type
            for _, _, v in values[1:]:
                try:
                    kind = promote(Val(F.lit(None), kind), Val(F.lit(None), v.type))[0].type
                except XdmError:
                    kind = "mixed"
            for k, (s, df, v) in enumerate(values):
                order = [F.col(o) for o in s.order] or [F.lit(0)]
                ranked = df.withColumn(branch + "r", F.row_number().over(Window.partitionBy(*loop.keys).orderBy(*order)))
                rows.append(ranked.select(*keep, F.lit(k).alias(branch), F.col(branch + "r"), convert(v, kind).col.alias(name)))
            item = Atom(name, kind)
        df = rows[0]
        for r in rows[1:]:
            df = df.unionByName(r)
        return Seq(df, (branch, branch + "r"), item, False, False)

    def set_operation(self, e: X.Binary, loop: Loop) -> Seq:
        a, b = self.sequence(e.left, loop), self.sequence(e.right, loop)
        if not (isinstance(a.item, Node) and isinstance(b.item, Node)):
            raise XdmError("XPTY0004", f"{e.op} of atomic values")
        if e.op == "union":
            return self.document_order(self.concatenated([a, b], loop), loop)
        name = fresh("j")
        keys = [*loop.keys, b.item.prefix + "doc_id", b.item.prefix + "pre"]
        ids = [f"{name}{j}" for j in range(len(keys))]
        rows = b.df.select(*[F.col(k).alias(i) for k, i in zip(keys, ids, strict=True)])
        own = [*loop.keys, a.item.prefix + "doc_id", a.item.prefix + "pre"]
        on = [F.col(k) == F.col(i) for k, i in zip(own, ids, strict=True)]
        return self.document_order(replace(a, df=a.df.join(rows, on, "left_semi" if e.op == "intersect" else "left_anti")), loop)

    def sequence_call(self, e: X.Call, loop: Loop) -> Seq:
        name, args = e.name, e.args
        if name in ("unordered", "zero-or-one", "one-or-more", "exactly-one", "trace"):
            seq = self.sequence(args[0], loop)
            return seq if name in ("unordered", "trace") else self.checked(name, seq, loop)
        if name == "data":
            seq = self.sequence(args[0], loop)
            inner, v = self.atomized(Loop(seq.df, loop.keys, seq.item), seq.item)
            c = fresh("d")
            return Seq(inner.df.withColumn(c, v.col), seq.order, Atom(c, v.type), seq.single, False)
        if name == "reverse":
            seq = self.ranked(self.sequence(args[0], loop), loop)
            c = fresh("o")
            return replace(seq, df=seq.df.withColumn(c, -F.col(seq.order[0])), order=(c,), distinct=False)
        if name == "distinct-values":
            seq = self.ranked(self.sequence(args[0], loop), loop)
            inner, v = self.atomized(Loop(seq.df, loop.keys, seq.item), seq.item)
            c, o = fresh("d"), fresh("o")
            value = convert(v, "string") if v.type == "untyped" else v
            rows = inner.df.select(*loop.df.columns, value.col.alias(c), F.col(seq.order[0]).alias(o))
            others = [x for x in loop.df.columns if x not in loop.keys]
            rows = rows.groupBy(*loop.keys, c).agg(F.min(o).alias(o), *[F.first(x).alias(x) for x in others])
            return Seq(rows, (o,), Atom(c, value.type), False, False)
        if name in ("subsequence", "remove", "insert-before"):
            seq = self.ranked(self.sequence(args[0], loop), loop)
            return self.positional(name, seq, args, loop)
        if name == "index-of":
            loop, v = self.scalar(args[1], loop)
            c = fresh("w")
            loop = loop.rebased(loop.df.withColumn(c, v.col))
            seq = self.ranked(self.sequence(args[0], loop), loop)
            inner, x = self.atomized(Loop(seq.df, loop.keys, seq.item), seq.item)
            o = fresh("o")
            rows = inner.df.where(compare("=", x, Val(F.col(c), v.type), general=True)).withColumn(o, F.col(seq.order[0]).cast("bigint"))
            return Seq(rows, (o,), Atom(o, "integer"), False, False)
        if name in ("tokenize", "string-to-codepoints"):
            values = []
            for a in args:
                loop, v = self.scalar(a, loop)
                values.append(v)
            made = SCALAR[(name, len(args))](*values)
            c, o = fresh("t"), fresh("o")
            return Seq(loop.df.select("*", F.posexplode(made.col).alias(o, c)), (o,), Atom(c, "string" if name == "tokenize" else "integer"))
        if name in ("id", "idref"):
            return self.by_id(name, args, loop)
        if name == "key":
            return self.by_key(args, loop)
        if name == "collection":
            which = None
            if args:
                loop, v = self.scalar(args[0], loop)
                if v.type != "empty" and v.lit is None:
                    raise XdmError("XPST0003", "a collection must be named by a literal here")
                which = v.lit
            if which not in self.collections:
                raise XdmError("FODC0002", f"no collection {which}")
            p = fresh("r")
            roots = self.some((DOCUMENT,)).where(F.col("kind") == DOCUMENT)
            if self.collections[which] is not None:
                roots = roots.where(F.col("base_uri").isin(self.collections[which]))
            return Seq(loop.df.crossJoin(axes.prefixed(roots, p)), (p + "doc_id", p + "pre"), Node(p))
        if name in ("doc", "document"):
            return self.by_uri(name, args, loop)
        if name == "root":
            seq = self.sequence(args[0] if args else X.Ctx(), loop)
            p = fresh("r")
            roots = axes.prefixed(self.some((DOCUMENT,)).where(F.col("kind") == DOCUMENT), p)
            return self.document_order(Seq(seq.df.join(roots, F.col(seq.item.prefix + "doc_id") == F.col(p + "doc_id")), (p + "doc_id", p + "pre"), Node(p), seq.single, False), loop)
        if name == "current":
            return self.sequence(X.Var(CURRENT), loop)
        if name == "in-scope-prefixes":
            seq = self.sequence(args[0], loop)
            inner = self.sequence(X.Step("namespace", X.Test("name")), replace(self.iterate(seq, loop, None), focus=seq.item))
            c = fresh("p")
            return Seq(inner.df.withColumn(c, F.col(inner.item.prefix + "local")), (c,), Atom(c, "string"))
        raise XdmError("XPST0017", f"{name}#{len(args)} is not known")

    def ranked(self, seq: Seq, loop: Loop) -> Seq:
        """A sequence with one order column, its positions from 1."""
        c = fresh("o")
        order = [F.col(o) for o in seq.order] or [F.lit(0)]
        return replace(seq, df=seq.df.withColumn(c, F.row_number().over(Window.partitionBy(*loop.keys).orderBy(*order))), order=(c,))

    def checked(self, name: str, seq: Seq, loop: Loop) -> Seq:
        c = fresh("n")
        df = seq.df.withColumn(c, F.count("*").over(Window.partitionBy(*loop.keys)))
        code, ok = {"zero-or-one": ("FORG0003", F.col(c) <= 1), "one-or-more": ("FORG0004", F.col(c) >= 1), "exactly-one": ("FORG0005", F.col(c) == 1)}[name]
        return replace(seq, df=df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"{code}: {name}")).cast("boolean"))))

    def positional(self, name: str, seq: Seq, args: list[X.Expr], loop: Loop) -> Seq:
        at = seq.order[0]
        inner = Loop(seq.df, loop.keys, seq.item, loop.env)
        where, v = self.scalar(args[1], inner)
        p = F.col(at)
        if name == "remove":
            return replace(seq, df=where.df.where(p != convert(v, "integer").col), distinct=False)
        if name == "subsequence":
            lo = F.floor(convert(v, "double").col + 0.5)
            if len(args) == 2:
                return replace(seq, df=where.df.where(p >= lo), distinct=False)
            where, n = self.scalar(args[2], where)
            return replace(seq, df=where.df.where((p >= lo) & (p < lo + F.floor(convert(n, "double").col + 0.5))), distinct=False)
        loop, place = self.scalar(args[1], loop)
        c = fresh("w")
        loop = loop.rebased(loop.df.withColumn(c, F.greatest(convert(place, "integer").col, F.lit(1))))
        base = self.ranked(self.sequence(args[0], loop), loop)
        o = base.order[0]
        before, after = replace(base, df=base.df.where(F.col(o) < F.col(c))), replace(base, df=base.df.where(F.col(o) >= F.col(c)))
        return self.concatenated([before, self.sequence(args[2], loop), after], loop)

    def by_id(self, name: str, args: list[X.Expr], loop: Loop) -> Seq:
        """fn:id and fn:idref by xml:id and attributes named id, idref or idrefs: tokens joined with attribute values."""
        seq = self.sequence(args[0], loop)
        inner, v = self.atomized(Loop(seq.df, loop.keys, seq.item), seq.item)
        token = fresh("t")
        words = F.filter(F.split(convert(v, "string").col, r"[ \t\r\n]+"), lambda x: x != "")
        wanted = inner.df.select("*", F.explode(F.array_distinct(words) if name == "id" else F.array(convert(v, "string").col)).alias(token))
        doc = self.focus(loop).prefix + "doc_id" if isinstance(loop.focus, Node) else "__root_doc_id"
        p = fresh("n")
        ids = self.some((ATTRIBUTE,)).where(F.col("kind") == ATTRIBUTE)
        if name == "id":
            found = ids.where(F.lower("local") == "id").select(F.col("doc_id").alias("__id"), F.col("parent").alias("__pre"), F.col("value").alias("__value"))
            hits = wanted.join(found, (F.col(doc) == F.col("__id")) & (F.col(token) == F.col("__value")))
            owners = axes.prefixed(self.some((ELEMENT,)).where(F.col("kind") == ELEMENT), p)
            hits = hits.join(owners, (F.col("__id") == F.col(p + "doc_id")) & (F.col("__pre") == F.col(p + "pre"))).drop("__id", "__pre", "__value")
        else:
            refs = axes.prefixed(ids.where(F.lower("local").isin("idref", "idrefs")), p)
            refs = refs.select("*", F.explode(F.split(F.col(p + "value"), r"[ \t\r\n]+")).alias("__ref"))
            hits = wanted.join(refs, (F.col(doc) == F.col(p + "doc_id")) & (F.col(token) == F.col("__ref"))).drop("__ref")
        return self.document_order(Seq(hits, (p + "doc_id", p + "pre"), Node(p, name == "idref"), False, False), loop)

    def by_uri(self, name: str, args: list[X.Expr], loop: Loop) -> Seq:
        """doc() and document(): a join with the documents by base URI; FODC0002 where there is none."""
        seq = self.sequence(args[0], loop)
        inner, v = self.atomized(Loop(seq.df, loop.keys, seq.item), seq.item)
        u, p = fresh("u"), fresh("r")
        uri = convert(v, "string").col
        if self.base_uri is not None:
            uri = strings.resolve_uri(uri, F.lit(self.base_uri))
        wanted = inner.df.withColumn(u, uri).where(F.col(u).isNotNull())
        # of documents that share a URI the first counts
        roots = self.nodes.where((F.col("kind") == DOCUMENT) & F.col("base_uri").isNotNull())
        roots = roots.withColumn("__k", F.row_number().over(Window.partitionBy("base_uri").orderBy("doc_id"))).where("__k = 1").drop("__k")
        hits = wanted.join(axes.prefixed(roots, p), F.col(u) == F.col(p + "base_uri"), "left")
        missing = F.raise_error(F.concat(F.lit("FODC0002: no document "), F.col(u))).cast("boolean")
        hits = hits.where(F.when(F.col(p + "pre").isNotNull(), True).otherwise(missing))
        return self.document_order(Seq(hits, (p + "doc_id", p + "pre"), Node(p), seq.single and name == "doc", False), loop)

    def by_key(self, args: list[X.Expr], loop: Loop) -> Seq:
        """key(): an equi join with the key relation (doc_id, name, value, pre), built once a key declaration."""
        name = args[0].value
        if name not in self.keys:
            raise XdmError("XTDE1260", f"no key {name}")
        seq = self.sequence(args[1], loop)
        inner, v = self.atomized(Loop(seq.df, loop.keys, seq.item), seq.item)
        token, p = fresh("t"), fresh("n")
        wanted = inner.df.withColumn(token, convert(v, "string").col)
        relation = self.key_relation(name).select(F.col("doc_id").alias("__kd"), F.col("key").alias("__kv"), F.col("pre").alias("__kp"))
        doc = self.focus(loop).prefix + "doc_id" if isinstance(loop.focus, Node) else "__root_doc_id"
        hits = wanted.join(relation, (F.col(doc) == F.col("__kd")) & (F.col(token) == F.col("__kv")))
        match = parse(self.keys[name][0], self.namespaces)
        last = match.right if isinstance(match, X.Path) else match
        matched = self.reached(last.axis, last.test) if isinstance(last, X.Step) else self.nodes
        hits = hits.join(axes.prefixed(matched, p), (F.col("__kd") == F.col(p + "doc_id")) & (F.col("__kp") == F.col(p + "pre"))).drop("__kd", "__kv", "__kp")
        return self.document_order(Seq(hits, (p + "doc_id", p + "pre"), Node(p), False, False), loop)

    def key_relation(self, name: str) -> DataFrame:
        """(doc_id, key, pre) of a declared key: match is a path from the root, use an expression on the matched node."""
        match, use = self.keys[name]
        loop = self.documents()
        matched = self.sequence(parse(match if match.startswith("/") else f"//{match}", self.namespaces), loop)
        inner = replace(self.iterate(matched, loop, None), focus=matched.item)
        used = self.sequence(parse(use, self.namespaces), inner)
        rows, v = self.atomized(Loop(used.df, inner.keys, used.item), used.item)
        p = matched.item.prefix
        return rows.df.select(F.col(p + "doc_id").alias("doc_id"), convert(v, "string").col.alias("key"), F.col(p + "pre").alias("pre")).distinct()

    # relations of several values

    def table(self, rows: str, **columns: str) -> DataFrame:
        """A relation: one row for each item of `rows`, with doc_id, pos and a column for every expression on the item."""
        loop = self.documents()
        seq = self.sequence(parse(rows, self.namespaces), loop)
        ranked = self.ranked(seq, loop)
        inner = replace(self.iterate(replace(ranked, order=self.order_of(seq.item) or ranked.order), loop, CURRENT), focus=seq.item)
        parsed = {name: parse(text, self.namespaces) for name, text in columns.items()}
        inner = self.prefetch(inner, *parsed.values())
        made = {}
        for name, e in parsed.items():
            inner, v = self.scalar(e, inner)
            made[name] = v
        # the columns are null-safe: an empty sequence is null
        return inner.df.select(
            F.col("__root_doc_id").alias("doc_id"), F.col(ranked.order[0]).alias("pos"), *[v.col.alias(n) for n, v in made.items()]
        )


SEQUENCE_CALLS = {
    "distinct-values", "reverse", "subsequence", "remove", "insert-before", "index-of", "tokenize", "string-to-codepoints", "id", "idref", "key",
    "collection", "doc", "document", "root", "current", "data", "unordered", "zero-or-one", "one-or-more", "exactly-one", "trace", "in-scope-prefixes",
}


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """+ - * div idiv mod of numbers, dates and durations."""
    if {a.type, b.type} & {"date", "dateTime", "time", "yearMonthDuration", "dayTimeDuration"}:
        return _temporal(op, a, b)
    a, b = convert(a, numeric_type(a.type)), convert(b, numeric_type(b.type))
    a, b = promote(a, b)
    if op == "idiv":
        return Val(numeric.integer_divide(a.col, b.col), "integer")
    if op == "div":
        return Val(numeric.divide(a.col, b.col, "double" if a.type == "double" else "decimal"), "double" if a.type == "double" else "decimal")
    if op == "mod":
        return Val(numeric.modulo(a.col, b.col, "double" if a.type == "double" else "exact"), a.type)
    made = {"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op]
    return Val(made.cast("decimal(38,18)") if a.type == "decimal" else made, a.type)


def _temporal(op: str, a: Val, b: Val) -> Val:
    moments = ("date", "dateTime", "time")
    if op == "-" and a.type in moments and b.type == a.type:
        return Val(dates.difference(a.col, b.col), "dayTimeDuration")
    if op in ("+", "-") and a.type in moments:
        sign = 1 if op == "+" else -1
        if b.type == "yearMonthDuration":
            return Val(dates.add_months(a.col, sign * b.col), a.type)
        moved = dates.add_micros(a.col, sign * b.col)
        if a.type == "date":
            moved = dates.moment(moved["micros"] - F.pmod(moved["micros"], F.lit(dates.DAY)), moved["tz"])
        if a.type == "time":
            moved = dates.moment(F.pmod(moved["micros"], F.lit(dates.DAY)), moved["tz"])
        return Val(moved, a.type)
    if op == "+" and b.type in moments:
        return _temporal(op, b, a)
    if a.type == b.type:
        if op == "div":
            return Val((a.col.cast("decimal(20,0)") / b.col.cast("decimal(20,0)")).cast("decimal(38,18)"), "decimal")
        return Val(a.col + b.col if op == "+" else a.col - b.col, a.type)
    duration, number = (a, b) if "Duration" in a.type else (b, a)
    factor = convert(number, "double").col
    made = duration.col * factor if op == "*" else duration.col / factor
    return Val(F.floor(made + 0.5).cast("bigint"), duration.type)

