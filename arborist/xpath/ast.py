"""Syntax trees of XPath 2.0 expressions."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """Any expression."""


@dataclass
class Lit(Expr):
    value: object
    type: str  # string, integer, decimal, double, QName


@dataclass
class Var(Expr):
    name: str


@dataclass
class Ctx(Expr):
    pass


@dataclass
class Call(Expr):
    name: str  # local name; constructors are xs:name, other namespaces {uri}name
    args: list[Expr]


@dataclass
class Sequence(Expr):
    items: list[Expr]


@dataclass
class For(Expr):
    var: str
    source: Expr
    body: Expr


@dataclass
class Quantified(Expr):
    some: bool
    var: str
    source: Expr
    body: Expr


@dataclass
class If(Expr):
    test: Expr
    then: Expr
    other: Expr


@dataclass
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass
class Unary(Expr):
    op: str
    arg: Expr


@dataclass
class SequenceType:
    item: str  # xs:integer, node(), element(), item(), empty-sequence(), ...
    test: Test | None = None
    occurs: str = ""  # "", ?, * or +


@dataclass
class TypeOp(Expr):
    op: str  # instance, treat, castable, cast
    arg: Expr
    type: SequenceType


@dataclass
class Test:
    kind: str  # name, node, text, comment, processing-instruction, element, attribute, document-node, namespace-node
    uri: str | None = None  # None: any
    local: str | None = None  # None: any
    inner: Test | None = None


@dataclass
class Step(Expr):
    axis: str
    test: Test
    predicates: list[Expr] = field(default_factory=list)


@dataclass
class Filter(Expr):
    base: Expr
    predicates: list[Expr]


@dataclass
class Root(Expr):
    pass


@dataclass
class Path(Expr):
    left: Expr
    right: Expr
