"""RELAX NG (XML syntax): schemas become patterns on the driver, documents are validated by derivatives in parallel.

Derivatives need a fold over each document, so they run in Arrow batches; patterns are hash-consed tuples and the
derivatives by element start, attribute and text are memoised for the life of a worker's task.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.xdm import XdmError

RNG = "http://relaxng.org/ns/structure/1.0"
_Q = f"{{{RNG}}}"

EMPTY, NOT_ALLOWED, TEXT = ("empty",), ("notAllowed",), ("text",)


def choice(a, b):
    if a == NOT_ALLOWED or a == b:
        return b
    return a if b == NOT_ALLOWED else ("choice", *sorted((a, b), key=repr))


def group(a, b):
    if NOT_ALLOWED in (a, b):
        return NOT_ALLOWED
    return b if a == EMPTY else a if b == EMPTY else ("group", a, b)


def interleave(a, b):
    if NOT_ALLOWED in (a, b):
        return NOT_ALLOWED
    return b if a == EMPTY else a if b == EMPTY else ("interleave", a, b)


def after(a, b):
    return NOT_ALLOWED if NOT_ALLOWED in (a, b) else ("after", a, b)


def one_or_more(a):
    return a if a == NOT_ALLOWED or a[0] == "oneOrMore" else ("oneOrMore", a)


class Grammar:
    """A compiled schema: start pattern and definitions; `resolve` gives the text of includes and external references."""

    def __init__(self, text: str, resolve=None) -> None:
        self.resolve = resolve
        self.definitions: dict[str, tuple] = {}
        self.scopes = 0
        self.start = self._pattern(ET.fromstring(text), "", "", None)
        self.resolve = None  # a compiled grammar is sent to the workers
        _Restrictions(self.definitions).check(self.start)

    # name classes: ("name", uri, local), ("any", except), ("ns", uri, except), ("choice", a, b)

    def _name_class(self, e: ET.Element, ns: str):
        ns = e.get("ns", ns)
        kind = e.tag.removeprefix(_Q)
        if kind == "name":
            return ("name", ns, (e.text or "").strip().rpartition(":")[2])
        if kind == "choice":
            return self._fold([self._name_class(c, ns) for c in e], lambda a, b: ("choice", a, b))
        inner = e.find(_Q + "except")
        less = self._fold([self._name_class(c, ns) for c in inner], lambda a, b: ("choice", a, b)) if inner is not None else None
        if kind == "anyName":
            return ("any", less)
        if kind == "nsName":
            return ("ns", ns, less)
        raise XdmError("rng", f"bad name class {kind}")

    @staticmethod
    def _fold(parts, join):
        out = parts[0]
        for p in parts[1:]:
            out = join(out, p)
        return out

    def _named(self, e: ET.Element, ns: str, attribute: bool):
        """(name class, pattern children) of an element or attribute."""
        children = [c for c in e if isinstance(c.tag, str) and c.tag.startswith(_Q)]
        if e.get("name"):
            uri = e.get("ns", "" if attribute else ns)
            return ("name", uri, e.get("name").strip().rpartition(":")[2]), children
        return self._name_class(children[0], ns), children[1:]

    def _pattern(self, e: ET.Element, ns: str, library: str, scope: int | None):
        ns, library = e.get("ns", ns), e.get("datatypeLibrary", library)
        kind = e.tag.removeprefix(_Q)
        children = [c for c in e if isinstance(c.tag, str) and c.tag.startswith(_Q)]
        inner = lambda cs: self._fold([self._pattern(c, ns, library, scope) for c in cs] or [EMPTY], group)
        if kind in ("empty", "notAllowed", "text"):
            return (kind,)
        if kind in ("element", "attribute"):
            name, body = self._named(e, ns, kind == "attribute")
            return (kind, name, inner(body) if body else TEXT)
        if kind in ("group", "div"):
            return inner(children)
        if kind == "interleave":
            return self._fold([self._pattern(c, ns, library, scope) for c in children], interleave)
        if kind == "choice":
            return self._fold([self._pattern(c, ns, library, scope) for c in children], choice)
        if kind == "optional":
            return choice(inner(children), EMPTY)
        if kind == "zeroOrMore":
            return choice(one_or_more(inner(children)), EMPTY)
        if kind == "oneOrMore":
            return one_or_more(inner(children))
        if kind == "mixed":
            return interleave(inner(children), TEXT)
        if kind == "list":
            return ("list", inner(children))
        if kind == "value":
            return ("value", e.get("type", "token"), e.text or "")
        if kind == "data":
            params = tuple((c.get("name"), c.text or "") for c in children if c.tag == _Q + "param")
            less = e.find(_Q + "except")
            return ("data", e.get("type"), params, self._fold([self._pattern(c, ns, library, scope) for c in less], choice) if less is not None else None)
        if kind in ("ref", "parentRef"):
            at = scope if kind == "ref" else self.parents.get(scope)
            return ("ref", f"{at}/{e.get('name').strip()}")
        if kind == "grammar":
            return self._grammar(e, ns, library, scope)
        if kind == "externalRef":
            return self._pattern(ET.fromstring(self._text(e.get("href"))), ns, library, scope)
        raise XdmError("rng", f"unknown pattern {kind}")

    parents: dict[int | None, int | None] = {}

    def _text(self, href: str) -> str:
        if self.resolve is None:
            raise XdmError("rng", f"no resolver for {href}")
        data = self.resolve(href, None)
        return data.decode() if isinstance(data, bytes) else data

    def _grammar(self, e: ET.Element, ns: str, library: str, outer: int | None):
        self.scopes += 1
        scope = self.scopes
        self.parents = {**self.parents, scope: outer}
        found: dict[str, list] = {}

        def collect(parent: ET.Element, ns: str, library: str, overridden: set[str]) -> None:
            ns, library = parent.get("ns", ns), parent.get("datatypeLibrary", library)
            for c in parent:
                kind = c.tag.removeprefix(_Q) if isinstance(c.tag, str) else ""
                name = "" if kind == "start" else c.get("name", "").strip()
                if kind in ("start", "define"):
                    if (kind, name) not in overridden:
                        body = self._fold([self._pattern(x, c.get("ns", ns), c.get("datatypeLibrary", library), scope) for x in c if isinstance(x.tag, str) and x.tag.startswith(_Q)], group)
                        found.setdefault(name, []).append((c.get("combine"), body))
                elif kind == "div":
                    collect(c, ns, library, overridden)
                elif kind == "include":
                    mine = {(x.tag.removeprefix(_Q), "" if x.tag == _Q + "start" else x.get("name", "").strip()) for x in c.iter() if x.tag in (_Q + "start", _Q + "define")}
                    collect(ET.fromstring(self._text(c.get("href"))), ns, library, overridden | mine)
                    collect(c, ns, library, overridden)

        collect(e, ns, library, set())
        for name, bodies in found.items():
            how = next((c for c, _ in bodies if c), "choice")
            if len(bodies) > 1 and sum(c is None for c, _ in bodies) > 1:
                raise XdmError("rng", f"{name or 'start'} is defined twice without combine")
            self.definitions[f"{scope}/{name}"] = self._fold([b for _, b in bodies], choice if how == "choice" else interleave)
        if "" not in found:
            raise XdmError("rng", "a grammar needs a start")
        return ("ref", f"{scope}/")


def _takes(names, uri: str, local: str) -> bool:
    """Whether a name class has a name."""
    if names[0] == "name":
        return names[1:] == (uri, local)
    if names[0] == "choice":
        return _takes(names[1], uri, local) or _takes(names[2], uri, local)
    if names[0] == "ns" and names[1] != uri:
        return False
    return names[-1] is None or not _takes(names[-1], uri, local)


def _samples(names) -> set[tuple[str, str]]:
    """Names that tell whether a name class has one in common with another: those it mentions, and one of each kind it does not."""
    if names is None:
        return set()
    if names[0] == "name":
        return {names[1:]}
    if names[0] == "choice":
        return _samples(names[1]) | _samples(names[2])
    return {(names[1], "\0")} | _samples(names[2]) if names[0] == "ns" else {("\0", "\0")} | _samples(names[1])


def _overlap(a, b) -> bool:
    return any(_takes(a, *n) and _takes(b, *n) for n in _samples(a) | _samples(b))


class _Restrictions:
    """The restrictions on schemas: where patterns may stand, string sequences, attributes and interleaved names."""

    #: Patterns that may not stand inside what the context names.
    _BANNED = {
        "attribute": {"attribute", "element"}, "list": {"list", "element", "attribute", "text", "interleave"},
        "except": {"element", "attribute", "list", "text", "group", "interleave", "oneOrMore", "empty"},
        "start": {"attribute", "data", "value", "list", "text", "empty", "group", "interleave", "oneOrMore"}, "repeated group": {"attribute"},
    }

    def __init__(self, definitions: dict[str, tuple]) -> None:
        self.definitions, self.done = definitions, set()

    def check(self, start: tuple) -> None:
        self.walk(start, frozenset({"start"}), ())

    def definition(self, name: str, stack: tuple) -> tuple:
        if name in stack:
            raise XdmError("rng", f"{name.partition('/')[2]} refers to itself outside an element")
        if name not in self.definitions:
            raise XdmError("rng", f"{name.partition('/')[2]} is not defined")
        return self.definitions[name]

    def walk(self, p: tuple, context: frozenset, stack: tuple) -> None:
        kind = p[0]
        for place in context:
            if kind in self._BANNED.get(place, ()):
                raise XdmError("rng", f"{kind} inside {place}")
        if kind == "ref":
            self.walk(self.definition(p[1], stack), context, (*stack, p[1]))
        elif kind == "element":
            if p not in self.done:
                self.done.add(p)
                self.walk(p[2], frozenset(), ())
                self.content(p[2], ())
        elif kind == "attribute":
            if p[1][0] in ("any", "ns") and "repeated" not in context:
                raise XdmError("rng", "an attribute of any name must be repeated")
            self.walk(p[2], frozenset({"attribute"}), stack)
        elif kind == "data" and p[3] is not None:
            self.walk(p[3], frozenset({"except"}), stack)
        elif kind == "list":
            self.walk(p[1], context | {"list"}, stack)
        elif kind == "oneOrMore":
            self.walk(p[1], context | {"repeated"}, stack)
        elif kind in ("group", "interleave"):
            inner = context | {"repeated group"} if "repeated" in context else context
            self.walk(p[1], inner, stack)
            self.walk(p[2], inner, stack)
            self.apart(p, stack)
        elif kind == "choice":
            self.walk(p[1], context, stack)
            self.walk(p[2], context, stack)

    def parts(self, p: tuple, kind: str, stack: tuple = ()) -> list[tuple]:
        """The patterns of a kind in p, elements and attributes not entered."""
        if p[0] == kind:
            return [p]
        if p[0] == "ref":
            return self.parts(self.definition(p[1], stack), kind, (*stack, p[1]))
        if p[0] in ("group", "interleave", "choice", "oneOrMore"):
            return [x for c in p[1:] for x in self.parts(c, kind, stack)]
        return []

    def apart(self, p: tuple, stack: tuple) -> None:
        """Attributes of both sides have no name in common; of interleaved sides neither have elements, and one has text at most."""
        for kind in ("attribute", "element") if p[0] == "interleave" else ("attribute",):
            for a in self.parts(p[1], kind, stack):
                for b in self.parts(p[2], kind, stack):
                    if _overlap(a[1], b[1]):
                        raise XdmError("rng", f"two {kind}s of one name in a {p[0]}")
        if p[0] == "interleave" and self.parts(p[1], "text", stack) and self.parts(p[2], "text", stack):
            raise XdmError("rng", "text on both sides of an interleave")

    def content(self, p: tuple, stack: tuple) -> int:
        """0 empty, 1 elements and text, 2 a string with a type, which stands alone."""
        if p[0] in ("empty", "notAllowed", "attribute"):
            return 0
        if p[0] in ("text", "element"):
            return 1
        if p[0] in ("data", "value", "list"):
            return 2
        if p[0] == "ref":
            return self.content(self.definition(p[1], stack), (*stack, p[1]))
        kinds = [self.content(c, stack) for c in p[1:]]
        if p[0] == "oneOrMore":
            kinds *= 2
        if p[0] != "choice" and 2 in kinds and sorted(kinds)[-2] > 0:
            raise XdmError("rng", "a string with a type beside other content")
        return max(kinds)


_KINDS = {"string": None, "token": None}


def _datatype(kind: str, text: str, params: tuple) -> bool:
    """Whether a string is in a datatype with parameters (Python side, for the fold)."""
    from decimal import Decimal

    from arborist.functions.casts import INTEGERS, PATTERNS, STRINGS

    value = " ".join(text.split()) if kind != "string" else text
    if kind in INTEGERS:
        low, high = INTEGERS[kind]
        if not re.fullmatch(r"[+-]?\d+", value) or (low is not None and int(value) < low) or (high is not None and int(value) > high):
            return False
    elif kind == "decimal" and not re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)", value):
        return False
    elif kind in ("double", "float") and not re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|-?INF|NaN", value):
        return False
    elif kind == "boolean" and value not in ("true", "false", "1", "0"):
        return False
    elif kind == "date" and not re.fullmatch(r"-?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(Z|[+-]\d\d:\d\d)?", value):
        return False
    else:
        found = PATTERNS.get(kind) or (STRINGS[kind][1] if kind in STRINGS else None)
        if found:
            import regex as full

            if not full.search(found, value):
                return False
    for name, bound in params:
        size = {"length": len(value) == int(bound) if name == "length" else True, "minLength": name != "minLength" or len(value) >= int(bound), "maxLength": name != "maxLength" or len(value) <= int(bound)}
        if not all(size.values()):
            return False
        if name == "pattern" and not re.fullmatch(bound, value):
            return False
        if name.startswith(("min", "max")) and name.endswith("clusive"):
            a, b = Decimal(value), Decimal(bound)
            if not {"minInclusive": a >= b, "maxInclusive": a <= b, "minExclusive": a > b, "maxExclusive": a < b}[name]:
                return False
    return True


def _in_class(c, uri: str, local: str) -> bool:
    if c[0] == "name":
        return c[1:] == (uri, local)
    if c[0] == "choice":
        return _in_class(c[1], uri, local) or _in_class(c[2], uri, local)
    if c[0] == "any":
        return c[1] is None or not _in_class(c[1], uri, local)
    return c[1] == uri and (c[2] is None or not _in_class(c[2], uri, local))


class Derivatives:
    """Derivatives of a grammar's patterns, memoised."""

    def __init__(self, grammar: Grammar) -> None:
        self.definitions = grammar.definitions
        self.start = grammar.start
        for name in ("nullable", "open", "attribute", "close", "end"):
            setattr(self, name, lru_cache(100_000)(getattr(self, "_" + name)))

    def _nullable(self, p) -> bool:
        k = p[0]
        if k in ("empty", "text"):
            return True
        if k == "choice":
            return self.nullable(p[1]) or self.nullable(p[2])
        if k in ("group", "interleave"):
            return self.nullable(p[1]) and self.nullable(p[2])
        if k == "oneOrMore":
            return self.nullable(p[1])
        return self.nullable(self.definitions[p[1]]) if k == "ref" else False

    def _map_after(self, p, f):
        if p[0] == "after":
            return after(p[1], f(p[2]))
        return choice(self._map_after(p[1], f), self._map_after(p[2], f)) if p[0] == "choice" else NOT_ALLOWED

    def _open(self, p, uri: str, local: str):
        """Derivative by a start tag's name."""
        k = p[0]
        if k == "ref":
            return self.open(self.definitions[p[1]], uri, local)
        if k == "choice":
            return choice(self.open(p[1], uri, local), self.open(p[2], uri, local))
        if k == "element":
            return after(p[2], EMPTY) if _in_class(p[1], uri, local) else NOT_ALLOWED
        if k == "interleave":
            a, b = p[1:]
            return choice(self._map_after(self.open(a, uri, local), lambda x: interleave(x, b)), self._map_after(self.open(b, uri, local), lambda x: interleave(a, x)))
        if k == "oneOrMore":
            return self._map_after(self.open(p[1], uri, local), lambda x: group(x, choice(p, EMPTY)))
        if k == "group":
            a, b = p[1:]
            x = self._map_after(self.open(a, uri, local), lambda y: group(y, b))
            return choice(x, self.open(b, uri, local)) if self.nullable(a) else x
        if k == "after":
            return self._map_after(self.open(p[1], uri, local), lambda x: after(x, p[2]))
        return NOT_ALLOWED

    def _attribute(self, p, uri: str, local: str, value: str):
        k = p[0]
        if k == "ref":
            return self.attribute(self.definitions[p[1]], uri, local, value)
        go = lambda x: self.attribute(x, uri, local, value)
        if k == "after":
            return after(go(p[1]), p[2])
        if k == "choice":
            return choice(go(p[1]), go(p[2]))
        if k == "group":
            return choice(group(go(p[1]), p[2]), group(p[1], go(p[2])))
        if k == "interleave":
            return choice(interleave(go(p[1]), p[2]), interleave(p[1], go(p[2])))
        if k == "oneOrMore":
            return group(go(p[1]), choice(p, EMPTY))
        if k == "attribute" and _in_class(p[1], uri, local):
            ok = (self.nullable(p[2]) and not value.strip()) or self.nullable(self.text(p[2], value))
            return EMPTY if ok else NOT_ALLOWED
        return NOT_ALLOWED

    def _close(self, p):
        """No more attributes: those that are still asked for fail."""
        k = p[0]
        if k == "ref":
            return self.close(self.definitions[p[1]]) if not self._plain(p) else p
        if k == "after":
            return after(self.close(p[1]), p[2])
        if k in ("choice", "group", "interleave"):
            return {"choice": choice, "group": group, "interleave": interleave}[k](self.close(p[1]), self.close(p[2]))
        if k == "oneOrMore":
            return one_or_more(self.close(p[1]))
        return NOT_ALLOWED if k == "attribute" else p

    def _plain(self, p) -> bool:
        return self.definitions[p[1]][0] == "element"

    def text(self, p, text: str):
        k = p[0]
        if k == "ref":
            return self.text(self.definitions[p[1]], text)
        if k == "text":
            return p
        if k == "choice":
            return choice(self.text(p[1], text), self.text(p[2], text))
        if k == "interleave":
            return choice(interleave(self.text(p[1], text), p[2]), interleave(p[1], self.text(p[2], text)))
        if k == "group":
            x = group(self.text(p[1], text), p[2])
            return choice(x, self.text(p[2], text)) if self.nullable(p[1]) else x
        if k == "after":
            return after(self.text(p[1], text), p[2])
        if k == "oneOrMore":
            return group(self.text(p[1], text), choice(p, EMPTY))
        if k == "value":
            same = p[2] == text if p[1] == "string" else p[2].split() == text.split()
            return EMPTY if same else NOT_ALLOWED
        if k == "data":
            ok = _datatype(p[1], text, p[2]) and not (p[3] is not None and self.nullable(self.text(p[3], text)))
            return EMPTY if ok else NOT_ALLOWED
        if k == "list":
            q = p[1]
            for word in text.split():
                q = self.text(q, word)
            return EMPTY if self.nullable(q) else NOT_ALLOWED
        return NOT_ALLOWED

    def _end(self, p):
        if p[0] == "choice":
            return choice(self.end(p[1]), self.end(p[2]))
        return p[2] if p[0] == "after" and self.nullable(p[1]) else NOT_ALLOWED

    def element(self, p, e: ET.Element, path: str):
        """(derivative by an element, path of the first error)."""
        uri, _, local = e.tag[1:].rpartition("}") if e.tag[0] == "{" else ("", "", e.tag)
        here = f"{path}/{local}"
        q = self.open(p, uri, local)
        if q == NOT_ALLOWED:
            return q, here
        for name, value in e.attrib.items():
            u, _, n = name[1:].rpartition("}") if name[0] == "{" else ("", "", name)
            q = self.attribute(q, u, n, value)
            if q == NOT_ALLOWED:
                return q, f"{here}/@{n}"
        q = self.close(q)
        if q == NOT_ALLOWED:
            return q, here
        children = [c for c in e if isinstance(c.tag, str)]
        runs = [e.text or "", *[c.tail or "" for c in children]]
        if not children:
            x = self.text(q, runs[0])
            q = choice(q, x) if not runs[0].strip() else x
        for k, c in enumerate(children):
            if runs[k].strip():
                q = self.text(q, runs[k])
            q, bad = self.element(q, c, here)
            if q == NOT_ALLOWED:
                return q, bad
        if children and runs[-1].strip():
            q = self.text(q, runs[-1])
        return self.end(q), here


def validate(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """(doc_id, path, message) of the first violation of every document that is not valid."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Derivatives(shared.value)
        for batch in batches:
            out = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    p, path = d.element(d.start, ET.fromstring(text), "")
                    if not d.nullable(p):
                        out.append((key, path, "not allowed here, or incomplete"))
                except ET.ParseError as e:
                    out.append((key, "", f"not well-formed: {e}"))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "path", "message"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(xml_col).cast("string")).mapInArrow(run, "doc_id bigint, path string, message string")
