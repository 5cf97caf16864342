"""Schema components on the driver, and content models as regular expressions over child symbols."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborist.functions import casts, dates, regex
from arborist.xdm import XdmError

#: Occurrence bounds beyond this are not spelt out in a pattern.
UNBOUNDED = None


@dataclass
class Simple:
    """A simple type: a base (built-in name or another type), facets, or a list or union of types."""

    name: str | None = None
    base: Simple | str = "string"
    facets: list[tuple[str, str]] = field(default_factory=list)
    item: Simple | None = None
    members: list[Simple] | None = None

    def primitive(self) -> str:
        """The built-in type below, or list or union."""
        if self.item is not None:
            return "list"
        if self.members is not None:
            return "union"
        return self.base.primitive() if isinstance(self.base, Simple) else self.base

    def whitespace(self) -> str:
        for name, value in reversed(self.facets):
            if name == "whiteSpace":
                return value
        if self.item is not None:
            return "collapse"
        if isinstance(self.base, Simple):
            return self.base.whitespace()
        return casts.STRINGS[self.base][0] if self.base in casts.STRINGS else "collapse"


#: Facets that a primitive does not have.
_ORDERED = {"decimal", "float", "double", "date", "dateTime", "time", "duration", "yearMonthDuration", "dayTimeDuration", *casts.INTEGERS}


def check_facets(t: Simple) -> None:
    """Raises where a facet does not apply to its primitive, or bounds contradict each other."""
    kind = t.primitive()
    for name, value in t.facets:
        if name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive") and kind not in _ORDERED:
            raise XdmError("cos-applicable-facets", f"{name} of {kind}")
        if name in ("totalDigits", "fractionDigits") and kind not in ("decimal", *casts.INTEGERS):
            raise XdmError("cos-applicable-facets", f"{name} of {kind}")
        if name in ("length", "minLength", "maxLength") and kind in (_ORDERED | {"boolean"}):
            raise XdmError("cos-applicable-facets", f"{name} of {kind}")
        if name == "pattern":
            regex.java_pattern(value, schema=True)
    _narrows(t, kind)
    bounds = dict(t.facets)
    if "minLength" in bounds and "maxLength" in bounds and int(bounds["minLength"]) > int(bounds["maxLength"]):
        raise XdmError("minLength-less-than-equal-to-maxLength", str(t.name))


#: Facets whose value may only grow, or only fall, in a derived type.
_GROW, _FALL = ("minLength", "minInclusive", "minExclusive"), ("maxLength", "maxInclusive", "maxExclusive", "totalDigits", "fractionDigits")


def _narrows(t: Simple, kind: str) -> None:
    """Raises where a facet allows what the base type's does not (bounds of numbers, and lengths)."""
    base = t.base
    inherited: dict[str, str] = {}
    while isinstance(base, Simple):
        for name, value in base.facets:
            inherited.setdefault(name, value)
        base = base.base
    numbers = kind in ("decimal", *casts.INTEGERS)
    for name, value in t.facets:
        old = inherited.get(name)
        if old is None or (name[3:] in ("Inclusive", "Exclusive") and not numbers):
            continue
        if (name in _GROW and Decimal(value) < Decimal(old)) or (name in _FALL and Decimal(value) > Decimal(old)) or (name == "length" and value != old):
            raise XdmError(f"{name}-valid-restriction", f"{name} {value} of {t.name}, where the base type has {old}")


def _ordered(c: Column, kind: str) -> Column:
    """A value as something that compares like the value space."""
    v = casts.cast(c, kind)
    return dates.instant(v) if kind in ("date", "dateTime", "time") else v


def _moments(a: Column, b: Column, facet: str) -> Column:
    """Whether a moment keeps a bound; one with and one without a time zone compare only where 14 hours do not matter."""
    x, y = dates.instant(a), dates.instant(b)
    apart = F.when(a["tz"].isNull() == b["tz"].isNull(), F.lit(0)).otherwise(14 * 3600 * dates.SECOND)
    sure = apart == 0
    return {
        "minInclusive": F.when(sure, x >= y).otherwise(x > y + apart), "maxInclusive": F.when(sure, x <= y).otherwise(x < y - apart),
        "minExclusive": x > y + apart, "maxExclusive": x < y - apart,
    }[facet]


def valid(c: Column, t: Simple) -> Column:
    """Whether a string is in a simple type, as a codegen predicate; null counts as invalid."""
    return F.coalesce(_valid(c, t), F.lit(False))


def _valid(c: Column, t: Simple) -> Column:
    if t.members is not None:
        ok = F.lit(False)
        for m in t.members:
            ok = ok | valid(c, m)
        return ok & _facets(casts.whitespace(c, "collapse"), t, None)
    if t.item is not None:
        words = F.filter(F.split(casts.whitespace(c, "collapse"), " "), lambda w: w != "")
        return F.forall(words, lambda w: valid(w, t.item)) & _facets(casts.whitespace(c, "collapse"), t, words)
    v = casts.whitespace(c, t.whitespace())
    base = _valid(c, t.base) if isinstance(t.base, Simple) else (casts.cast(v, t.base).isNotNull() if t.base not in ("string", "anySimpleType", "anyAtomicType", "error") else F.lit(t.base != "error"))
    return base & _facets(v, t, None)


def _facets(v: Column, t: Simple, words: Column | None) -> Column:
    kind = t.primitive()
    ok = F.lit(True)
    octets = {"hexBinary": F.char_length(v) / 2, "base64Binary": F.octet_length(F.try_to_binary(v, F.lit("base64")))} if kind in ("hexBinary", "base64Binary") else {}
    size = F.size(words) if words is not None else octets.get(kind, F.char_length(v))
    patterns = [value for name, value in t.facets if name == "pattern"]
    if patterns:  # of one step: any of them
        some = F.lit(False)
        for p in patterns:
            some = some | regex.facet(v, p)
        ok = ok & some
    values = [value for name, value in t.facets if name == "enumeration"]
    if values:
        if kind in ("string", "list", "union") or kind in casts.STRINGS or kind not in _ORDERED:
            ok = ok & v.isin(values)
        else:
            same = F.lit(False)
            for x in values:
                same = same | (_ordered(v, kind) == _ordered(F.lit(x), kind))
            ok = ok & same
    for name, value in t.facets:
        if name == "length":
            ok = ok & (size == int(value))
        elif name == "minLength":
            ok = ok & (size >= int(value))
        elif name == "maxLength":
            ok = ok & (size <= int(value))
        elif name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
            if kind in ("date", "dateTime", "time"):
                ok = ok & _moments(casts.cast(v, kind), casts.cast(F.lit(value), kind), name)
                continue
            a, b = _ordered(v, kind), _ordered(F.lit(value), kind)
            ok = ok & {"minInclusive": a >= b, "maxInclusive": a <= b, "minExclusive": a > b, "maxExclusive": a < b}[name]
        elif name == "totalDigits":
            digits = F.regexp_replace(F.regexp_replace(v, r"^[+-]?0*|(\.[0-9]*?)0*$", "$1"), r"[.]", "")
            ok = ok & (F.char_length(digits) <= int(value))
        elif name == "fractionDigits":
            ok = ok & (F.char_length(F.rtrim(F.regexp_extract(v, r"\.([0-9]*)", 1), F.lit("0"))) <= int(value))
        elif name == "explicitTimezone":
            zoned = F.rlike(v, F.lit(r"(Z|[+-][0-9]{2}:[0-9]{2})$"))
            ok = ok & (zoned if value == "required" else ~zoned if value == "prohibited" else F.lit(True))
    return ok


# content models


@dataclass
class Particle:
    """sequence, choice, all, element or any, with occurrence bounds (None: unbounded)."""

    kind: str
    least: int = 1
    most: int | None = 1
    children: list[Particle] = field(default_factory=list)
    name: tuple[str, str] | None = None
    names: list[tuple[str, str]] = field(default_factory=list)  # an element and those that may stand for it
    wildcard: tuple[str, str] = ("##any", "strict")
    target: str = ""  # of the schema document, for ##other and ##targetNamespace
    without: tuple = ()  # namespaces and names that a wildcard does not take


class Symbols:
    """A private character for every element name of a schema, and for the other names of each namespace that wildcards name."""

    OTHER = chr(0xF8FF)

    def __init__(self) -> None:
        self.of: dict[tuple[str, str], str] = {}
        self.spaces: dict[str, str] = {}

    def space(self, uri: str) -> str:
        """The symbol of the names of a namespace that the schema does not mention."""
        return self.spaces.setdefault(uri, chr(0xF8FE - len(self.spaces)))

    def get(self, name: tuple[str, str]) -> str:
        return self.of.setdefault(name, chr(0xE000 + len(self.of)))

    def column(self, uri: str = "uri", local: str = "local") -> Column:
        """The symbol of a node's name."""
        col = F.lit(self.OTHER)
        if not self.of:
            return col
        names = F.create_map(*[F.lit(x) for (u, n), s in self.of.items() for x in (f"{{{u}}}{n}", s)])
        if self.spaces:
            spaces = F.create_map(*[F.lit(x) for pair in self.spaces.items() for x in pair])
            col = F.coalesce(F.try_element_at(spaces, F.coalesce(F.col(uri), F.lit(""))), col)
        return F.coalesce(F.try_element_at(names, F.concat(F.lit("{"), F.coalesce(F.col(uri), F.lit("")), F.lit("}"), F.col(local))), col)


def pattern(p: Particle, symbols: Symbols, target: str = "") -> str:
    """A content model as a pattern over symbols."""
    return _times(_body(p, symbols, target), p.least, p.most)


def _times(body: str, least: int, most: int | None) -> str:
    if (least, most) == (1, 1):
        return body
    if most == 0:
        return ""
    return f"(?:{body}){{{least},{'' if most is None else most}}}"


def _body(p: Particle, symbols: Symbols, target: str) -> str:
    if p.kind == "element":
        chars = [symbols.get(n) for n in (p.names or [p.name])]
        return chars[0] if len(chars) == 1 else f"[{''.join(chars)}]"
    if p.kind == "any":
        return _wildcard(p, symbols, target)
    parts = [pattern(c, symbols, target) for c in p.children]
    if p.kind == "choice":
        return f"(?:{'|'.join(parts)})" if parts else "(?!)"
    return f"(?:{''.join(parts)})"


def namespace_fits(uri: str, p: Particle) -> bool:
    """Whether a wildcard takes names of a namespace."""
    if uri in {"" if x == "##local" else p.target if x == "##targetNamespace" else x for x in p.without if isinstance(x, str)}:
        return False
    allowed = p.wildcard[0]
    if allowed == "##any":
        return True
    if allowed == "##other":
        return uri not in ("", p.target)
    return uri in {"" if x == "##local" else p.target if x == "##targetNamespace" else x for x in allowed.split()}


def wildcard_symbols(p: Particle, symbols: Symbols) -> str:
    """The symbols of all names that a wildcard takes."""
    chars = "".join(s for name, s in symbols.of.items() if namespace_fits(name[0], p) and name not in p.without)
    chars += "".join(s for uri, s in symbols.spaces.items() if namespace_fits(uri, p))
    return chars + (Symbols.OTHER if p.wildcard[0] in ("##any", "##other") else "")


def _wildcard(p: Particle, symbols: Symbols, target: str) -> str:
    chars = wildcard_symbols(p, symbols)
    return f"[{chars}]" if chars else "(?!)"


# derivation by restriction


def _term(p: Particle, symbols: Symbols):
    """A content model as a term: a set of symbols, ("seq", ...), ("alt", ...) or ("times", term, least, most)."""
    if p.kind in ("element", "any"):
        body = frozenset(wildcard_symbols(p, symbols) if p.kind == "any" else (symbols.get(n) for n in (p.names or [p.name])))
    elif p.kind == "choice":
        body = _alt([_term(c, symbols) for c in p.children])
    else:
        body = _seq([_term(c, symbols) for c in p.children])
    return _repeated(body, p.least, p.most)


def _seq(parts):
    flat = [y for x in parts for y in (x[1:] if isinstance(x, tuple) and x[0] == "seq" else (x,))]
    if any(x == frozenset() for x in flat):
        return frozenset()
    return flat[0] if len(flat) == 1 else ("seq", *flat)


def _alt(parts):
    flat = {y for x in parts for y in (x[1:] if isinstance(x, tuple) and x[0] == "alt" else (x,)) if y != frozenset()}
    if not flat:
        return frozenset()
    return next(iter(flat)) if len(flat) == 1 else ("alt", *sorted(flat, key=repr))


def _repeated(x, least: int, most: int | None):
    if most == 0:
        return ("seq",)
    return x if (least, most) == (1, 1) else ("times", x, least, most)


def _nullable(x) -> bool:
    if isinstance(x, frozenset):
        return False
    if x[0] == "seq":
        return all(map(_nullable, x[1:]))
    if x[0] == "alt":
        return any(map(_nullable, x[1:]))
    return x[2] == 0 or _nullable(x[1])


def _after(x, symbol: str):
    """What may follow a symbol at the start of a term."""
    if isinstance(x, frozenset):
        return ("seq",) if symbol in x else frozenset()
    if x[0] == "alt":
        return _alt([_after(y, symbol) for y in x[1:]])
    if x[0] == "times":
        return _seq([_after(x[1], symbol), _repeated(x[1], max(x[2] - 1, 0), None if x[3] is None else x[3] - 1)])
    out = []
    for k, y in enumerate(x[1:], 1):
        out.append(_seq([_after(y, symbol), *x[k + 1 :]]))
        if not _nullable(y):
            break
    return _alt(out)


def _symbols_of(x) -> frozenset:
    return x if isinstance(x, frozenset) else frozenset().union(*(_symbols_of(y) for y in (x[1:2] if x[0] == "times" else x[1:])))


def included(a: Particle, b: Particle, symbols: Symbols, most: int = 5000) -> bool:
    """Whether every word of one model is a word of another; models of over `most` pairs of states, and xs:all, count as such."""
    if any(k.kind == "all" for k in (a, b)):
        return True
    start = (_term(a, symbols), _term(b, symbols))
    seen, todo = {start}, [start]
    letters = _symbols_of(start[0])
    while todo and len(seen) <= most:
        x, y = todo.pop()
        if _nullable(x) and not _nullable(y):
            return False
        for s in letters:
            nx = _after(x, s)
            if nx == frozenset():
                continue
            ny = _after(y, s)
            if ny == frozenset():
                return False
            if (nx, ny) not in seen:
                seen.add((nx, ny))
                todo.append((nx, ny))
    return True


def prefixes(p: Particle, symbols: Symbols, target: str = "") -> str:
    """A pattern of all beginnings of a content model's words."""
    body = _prefix_body(p, symbols, target)
    if p.most == 1:
        return f"(?:{body})?"
    full = _body(p, symbols, target)
    return f"(?:{full}){{0,{'' if p.most is None else max(p.most - 1, 0)}}}(?:{body})?"


def _prefix_body(p: Particle, symbols: Symbols, target: str) -> str:
    if p.kind in ("element", "any"):
        return _body(p, symbols, target)
    if p.kind == "choice":
        return "|".join(prefixes(c, symbols, target) for c in p.children) or "(?!)"
    out, before = [], ""
    for c in p.children:
        out.append(before + prefixes(c, symbols, target))
        before += pattern(c, symbols, target)
    return "|".join(out)


def all_ok(s: Column, p: Particle, symbols: Symbols) -> tuple[Column, Column]:
    """(no child too many or unknown, no child missing) of an xs:all group over the symbols of the children."""
    known, fits, full = [], F.lit(True), F.lit(True)
    for c in p.children:
        chars = list(wildcard_symbols(c, symbols)) if c.kind == "any" else [symbols.get(n) for n in (c.names or [c.name])]
        known += chars
        n = F.char_length(s) - F.char_length(F.translate(s, "".join(chars), ""))
        if c.most is not None:
            fits = fits & (n <= c.most)
        full = full & (n >= c.least)
    fits = fits & (F.translate(s, "".join(known), "") == "") if known else fits & (s == "")
    return fits, full | (F.lit(p.least == 0) & (s == ""))


def first_ambiguity(p: Particle) -> str | None:
    """Unique particle attribution: a name that two different particles compete for, by first and follow sets; None if there is none."""
    ids: list[Particle] = []

    def walk(q: Particle):
        """(nullable, first, last) positions, collecting follow pairs."""
        if q.most == 0:
            return True, set(), set()
        if q.kind in ("element", "any"):
            ids.append(q)
            k = len(ids) - 1
            nullable, first, last = False, {k}, {k}
        elif q.kind == "choice":
            nullable, first, last = not q.children, set(), set()
            for c in q.children:
                n, f, z = walk(c)
                nullable, first, last = nullable or n, first | f, last | z
        else:
            nullable, first, last = True, set(), set()
            for c in q.children:
                n, f, z = walk(c)
                for x in last:
                    follow.setdefault(x, set()).update(f)
                first = first | f if nullable else first
                last = last | z if n else z
                nullable = nullable and n
            if q.kind == "all":
                first = set(range(len(ids)))
        if q.most is None or q.most > 1:
            for x in last:
                follow.setdefault(x, set()).update(first)
        return nullable or q.least == 0, first, last

    follow: dict[int, set[int]] = {}
    _, start, _ = walk(p)
    for group in (start, *follow.values()):
        names: dict = {}
        for k in sorted(group):
            for name in ids[k].names or [ids[k].name] if ids[k].kind == "element" else ["##any"]:
                if name in names and names[name] != k:
                    return str(name)
                names[name] = k
    return None
