"""Typed columns, conversions between their types, and the scalar function library by name and arity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborist.functions import casts, dates, numeric, regex, strings
from arborist.xdm import XdmError


@dataclass(frozen=True)
class Val:
    """A column and its atomic type; lit is the value of a literal."""

    col: Column
    type: str
    lit: object = None


NUMERIC = ("integer", "decimal", "float", "double")
_MOMENTS = ("date", "dateTime", "time")
_TEXT = ("string", "untyped", "anyURI", "untypedAtomic")


def numeric_type(kind: str) -> str:
    """The type in which a value takes part in arithmetic."""
    if kind in NUMERIC:
        return kind
    if kind in ("untyped", "untypedAtomic", "empty"):
        return "double"
    if kind in casts.INTEGERS:
        return "integer"
    raise XdmError("XPTY0004", f"{kind} is no number")


# The type that each built-in type is derived from.
_DERIVED = {
    "byte": "short", "short": "int", "int": "long", "long": "integer", "unsignedByte": "unsignedShort", "unsignedShort": "unsignedInt",
    "unsignedInt": "unsignedLong", "unsignedLong": "nonNegativeInteger", "positiveInteger": "nonNegativeInteger", "nonNegativeInteger": "integer",
    "negativeInteger": "nonPositiveInteger", "nonPositiveInteger": "integer", "integer": "decimal", "yearMonthDuration": "duration",
    "dayTimeDuration": "duration", "dateTimeStamp": "dateTime", "ID": "NCName", "IDREF": "NCName", "ENTITY": "NCName", "NCName": "Name", "Name": "token",
    "NMTOKEN": "token", "language": "token", "token": "normalizedString", "normalizedString": "string",
}


def derives(kind: str, wanted: str) -> bool:
    """Whether a type is another one or derived from it."""
    kind = {"untyped": "untypedAtomic"}.get(kind, kind)
    if wanted in (kind, "anyAtomicType"):
        return True
    return kind in _DERIVED and derives(_DERIVED[kind], wanted)


def convert(v: Val, kind: str, castable: bool = False) -> Val:
    """A value in another type; null where it cannot be cast (casts that must not fail check for that)."""
    kind = {"untypedAtomic": "untyped", "anyURI": "anyURI"}.get(kind, kind)
    if v.type == kind:
        return v
    if kind == "mixed":
        return mixed(v)
    if v.type == "mixed":
        if kind in ("string", "untyped", "anyURI"):
            return Val(v.col["s"], kind)
        if kind in NUMERIC:
            return convert(Val(F.coalesce(v.col["n"], casts.cast(v.col["s"], "double")), "double"), kind)
        return convert(Val(v.col["s"], "untyped"), kind, castable)
    if v.type == "empty":
        return Val(F.lit(None).cast(_SPARK.get(kind, "string")), kind)
    if kind in ("string", "untyped", "anyURI"):
        return Val(as_string(v), kind)
    if v.type in _TEXT:
        return Val(casts.cast(v.col, kind), kind if kind not in casts.INTEGERS else "integer")
    if kind in NUMERIC and v.type in (*NUMERIC, "boolean"):
        if kind == "integer" and v.type in ("double", "float"):
            whole = F.when(F.isnan(v.col) | (F.abs(v.col) == float("inf")), None).otherwise(v.col)
            return Val(whole.cast("bigint"), kind)
        if kind == "decimal":
            bad = F.isnan(v.col) | (F.abs(v.col) == float("inf")) if v.type in ("double", "float") else F.lit(False)
            return Val(F.when(~bad, v.col).cast("int").cast("decimal(38,18)") if v.type == "boolean" else F.when(~bad, v.col).cast("decimal(38,18)"), kind)
        return Val((v.col.cast("int") if v.type == "boolean" else v.col).cast(_SPARK[kind]), kind)
    if kind == "boolean" and v.type in NUMERIC:
        return Val(~((v.col == 0) | (F.isnan(v.col) if v.type == "double" else F.lit(False))), kind)
    if kind in casts.INTEGERS and v.type in (*NUMERIC, "boolean"):
        low, high = casts.INTEGERS[kind]
        n = convert(v, "integer").col
        ok = F.lit(True)
        if low is not None:
            ok = ok & (n >= F.lit(low).cast("decimal(38,0)"))
        if high is not None:
            ok = ok & (n <= F.lit(high).cast("decimal(38,0)"))
        return Val(F.when(ok, n), "integer")
    if v.type == "dateTime" and kind in ("date", "time"):
        day = v.col["micros"] - F.pmod(v.col["micros"], F.lit(dates.DAY))
        return Val(dates.moment(day if kind == "date" else F.pmod(v.col["micros"], F.lit(dates.DAY)), v.col["tz"]), kind)
    if v.type == "date" and kind == "dateTime":
        return Val(v.col, kind)
    if castable:
        raise XdmError("XPTY0004", f"{v.type} cannot be cast to {kind}")
    raise XdmError("XPTY0004", f"{v.type} is not {kind}")


#: The kinds of values in sequences of several types: numbers, text, truth values, moments and durations.
_CLASSES = {"boolean": "b", "date": "d", "dateTime": "D", "time": "T", "yearMonthDuration": "Y", "dayTimeDuration": "S", "QName": "q"}


def mixed(v: Val) -> Val:
    """A value as one of a sequence of several types: its kind, its text, and its number if it is one."""
    if v.type == "mixed":
        return v
    number = v.type in NUMERIC
    text = as_string(convert(v, "double")) if number else as_string(v)
    kind = F.lit("n" if number else _CLASSES.get(v.type, "t"))
    made = F.struct(kind.alias("k"), text.alias("s"), (convert(v, "double").col if number else F.lit(None).cast("double")).alias("n"))
    return Val(F.when(v.col.isNotNull(), made), "mixed")


def qname(uri: Column, name: Column) -> Val:
    """A qualified name of a namespace and prefix:local."""
    parted = F.struct(uri.alias("uri"), F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1)).otherwise("").alias("prefix"), F.substring_index(name, ":", -1).alias("local"))
    return Val(F.when(name.isNotNull(), parted), "QName")


_SPARK = {"integer": "bigint", "decimal": "decimal(38,18)", "double": "double", "float": "float", "boolean": "boolean", "string": "string"}


def as_string(v: Val) -> Column:
    if v.type in _TEXT or v.type == "array":
        return v.col
    if v.type == "mixed":
        return v.col["s"]
    if v.type == "QName":
        return F.when(v.col["prefix"] == "", v.col["local"]).otherwise(F.concat(v.col["prefix"], F.lit(":"), v.col["local"]))
    if v.type in _MOMENTS:
        return dates.canonical(v.col, v.type)
    if v.type == "double":
        return numeric.double_text(v.col)
    if v.type == "decimal":
        text = v.col.cast("decimal(38,18)").cast("string")
        return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return v.col.cast("string")


def promote(a: Val, b: Val) -> tuple[Val, Val]:
    """Two values in their least common type."""
    if a.type == b.type:
        return a, b
    if a.type == "empty":
        return convert(a, b.type), b
    if b.type == "empty":
        return a, convert(b, a.type)
    if a.type in NUMERIC and b.type in NUMERIC:
        kind = NUMERIC[max(NUMERIC.index(a.type), NUMERIC.index(b.type))]
        return convert(a, kind), convert(b, kind)
    if a.type in _TEXT and b.type in _TEXT:
        return Val(a.col, "string"), Val(b.col, "string")
    raise XdmError("XPTY0004", f"{a.type} and {b.type} have no common type")


def compare(op: str, a: Val, b: Val, general: bool) -> Column:
    """A comparison of two items; general ones cast untyped values to the other side's type, value ones to string."""
    if "empty" in (a.type, b.type):
        return F.lit(None).cast("boolean")
    if a.type == "QName" and b.type == "QName":
        if op not in ("=", "!="):
            raise XdmError("XPTY0004", "qualified names have no order")
        same = (a.col["uri"] == b.col["uri"]) & (a.col["local"] == b.col["local"])
        return same if op == "=" else ~same
    if "mixed" in (a.type, b.type):
        x, y = mixed(a).col, mixed(b).col
        made = F.when(x["k"] == "n", compare(op, Val(x["n"], "double"), Val(y["n"], "double"), general)).otherwise(
            compare(op, Val(x["s"], "string"), Val(y["s"], "string"), general)
        )
        return F.when(x["k"] == y["k"], made).otherwise(F.raise_error(F.lit("XPTY0004: values do not compare")).cast("boolean"))
    if a.type == b.type == "untyped" or not general:
        a, b = (Val(v.col, "string") if v.type == "untyped" else v for v in (a, b))
    elif "untyped" in (a.type, b.type):
        other = b if a.type == "untyped" else a
        kind = "double" if other.type in NUMERIC else other.type
        a, b = convert(a, kind), convert(b, kind)
    a, b = promote(a, b)
    x, y = a.col, b.col
    if a.type in _MOMENTS:
        x, y = dates.instant(x), dates.instant(y)
    if a.type == "double":
        number = ~F.isnan(x) & ~F.isnan(y)
        return (x != y) | ~number if op == "!=" else number & {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def ebv_value(v: Val) -> Column:
    """Effective boolean value of one item or none."""
    if v.type == "boolean":
        return F.coalesce(v.col, F.lit(False))
    if v.type == "empty":
        return F.lit(False)
    if v.type in _TEXT:
        return F.coalesce(v.col != "", F.lit(False))
    if v.type in NUMERIC:
        nan = F.isnan(v.col) if v.type in ("double", "float") else F.lit(False)
        return F.coalesce((v.col != 0) & ~nan, F.lit(False))
    raise XdmError("FORG0006", f"{v.type} has no effective boolean value")


def _s(v: Val) -> Column:
    return as_string(v)


def _q(v: Val) -> Column:
    if v.type != "QName":
        raise XdmError("XPTY0004", f"{v.type} is no QName")
    return v.col


def _d(v: Val) -> Column:
    return convert(v, "double").col


def _lit(v: Val, what: str) -> str:
    if v.lit is None:
        raise XdmError("XPST0003", f"{what} must be a literal here")
    return str(v.lit)


def _literal(*values: Val | None) -> bool:
    return all(v is None or v.lit is not None for v in values)


def _java(p: Val, f: Val | None, nonempty: bool = False) -> Column:
    return regex.dynamic(_s(p), _s(f) if f else F.lit(""), nonempty)


def _matches(a: Val, p: Val, f: Val | None = None) -> Val:
    if _literal(p, f):
        return Val(regex.matches(_s(a), str(p.lit), str(f.lit) if f else ""), "boolean")
    return Val(F.rlike(strings.text(_s(a)), _java(p, f)), "boolean")


def _replace(a: Val, p: Val, r: Val, f: Val | None = None) -> Val:
    if _literal(p, r, f):
        return Val(regex.replace(_s(a), str(p.lit), str(r.lit), str(f.lit) if f else ""), "string")
    to = regex.dynamic_replacement(_s(r), _s(p), _s(f) if f else F.lit(""))
    return Val(F.regexp_replace(strings.text(_s(a)), _java(p, f, True), to), "string")


def _tokenize(a: Val, p: Val, f: Val | None = None) -> Val:
    if _literal(p, f):
        return Val(regex.tokenize(_s(a), str(p.lit), str(f.lit) if f else ""), "array")
    made = F.split(strings.text(_s(a)), _java(p, f, True), -1)
    return Val(F.when(strings.text(_s(a)) == "", F.array().cast("array<string>")).otherwise(made), "array")


def _translate(a: Val, b: Val, c: Val) -> Val:
    if _literal(b, c):
        return Val(strings.translate(_s(a), str(b.lit), str(c.lit)), "string")
    return Val(F.call_function("translate", strings.text(_s(a)), strings.text(_s(b)), strings.text(_s(c))), "string")


def _formatted(of: str):
    def run(v: Val, p: Val, language: Val | None = None, calendar: Val | None = None, place: Val | None = None) -> Val:
        said = lambda x: None if x is None or x.type == "empty" else _lit(x, "a language or calendar")
        return Val(dates.format_in(convert(v, of).col, _lit(p, "a picture"), said(language), said(calendar)), "string")

    return run


def _now(kind: str) -> Val:
    at = dates.now()
    inside = F.pmod(at["micros"], F.lit(dates.DAY))
    micros = {"dateTime": at["micros"], "date": at["micros"] - inside, "time": inside}[kind]
    return Val(dates.moment(micros, 0), kind)


#: Instructions of a stylesheet that element-available knows.
_INSTRUCTIONS = frozenset(
    "analyze-string apply-imports apply-templates attribute call-template choose comment copy copy-of document element fallback for-each "
    "for-each-group if message namespace next-match number perform-sort processing-instruction result-document sequence text value-of variable".split()
)


def register_function(uri: str, local: str, arity: int, function, returns: str = "string") -> None:
    """Make a function of columns callable as prefix:local(...) where the prefix stands for the namespace; its arguments are strings."""
    SCALAR[f"{{{uri}}}{local}", arity] = lambda *a: Val(function(*[_s(x) for x in a]), returns)


def _text(made, kind: str = "string"):
    return lambda *a: Val(made(*[_s(x) for x in a]), kind)


def _collated(made):
    def run(a: Val, b: Val, c: Val | None = None) -> Val:
        return Val(made(_s(a), _s(b), _lit(c, "a collation") if c else None), "boolean" if made is not strings.compare else "integer")

    return run


def _before(made):
    return lambda a, b, c=None: Val(made(_s(a), _s(b), _lit(c, "a collation") if c else None), "string")


def _rounded(made):
    def run(v: Val, *more: Val) -> Val:
        kind = numeric_type(v.type)
        v = convert(v, kind)
        args = [int(_lit(m, "a precision")) for m in more]
        return Val(made(v.col, *args, kind=kind).cast(_SPARK[kind]), kind)

    return run


def _moment(made, kind: str, of: str):
    def run(v: Val) -> Val:
        v = v if v.type in (*_MOMENTS, "yearMonthDuration", "dayTimeDuration") else convert(v, of)
        out = made(v.col)
        return Val(out.cast("bigint") if kind == "integer" else out, kind)

    return run


def _duration(months, micros):
    def run(v: Val) -> Val:
        if months is None:
            made = F.lit(0) if v.type == "yearMonthDuration" else micros(v.col)
        else:
            made = months(v.col) if v.type == "yearMonthDuration" else F.lit(0)
        return Val(F.when(v.col.isNotNull(), made), "decimal" if micros is dates.seconds_from_duration else "integer")

    return run


def _constructor(kind: str):
    def run(v: Val) -> Val:
        made = convert(v, kind, castable=True)
        failed = F.raise_error(F.concat(F.lit(f"FORG0001: cannot cast to xs:{kind}: "), as_string(v)))
        return Val(F.when(v.col.isNull(), F.lit(None)).when(made.col.isNotNull(), made.col).otherwise(failed), made.type)

    return run


SCALAR: dict[tuple[str, int | None], object] = {
    ("string", 1): lambda v: Val(F.coalesce(_s(v), F.lit("")), "string"),
    ("concat", None): lambda *a: Val(strings.concat(*[_s(x) for x in a]), "string"),
    ("string-length", 1): _text(strings.string_length, "integer"),
    ("normalize-space", 1): _text(strings.normalize_space),
    ("upper-case", 1): _text(strings.upper_case), ("lower-case", 1): _text(strings.lower_case),
    ("substring", 2): lambda a, b: Val(strings.substring(_s(a), _d(b)), "string"),
    ("substring", 3): lambda a, b, c: Val(strings.substring(_s(a), _d(b), _d(c)), "string"),
    ("translate", 3): _translate,
    ("string-to-codepoints", 1): _text(strings.string_to_codepoints, "array"),
    ("codepoint-equal", 2): _text(strings.codepoint_equal, "boolean"),
    ("normalize-unicode", 1): _text(strings.normalize_unicode),
    ("normalize-unicode", 2): lambda a, b: Val(strings.normalize_unicode(_s(a), _lit(b, "a form")), "string"),
    ("encode-for-uri", 1): _text(strings.encode_for_uri), ("iri-to-uri", 1): _text(strings.iri_to_uri),
    ("escape-html-uri", 1): _text(strings.escape_html_uri), ("resolve-uri", 2): _text(strings.resolve_uri, "anyURI"),
    ("default-collation", 0): lambda: Val(F.lit(strings.CODEPOINT), "string"),
    ("matches", 2): _matches, ("matches", 3): _matches, ("replace", 3): _replace, ("replace", 4): _replace, ("tokenize", 2): _tokenize, ("tokenize", 3): _tokenize,
    ("current-dateTime", 0): lambda: _now("dateTime"), ("current-date", 0): lambda: _now("date"), ("current-time", 0): lambda: _now("time"),
    ("QName", 2): lambda u, n: qname(F.coalesce(_s(u), F.lit("")), _s(n)), ("local-name-from-QName", 1): lambda q: Val(_q(q)["local"], "string"),
    ("namespace-uri-from-QName", 1): lambda q: Val(_q(q)["uri"], "anyURI"), ("prefix-from-QName", 1): lambda q: Val(F.when(_q(q)["prefix"] != "", _q(q)["prefix"]), "string"),
    ("element-available", 1): lambda p: Val(F.lit(_lit(p, "a name").rpartition(":")[2] in _INSTRUCTIONS), "boolean"),
    ("number", 1): lambda v: Val(F.coalesce(_d(v), numeric.nan()), "double"),
    ("abs", 1): lambda v: Val(F.abs(convert(v, numeric_type(v.type)).col), numeric_type(v.type)),
    ("ceiling", 1): _rounded(numeric.ceiling), ("floor", 1): _rounded(numeric.floor), ("round", 1): _rounded(numeric.round_),
    ("round-half-to-even", 1): _rounded(numeric.round_half_to_even), ("round-half-to-even", 2): _rounded(numeric.round_half_to_even),
    ("true", 0): lambda: Val(F.lit(True), "boolean"), ("false", 0): lambda: Val(F.lit(False), "boolean"),
    ("data", 1): lambda v: v, ("trace", 2): lambda v, _: v,
    ("format-number", 2): lambda v, p: Val(numeric.format_number(_d(v), _lit(p, "a picture")), "string"),
    ("error", 0): lambda: Val(F.raise_error(F.lit("FOER0000")), "string"),
    ("error", None): lambda *a: Val(F.raise_error(F.concat_ws(": ", *[_s(x) for x in a[:2]])), "string"),
    ("dateTime", 2): lambda d, t: Val(dates.combine(convert(d, "date").col, convert(t, "time").col), "dateTime"),
    ("implicit-timezone", 0): lambda: Val(F.lit(0).cast("bigint"), "dayTimeDuration"),
    ("unparsed-text-available", 1): lambda _: Val(F.lit(False), "boolean"),
    ("unparsed-text", 1): lambda _: Val(F.raise_error(F.lit("FOUT1170: unparsed text is not read")), "string"),
    ("system-property", 1): lambda p: Val(F.lit({"xsl:version": "2.0", "xsl:vendor": "arborist", "xsl:product-name": "arborist"}.get(_lit(p, "a property"), "")), "string"),
    ("function-available", 1): lambda p: Val(F.lit(any(k == _lit(p, "a name") for k, _ in (*SCALAR, *OTHERS))), "boolean"),
    ("function-available", 2): lambda p, n: Val(F.lit(any((_lit(p, "a name"), k) in (*SCALAR, *OTHERS) for k in (int(_lit(n, "an arity")), None))), "boolean"),
}
for _n, _f in (("contains", strings.contains), ("starts-with", strings.starts_with), ("ends-with", strings.ends_with), ("compare", strings.compare)):
    SCALAR[_n, 2] = SCALAR[_n, 3] = _collated(_f)
for _n, _f in (("substring-before", strings.substring_before), ("substring-after", strings.substring_after)):
    SCALAR[_n, 2] = SCALAR[_n, 3] = _before(_f)
for _of in ("date", "dateTime"):
    for _n, _f in (("year", dates.year), ("month", dates.month), ("day", dates.day)):
        SCALAR[f"{_n}-from-{_of}", 1] = _moment(_f, "integer", _of)
for _of in ("time", "dateTime"):
    SCALAR[f"hours-from-{_of}", 1] = _moment(dates.hours, "integer", _of)
    SCALAR[f"minutes-from-{_of}", 1] = _moment(dates.minutes, "integer", _of)
    SCALAR[f"seconds-from-{_of}", 1] = _moment(dates.seconds, "decimal", _of)
for _of in _MOMENTS:
    SCALAR[f"timezone-from-{_of}", 1] = _moment(dates.timezone, "dayTimeDuration", _of)
    SCALAR[f"format-{_of}", 2] = SCALAR[f"format-{_of}", 5] = _formatted(_of)
    _adjust = {"date": dates.adjust_date, "time": dates.adjust_time, "dateTime": dates.adjust}[_of]
    SCALAR[f"adjust-{_of}-to-timezone", 1] = (lambda f, of: lambda v: Val(f(convert(v, of).col, 0), of))(_adjust, _of)
    SCALAR[f"adjust-{_of}-to-timezone", 2] = (
        lambda f, of: lambda v, z: Val(f(convert(v, of).col, None if z.type == "empty" else (z.col / (60 * dates.SECOND)).cast("int")), of)
    )(_adjust, _of)
SCALAR |= {
    ("years-from-duration", 1): _duration(dates.years_from_months, dates.years_from_months), ("months-from-duration", 1): _duration(dates.months_from_months, dates.months_from_months),
    ("days-from-duration", 1): _duration(None, dates.days_from_duration), ("hours-from-duration", 1): _duration(None, dates.hours_from_duration),
    ("minutes-from-duration", 1): _duration(None, dates.minutes_from_duration), ("seconds-from-duration", 1): _duration(None, dates.seconds_from_duration),
}
for _kind in casts.TYPES:
    SCALAR[f"xs:{_kind}", 1] = _constructor(_kind)

#: Functions that the engine compiles itself, as they take sequences, nodes or the context.
OTHERS = [
    (_n, _k)
    for _names, _arities in (
        ("position last current root collection static-base-uri", (0,)), ("not empty exists boolean count avg min max distinct-values reverse unordered data", (1,)),
        ("sum string-join subsequence id idref min max lang", (2,)), ("sum string-join root collection doc doc-available document codepoints-to-string resolve-uri id idref lang", (1,)),
        ("zero-or-one one-or-more exactly-one in-scope-prefixes", (1,)), ("deep-equal index-of remove key resolve-QName namespace-uri-for-prefix", (2,)),
        ("subsequence insert-before format-number deep-equal key", (3,)), ("string data number string-length normalize-space", (0,)),
        ("name local-name namespace-uri node-name base-uri document-uri generate-id line-number column-number nilled", (0, 1)),
    )
    for _n in _names.split()
    for _k in _arities
]
