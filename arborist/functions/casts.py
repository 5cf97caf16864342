"""Casts from strings: for every type a lexical check and the value; null where the text is not in the type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborist.functions import dates, numeric

#: Bounds of the integer types.
INTEGERS: dict[str, tuple[int | None, int | None]] = {
    "integer": (None, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None),
    **{name: (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) for name, bits in (("long", 64), ("int", 32), ("short", 16), ("byte", 8))},
    **{f"unsigned{name}": (0, 2**bits - 1) for name, bits in (("Long", 64), ("Int", 32), ("Short", 16), ("Byte", 8))},
}

_I, _C = r"[\p{L}_:]", r"[\p{L}\p{Nd}\p{M}\-._:·]"
_NI, _NC = r"[\p{L}_]", r"[\p{L}\p{Nd}\p{M}\-._·]"
#: String types: how white space is treated, and the pattern of the collapsed value.
STRINGS = {
    "string": ("preserve", None), "normalizedString": ("replace", None), "token": ("collapse", None),
    "language": ("collapse", r"^[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*$"), "Name": ("collapse", rf"^{_I}{_C}*$"), "NCName": ("collapse", rf"^{_NI}{_NC}*$"),
    "ID": ("collapse", rf"^{_NI}{_NC}*$"), "IDREF": ("collapse", rf"^{_NI}{_NC}*$"), "ENTITY": ("collapse", rf"^{_NI}{_NC}*$"),
    "NMTOKEN": ("collapse", rf"^{_C}+$"),
}

_DAYS = {"01": 31, "02": 29, "03": 31, "04": 30, "05": 31, "06": 30, "07": 31, "08": 31, "09": 31, "10": 31, "11": 30, "12": 31}
_TZ = r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
#: Partial dates and binary types: patterns of the collapsed text.
PATTERNS = {
    "gYear": rf"^-?([1-9][0-9]{{3,}}|0[0-9]{{3}}){_TZ}$", "gYearMonth": rf"^-?([1-9][0-9]{{3,}}|0[0-9]{{3}})-(0[1-9]|1[0-2]){_TZ}$",
    "gMonth": rf"^--(0[1-9]|1[0-2]){_TZ}$", "gDay": rf"^---(0[1-9]|[12][0-9]|3[01]){_TZ}$",
    "gMonthDay": "^--(" + "|".join(f"{m}-(0[1-9]|[12][0-9]" + ("|30)" if n == 30 else "|3[01])" if n == 31 else ")") for m, n in _DAYS.items()) + f"){_TZ}$",
    "hexBinary": r"^([0-9a-fA-F]{2})*$",
    "base64Binary": r"^(([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|([A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?$",
    "anyURI": r"^[^\\<>{}|^`\"]*$", "QName": rf"^({_NI}{_NC}*:)?{_NI}{_NC}*$", "duration": dates.DURATION,
}

TYPES = ["boolean", "decimal", "double", "float", "date", "dateTime", "time", "dateTimeStamp", "yearMonthDuration", "dayTimeDuration", "untypedAtomic", *STRINGS, *INTEGERS, *PATTERNS]


def whitespace(c: Column, how: str) -> Column:
    """The whiteSpace facet: preserve, replace or collapse."""
    if how == "preserve":
        return c
    spaced = F.translate(c, "\t\n\r", "   ")
    return spaced if how == "replace" else F.trim(F.regexp_replace(spaced, " +", " "))


def cast(c: Column, kind: str) -> Column:
    """The value of a string in a type; null where it is none."""
    t = whitespace(c, "collapse")
    if kind in STRINGS:
        how, pattern = STRINGS[kind]
        v = whitespace(c, how)
        return v if pattern is None else F.when(F.rlike(v, F.lit(pattern)), v)
    if kind in ("untyped", "untypedAtomic"):
        return c
    if kind == "boolean":
        return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)
    if kind in INTEGERS:
        low, high = INTEGERS[kind]
        wide = F.when(F.rlike(t, F.lit(r"^[+-]?[0-9]{1,38}$")), t.try_cast("decimal(38,0)"))
        if kind in ("unsignedLong", "integer") or (low is not None and high is None) or low is None:
            value = wide.cast("decimal(38,0)")
        else:
            value = wide
        ok = F.lit(True)
        if low is not None:
            ok = ok & (value >= F.lit(low).cast("decimal(38,0)"))
        if high is not None:
            ok = ok & (value <= F.lit(high).cast("decimal(38,0)"))
        fits = (value >= F.lit(-(2**63)).cast("decimal(38,0)")) & (value <= F.lit(2**63 - 1).cast("decimal(38,0)"))
        return F.when(ok & value.isNotNull(), F.when(fits, value).otherwise(F.raise_error(F.lit("FOCA0003: integer beyond 64 bits")).cast("decimal(38,0)")).cast("bigint"))
    if kind == "decimal":
        return F.when(F.rlike(t, F.lit(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")), t.try_cast("decimal(38,18)"))
    if kind in ("double", "float"):
        v = numeric.to_double(c)
        return v.cast("float") if kind == "float" else v
    if kind == "date":
        return _real(dates.parse_date(c))
    if kind == "dateTime":
        return _real(dates.parse_datetime(c))
    if kind == "dateTimeStamp":
        v = _real(dates.parse_datetime(c))
        return F.when(v["tz"].isNotNull(), v)
    if kind == "time":
        return dates.parse_time(c)
    if kind == "yearMonthDuration":
        return dates.parse_year_month(c)
    if kind == "dayTimeDuration":
        return dates.parse_day_time(c)
    v = F.when(F.rlike(t, F.lit(PATTERNS[kind])), t)
    return F.upper(v) if kind == "hexBinary" else v


def _real(m: Column) -> Column:
    """A moment whose day exists."""
    return F.when(m["micros"].isNotNull(), m)


def castable(c: Column, kind: str) -> Column:
    return cast(c, kind).isNotNull()
