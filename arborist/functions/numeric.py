"""Numeric functions and arithmetic with the rules of XPath, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

def nan() -> Column:
    return F.lit(float("nan"))


#: Lexical forms that a cast to double takes; Spark takes more (yes, 1d), so it is asked only after them.
DOUBLE = r"^[ \t\r\n]*(?:[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|-?INF|NaN)[ \t\r\n]*$"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n"))


def to_double(c: Column) -> Column:
    """A string as a double; null where it is none (INF, -INF and NaN are)."""
    t = trimmed(c)
    return (
        F.when(t == "INF", F.lit(float("inf")))
        .when(t == "-INF", F.lit(float("-inf")))
        .when(t == "NaN", nan())
        .when(F.rlike(c, F.lit(DOUBLE)), t.try_cast("double"))
    )


def number(c: Column) -> Column:
    """fn:number of a string: NaN where it is no number or empty."""
    return F.coalesce(to_double(c), nan())


def absolute(c: Column) -> Column:
    return F.abs(c)


def ceiling(c: Column, kind: str = "double") -> Column:
    return _same(c, F.ceil(c), kind)


def floor(c: Column, kind: str = "double") -> Column:
    return _same(c, F.floor(c), kind)


def _same(c: Column, whole: Column, kind: str) -> Column:
    if kind == "double":
        return F.when(F.isnan(c) | (F.abs(c) >= 1e18), c).otherwise(whole.cast("double"))
    return whole.cast("decimal(38,0)") if kind == "decimal" else c


def round_(c: Column, kind: str = "double") -> Column:
    """Ties go towards positive infinity; a value in [-0.5, 0) gives negative zero."""
    if kind == "integer":
        return c
    if kind == "decimal":
        return F.floor(c + F.lit(0.5).cast("decimal(2,1)")).cast("decimal(38,0)")
    whole = F.floor(c + 0.5).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) >= 4503599627370496.0), c).when((c < 0) & (c >= -0.5), F.lit(-0.0)).otherwise(whole)


def round_half_to_even(c: Column, precision: int = 0, kind: str = "double") -> Column:
    if kind == "integer" and precision >= 0:
        return c
    if kind == "double":
        exact = F.bround(c.cast("decimal(38,12)"), precision).cast("double") if precision <= 12 else c
        return F.when(F.isnan(c) | (F.abs(c) >= 1e18), c).otherwise(exact)
    return F.bround(c, precision)


def divide(a: Column, b: Column, kind: str = "double") -> Column:
    """div: doubles by zero give infinities or NaN; exact numbers raise FOAR0001 and keep 18 fraction digits."""
    if kind == "double":
        zero = F.when((a == 0) | F.isnan(a), nan()).when((a > 0) == _positive(b), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))
    x, y = a.cast("decimal(20,6)"), b.cast("decimal(20,6)")
    return F.when(y == 0, F.raise_error(F.lit("FOAR0001: division by zero")).cast("decimal(38,18)")).otherwise((x / F.when(y == 0, None).otherwise(y)).cast("decimal(38,18)"))


def _positive(b: Column) -> Column:
    """Whether a zero is positive: 1 / -0 is negative; Spark prints -0 with its sign."""
    return ~F.startswith(b.cast("string"), F.lit("-"))


def integer_divide(a: Column, b: Column) -> Column:
    """idiv: truncates; FOAR0001 by zero."""
    safe = F.when(b == 0, F.lit(None)).otherwise(b)
    return F.when(b == 0, F.raise_error(F.lit("FOAR0001: division by zero")).cast("bigint")).otherwise(((a - a % safe) / safe).cast("bigint"))


def modulo(a: Column, b: Column, kind: str = "double") -> Column:
    """mod keeps the dividend's sign; a double by zero gives NaN, exact numbers raise FOAR0001."""
    safe = F.when(b == 0, F.lit(None)).otherwise(b)
    if kind == "double":
        return F.when(b == 0, nan()).otherwise(a % safe)
    return F.when(b == 0, F.raise_error(F.lit("FOAR0001: division by zero")).cast("bigint")).otherwise(a % safe)


def equal(a: Column, b: Column) -> Column:
    """eq of doubles: NaN equals nothing."""
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def less(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def double_text(c: Column) -> Column:
    """The canonical text of a double: integers without a point below a million, else E notation."""

    @pandas_udf(StringType())
    def run(s):
        return s.map(canonical_double)

    plain = (F.abs(c) < 1e6) & (c == F.floor(c))
    return F.when(c.isNull(), F.lit(None)).when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").when(
        plain & (c != 0), c.cast("bigint").cast("string")
    ).otherwise(run(c))


def canonical_double(v: float | None) -> str | None:
    """Text of a double as XPath casts it to a string."""
    import math
    from decimal import Decimal

    if v is None:
        return None
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "INF" if v > 0 else "-INF"
    if v == 0:
        return "-0" if math.copysign(1, v) < 0 else "0"
    if 1e-6 <= abs(v) < 1e6:
        text = format(Decimal(repr(v)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    mantissa, _, exponent = f"{Decimal(repr(v)).normalize():E}".partition("E")
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}E{int(exponent)}"


class DecimalFormat:
    """The symbols of xsl:decimal-format."""

    def __init__(self, point: str = ".", group: str = ",", minus: str = "-", percent: str = "%", mille: str = "‰", zero: str = "0",
                 digit: str = "#", separator: str = ";", infinity: str = "Infinity", nan: str = "NaN") -> None:
        self.point, self.group, self.minus, self.percent, self.mille = point, group, minus, percent, mille
        self.zero, self.digit, self.separator, self.infinity, self.nan = zero, digit, separator, infinity, nan


def picture(value, text: str, fmt: DecimalFormat | None = None) -> str:
    """A number by a picture of format-number."""
    import math
    from decimal import ROUND_HALF_EVEN, Decimal

    from arborist.xdm import XdmError

    f = fmt or DecimalFormat()
    parts = text.split(f.separator)
    if len(parts) > 2:
        raise XdmError("XTDE1310", f"bad picture {text!r}")
    active = f.digit + f.zero + f.point + f.group

    def parsed(p: str):
        places = [k for k, ch in enumerate(p) if ch in active]
        if not places:
            raise XdmError("XTDE1310", f"picture {text!r} has no digit")
        a, b = places[0], places[-1] + 1
        prefix, body, suffix = p[:a], p[a:b], p[b:]
        if any(ch not in active for ch in body) or body.count(f.point) > 1:
            raise XdmError("XTDE1310", f"bad picture {text!r}")
        whole, _, fraction = body.partition(f.point)
        if f.digit in whole.lstrip(f.digit + f.group) or f.zero in fraction.lstrip(f.zero + f.group) and f.digit in fraction[: fraction.rfind(f.zero)]:
            raise XdmError("XTDE1310", f"bad picture {text!r}")
        groups = [len(x) for x in whole.split(f.group)[1:]]
        return prefix, whole.replace(f.group, ""), fraction.replace(f.group, ""), suffix, groups, f.point in body

    prefix, whole, fraction, suffix, groups, _ = parsed(parts[0])
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return f.nan
    number = Decimal(repr(value)) if isinstance(value, float) and not math.isinf(value) else value
    negative = (value < 0) or (isinstance(value, float) and value == 0 and math.copysign(1, value) < 0)
    if negative:
        if len(parts) == 2:
            prefix, _, _, suffix, _, _ = parsed(parts[1])
        else:
            prefix = f.minus + prefix
    if isinstance(value, float) and math.isinf(value):
        return prefix + f.infinity + suffix
    number = abs(Decimal(number))
    if f.percent in prefix + suffix:
        number *= 100
    if f.mille in prefix + suffix:
        number *= 1000
    least, most = fraction.count(f.zero), len(fraction)
    shown = number.quantize(Decimal(1).scaleb(-most), ROUND_HALF_EVEN) if most else number.quantize(Decimal(1), ROUND_HALF_EVEN)
    digits, _, tail = format(shown, "f").partition(".")
    tail = tail[:least] + tail[least:].rstrip("0")
    digits = digits.lstrip("0").rjust(max(whole.count(f.zero), 0), "0")
    if not digits and not tail:
        digits = "0" if not fraction else digits or "0"
    if groups:
        sizes, out = groups[::-1], []
        regular = len(set(sizes)) == 1 or len(sizes) == 1
        while digits:
            n = sizes.pop(0) if sizes else (groups[-1] if regular else len(digits))
            out.append(digits[-n:])
            digits = digits[:-n]
        digits = f.group.join(reversed(out))
    made = digits + (f.point + tail if tail else "")
    if f.zero != "0":
        made = made.translate({48 + k: chr(ord(f.zero) + k) for k in range(10)})
    return prefix + made + suffix


def format_number(c: Column, text: str, fmt: DecimalFormat | None = None) -> Column:
    @pandas_udf(StringType())
    def run(s):
        return s.map(lambda v: picture(None if v is None else v, text, fmt))

    return run(c)
